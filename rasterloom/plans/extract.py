"""Text and layout of images from saved OCR results.

Blocks are ordered, cut and formatted inside the payload row, so the job reads payloads, looks up
image dimensions, and needs no shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as lay
from ..functions.errors import capped_warnings
from ..operators.layout import fall_back
from ..settings import FALLBACK_CODES, MAX_BLOCKS, MSG_BLOCKS_TRUNCATED, MSG_CONTENT_TRUNCATED

#: Parts of a run that are stored one after the other.
SLICES = 16
Step = Callable[[DataFrame], DataFrame]


def extract_layout(
    results: DataFrame,
    images: DataFrame,
    output_format: str = "markdown",
    include_coordinates: bool = True,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """``results(image_id, blocks, markdown, warnings, provider, fallback_used, error_code)`` of the
    payload parsers or the fallback rule, as one response row per image."""
    refused = F.col("error_code") if "error_code" in images.columns else F.lit(None).cast("string")
    dims = images.select("image_id", "width", "height", refused.alias("_image_code"))
    width, height = F.col("width"), F.col("height")
    many = F.size("blocks") > max_blocks
    shaped = lay.text_blocks(
        lay.ordered_blocks(F.col("blocks"), max_blocks), width, height, include_coordinates
    )
    lines = F.transform("_shaped", lambda b: lay.content_line(output_format, b))
    content = lay.joined_content(output_format, lines, F.col("markdown"))
    cut = lay.content_is_cut(F.col("_content"))
    notes = F.filter(
        F.array(
            F.when(F.col("_many"), MSG_BLOCKS_TRUNCATED % max_blocks),
            F.when(cut, MSG_CONTENT_TRUNCATED),
        ),
        lambda w: w.isNotNull(),
    )
    # A confidence outside 0..1 does not fit the response and fails the whole answer.
    invalid = F.exists("_shaped", lambda b: (b["confidence"] < 0) | (b["confidence"] > 1))
    refused = F.col("_image_code")
    code = F.when(refused.isNotNull(), refused).when(width.isNull(), "not_found").when(
        F.col("error_code").isNull() & F.coalesce(invalid, F.lit(False)), "internal"
    )
    answered = F.coalesce(code, F.col("error_code")).isNull()
    return (
        results.join(dims, "image_id", "left")
        .withColumn("_many", many)
        .withColumn("_shaped", shaped)
        .withColumn("_content", content)
        .select(
            "image_id",
            F.when(answered, lay.cut_content(F.col("_content"))).alias("content"),
            F.when(answered, F.col("_shaped")).alias("blocks"),
            "width",
            "height",
            "provider",
            "fallback_used",
            F.when(answered, F.col("_many") | cut).alias("truncated"),
            F.when(answered, capped_warnings(F.concat("warnings", notes))).alias("warnings"),
            F.coalesce(code, F.col("error_code")).alias("error_code"),
        )
    )


def _finished(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def staged(inputs: DataFrame, step: Step, path: str, slices: int = SLICES) -> DataFrame:
    """``step`` over ``inputs``, stored slice by slice of their ``image_id``: a run that broke off goes on with the next slice."""
    spark = inputs.sparkSession
    for k in range(slices):
        target = f"{path}/slice={k}"
        if not _finished(spark, target):
            part = inputs.where(F.pmod(F.xxhash64("image_id"), F.lit(slices)) == k)
            step(part).write.mode("overwrite").parquet(target)
    return spark.read.parquet(path).drop("slice")


def fallback_run(
    files: DataFrame,
    primary: Step,
    secondary: Step,
    parse_primary: Step,
    parse_secondary: Step,
    path: str,
    slices: int = SLICES,
) -> DataFrame:
    """Text of ``files`` in two phases: the second engine sees only what the first failed on in a way that may be retried.

    ``primary`` and ``secondary`` turn files into payload rows, as ``recognize_with`` does. Both phases are stored below ``path``, and
    a repeated run calls no engine again for a slice that is stored. The answer is that of ``fall_back``.
    """
    managed = parse_primary(staged(files, primary, f"{path}/primary", slices))
    failed = managed.where(F.col("error_code").isin(*FALLBACK_CODES)).select("image_id")
    again = files.withColumn("image_id", F.col("image_id").cast("string")).join(failed, "image_id", "left_semi")
    return fall_back(managed, parse_secondary(staged(again, secondary, f"{path}/secondary", slices)))
