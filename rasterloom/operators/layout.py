"""Text layout on a flat ``blocks`` table, and the provider fallback rule.

One image may own any number of block rows: counts are partial sums, and the rank filter lets Spark
drop rows beyond the limit before the shuffle, so no task ever holds more than the limit per image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as lay
from ..settings import FALLBACK_CODES, LOCAL_PROVIDER, MANAGED_PROVIDER, MAX_BLOCKS, MSG_FELL_BACK
from ..sources.payloads import provenance


def reading_order(blocks: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The first blocks of every image by page, top, left, and position in the source."""
    window = Window.partitionBy("image_id").orderBy(
        "page", lay.order_top(F.col("polygon")), lay.order_left(F.col("polygon")), "ord"
    )
    return (
        blocks.withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") <= max_blocks)
        .withColumn("position", F.col("_rank") - 1)
        .drop("_rank")
    )


def block_counts(blocks: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    return blocks.groupBy("image_id").agg(
        F.count("*").alias("block_count"), (F.count("*") > max_blocks).alias("truncated")
    )


def shaped_blocks(
    ordered: DataFrame, width: Column, height: Column, coordinates: bool = True
) -> DataFrame:
    """Ordered blocks as response blocks: id, type, cut text, box, polygon, confidence."""
    polygon = F.col("polygon") if coordinates else F.array().cast("array<double>")
    return ordered.select(
        "image_id",
        "position",
        lay.block_id(F.col("position")).alias("id"),
        lay.block_type(F.col("block_type")).alias("type"),
        lay.block_text(F.col("text")).alias("text"),
        "page",
        lay.normalized_box(polygon, width, height).alias("box"),
        lay.normalized_polygon(polygon, width, height).alias("polygon"),
        "confidence",
    )


def assemble_content(
    shaped: DataFrame, output_format: str, markdown: DataFrame | None = None
) -> DataFrame:
    """Formatted content per image; at most 500 shaped blocks meet in one group."""
    block = F.struct(*[F.col(c) for c in ("id", "text", "confidence", "box")])
    line = lay.content_line(output_format, block)
    grouped = shaped.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("_lines")
    )
    given = None
    if markdown is not None:
        grouped = grouped.join(markdown.select("image_id", "markdown"), "image_id", "left")
        given = F.col("markdown")
    content = lay.joined_content(
        output_format, F.transform("_lines", lambda entry: entry["line"]), given
    )
    return grouped.select("image_id", content.alias("_content")).select(
        "image_id",
        lay.cut_content(F.col("_content")).alias("content"),
        lay.content_is_cut(F.col("_content")).alias("content_truncated"),
    )


def fall_back(managed: DataFrame, local: DataFrame, mode: str = "auto") -> DataFrame:
    """The result a request ends with when the managed provider is preferred.

    ``auto`` takes the local result after a retryable managed failure and adds a warning; any other
    failure stands. ``azure`` and ``local`` never switch.
    """
    fields = ["state", "error_code", "blocks", "markdown", "warnings"]
    if mode != "auto":
        chosen = managed if mode == "azure" else local
        name = MANAGED_PROVIDER if mode == "azure" else LOCAL_PROVIDER
        return chosen.select(
            "image_id",
            *fields,
            provenance(F.lit(name)).alias("provider"),
            F.lit(False).alias("fallback_used"),
        )
    second = local.select(
        "image_id",
        F.lit(True).alias("_answered"),
        *[F.col(c).alias(f"_{c}") for c in fields],
    )
    switch = F.coalesce(F.col("error_code").isin(*FALLBACK_CODES), F.lit(False))
    reason = F.concat(F.lit(MSG_FELL_BACK), F.col("error_code"))

    def pick(name: str) -> Column:
        return F.when(F.col("_switch"), F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    unanswered = F.col("_switch") & F.col("_answered").isNull()
    return (
        managed.join(second, "image_id", "left")
        .withColumn("_switch", switch)
        .select(
            "image_id",
            pick("state"),
            F.when(unanswered, "provider_unavailable")
            .otherwise(pick("error_code"))
            .alias("error_code"),
            pick("blocks"),
            pick("markdown"),
            F.when(F.col("_switch"), F.concat(F.array(reason), F.col("_warnings")))
            .otherwise(F.col("warnings"))
            .alias("warnings"),
            provenance(
                F.when(F.col("_switch"), LOCAL_PROVIDER).otherwise(F.lit(MANAGED_PROVIDER))
            ).alias("provider"),
            F.col("_switch").alias("fallback_used"),
        )
    )
