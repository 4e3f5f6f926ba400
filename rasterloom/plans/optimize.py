"""Crop requests from check to raster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.regions import box_gate, crop_segments, field, fit_sizes
from ..operators.resample import STRIP, resample
from ..operators.spread import ROWS_PER_SLOT

RESPONSE = (
    "request_id",
    "image_id",
    "image_width",
    "image_height",
    "crop_width",
    "crop_height",
    "output_width",
    "output_height",
    "byte_count",
    "original_byte_count",
    "output_format",
    "box_x",
    "box_y",
    "box_width",
    "box_height",
    "warnings",
    "error",
)


def optimize_regions(crops: DataFrame, images: DataFrame) -> DataFrame:
    """One response row per request; refused requests carry an ``error`` and no sizes.

    ``byte_count`` is the raw raster size, since no encoder is part of this package.
    """
    gated = box_gate(crops, images)
    accepted = (
        fit_sizes(gated)
        .withColumnsRenamed({"width": "crop_width", "height": "crop_height"})
        .withColumn(
            "byte_count", F.col("output_width").cast("long") * F.col("output_height") * 3
        )
        .withColumn("error", F.lit(None).cast(gated.schema["error"].dataType))
        .select(*RESPONSE)
    )
    refused = gated.where("error IS NOT NULL").withColumnsRenamed(
        {"width": "crop_width", "height": "crop_height"}
    )
    return accepted.unionByName(
        refused.select(*[c for c in RESPONSE if c in refused.columns]), allowMissingColumns=True
    )


def region_rasters(
    crops: DataFrame, images: DataFrame, tiles: DataFrame, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Rasters of all accepted requests as strips of 16 columns, downscaled where asked for."""
    fitted = fit_sizes(box_gate(crops, images))
    shrunk = resample(fitted, tiles, rows_per_slot)
    plain = fitted.where("scale >= 1.0")
    channels = ("r", "g", "b")
    end = F.col("crop_x") + F.size("r")
    strips = F.sequence(
        F.floor(F.col("crop_x") / STRIP).cast("int"), F.floor((end - 1) / STRIP).cast("int")
    )
    first = F.greatest(F.col("crop_x"), F.col("strip") * STRIP)
    length = F.least(end, (F.col("strip") + 1) * STRIP) - first
    pieces = (
        crop_segments(plain, tiles, rows_per_slot)
        .withColumn("strip", F.explode(strips))
        .withColumn("_first", first)
        .select(
            "request_id",
            "strip",
            "crop_y",
            "_first",
            (F.col("_first") + length).alias("_end"),
            *[F.slice(c, F.col("_first") - F.col("crop_x") + 1, length).alias(c) for c in channels],
        )
        .groupBy("request_id", "strip")
        .agg(
            F.array_sort(F.collect_list(F.struct("crop_y", "_first", *channels))).alias("_pieces"),
            (F.max("_end") - F.min("_first")).alias("tw"),
            (F.max("crop_y") + 1).alias("th"),
        )
    )
    whole = pieces.select(
        "request_id",
        "strip",
        "tw",
        "th",
        *[F.flatten(F.transform("_pieces", field(c))).alias(c) for c in channels],
    )
    return shrunk.unionByName(whole)
