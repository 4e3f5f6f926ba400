"""Crop requests: box checks, output sizes, and the pixels of a box by tile keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions.errors import error_struct, first_errors
from ..functions.gates import box_error, crop_param_errors
from ..settings import MSG_DOWNSCALED, TILE
from .spread import ROWS_PER_SLOT, hot_keys, spread_join

CHANNELS = ("r", "g", "b")
CROP_DEFAULTS = {"max_width": 1024, "max_height": 1024, "quality": 80, "output_format": "webp"}


def field(name: str) -> Callable[[Column], Column]:
    return lambda record: record[name]


def box_gate(crops: DataFrame, images: DataFrame) -> DataFrame:
    """Requests with image dimensions and an ``error`` struct; boxes are never clamped.

    Parameters out of range come first, then the code of an image that was refused (``images.error_code``), then
    the box. ``images.byte_count`` and ``images.error_code`` may be absent.
    """

    def known(column: str, kind: str) -> Column:
        return F.col(column) if column in images.columns else F.lit(None).cast(kind)

    dims = images.select(
        "image_id",
        F.col("width").alias("image_width"),
        F.col("height").alias("image_height"),
        known("byte_count", "long").alias("original_byte_count"),
        known("error_code", "string").alias("_image_code"),
    )
    limits = [c for c in ("max_width", "max_height", "quality") if c in crops.columns]
    broken = crop_param_errors(
        *[F.col(c) for c in ("x", "y", "width", "height")],
        *[F.col(c) if c in limits else F.lit(None).cast("int") for c in ("max_width", "max_height", "quality")],
    )
    message = box_error(
        *[F.col(c) for c in ("x", "y", "width", "height", "image_width", "image_height")]
    )
    absent = F.col("image_width").isNull()
    details = F.when(
        F.col("x").cast("long") < F.col("image_width"),
        F.create_map(
            F.lit("imageWidth"),
            F.col("image_width").cast("string"),
            F.lit("imageHeight"),
            F.col("image_height").cast("string"),
        ),
    )
    refused = F.col("_image_code")
    code = (
        F.when(F.size("_broken") > 0, "invalid_input")
        .when(refused.isNotNull(), refused)
        .when(absent, "not_found")
        .when(message.isNotNull(), "invalid_input")
    )
    beyond = (F.col("x") < F.col("image_width")) & (F.col("y") < F.col("image_height"))
    gated = crops.withColumn("_broken", broken).join(dims, "image_id", "left")
    return gated.withColumn(
        "error",
        error_struct(
            code,
            F.when(F.size("_broken") > 0, first_errors(F.col("_broken")))
            .when(refused.isNotNull(), "Image was refused")
            .when(absent, "Image was not found")
            .otherwise(message),
            F.when(beyond & (F.size("_broken") == 0), details),
        ),
    ).drop("_broken", "_image_code")


def fit_sizes(gated: DataFrame) -> DataFrame:
    """Output size, box fractions and warnings of the requests that passed the gate."""
    scale = px.fit_scale(*[F.col(c) for c in ("width", "height", "max_width", "max_height")])
    down = F.col("scale") < 1.0
    return (
        gated.where("error IS NULL")
        .withColumn("scale", scale)
        .withColumn("output_width", px.fitted(F.col("width"), F.col("scale")))
        .withColumn("output_height", px.fitted(F.col("height"), F.col("scale")))
        .withColumn("box_x", px.box_fraction(F.col("x"), F.col("image_width")))
        .withColumn("box_y", px.box_fraction(F.col("y"), F.col("image_height")))
        .withColumn("box_width", px.box_fraction(F.col("width"), F.col("image_width")))
        .withColumn("box_height", px.box_fraction(F.col("height"), F.col("image_height")))
        .withColumn("downscaled", down)
        .withColumn(
            "warnings",
            F.when(down, F.array(F.lit(MSG_DOWNSCALED))).otherwise(
                F.array().cast("array<string>")
            ),
        )
        .drop("error")
    )


def _tile_span(start: Column, length: Column) -> Column:
    return F.sequence(
        F.floor(start / TILE).cast("int"), F.floor((start + length - 1) / TILE).cast("int")
    )


def crop_segments(
    crops: DataFrame, tiles: DataFrame, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Pieces of image lines inside each box: ``(request_id, y, x, r, g, b)`` in crop coordinates.

    The box is turned into its tile keys, so the range join is an equi-join; every piece is cut out
    of its tile with ``slice`` and no pixel leaves the tile row before that.
    """
    keyed = crops.select(
        "request_id", "image_id", "x", "y", "width", "height"
    ).select(
        "*", F.explode(_tile_span(F.col("y"), F.col("height"))).alias("ty")
    ).select("*", F.explode(_tile_span(F.col("x"), F.col("width"))).alias("tx"))
    place = ["image_id", "ty", "tx"]
    hot = hot_keys(keyed, place, rows_per_slot)
    hit = spread_join(keyed, tiles, place, F.col("request_id"), hot)
    top, left = F.col("ty") * TILE, F.col("tx") * TILE
    first_y = F.greatest(F.col("y") - top, F.lit(0))
    last_y = F.least(F.col("y") + F.col("height") - top, F.col("th")) - 1
    first_x = F.greatest(F.col("x") - left, F.lit(0))
    end_x = F.least(F.col("x") + F.col("width") - left, F.col("tw"))
    lined = (
        hit.withColumn("_fx", first_x)
        .withColumn("_n", end_x - first_x)
        .withColumn("_row", F.explode(F.sequence(first_y, last_y)))
    )
    start = F.col("_row") * F.col("tw") + F.col("_fx") + 1
    return lined.select(
        "request_id",
        (top + F.col("_row") - F.col("y")).alias("crop_y"),
        (left + F.col("_fx") - F.col("x")).alias("crop_x"),
        *[F.slice(c, start, F.col("_n")).alias(c) for c in CHANNELS],
    )


def crop_pixels(
    crops: DataFrame, tiles: DataFrame, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """One row per pixel of every valid crop, shifted to the origin."""
    pieces = crop_segments(crops, tiles, rows_per_slot)
    zipped = F.posexplode(F.arrays_zip(*CHANNELS)).alias("_i", "_p")
    return pieces.select("request_id", "crop_x", "crop_y", zipped).select(
        "request_id",
        (F.col("crop_x") + F.col("_i")).alias("x"),
        F.col("crop_y").alias("y"),
        *[F.col(f"_p.{c}").cast("int").alias(c) for c in CHANNELS],
    )


def crops_from_changes(
    compared: DataFrame,
    pairs: DataFrame,
    max_width: int = CROP_DEFAULTS["max_width"],
    max_height: int = CROP_DEFAULTS["max_height"],
    quality: int = CROP_DEFAULTS["quality"],
    output_format: str = CROP_DEFAULTS["output_format"],
) -> DataFrame:
    """Compare first, then look at the changed regions: one crop of the after-image per region.

    A region that lies in the before-image alone has no pixels in the after-image; such a box fails
    the box gate like any other.
    """
    region = F.posexplode("regions").alias("region_index", "_r")
    return (
        compared.select("pair_id", region)
        .join(pairs.select("pair_id", F.col("after_id").alias("image_id")), "pair_id")
        .select(
            F.concat_ws(":", "pair_id", "region_index").alias("request_id"),
            "pair_id",
            "image_id",
            F.col("_r.x").alias("x"),
            F.col("_r.y").alias("y"),
            F.col("_r.width").alias("width"),
            F.col("_r.height").alias("height"),
            F.lit(max_width).alias("max_width"),
            F.lit(max_height).alias("max_height"),
            F.lit(quality).alias("quality"),
            F.lit(output_format).alias("output_format"),
        )
    )


def byte_savings(fitted: DataFrame) -> DataFrame:
    """Raw raster bytes of the outputs against the bytes of the originals, per output format."""
    out = F.col("output_width").cast("long") * F.col("output_height") * 3
    original = F.sum("original_byte_count")
    return fitted.groupBy("output_format").agg(
        F.count("*").alias("requests"),
        original.alias("original_bytes"),
        F.sum(out).alias("output_bytes"),
        F.when(original > 0, F.lit(1.0) - F.sum(out) / original.cast("double")).alias("_saved"),
    ).select(
        "output_format",
        "requests",
        "original_bytes",
        "output_bytes",
        px.round_exact(F.col("_saved"), 6).alias("saved_ratio"),
    )
