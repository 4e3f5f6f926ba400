"""Image comparison: tile alignment, pixel deltas, totals, regions and the diff raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels as px
from ..functions.errors import capped_warnings, present
from ..functions.gates import compare_param_errors
from ..session import cut_lineage, written
from ..settings import (
    MAX_COMPONENTS,
    MAX_REGIONS,
    MSG_NO_DIFF,
    MSG_REGIONS_TRUNCATED,
    MSG_SIZE_DIFFERS,
    TILE,
)
from .components import label_components
from .digests import CHANNELS, POSITION, differing_tiles, tile_digests
from .key_filter import only_keys
from .pixelwise import grey_tiles, measure_tiles, paint_tiles
from .spread import ROWS_PER_SLOT, hot_keys, spread_join

TOTALS = (
    "pair_id",
    "before_width",
    "before_height",
    "after_width",
    "after_height",
    "dimensions_changed",
    "comparison_width",
    "comparison_height",
    "changed_pixels",
    "changed_ratio",
    "similarity",
)


def pair_dims(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs with the dimensions of both images; missing images leave nulls."""

    def sized(side: str) -> DataFrame:
        return images.select(
            F.col("image_id").alias(f"{side}_id"),
            F.col("width").alias(f"{side}_width"),
            F.col("height").alias(f"{side}_height"),
        )

    names = ("before_width", "before_height", "after_width", "after_height")
    dims = [F.col(name) for name in names]
    bw, bh, aw, ah = dims
    return (
        pairs.join(sized("before"), "before_id", "left")
        .join(sized("after"), "after_id", "left")
        .withColumn("dimensions_changed", (bw != aw) | (bh != ah))
        .withColumn("union_area", px.union_area(*dims))
        .withColumn("comparison_width", F.when(F.col("union_area").isNotNull(), F.least(bw, aw)))
        .withColumn("comparison_height", F.when(F.col("union_area").isNotNull(), F.least(bh, ah)))
        .withColumn("outside", px.union_area(*dims) - px.overlap_area(*dims))
    )


def gated_pairs(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs with ``error_code``: broken parameters first, then the code of the first image that was refused."""
    broken = F.size(compare_param_errors(F.col("threshold"), F.col("max_regions"))) > 0
    code = F.when(broken, "invalid_input")
    if "error_code" in images.columns:
        for side in ("before", "after"):
            refused = images.where("error_code IS NOT NULL").select(
                F.col("image_id").alias(f"{side}_id"), F.col("error_code").alias(f"_{side}_code")
            )
            pairs = pairs.join(refused, f"{side}_id", "left")
        code = code.otherwise(F.coalesce("_before_code", "_after_code"))
    return pairs.withColumn("error_code", code).drop("_before_code", "_after_code")


def align_tiles(
    tiles: DataFrame, pairs: DataFrame, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """The tiles of every pair that differ, both sides on one canvas, found by digests.

    Only tiles that lie in both images and differ bring their pixels; others are tested against a filter of those where they
    are read, before any exchange. A tile in one image alone has null channels on both sides.
    """
    digests = written(tile_digests(tiles), "tile-digests")
    found = differing_tiles(digests, pairs, rows_per_slot)
    asked = pairs.select("pair_id", "threshold", "before_id", "after_id")
    found = written(found.join(asked, "pair_id"), "differing-tiles")
    met = F.col("before_tw").isNotNull() & F.col("after_tw").isNotNull()
    both = found.where(met)
    for name in ("before", "after"):
        key = [f"{name}_id", *POSITION]
        side = tiles.select(
            F.col("image_id").alias(f"{name}_id"), *POSITION, *[F.col(c).alias(f"{name}_{c}") for c in CHANNELS]
        )
        keys = found.where(met).select(*key)
        hot = hot_keys(keys, key, rows_per_slot)
        both = spread_join(both, only_keys(side, keys, key), key, F.col("pair_id"), hot)
    channels = [f"{name}_{c}" for name in ("before", "after") for c in CHANNELS]
    lone = found.where(~met).select("*", *[F.lit(None).cast("array<smallint>").alias(c) for c in channels])
    return both.unionByName(lone).drop("before_id", "after_id")


def tile_stats(aligned: DataFrame) -> DataFrame:
    """Changed count, bounds of the changed pixels and channel sum per tile that differs at all."""
    schema = T.StructType(
        [
            aligned.schema["pair_id"],
            aligned.schema["ty"],
            aligned.schema["tx"],
            T.StructField("n", T.LongType()),
            *[T.StructField(c, T.IntegerType()) for c in ("min_x", "min_y", "max_x", "max_y")],
            T.StructField("channel_sum", T.LongType()),
        ]
    )
    measured = aligned.mapInArrow(measure_tiles(TILE), schema)
    return measured.where((F.col("n") > 0) | (F.col("channel_sum") > 0))


def _with_totals(dims: DataFrame, sums: DataFrame) -> DataFrame:
    changed = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    channel_sum = F.coalesce(F.col("channel_sum"), F.lit(0).cast("long"))
    known = F.col("union_area").isNotNull()
    return (
        dims.join(sums, "pair_id", "left")
        .withColumn("changed_pixels", F.when(known, changed))
        .withColumn(
            "changed_ratio", F.when(known, px.changed_ratio(changed, F.col("union_area")))
        )
        .withColumn(
            "similarity",
            F.when(known, px.similarity(channel_sum, F.col("outside"), F.col("union_area"))),
        )
    )


def compare_totals(
    tiles: DataFrame, images: DataFrame, pairs: DataFrame, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Similarity, changed pixels and ratio per pair; partial sums before the only shuffle by pair."""
    sums = (
        tile_stats(align_tiles(tiles, pairs, rows_per_slot))
        .groupBy("pair_id")
        .agg(F.sum("n").alias("n"), F.sum("channel_sum").alias("channel_sum"))
    )
    return _with_totals(pair_dims(pairs, images), sums).select(*TOTALS)


def component_stats(labelled: DataFrame) -> DataFrame:
    """Tight box and pixel count per component; tiles without a changed pixel share a null label."""
    return labelled.groupBy("pair_id", "label").agg(
        F.sum("n").alias("n"),
        F.min("min_x").alias("x"),
        F.min("min_y").alias("y"),
        (F.max("max_x") - F.min("min_x") + 1).alias("width"),
        (F.max("max_y") - F.min("min_y") + 1).alias("height"),
        F.sum("channel_sum").alias("channel_sum"),
    )


def _discovery() -> Column:
    return F.row_number().over(
        Window.partitionBy("pair_id").orderBy(F.col("label").asc_nulls_last())
    )


def changed_regions(labelled: DataFrame) -> DataFrame:
    """Regions of every pair: the first 1000 components in row-major order."""
    return first_regions(component_stats(labelled))


def first_regions(components: DataFrame) -> DataFrame:
    return (
        components.where("label IS NOT NULL")
        .withColumn("discovery", _discovery())
        .where(F.col("discovery") <= MAX_COMPONENTS)
        .select(
            "pair_id", "discovery", "x", "y", "width", "height", F.col("n").alias("changed_pixels")
        )
    )


def largest_regions(regions: DataFrame, max_regions: int) -> DataFrame:
    """The largest regions of every pair; ties go to the upper, then to the left one."""
    order = Window.partitionBy("pair_id").orderBy(
        F.col("changed_pixels").desc(), "y", "x", "discovery"
    )
    return (
        regions.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max_regions)
        .select("pair_id", "rank", "x", "y", "width", "height", "changed_pixels")
    )


def compare_images(
    tiles: DataFrame,
    images: DataFrame,
    pairs: DataFrame,
    rows_per_slot: int = ROWS_PER_SLOT,
    aligned: DataFrame | None = None,
) -> DataFrame:
    """One row per pair: totals, ordered regions, truncation flag and warnings.

    Pixels are read once: tile statistics feed both the totals and the regions. Both ranks are filters, so
    Spark cuts every group before its shuffle. A pair whose parameters break a rule, or whose image was refused
    (``images.error_code``, where that column exists), answers with that code and nothing else. ``aligned`` may hand in
    what ``align_tiles`` found for these pairs.
    """
    pairs = gated_pairs(pairs, images)
    usable = pairs.where("error_code IS NULL").drop("error_code")
    if aligned is None:
        aligned = align_tiles(tiles, usable, rows_per_slot)
    stats = tile_stats(aligned)
    components = cut_lineage(component_stats(label_components(stats)))
    limit = usable.select("pair_id", F.col("max_regions").alias("_limit"))
    listed = (
        largest_regions(first_regions(components), MAX_REGIONS)
        .join(limit, "pair_id")
        .where("rank <= _limit")
        .groupBy("pair_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", "x", "y", "width", "height", "changed_pixels"))
            ).alias("_listed")
        )
    )
    sums = (
        components.groupBy("pair_id")
        .agg(
            F.sum("n").alias("n"),
            F.sum("channel_sum").alias("channel_sum"),
            F.least(F.count("label"), F.lit(MAX_COMPONENTS)).alias("_regions"),
        )
        .join(listed, "pair_id", "left")
    )
    totals = _with_totals(pair_dims(pairs, images), sums)
    found = F.coalesce(F.col("_regions"), F.lit(0).cast("long"))
    missing = F.col("error_code").isNotNull() | F.col("union_area").isNull()
    truncated = found > F.col("max_regions")
    unchanged = F.col("changed_pixels") == 0
    warnings = present(
        F.when(F.col("outside") > 0, MSG_SIZE_DIFFERS),
        F.when(truncated, F.format_string(MSG_REGIONS_TRUNCATED, F.col("max_regions"))),
        F.when(F.col("include_diff") & unchanged, MSG_NO_DIFF),
    )
    regions = F.transform(
        F.coalesce(F.col("_listed"), F.array()),
        lambda r: F.struct(
            r["x"].alias("x"),
            r["y"].alias("y"),
            r["width"].alias("width"),
            r["height"].alias("height"),
            r["changed_pixels"].alias("changed_pixels"),
        ),
    )
    return totals.select(
        "pair_id",
        *[F.when(~missing, F.col(c)).alias(c) for c in TOTALS if c != "pair_id"],
        F.when(~missing, regions).alias("regions"),
        F.when(~missing, F.col("include_diff") & ~unchanged).alias("has_diff"),
        F.when(~missing, truncated).alias("truncated"),
        F.when(~missing, capped_warnings(warnings)).alias("warnings"),
        F.when(missing, F.coalesce("error_code", F.lit("not_found"))).alias("error_code"),
    )


def diff_raster(
    tiles: DataFrame,
    images: DataFrame,
    pairs: DataFrame,
    rows_per_slot: int = ROWS_PER_SLOT,
    aligned: DataFrame | None = None,
) -> DataFrame:
    """Diff tiles on the bounding canvas: grey after-image, changed positions red, corners black.

    Only pairs that ask for a diff and changed at all get one. Tiles that differ are measured and painted in one pass;
    the others are the grey after-image alone. ``aligned`` as in ``compare_images``.
    """
    asked = pair_dims(pairs.where("include_diff"), images).where("union_area IS NOT NULL")
    canvas = asked.select(
        "pair_id",
        "after_id",
        F.greatest("before_width", "after_width").alias("canvas_width"),
        F.greatest("before_height", "after_height").alias("canvas_height"),
        "before_width",
        "before_height",
        "after_width",
        "after_height",
    )
    size = canvas.select("pair_id", "canvas_width", "canvas_height")
    shape = (
        F.least(F.lit(TILE), F.col("canvas_width") - F.col("tx") * TILE).alias("tw"),
        F.least(F.lit(TILE), F.col("canvas_height") - F.col("ty") * TILE).alias("th"),
    )
    channel = T.ArrayType(T.ShortType())
    if aligned is None:
        aligned = align_tiles(tiles, asked, rows_per_slot)
    aligned = aligned.join(size, "pair_id").select("*", *shape)
    head = [aligned.schema["pair_id"], *[T.StructField(c, T.IntegerType()) for c in ("ty", "tx", "tw", "th")]]
    planes = [T.StructField(c, channel) for c in CHANNELS]
    painted = aligned.mapInArrow(paint_tiles, T.StructType([*head, *planes, T.StructField("n", T.LongType())]))
    painted = written(painted, "painted-tiles")
    changed = painted.groupBy("pair_id").agg(F.sum("n").alias("n")).where("n > 0").select("pair_id")
    canvas = written(canvas.join(changed, "pair_id", "left_semi"), "drawn-pairs")
    coloured = painted.drop("n").join(changed, "pair_id", "left_semi")

    drawn = canvas.select("pair_id", F.col("after_id").alias("image_id"))
    hot = hot_keys(drawn, ["image_id"], rows_per_slot)
    rest = spread_join(drawn, tiles, ["image_id"], F.col("pair_id"), hot).join(
        painted.select("pair_id", *POSITION), ["pair_id", *POSITION], "left_anti"
    )
    rest = rest.select("pair_id", *POSITION, "tw", "th", *CHANNELS).mapInArrow(grey_tiles, T.StructType([*head, *planes]))
    none = F.lit(0).cast("short")
    rows = F.sequence(F.lit(0), F.floor((F.col("canvas_height") - 1) / TILE).cast("int"))
    cols = F.sequence(F.lit(0), F.floor((F.col("canvas_width") - 1) / TILE).cast("int"))
    top, left = F.col("ty") * TILE, F.col("tx") * TILE
    in_before = (top < F.col("before_height")) & (left < F.col("before_width"))
    in_after = (top < F.col("after_height")) & (left < F.col("after_width"))
    black = F.array_repeat(none, F.col("tw") * F.col("th"))
    corners = (
        canvas.where("(before_width - after_width) * (before_height - after_height) < 0")
        .withColumn("ty", F.explode(rows))
        .withColumn("tx", F.explode(cols))
        .where(~in_before & ~in_after)
        .select("pair_id", "ty", "tx", *shape)
        .select("*", black.alias("r"), black.alias("g"), black.alias("b"))
    )
    return coloured.unionByName(rest).unionByName(corners)
