"""A hash tree over tiles: digests of tiles, and of blocks of 64 x 64 tiles.

Two images are compared from the top: blocks whose digests agree are done, then tiles of the other blocks. Only tiles that
differ have their pixels fetched. A digest has 128 bits, two hashes of the same values in different orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import BLOCK
from .spread import hot_keys, spread_join

CHANNELS = ("r", "g", "b")
POSITION = ("ty", "tx")


def _block(name: str) -> Column:
    return F.floor(F.col(name) / BLOCK).cast("int")


def tile_digests(tiles: DataFrame) -> DataFrame:
    """``image_id, ty, tx, tw, th, d1, d2``: what ``tiles`` say without their pixels; digests stored with them are used."""
    if {"d1", "d2"} <= set(tiles.columns):
        found = tiles
    else:
        found = tiles.withColumns(
            {"d1": F.xxhash64("tw", "th", *CHANNELS), "d2": F.xxhash64(*reversed(CHANNELS), "th", "tw")}
        )
    return found.select("image_id", *POSITION, "tw", "th", "d1", "d2")


def block_digests(digests: DataFrame) -> DataFrame:
    """``image_id, by, bx, b1, b2, c``: digests of a block's tiles with their places, folded in any order."""
    placed = digests.select(
        "image_id",
        _block("ty").alias("by"),
        _block("tx").alias("bx"),
        F.xxhash64("ty", "tx", "d1", "d2").alias("h1"),
        F.xxhash64("d2", "d1", "tx", "ty").alias("h2"),
    )
    return placed.groupBy("image_id", "by", "bx").agg(
        F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.count("*").alias("c")
    )


def _sides(pairs: DataFrame) -> DataFrame:
    side = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("before_id").alias("image_id")),
            F.struct(F.lit(1).alias("side"), F.col("after_id").alias("image_id")),
        )
    )
    return pairs.select("pair_id", side.alias("_s")).select("pair_id", "_s.*")


def differing_blocks(digests: DataFrame, pairs: DataFrame, rows_per_slot: int) -> DataFrame:
    """``pair_id, by, bx`` where the images' blocks differ or one of them has none."""
    sides = _sides(pairs)
    hot = hot_keys(sides, ["image_id"], rows_per_slot)
    placed = spread_join(sides, block_digests(digests), ["image_id"], F.col("pair_id"), hot)
    seen = placed.groupBy("pair_id", "by", "bx").agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{name}_{c}") for c in ("b1", "b2", "c") for name, f in (("low", F.min), ("high", F.max))],
    )
    differ = F.col("n") < 2
    for c in ("b1", "b2", "c"):
        differ = differ | (F.col(f"low_{c}") != F.col(f"high_{c}"))
    return seen.where(differ).select("pair_id", "by", "bx")


def differing_tiles(digests: DataFrame, pairs: DataFrame, rows_per_slot: int) -> DataFrame:
    """``pair_id, ty, tx, before_tw, before_th, after_tw, after_th`` of the tiles that differ; an absent side is null."""
    wanted = differing_blocks(digests, pairs, rows_per_slot).join(_sides(pairs), "pair_id")
    place = ["image_id", "by", "bx"]
    tiles = digests.withColumns({"by": _block("ty"), "bx": _block("tx")})
    hot = hot_keys(wanted, place, rows_per_slot)
    placed = spread_join(wanted, tiles, place, F.col("pair_id"), hot)
    values = ("tw", "th", "d1", "d2")
    both = placed.groupBy("pair_id", *POSITION).agg(
        *[
            F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{name}_{c}")
            for k, name in enumerate(("before", "after"))
            for c in values
        ]
    )
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    return both.where(~same).drop("before_d1", "before_d2", "after_d1", "after_d2")
