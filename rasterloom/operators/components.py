"""4-connected components of changed tiles.

Components are first found inside blocks of 64 x 64 tiles, one bounded row per block. Touching border
tiles of different blocks become edges of a small graph, whose components are found by alternating star contractions (Kiveris et al., 2014) over DataFrames.

A label is ``ty * 2^20 + tx`` of the first tile in row-major order, so labels are also the discovery
order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

BLOCK = 64
ROW_STRIDE = 2**20


def _touching(sorted_codes: np.ndarray, neighbour: np.ndarray) -> np.ndarray:
    """Position of every neighbour code in the sorted codes, -1 where that tile is absent."""
    at = np.searchsorted(sorted_codes, neighbour)
    at[at == len(sorted_codes)] = 0
    return np.where(sorted_codes[at] == neighbour, at, -1)


def _first_of_component(codes: np.ndarray) -> np.ndarray:
    """Index of the first tile of each tile's component; ``codes`` are sorted and unique.

    A code is block * 64 * 128 + row * 128 + column: the unused columns keep rows apart.
    """
    here = np.arange(len(codes))
    tail, head = [], []
    last_row = codes // 128 % BLOCK == BLOCK - 1
    for step, allowed in ((1, np.ones(len(codes), bool)), (128, ~last_row)):
        other = _touching(codes, codes + step)
        joined = (other >= 0) & allowed
        tail.append(here[joined])
        head.append(other[joined])
    u, v = np.concatenate(tail), np.concatenate(head)
    first = here.copy()
    while True:
        low = np.minimum(first[u], first[v])
        lowered = first.copy()
        np.minimum.at(lowered, first[u], low)
        np.minimum.at(lowered, first[v], low)
        while True:
            jumped = lowered[lowered]
            if np.array_equal(jumped, lowered):
                break
            lowered = jumped
        if np.array_equal(lowered, first):
            return first
        first = lowered


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _block_labels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For each list of tile codes inside a block, the code of the first tile of the component."""
    for batch in batches:
        sizes = batch.map(len).to_numpy()
        if sizes.sum() == 0:
            yield pd.Series([[] for _ in sizes])
            continue
        local = np.concatenate([np.asarray(codes, dtype=np.int64) for codes in batch])
        block = np.repeat(np.arange(len(sizes)), sizes)
        codes = block * (BLOCK * 128) + local // BLOCK * 128 + local % BLOCK
        order = np.argsort(codes)
        labels = np.empty(len(codes), dtype=np.int64)
        labels[order] = local[order][_first_of_component(codes[order])]
        yield pd.Series(np.split(labels.astype(np.int32), np.cumsum(sizes)[:-1]))


def label_blocks(stats: DataFrame) -> DataFrame:
    """Tile statistics with the label of the component inside the tile's block."""
    columns = stats.columns
    grouped = (
        stats.withColumn("_by", F.floor(F.col("ty") / BLOCK).cast("int"))
        .withColumn("_bx", F.floor(F.col("tx") / BLOCK).cast("int"))
        .groupBy("pair_id", "_by", "_bx")
        .agg(F.collect_list(F.struct(*[c for c in columns if c != "pair_id"])).alias("_tiles"))
    )
    # Tiles without a changed pixel only carry their channel sum along.
    hit = F.filter("_tiles", lambda t: t["n"] > 0)
    idle = F.filter("_tiles", lambda t: t["n"] == 0)
    code = F.transform(
        "_hit", lambda t: F.pmod(t["ty"], F.lit(BLOCK)) * BLOCK + F.pmod(t["tx"], F.lit(BLOCK))
    )
    labelled = (
        grouped.select("pair_id", "_by", "_bx", hit.alias("_hit"), idle.alias("_idle"))
        .withColumn("_codes", _block_labels(code))
    )
    joined = F.concat(
        F.transform(
            F.arrays_zip("_hit", "_codes"),
            lambda z: F.struct(z["_hit"].alias("tile"), z["_codes"].alias("code")),
        ),
        F.transform(
            "_idle", lambda t: F.struct(t.alias("tile"), F.lit(None).cast("int").alias("code"))
        ),
    )
    code = F.col("_z.code")
    top = F.col("_by") * BLOCK + F.floor(code / BLOCK)
    left = F.col("_bx") * BLOCK + F.pmod(code, F.lit(BLOCK))
    return labelled.select("pair_id", "_by", "_bx", F.explode(joined).alias("_z")).select(
        "pair_id",
        "_z.tile.*",
        (top.cast("long") * ROW_STRIDE + left).alias("label"),
    )


def tile_adjacency(labelled: DataFrame) -> DataFrame:
    """Edges between the labels of touching tiles that lie in different blocks."""
    tiles = labelled.where("label IS NOT NULL").select("pair_id", "ty", "tx", "label")
    below = tiles.where(F.pmod("ty", F.lit(BLOCK)) == BLOCK - 1).withColumn("ty", F.col("ty") + 1)
    beside = tiles.where(F.pmod("tx", F.lit(BLOCK)) == BLOCK - 1).withColumn("tx", F.col("tx") + 1)
    near = below.unionByName(beside).withColumnRenamed("label", "_other")
    return (
        near.join(tiles, ["pair_id", "ty", "tx"])
        .where(F.col("label") != F.col("_other"))
        .select(
            "pair_id",
            F.greatest("label", "_other").alias("u"),
            F.least("label", "_other").alias("v"),
        )
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select("pair_id", F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("pair_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.where("v > u").join(low, ["pair_id", "u"])
    return linked.where("v <> m").select("pair_id", F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("pair_id", "u").agg(F.min("v").alias("m"))
    moved = edges.join(low, ["pair_id", "u"]).where("v <> m").select("pair_id", "v", "m")
    kept = low.select("pair_id", F.col("u").alias("v"), "m")
    linked = moved.unionByName(kept).select(
        "pair_id", F.col("v").alias("u"), F.col("m").alias("v")
    )
    return linked.where("u <> v")


def contract(edges: DataFrame) -> DataFrame:
    """Edges ``(pair_id, u, v)`` with u > v turned into stars: every label points at its least one."""

    def fingerprint(frame: DataFrame) -> tuple:
        return tuple(
            frame.agg(
                F.count("*"), F.sum(F.xxhash64("pair_id", "u", "v").cast("decimal(38,0)"))
            ).first()
        )

    current = cut_lineage(edges)
    mark = fingerprint(current)
    if not mark[0]:
        return current
    while True:
        current = cut_lineage(_small_star(_large_star(current).distinct()).distinct())
        seen, mark = mark, fingerprint(current)
        if seen == mark:
            return current


def label_components(stats: DataFrame) -> DataFrame:
    """Tile statistics with the component label of every changed tile, null for the others.

    Whether blocks touch is read off the tiles themselves; without a touching pair no round runs.
    """
    labelled = cut_lineage(label_blocks(stats))
    roots = contract(tile_adjacency(labelled)).select(
        "pair_id", F.col("u").alias("label"), F.col("v").alias("_root")
    )
    return (
        labelled.join(roots, ["pair_id", "label"], "left")
        .withColumn("label", F.coalesce("_root", "label"))
        .drop("_root")
    )
