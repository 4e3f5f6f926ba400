"""Comparison with stored diffs: content-addressed artifacts, each kept once whatever number of runs makes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import align_tiles, compare_images, diff_raster
from ..operators.digests import tile_digests
from ..session import written

_IDS = "artifact_id string, run string"


def artifact_ids(diffs: DataFrame) -> DataFrame:
    """``pair_id, artifact_id`` of diff tiles: a digest over the pair's tile digests in order.

    A pair has as many tiles as its canvas, which the limit on pixels bounds. Equal diffs have equal ids.
    """
    digests = tile_digests(diffs.withColumnRenamed("pair_id", "image_id"))
    tile = F.struct("ty", "tx", "tw", "th", "d1", "d2")
    ordered = digests.groupBy("image_id").agg(F.array_sort(F.collect_list(tile)).alias("tiles"))
    text = F.array_join(F.transform("tiles", lambda t: F.concat_ws(":", *[t[c] for c in ("ty", "tx", "tw", "th", "d1", "d2")])), ",")
    return ordered.select(
        F.col("image_id").alias("pair_id"), F.concat(F.lit("a"), F.substring(F.sha2(text, 256), 1, 32)).alias("artifact_id")
    )


def _known(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Artifacts that other runs have stored. A run's ids are written last, so a run that broke off has none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ids")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _IDS).select("artifact_id")
    return spark.read.schema(_IDS).parquet(f"{path}/ids").where(F.col("run") != run).select("artifact_id")


def store_diffs(diffs: DataFrame, path: str, run: str) -> DataFrame:
    """Store diff tiles under the ids of their artifacts; gives ``pair_id, artifact_id`` of all pairs.

    What is stored already, and what several pairs share, is written once. A run that is repeated under its name replaces
    what it wrote.
    """
    spark = diffs.sparkSession
    ids = written(artifact_ids(diffs), "artifact-ids")
    new = ids.join(_known(spark, path, run), "artifact_id", "left_anti")
    first = written(new.groupBy("artifact_id").agg(F.min("pair_id").alias("pair_id")), "new-artifacts")
    tiles = diffs.join(first, "pair_id").drop("pair_id")
    tiles.write.mode("overwrite").parquet(f"{path}/tiles/run={run}")
    first.select("artifact_id").write.mode("overwrite").parquet(f"{path}/ids/run={run}")
    return ids


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of stored diffs, of runs that ended."""
    ids = spark.read.schema(_IDS).parquet(f"{path}/ids")
    return spark.read.parquet(f"{path}/tiles").join(ids, ["artifact_id", "run"], "left_semi").drop("run")


def compare_and_store(tiles: DataFrame, images: DataFrame, pairs: DataFrame, path: str, run: str) -> DataFrame:
    """``compare_images`` with ``diff_artifact_id``: the stored diff of each pair that asked for one and changed."""
    aligned = written(align_tiles(tiles, pairs), "aligned")
    ids = store_diffs(written(diff_raster(tiles, images, pairs, aligned=aligned), "diffs"), path, run)
    named = ids.withColumnRenamed("artifact_id", "diff_artifact_id")
    found = compare_images(tiles, images, pairs, aligned=aligned).join(named, "pair_id", "left")
    return found.withColumn("diff_artifact_id", F.when(F.col("has_diff"), F.col("diff_artifact_id")))
