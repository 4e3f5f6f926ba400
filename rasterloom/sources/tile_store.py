"""Stored tiles, laid out so that a crop reads few row groups.

Tiles lie in hash folders of their images; inside a folder they are sorted by image and Morton code, so a row group holds
a compact patch of one image, and its least and greatest values tell whether a box can meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.regions import crop_pixels
from ..settings import TILE, TILES

STORE_BUCKETS = 256
ROW_GROUP_BYTES = 4 << 20
#: Steps that move the 16 bits of a number apart, each with the bits that stay.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _apart(number: Column) -> Column:
    out = number.cast("long")
    for shift, mask in _SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def morton(ty: Column, tx: Column) -> Column:
    """Bits of both numbers, below 2^16, in turn. It never falls when one of them grows."""
    return F.shiftleft(_apart(ty), 1).bitwiseOR(_apart(tx))


def _bucket(image_id: Column) -> Column:
    return F.pmod(F.xxhash64(image_id), F.lit(STORE_BUCKETS)).cast("int")


def write_tile_store(tiles: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Append ``tiles``, with image ids of any one type; a folder with many tiles is written by many tasks, each with a range of the order."""
    fields = [F.col(f.name).cast(f.dataType.simpleString()) for f in TILES.fields if f.name != "image_id"]
    keyed = tiles.select("image_id", *fields).withColumn("bucket", _bucket(F.col("image_id"))).withColumn("code", morton(F.col("ty"), F.col("tx")))
    order = ["bucket", "image_id", "code"]
    writer = keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append")
    writer.option("parquet.block.size", row_group_bytes).partitionBy("bucket").parquet(path)


def read_tiles_for(spark: SparkSession, path: str, crops: DataFrame) -> DataFrame:
    """Tiles of the store that ``crops(image_id, x, y, width, height)`` may meet.

    One row over all crops gives the folders (256 at most) and the least and greatest image, place and code; these are
    plain filters on the scan, so folders, row groups and pages outside of them are not read. No tile that a crop meets is
    left out; others may remain. Without crops nothing is read. Ids of images have the type they have in the store.
    """
    own = T.StructField("image_id", crops.schema["image_id"].dataType)
    kept = [own, *[f for f in TILES.fields if f.name != "image_id"]]
    schema = T.StructType([*kept, T.StructField("code", T.LongType()), T.StructField("bucket", T.IntegerType())])
    top, left = F.floor(F.col("y") / TILE).cast("int"), F.floor(F.col("x") / TILE).cast("int")
    bottom = F.floor((F.col("y") + F.col("height") - 1) / TILE).cast("int")
    right = F.floor((F.col("x") + F.col("width") - 1) / TILE).cast("int")
    reach = crops.agg(
        F.collect_set(_bucket(F.col("image_id"))).alias("buckets"),
        F.min("image_id").alias("first_image"), F.max("image_id").alias("last_image"),
        F.min(top).alias("top"), F.max(bottom).alias("bottom"), F.min(left).alias("left"), F.max(right).alias("right"),
        F.min(morton(top, left)).alias("first_code"), F.max(morton(bottom, right)).alias("last_code"),
    ).first()
    stored = spark.read.schema(schema).parquet(path)
    met = (
        F.col("bucket").isin(reach["buckets"])
        & F.col("image_id").between(reach["first_image"], reach["last_image"])
        & F.col("ty").between(reach["top"], reach["bottom"])
        & F.col("tx").between(reach["left"], reach["right"])
        & F.col("code").between(reach["first_code"], reach["last_code"])
    )
    return stored.where(met).select(*TILES.fieldNames())


def stored_crop_pixels(spark: SparkSession, path: str, crops: DataFrame) -> DataFrame:
    """``crop_pixels`` of valid crops from a store."""
    return crop_pixels(crops, read_tiles_for(spark, path, crops))
