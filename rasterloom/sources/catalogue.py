"""Stored assets: file layout, object layout, and the partitioned ledger."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assets import asset_kind
from ..settings import ASSET_METADATA
from .folders import by_folders, load
from .images import plain_path


def _file_parts(path: str = "path") -> tuple:
    name = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    bucket = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return name, bucket


def _metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    reader = (
        spark.read.schema(ASSET_METADATA)
        .format("json")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
    )
    raw = load(reader, paths).withColumn("path", F.col("_metadata.file_path"))
    name, bucket = _file_parts()
    parsed = raw.select(
        name.alias("file_id"),
        bucket.alias("principal_bucket"),
        F.col("assetId").alias("asset_id"),
        "principal",
        F.col("contentType").alias("content_type"),
        F.col("byteCount").try_cast("long").alias("byte_count"),
        F.try_to_timestamp("createdAt").alias("created_at"),
        F.try_to_timestamp("expiresAt").alias("expires_at"),
    )
    fields = ("asset_id", "principal", "content_type", "byte_count", "created_at", "expires_at")
    readable = F.lit(True)
    for field in fields:
        readable = readable & F.col(field).isNotNull()
    return parsed.withColumn("readable", readable)


def scan_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The JSON metadata files of a file store; ``readable`` tells whether all fields parse. Read once, some folders at a time."""
    return by_folders(spark, [root], lambda paths: _metadata(spark, paths), "metadata")


def _blobs(spark: SparkSession, paths: list[str]) -> DataFrame:
    name, bucket = _file_parts()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin")
    return load(reader, paths).select(
        name.alias("file_id"),
        bucket.alias("principal_bucket"),
        F.col("length").alias("byte_count"),
        plain_path(F.col("path")).alias("path"),
    )


def scan_blobs(spark: SparkSession, root: str) -> DataFrame:
    """The payload files of a file store with their sizes, listed some folders at a time; the contents are not read."""
    return by_folders(spark, [root], lambda paths: _blobs(spark, paths), "blobs")


class Store(NamedTuple):
    """Both scans of a file store, for several questions to one state of it."""

    metadata: DataFrame
    blobs: DataFrame


def scan_store(spark: SparkSession, root: str) -> Store:
    return Store(scan_metadata(spark, root), scan_blobs(spark, root))


def scan_assets(spark: SparkSession, root: str, store: Store | None = None) -> DataFrame:
    """Assets of a file store: readable metadata whose payload file exists."""
    store = store or scan_store(spark, root)
    blobs = store.blobs.select(
        "file_id", "principal_bucket", F.col("byte_count").alias("stored_bytes"), "path"
    )
    return (
        store.metadata.where("readable")
        .join(blobs, ["file_id", "principal_bucket"])
        .select(
            "asset_id",
            asset_kind(F.col("asset_id")).alias("kind"),
            "principal",
            "principal_bucket",
            "content_type",
            "byte_count",
            "created_at",
            "expires_at",
            "stored_bytes",
            "path",
        )
    )


def orphan_files(spark: SparkSession, root: str, store: Store | None = None) -> DataFrame:
    """Payload files without readable metadata; they still use the quota of their bucket."""
    store = store or scan_store(spark, root)
    readable = store.metadata.where("readable").select("file_id", "principal_bucket")
    return store.blobs.join(readable, ["file_id", "principal_bucket"], "left_anti")


def object_assets(listing: DataFrame) -> DataFrame:
    """An object listing ``(name, size, content_type, metadata)`` as assets.

    Names are ``bucket/asset_id``. A missing content type counts as PNG; an expiry that does not
    parse stays null and is read as expired but counted in the quota.
    """
    content_type = F.when(
        F.coalesce(F.col("content_type"), F.lit("")) == "", "image/png"
    ).otherwise(F.col("content_type"))
    asset_id = F.element_at(F.split("name", "/"), -1)
    return listing.select(
        asset_id.alias("asset_id"),
        asset_kind(asset_id).alias("kind"),
        F.coalesce(F.col("metadata")["principal"], F.lit("")).alias("principal"),
        F.substring_index("name", "/", 1).alias("principal_bucket"),
        content_type.alias("content_type"),
        F.col("size").cast("long").alias("byte_count"),
        F.try_to_timestamp(F.col("metadata")["createdat"]).alias("created_at"),
        F.try_to_timestamp(F.col("metadata")["expiresat"]).alias("expires_at"),
    )
