"""Asset catalogue: visibility, usage, expiry, retention, orphans and references."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates, media
from ..functions.errors import error_struct
from ..session import written
from ..settings import DEFAULT_MAX_IMAGE_BYTES, DEFAULT_MAX_IMAGE_PIXELS, DEFAULT_TTL_SECONDS
from .key_filter import only_keys

#: Hash folders of a content store.
CONTENT_BUCKETS = 256


def asset_kind(asset_id: Column) -> Column:
    """The kind an id carries in its first letter; null means not found."""
    return F.when(asset_id.startswith("i"), "input").when(asset_id.startswith("a"), "artifact")


def principal_bucket(principal: Column) -> Column:
    return F.regexp_replace(principal, "^p_", "")


def created_second(created_at: Column) -> Column:
    return F.date_trunc("second", created_at)


def expires_at(created_at: Column, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> Column:
    zero = F.lit(0)
    return created_second(created_at) + F.make_dt_interval(zero, zero, zero, F.lit(ttl_seconds))


def with_expiry(uploads: DataFrame, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    return (
        uploads.withColumn("expires_at", expires_at(F.col("created_at"), ttl_seconds))
        .withColumn("created_at", created_second(F.col("created_at")))
        .withColumn("kind", asset_kind(F.col("asset_id")))
        .withColumn("principal_bucket", principal_bucket(F.col("principal")))
    )


def gate_uploads(uploads: DataFrame, max_bytes: int) -> DataFrame:
    code = media.upload_gate(F.col("content_type"), F.col("byte_count"), max_bytes)
    return uploads.withColumn("error_code", code).withColumn(
        "content_type", media.normalized_content_type(F.col("content_type"))
    )


def catalogue(inputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Both containers as one table."""
    return inputs.withColumn("kind", F.lit("input")).unionByName(
        artifacts.withColumn("kind", F.lit("artifact"))
    )


def _moment(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def live_when_read(expires: Column, as_of: datetime | str | Column) -> Column:
    """An unreadable expiry counts as expired now when an asset is read."""
    return F.coalesce(expires > _moment(as_of), F.lit(False))


def live_in_quota(expires: Column, as_of: datetime | str | Column) -> Column:
    """An unreadable expiry keeps using quota."""
    return F.coalesce(expires > _moment(as_of), F.lit(True))


def visible_assets(assets: DataFrame, principal: str, as_of: datetime | str) -> DataFrame:
    """Assets a principal may read; the filter on the bucket prunes partitions of a stored ledger."""
    mine = assets.where(F.col("principal") == principal)
    if "principal_bucket" in assets.columns:
        mine = mine.where(F.col("principal_bucket") == principal.removeprefix("p_"))
    return mine.where(live_when_read(F.col("expires_at"), as_of))


def resolve_assets(
    requests: DataFrame, assets: DataFrame, as_of: datetime | str
) -> DataFrame:
    """``requests(request_id, principal, asset_id)`` with the asset or ``not_found``.

    A foreign and an expired asset look the same as a missing one.
    """
    held = assets.where(live_when_read(F.col("expires_at"), as_of)).select(
        "asset_id", "principal", "content_type", "byte_count", "expires_at"
    )
    found = requests.join(held, ["asset_id", "principal"], "left")
    usable = (
        F.col("byte_count").isNotNull()
        & gates.stored_id_gate(F.col("asset_id")).isNull()
        & asset_kind(F.col("asset_id")).isNotNull()
    )
    return found.withColumn("error_code", F.when(~usable, "not_found"))


def resolve_references(
    references: DataFrame,
    files: DataFrame,
    assets: DataFrame,
    roots: Sequence[str],
    as_of: datetime | str,
) -> DataFrame:
    """``references(reference_id, principal, reference)`` to content rows or an error.

    Paths are matched with ``files(path, byte_count)`` after the path rules, ids with the
    principal's live assets. Both are equi-joins; no reference takes part in more than one.
    """
    parsed = references.withColumn("_ref", gates.parsed_reference(F.col("reference")))
    kept = ["reference_id", "principal"]
    bad = parsed.where("_ref IS NULL").select(
        *kept,
        F.lit(None).cast("string").alias("source_kind"),
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("asset_id"),
        F.lit(None).cast("long").alias("byte_count"),
        F.lit("invalid_input").alias("error_code"),
    )
    known = files.select(F.col("path").alias("_path"), F.col("byte_count").cast("long"))
    by_path = (
        parsed.where("_ref.kind = 'local_path'")
        .withColumn("path", F.col("_ref.path"))
        .withColumn("_path", gates.normalized_path(F.col("path")))
        .join(known, "_path", "left")
        .select(
            *kept,
            F.lit("local_path").alias("source_kind"),
            F.col("_path").alias("path"),
            F.lit(None).cast("string").alias("asset_id"),
            "byte_count",
            gates.path_gate(F.col("path"), roots, F.col("byte_count").isNotNull()).alias(
                "error_code"
            ),
        )
    )
    by_id = resolve_assets(
        parsed.where("_ref.kind = 'asset'").select(*kept, F.col("_ref.asset_id").alias("asset_id")),
        assets,
        as_of,
    ).select(
        *kept,
        F.lit("asset").alias("source_kind"),
        F.lit(None).cast("string").alias("path"),
        "asset_id",
        F.col("byte_count").cast("long").alias("byte_count"),
        "error_code",
    )
    return bad.unionByName(by_path).unionByName(by_id)


def reference_contents(
    references: DataFrame,
    files: DataFrame,
    assets: DataFrame,
    contents: DataFrame,
    roots: Sequence[str],
    as_of: datetime | str,
    max_bytes: int = DEFAULT_MAX_IMAGE_BYTES,
    max_pixels: int = DEFAULT_MAX_IMAGE_PIXELS,
) -> DataFrame:
    """References with the content they name: ``content_type``, ``byte_count`` and ``content``, or an error.

    ``contents(content_id, content, bucket)`` is a store as ``write_contents`` lays it out; ids are paths and asset ids. All rules
    are applied to the keys first. Then only buckets that a good reference names are scanned, and only rows that may be
    named, by a filter tested at the scan, are exchanged. A content that the store lacks is ``not_found``.
    """
    found = written(resolve_references(references, files, assets, roots, as_of), "references")
    bucket = F.pmod(F.xxhash64("content_id"), F.lit(CONTENT_BUCKETS)).cast("int")
    good = found.where("error_code IS NULL").withColumn("content_id", F.coalesce("path", "asset_id"))
    good = good.withColumn("bucket", bucket)
    named = [row["bucket"] for row in good.select("bucket").distinct().collect()]  # 256 at most
    keys = good.select("content_id").distinct()
    held = only_keys(contents.where(F.col("bucket").isin(named)), keys, ["content_id"])
    met = good.drop("error_code", "byte_count").join(held, ["bucket", "content_id"], "left")
    content = F.col("content")
    code = F.when(content.isNull(), "not_found").otherwise(media.payload_gate(content, max_bytes, max_pixels))
    kept = ["reference_id", "principal", "source_kind", "path", "asset_id"]
    judged = met.withColumn("error_code", code).select(
        *kept,
        media.sniff_content_type(content).alias("content_type"),
        F.length(content).cast("long").alias("byte_count"),
        F.when(F.col("error_code").isNull(), content).alias("content"),
        "error_code",
    )
    bad = found.where("error_code IS NOT NULL").select(
        *kept,
        F.lit(None).cast("string").alias("content_type"),
        "byte_count",
        F.lit(None).cast("binary").alias("content"),
        "error_code",
    )
    return judged.unionByName(bad)


def contained_paths(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``paths(path)`` that are or lie below one of ``roots(root)``; relative paths and paths with a NUL never do.

    Roots below other roots add nothing and go first. What is left are roots none of which is above another, so of the
    ancestors that a path offers as join keys at most one is a root: every path comes out of one semi-join as often as it
    went in. Ancestors that are no root, such as the file system's own, are filtered out before the exchange.
    """
    clean = roots.select(gates.normalized_path(F.col("root")).alias("_root")).where("_root IS NOT NULL").distinct()
    chain = gates.path_ancestors(F.col("_root"))
    above = clean.select(F.col("_root").alias("_below"), F.explode(F.slice(chain, 1, F.size(chain) - 1)).alias("_root"))
    nested = above.join(clean, "_root", "left_semi").select(F.col("_below").alias("_root"))
    top = clean.join(nested, "_root", "left_anti")
    formed = paths.where(gates.path_form_gate(F.col("path")).isNull())
    offered = formed.withColumn("_root", F.explode(gates.path_ancestors(gates.normalized_path(F.col("path")))))
    return only_keys(offered, top, ["_root"]).join(top, "_root", "left_semi").drop("_root")


def quota_usage(assets: DataFrame, as_of: datetime | str, scope: str = "principal") -> DataFrame:
    """Live bytes and count per principal, or per principal and container."""
    keys = ["principal"] if scope == "principal" else ["principal", "kind"]
    return (
        assets.where(live_in_quota(F.col("expires_at"), as_of))
        .groupBy(*keys)
        .agg(F.count("*").alias("asset_count"), F.sum("byte_count").alias("total_bytes"))
    )


def purge_counts(assets: DataFrame, as_of: datetime | str) -> DataFrame:
    """Removed and kept assets per kind; rows without readable metadata are not counted as removed."""
    gone = F.col("expires_at") <= _moment(as_of)
    return assets.groupBy("kind").agg(
        F.count(F.when(gone, 1)).alias("removed"),
        F.count(F.when(~F.coalesce(gone, F.lit(False)), 1)).alias("kept"),
    )


def purge_expired(assets: DataFrame, as_of: datetime | str) -> DataFrame:
    return assets.where(F.coalesce(F.col("expires_at") > _moment(as_of), F.lit(True)))


def retention_days(ttl_seconds: int) -> int:
    return max(1, ttl_seconds // 86400)


def beyond_retention(assets: DataFrame, as_of: datetime | str, ttl_seconds: int) -> DataFrame:
    """Assets older than the retention of the store, whole days since creation."""
    age = F.floor((F.unix_micros(_moment(as_of)) - F.unix_micros("created_at")) / 86_400_000_000)
    return assets.withColumn("age_days", age.cast("int")).where(
        F.col("age_days") > retention_days(ttl_seconds)
    )


def orphan_blobs(blobs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Blobs without readable metadata; they still use quota."""
    return blobs.join(metadata.select("asset_id", "principal"), ["asset_id", "principal"], "left_anti")


def quarantine(
    frame: DataFrame, code: str = "error_code", message: Column | None = None
) -> DataFrame:
    """Rows that carry an error code, as error records."""
    return frame.where(F.col(code).isNotNull()).withColumn(
        "error", error_struct(F.col(code), F.lit("") if message is None else message)
    )
