"""Quota admission: which uploads of a principal fit its quota, in order of arrival.

The rule depends on every earlier decision: expired assets are dropped, then an upload is refused if
it would exceed the count or the bytes; a refused upload uses nothing.

Uploads that no state could admit are refused first: those larger than the quota by a column test, and in seconds with more
uploads of one owner than the quota allows, found by a count, those of salted groups of rows: an asset expires on a whole
second, so within one second nothing is freed, and an upload behind ``quota_count`` earlier ones of the same second
that are no larger can never be admitted. The others are decided in one pass over partitions sorted by owner and time; all
that is carried from row to row, and from batch to batch, is the owner's live assets, ``quota_count`` at most
besides those it held before.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import upload_gate
from ..session import written
from ..settings import (
    ADMISSIONS,
    DEFAULT_MAX_IMAGE_BYTES,
    DEFAULT_QUOTA_BYTES,
    DEFAULT_QUOTA_COUNT,
    DEFAULT_TTL_SECONDS,
)

SALTS = 32
SECOND = 1_000_000
NEVER = 2**62
ADMITTED = "accepted"
REFUSED = "quota_exceeded"


def _hopeless(uploads: DataFrame, group: Sequence[str], quota_count: int) -> DataFrame:
    """Mark uploads that no state admits; ``group`` lies within one second of one owner.

    Sorted partitions are streamed; only the smallest ``quota_count`` sizes of a group are kept. Rows marked
    before are passed on.
    """
    group = list(group)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, smallest = None, []
        for batch in batches:
            lost = batch["hopeless"].to_numpy(dtype=bool, copy=True)
            owners = zip(*[batch[c] for c in group], strict=True)
            for row, (owner, size) in enumerate(zip(owners, batch["byte_count"], strict=True)):
                if owner != current:
                    current, smallest = owner, []
                if lost[row]:
                    continue
                if len(smallest) < quota_count:
                    heapq.heappush(smallest, -size)
                elif quota_count and size < -smallest[0]:
                    heapq.heapreplace(smallest, -size)
                else:
                    lost[row] = True
            yield batch.assign(hopeless=lost)

    return (
        uploads.repartition(*group)
        .sortWithinPartitions(*group, "moment", "asset_id")
        .mapInPandas(mark, uploads.schema)
    )


def _decided(
    rows: DataFrame, owner: list[str], ttl_seconds: int, quota_bytes: int, quota_count: int
) -> DataFrame:
    """Held assets (``order`` 0, ``moment`` their expiry) and contenders (``order`` 1), decided as streams of rows."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = None
        held: deque[tuple[int, int]] = deque()
        live: deque[tuple[int, int]] = deque()
        for batch in batches:
            keys = list(zip(*[batch[c] for c in owner], strict=True))
            verdicts = np.zeros(len(batch), dtype=bool)
            data = zip(keys, batch["order"], batch["moment"], batch["byte_count"], strict=True)
            for row, (key, order, now, size) in enumerate(data):
                if key != current:
                    current, held, live = key, deque(), deque()
                    used = 0
                if order == 0:
                    held.append((now, size))
                    used += size
                    continue
                for stock in (held, live):
                    while stock and stock[0][0] <= now:
                        used -= stock.popleft()[1]
                if len(held) + len(live) < quota_count and used + size <= quota_bytes:
                    live.append((now // SECOND * SECOND + ttl_seconds * SECOND, size))
                    used += size
                    verdicts[row] = True
            out = batch[["asset_id", "principal", "byte_count", "moment"]].assign(admitted=verdicts)
            yield out[batch["order"] == 1]

    return (
        rows.repartition(*owner)
        .sortWithinPartitions(*owner, "order", "moment", "asset_id")
        .mapInPandas(decide, "asset_id string, principal string, byte_count long, moment long, admitted boolean")
    )


def quota_admission(
    uploads: DataFrame,
    ttl_seconds: int = DEFAULT_TTL_SECONDS,
    quota_bytes: int = DEFAULT_QUOTA_BYTES,
    quota_count: int = DEFAULT_QUOTA_COUNT,
    max_bytes: int = DEFAULT_MAX_IMAGE_BYTES,
    scope: str = "principal",
    held: DataFrame | None = None,
) -> DataFrame:
    """Every upload with its decision: accepted, or the code it is refused with.

    ``scope`` is ``principal`` where inputs and artifacts share one quota and ``container`` where
    each kind has its own. Uploads of one owner at the same instant follow the asset id. ``held(principal, kind,
    byte_count, expires_at)`` is what the store has before: live assets, and orphans or blobs without a readable expiry
    (null), which use quota for good. Like the expiries that admission gives, theirs lie on whole seconds.
    """
    owner = ["principal"] if scope == "principal" else ["principal", "kind"]
    gate = upload_gate(F.col("content_type"), F.col("byte_count"), max_bytes)
    judged = uploads.withColumn("decision", gate)
    refused = judged.where("decision IS NOT NULL").select(*ADMISSIONS.fieldNames())
    moment = F.unix_micros("created_at")
    size = F.col("byte_count").cast("long").alias("byte_count")
    eligible = judged.where("decision IS NULL").select(
        *owner,
        "asset_id",
        size,
        moment.alias("moment"),
        (F.floor(moment / SECOND) * SECOND).alias("second"),
        F.pmod(F.xxhash64("asset_id"), F.lit(SALTS)).cast("int").alias("salt"),
        (size > quota_bytes).alias("hopeless"),
    )
    # A refusal by number takes more uploads of one owner in one second than the quota allows: only such crowds are looked at.
    place = [*owner, "second"]
    crowds = eligible.groupBy(*place).agg(F.count("*").alias("crowd")).where(F.col("crowd") > quota_count)
    known = eligible.join(crowds, place, "left")
    marked = known.where("crowd IS NOT NULL").drop("crowd")
    for group in ([*place, "salt"], place):
        marked = _hopeless(marked, group, quota_count)
    marked = marked.unionByName(known.where("crowd IS NULL").drop("crowd"))
    marked = written(marked.drop("second", "salt"), "contenders")
    rows = marked.where("NOT hopeless").drop("hopeless").withColumn("order", F.lit(1))
    if held is not None:
        expiry = F.coalesce(F.unix_micros("expires_at"), F.lit(NEVER))
        stock = held.select(
            *owner, F.lit("").alias("asset_id"), size, expiry.alias("moment"), F.lit(0).alias("order")
        )
        rows = rows.unionByName(stock)
    decided = _decided(rows, owner, ttl_seconds, quota_bytes, quota_count).unionByName(
        marked.where("hopeless").select("asset_id", "principal", "byte_count", "moment", F.lit(False).alias("admitted"))
    )
    return refused.unionByName(
        decided.select(
            "asset_id",
            "principal",
            "byte_count",
            F.timestamp_micros("moment").alias("created_at"),
            F.when(F.col("admitted"), ADMITTED).otherwise(F.lit(REFUSED)).alias("decision"),
        )
    )
