"""Exact deduplication: 128-bit content hash, bytes compared inside the groups.

Only hashes, ids and, once per partition and distinct text, the text itself move. No group is ever
collected: copies are folded on the map side, and rows find their group through a plain join, which
adaptive execution splits where one hash holds many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.session import written

from .text import ascii_lower, documents


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hashed=content_hash,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts
    form one group. ``keep`` names the row that stays: the ``smallest`` or ``largest`` id. A null id never
    stays while its group has another id; a group of null ids has a null ``keep_id`` and keeps its rows.
    Repeated rows of one id count in ``group_size`` and share one decision. Empty tables give none.

    ``hashed`` may be any shorter hash: texts that collide are told apart by their bytes.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("text", ascii_lower(F.col("text")))
    rows = rows.withColumn("h", hashed(F.col("text")))
    # The text is part of the key: Spark compares it byte by byte.
    exact = rows.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = written(exact.withColumn("sha", F.sha2("text", 256)).drop("text"), "exact-groups")
    # The digest tells colliding groups of one hash apart without moving a text again.
    hashes = rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
    found = hashes.join(
        groups.withColumnRenamed("h", "_h"),
        (F.col("h") == F.col("_h")) & (F.col("text_sha256") == F.col("sha")),
        "left",
    )
    return found.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
