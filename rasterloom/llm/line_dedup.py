"""Line deduplication over a corpus.

Lines become 128-bit hashes with document and position. They are range-partitioned by all of these, so
one line that holds a third of all rows still spreads over many tasks, sorted inside each task, and
streamed: the first document of a hash is its owner. Where a hash runs over a partition's border, the
owner is settled from two rows per partition. Decisions come back as compressed bitmaps, never as text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.session import written

from .text import ascii_lower, documents

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
_STREAMED = "kind int, h1 long, h2 long, doc_id long, body long, pos int"
_CERTAIN, _PENDING, _OWNER = 0, 1, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    # Two words of hash, seeded differently; ``body`` tells rows apart that repeat an id with another text.
    return (
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select(
            "doc_id",
            F.xxhash64("text").alias("body"),
            F.posexplode(F.split("text", "\n")).alias("pos", "_raw"),
        )
        .where(F.char_length("_raw") >= min_chars)
        .select("doc_id", "body", "pos", line_key(F.col("_raw")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
            "doc_id",
            "body",
            "pos",
        )
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines to dropped lines. A partition's first hash may have begun before: its rows are
    pending, and its least document is reported, as is that of the last hash."""
    opening = last = None  # (h1, h2, first document)
    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, body, pos = (
            batch.column(c).to_numpy(zero_copy_only=False)
            for c in ("h1", "h2", "doc_id", "body", "pos")
        )
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None:
            new[0] = (h1[0], h2[0]) != last[:2]
        owners = np.concatenate([[last[2] if last else doc[0]], doc[new]])
        owner = owners[np.cumsum(new)]
        if opening is None:
            opening = (h1[0], h2[0], doc[0])
        # Rows of the opening hash lead the partition.
        if begun:
            lead = 0
        else:
            other = (h1 != opening[0]) | (h2 != opening[1])
            begun = bool(other.any())
            lead = int(np.argmax(other)) if begun else len(h1)
        last = (h1[-1], h2[-1], owner[-1])
        drop = np.flatnonzero(doc != owner)
        out = np.concatenate([np.arange(lead), drop[drop >= lead]])
        kind = np.full(len(out), _CERTAIN, np.int32)
        kind[:lead] = _PENDING
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (kind, h1[out], h2[out], doc[out], body[out], pos[out])],
            names=["kind", "h1", "h2", "doc_id", "body", "pos"],
        )
    if opening is not None:
        ends = [opening, last]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([_OWNER] * 2, pa.int32()),
                *[pa.array([e[k] for e in ends], pa.int64()) for k in range(3)],
                pa.array([0, 0], pa.int64()),
                pa.array([0, 0], pa.int32()),
            ],
            names=["kind", "h1", "h2", "doc_id", "body", "pos"],
        )


def pack_bits(dropped: np.ndarray, n_lines: int) -> bytes:
    """One bit per line, set where it stays, deflated."""
    bits = np.ones(-(-n_lines // 8) * 8, dtype=bool)  # the padding stays, too
    bits[dropped] = False
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def unpack_bits(blob: bytes, n_lines: int) -> np.ndarray:
    """The decision for each of ``n_lines``; lines after the end of the bitmap stay."""
    bits = np.ones(n_lines, dtype=bool)
    known = np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8))[:n_lines]
    bits[: len(known)] = known
    return bits


@F.pandas_udf(T.BinaryType())
def _bitmaps(positions: pd.Series) -> pd.Series:
    # Lines after the last dropped one stay, so the bitmap may end there.
    return positions.map(lambda p: pack_bits(np.asarray(p), int(max(p)) + 1))


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """``doc_id, body, n_dropped, bitmap`` for each text that loses lines.

    A line of ``min_chars`` code points or more, stripped of ASCII blanks and lower-cased (A-Z), stays only
    in the smallest id that holds it, there with all its repeats. ``body`` is xxhash64 of the text. The
    bitmap ends at the last dropped line; all later lines stay. Null ids and null texts take no part.
    """
    lines = _lines(documents(docs, id_col, text_col), min_chars)
    order = ["h1", "h2", "doc_id", "pos"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = written(ranged.mapInArrow(_stream, _STREAMED), "line-decisions")
    owners = (
        streamed.where(F.col("kind") == _OWNER)
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("owner"))
    )
    # Two rows per partition at most: small by construction.
    settled = (
        streamed.where(F.col("kind") == _PENDING)
        .join(F.broadcast(owners), ["h1", "h2"])
        .where("doc_id <> owner")
    )
    dropped = (
        streamed.where(F.col("kind") == _CERTAIN)
        .select("doc_id", "body", "pos")
        .unionByName(settled.select("doc_id", "body", "pos"))
    )
    return (
        dropped.groupBy("doc_id", "body")
        .agg(F.collect_set("pos").alias("_pos"))
        .select(
            "doc_id",
            "body",
            F.size("_pos").cast("long").alias("n_dropped"),
            _bitmaps("_pos").alias("bitmap"),
        )
    )


def _apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(body: str | None, blob: bytes | None) -> str:
        if body is None:
            return ""
        if blob is None:
            return body
        lines = body.split("\n")
        bits = unpack_bits(blob, len(lines))
        return "\n".join([line for line, keep in zip(lines, bits, strict=True) if keep])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


_kept_text = F.pandas_udf(_apply, T.StringType())


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """The documents with repeated lines removed, all columns kept, plus ``n_lines`` (before) and ``n_dropped``.

    See ``keep_bitmaps``. Null texts come back as empty texts of one line; rows with a null id keep every
    line; repeated rows of one id lose the same lines. Empty tables give none. A text whose lines all go becomes
    the empty text. Columns named like the two new ones are replaced.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars).select(
        F.struct("doc_id", "body", "n_dropped", "bitmap").alias("__line_dedup")
    )
    mark, given = F.col("__line_dedup"), F.col(f"`{text_col}`")
    marked = docs.join(
        bitmaps,
        (F.col(f"`{id_col}`") == mark["doc_id"]) & (F.xxhash64(given) == mark["body"]),
        "left",
    )
    text = F.coalesce(given, F.lit(""))
    changed = F.when(mark.isNull(), text).otherwise(_kept_text(text, mark["bitmap"]))
    return marked.withColumns(
        {
            "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
            "n_dropped": F.coalesce(mark["n_dropped"], F.lit(0)).cast("long"),
            text_col: changed,
        }
    ).drop("__line_dedup")
