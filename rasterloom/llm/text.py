"""Texts of an Arrow batch as flat arrays: words, hashes, packed integers.

A batch is handled in pieces of a few megabytes, so memory does not depend on the length of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space: blank, tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that belong to no word of letters and digits.
NO_WORD = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def ascii_lower(text: Column) -> Column:
    """The text in lower case, A-Z only. Where all characters are ASCII the faster ``lower`` does the same."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def documents(frame: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns an operator needs, under names of its own: clashing extra columns stay outside."""
    renamed = {id_col: "doc_id", text_col: "text", **{c: c for c in more}}
    return frame.select(*[F.col(f"`{old}`").alias(new) for old, new in renamed.items()])


def pieces(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(low, high - low)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins (one entry more than texts); null counts as empty."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    where = np.frombuffer(offsets, np.int64 if wide else np.int32)
    where = where[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[where[0] : where[-1]], where - where[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and text number of every word; no word spans two texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~apart[data]
    head = np.zeros(len(data) + 1, dtype=bool)
    head[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | head[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | head[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1


class SpanHashes:
    """64-bit hashes of any spans of some bytes: equal bytes hash alike, wherever they lie."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        # Made for each piece: a cache would outlive its task in the reused workers.
        self._inverse = np.cumprod(np.full(n + 1, _INVERSE, np.uint64))
        self._total = np.zeros(n + 1, np.uint64)
        power = np.cumprod(np.full(n, _BASE, np.uint64))
        power *= data.astype(np.uint64) + np.uint64(1)
        np.cumsum(power, out=self._total[1:])

    def raw(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Distinct for distinct spans like the hash, but with its information in the low bits."""
        return (self._total[last] - self._total[first]) * self._inverse[first]

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix(self.raw(first, last) + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return SpanHashes(data)(first, last) if len(first) else np.zeros(0, np.uint64)


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbours, in their order; shorter input gives nothing."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = hashes[:n]
    for k in range(1, width):
        run = mix(run * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + n])
    return run


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: high bytes that are mostly zero cost nearly nothing."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)
