"""Rows that may have one of many keys: a Bloom filter built by all tasks, tested before rows are shuffled.

A filter has a fixed greatest size, so it can go to every task. Beyond that size it lets more rows pass; what
passes is joined with the keys themselves afterwards, so results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
_PROBES = 4
_PARTS = 16
_SHAPE = "part int, bits binary"


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of every key: two halves of its hash, combined anew for each probe."""
    keys = keys.astype(np.int64).view(np.uint64)
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(_PROBES, dtype=np.uint64)[:, None]
    return ((low + probes * high) % np.uint64(bits)).astype(np.int64)


def _rows(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    blobs = pa.array([x.tobytes() for x in parts.values()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), blobs], names=["part", "bits"])


def build(keys: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The filter's bytes: 16 MB at most, whatever the number of keys."""
    hashed = keys.select(F.xxhash64(*columns).alias("h"))
    bits = LEAST_BITS
    wanted = BITS_PER_KEY * keys.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, dtype=bool)
        for batch in batches:
            own[_places(batch.column("h").to_numpy(), bits).ravel()] = True
        yield _rows(dict(enumerate(np.split(np.packbits(own), _PARTS))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                found = np.frombuffer(blob, np.uint8)
                sums[part] = sums[part] | found if part in sums else found
        yield _rows(sums)

    table = np.zeros((_PARTS, bits // 8 // _PARTS), np.uint8)
    for row in hashed.mapInArrow(mark, _SHAPE).repartition(_PARTS, "part").mapInArrow(merge, _SHAPE).collect():
        table[row["part"]] |= np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


def may_hold(filled: np.ndarray, columns: Sequence[str | Column], spark) -> Column:
    """True for every row whose columns are a key, and for few others. Types must be those of the keys."""
    shared = spark.sparkContext.broadcast(filled)

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        bits = shared.value
        places = _places(hashes.to_numpy(zero_copy_only=False), 8 * len(bits))
        return pa.array(((bits[places >> 3] >> (7 - (places & 7))) & 1).all(axis=0))

    return test(F.xxhash64(*columns))


def only_keys(rows: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` that may have a key of ``keys``, tested where they are read."""
    return rows.where(may_hold(build(keys, columns), columns, rows.sparkSession))
