"""Similarity join of documents by the Jaccard similarity of their word n-grams, with prefix filtering.

All documents order their n-grams alike, rare ones first. Two sets that are similar enough share one of their first few n-grams, the
prefix, so sets meet only under prefix n-grams that several sets have. What meets is judged by size (length filter), by
where the n-gram stands in either set (positional filter) and by how many n-grams lie in each range of hashes (suffix filter).
What passes is connected to candidate components, to which each set moves once; there a pair is
compared exactly, at most once, and only while its sets are not connected already.

How rare an n-gram is comes from counts over the whole corpus, added up by hash in a table of fixed size: an n-gram counts as
frequent as all of its slot, so a frequent one never seems rare. Any order gives the same links; a finer one gives fewer candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.key_filter import only_keys
from rasterloom.session import written

from .shingles import Filtered, Test, linked, part_counts, set_keys, shingle_sets, verified
from .text import documents, pack, pieces, unpack

SHINGLE = 3
#: Shared n-grams of all n-grams, as a fraction.
SIMILAR = (9, 10)
#: Slots of the frequency table: 2^22 numbers of two bytes go to every task.
SLOT_BITS = 22
#: Counts of the suffix filter: 2^7 at most.
COUNT_BITS = 7
_PARTS = 64


def frequencies(rows: DataFrame, width: int, bits: int) -> np.ndarray:
    """How many documents hold an n-gram of each slot, 65535 standing for more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for part in pieces(batches):
            slots = np.sort(shingle_sets(part.column("text"), width)[0] >> np.uint64(64 - bits)).astype(np.int64)
            heads = np.flatnonzero(np.diff(slots, prepend=-1))
            total[slots[heads]] += np.diff(np.append(heads, len(slots))).astype(np.uint32)
        counts = [pack(x) for x in np.split(total, _PARTS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_PARTS), pa.int32()), pa.array(counts)], names=["part", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + unpack(blob, np.uint32).astype(np.int64)
        counts = [np.minimum(x, 65535).astype(np.uint16).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(counts, pa.binary())], names=["part", "counts"]
        )

    shape = "part int, counts binary"
    parts = rows.select("text").mapInArrow(count, shape).repartition(_PARTS, "part").mapInArrow(add, shape)
    table = np.zeros((_PARTS, (1 << bits) // _PARTS), np.uint16)
    for row in parts.collect():  # 64 rows of 128 KB, whatever the input
        table[row["part"]] = np.frombuffer(row["counts"], np.uint16)
    return table.ravel()


def prefix_size(n: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Of two sets at least this similar, the first so many n-grams have one in common."""
    part, of = similar
    return np.where(n > 0, n + (-(part * n)) // of + 1, 0)


def _prefixes(rows: DataFrame, rarity, width: int, similar: tuple[int, int], bits: int) -> DataFrame:
    """``doc_id, key, n, prefix, counts``: the n-grams of each text's prefix in the common order, and its part counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        for part in pieces(batches):
            hashes, cuts = shingle_sets(part.column("text"), width)
            sizes = np.diff(cuts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((hashes, table[(hashes >> np.uint64(64 - bits)).astype(np.int64)], owner))
            taken = prefix_size(sizes, similar)
            first = np.arange(len(hashes)) - np.repeat(cuts[:-1], sizes) < np.repeat(taken, sizes)
            ends = np.concatenate([[0], np.cumsum(taken)]).astype(np.int32)
            counts = [part_counts(hashes[a:b], COUNT_BITS) for a, b in zip(cuts, cuts[1:], strict=False)]
            columns = [
                part.column("doc_id"),
                pa.array(set_keys(hashes, cuts).view(np.int64)),
                pa.array(sizes.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[order][first].view(np.int64))),
                pa.array(counts, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "prefix", "counts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key long, n long, prefix array<long>, counts binary")


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    similar: tuple[int, int] = SIMILAR,
    bits: int = SLOT_BITS,
) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of every row: the size of its set of distinct n-grams, the smallest id with
    the same set, and the smallest id reachable over links, itself included.

    Two documents link if they share at least the fraction ``similar`` of all their n-grams. Words end at ASCII white space,
    A-Z count as a-z; fewer words than ``width`` are one n-gram. Documents without words (null, empty, blank) have size 0 and
    their own id in both columns. Null ids take part, but name a class or component only if it has no other id (then null).
    Repeated rows come back once each; other columns do not matter. Empty tables give none. Sets and n-grams are told apart by
    64-bit hashes.
    """
    rows = documents(docs, id_col, text_col)
    rarity = rows.sparkSession.sparkContext.broadcast(frequencies(rows, width, bits))
    prints = written(_prefixes(rows, rarity, width, similar, bits), "ngram-prefixes")
    full = prints.where("n > 0")
    classes = full.groupBy("key").agg(
        F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "prefix", "counts")]
    )
    classes = written(classes, "ngram-classes")
    entries = classes.select("key", "n", "counts", F.posexplode("prefix").alias("pos", "g"))
    shared = entries.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    shared = written(shared, "ngram-shared")
    # Most n-grams of a prefix are in one set alone; they are told off where they are read.
    members = written(only_keys(entries, shared, ["g"]).join(shared, "g"), "ngram-members")

    def prepare(tile: pa.Table) -> Test:
        n, pos = (tile.column(c).to_numpy().astype(np.int64) for c in ("n", "pos"))
        return Filtered(n, pos, tile.column("counts").to_pylist(), similar)

    candidates = linked(members, prepare, "ngram-candidates").distinct()
    components = verified(rows, classes, candidates, width, similar, "ngram")
    named = components.join(classes.select("key", F.col("least").alias("class_id")), "key")
    found = full.select("doc_id", "key", "n").join(named, "key")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    alone = prints.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")
    )
    return found.unionByName(alone)
