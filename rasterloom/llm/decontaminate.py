"""Benchmark decontamination: which documents hold how much of which test item.

Containment of an item in a document is the share of its distinct word shingles that the document holds. Items
are partitioned by size (powers of two); a partition fixes how many of an item's smallest MinHash values form its
sketch: one more than the shingles that a match may lack, so a document that reaches the threshold holds one of
them for certain. Documents of any length probe the sketches with all their shingles in one pass without a shuffle;
what meets a sketch is verified by exact containment of the shingles' text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.session import written

from .text import NO_WORD, chain, documents, flat, hash_spans, pieces, word_bounds

WIDTH = 5
THRESHOLD = 0.8
#: An index is built of blocks of this many items and bytes of text; each block is one pass over the documents.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
_BLOOM = 20


def words(lowered: str) -> list[bytes]:
    """Runs of letters and digits (ASCII) and of all other characters beyond ASCII."""
    data = np.frombuffer(lowered.encode(), np.uint8)
    first, last, _ = word_bounds(data, np.array([0, len(data)]), NO_WORD)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def shingles(of: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(of[k : k + width]) for k in range(len(of) - width + 1)}


class Sketches:
    """Sketches of a block of items, by shingle width and size partition, and their shingles for the exact check."""

    def __init__(self, texts: list[str], width: int, threshold: float):
        self.threshold = threshold
        self.exact: list[tuple[int, set[bytes]]] = []
        by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for number, text in enumerate(texts):
            own = words(text)
            wide = min(width, len(own))
            held = shingles(own, wide) if own else set()
            self.exact.append((wide, held))
            if held:
                by_size[wide, len(held).bit_length()].append((number, self._hashes(own, wide)))
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sketches: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for (wide, _), members in by_size.items():
            size = max(len(h) - math.ceil(threshold * len(h) - 1e-9) + 1 for _, h in members)
            sketches[wide] += [(h[:size], number) for number, h in members]
        for wide, found in sketches.items():
            values = np.concatenate([h for h, _ in found])
            owner = np.repeat([n for _, n in found], [len(h) for h, _ in found])
            order = np.argsort(values, kind="stable")
            bloom = np.zeros(1 << _BLOOM, dtype=bool)
            bloom[(values >> np.uint64(64 - _BLOOM)).astype(np.int64)] = True
            self.index[wide] = values[order], owner[order], bloom

    @staticmethod
    def _hashes(own: list[bytes], wide: int) -> np.ndarray:
        data = np.frombuffer(b" ".join(own), np.uint8)
        first, last, _ = word_bounds(data, np.array([0, len(data)]), NO_WORD)
        return np.unique(chain(hash_spans(data, first, last), wide))

    def candidates(self, lowered: pa.Array) -> list[tuple[int, int]]:
        """Pairs of text and item that share a value of the item's sketch."""
        data, offsets = flat(lowered)
        first, last, doc = word_bounds(data, offsets, NO_WORD)
        hashes = hash_spans(data, first, last)
        pairs: set[tuple[int, int]] = set()
        for wide, (values, owner, bloom) in self.index.items():
            runs = chain(hashes, wide)
            maybe = np.flatnonzero(bloom[(runs >> np.uint64(64 - _BLOOM)).astype(np.int64)])
            maybe = maybe[doc[maybe] == doc[maybe + wide - 1]]
            low = np.searchsorted(values, runs[maybe], "left")
            high = np.searchsorted(values, runs[maybe], "right")
            for at in np.flatnonzero(high > low):
                text = int(doc[maybe[at]])
                pairs.update((text, int(n)) for n in owner[low[at] : high[at]])
        return sorted(pairs)

    def search(self, lowered: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text the items it holds: number, shingles shared, shingles of the item."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(lowered))]
        held: dict[int, set[bytes]] = {}
        current, own = -1, []
        for text, number in self.candidates(lowered):
            if text != current:
                current, own, held = text, words(lowered[text].as_py() or ""), {}
            wide, item = self.exact[number]
            if wide not in held:
                held[wide] = shingles(own, wide)
            shared = len(item & held[wide])
            if shared >= self.threshold * len(item) - 1e-9:
                found[text].append((number, shared, len(item)))
        return found


def _hits(items: list[tuple[object, str]], kind: str, width: int, threshold: float):
    struct = f"array<struct<item_id: {kind}, n_shared: int, n_item: int>>"
    made: list[Sketches] = []

    def search(texts: pa.Array) -> pa.Array:
        if not made:
            lowered = pc.utf8_lower(pa.array([t for _, t in items], pa.string()))
            made.append(Sketches(lowered.to_pylist(), width, threshold))
        found: list[list[dict]] = []
        for part in pieces(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
            for hits in made[0].search(pc.utf8_lower(part.column("text"))):
                found.append(
                    [{"item_id": items[n][0], "n_shared": s, "n_item": m} for n, s, m in hits]
                )
        identity = pa.int64() if kind in ("bigint", "long") else pa.int32() if kind == "int" else pa.string()
        fields = [("item_id", identity), ("n_shared", pa.int32()), ("n_item", pa.int32())]
        return pa.array(found, pa.list_(pa.struct(fields)))

    # Not to be computed twice, for a filter and for the result.
    return F.arrow_udf(search, struct).asNondeterministic()


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """Distinct ``doc_id, text`` of the items in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text.

    Blocks go by the hash of id and text, so an id that repeats with many texts is spread. Null ids and texts are left out.
    """
    known = documents(items, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL").distinct()
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    if blocks == 1:
        return [known]
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    stored = written(known.withColumn("block", number), "items")
    return [stored.where(F.col("block") == k).drop("block") for k in range(blocks)]


def held_items(text: Column, block: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> Column:
    """Array of the items of a block that a text holds: ``item_id, n_shared, n_item``; empty for null and empty texts.

    The block, bounded by ``item_blocks``, is gathered and goes to the tasks that search it.
    """
    rows = sorted((r["doc_id"], r["text"]) for r in block.collect())
    return _hits(rows, block.schema["doc_id"].dataType.simpleString(), width, threshold)(text)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment``, a row for each item a document holds.

    Words are compared in lower case, punctuation apart. An item of fewer than ``width`` words is one shingle of
    all its words; one without words is held by no text. Null ids or texts of items are left out. Documents are taken
    whole, whatever their length; repeated rows report once each; documents that hold nothing report nothing, and
    empty tables give none. Every block of items is a pass over the documents, whose result is written before the next
    block is gathered, so driver and tasks hold one block at a time.
    """
    rows = documents(docs, id_col, text_col)
    blocks = item_blocks(items)
    parts = []
    for block in blocks:
        held = held_items(F.col("text"), block, width, threshold)
        found = rows.select("doc_id", held.alias("hits"))
        found = found.select("doc_id", F.explode("hits").alias("hit")).select(
            "doc_id", "hit.*", (F.col("hit.n_shared") / F.col("hit.n_item")).alias("containment")
        )
        parts.append(found if len(blocks) == 1 else written(found, "contamination"))
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns; null and empty texts stay.

    Blocks are passed as in ``contamination``, each over the rows that the ones before left.
    """
    blocks = item_blocks(items)
    for block in blocks:
        docs = docs.where(F.size(held_items(F.col(text_col), block, width, threshold)) == 0)
        if len(blocks) > 1:
            docs = written(docs, "uncontaminated")
    return docs
