"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes. A cut is shared if tokens of both end there. An interval of bytes is divided at the shared cut
nearest to its middle, found by bisecting the other side's ends, and both halves are divided again; an interval
without a cut inside is a leaf: one group of tokens on either side. All intervals of a batch are divided at once, level by level.

Inside a group every token of one side overlaps tokens of the other: these are the links. How often two ids are linked is
counted over the corpus: a batch reports each distinct pair once, and asks for the sums of its own pairs, so a pair in a third of
all texts is one row per batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import written

from .text import documents, pack, pieces, unpack

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Text of a batch; a batch asks once for each pair of ids that it links.
BATCH_BYTES = 2 << 20
#: How byte-level vocabularies cut texts before merging, and which bytes stand for themselves in their entries.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class Side(NamedTuple):
    """One tokenizer: what encodes a list of texts, and the bytes of every id."""

    encode: object
    tokens: list[bytes]


def _byte_level(path: str) -> Side:
    import tiktoken

    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    letters = {chr(b): b for b in PLAIN}
    others = [b for b in range(256) if b not in letters.values()]
    letters |= {chr(256 + k): b for k, b in enumerate(others)}
    special = {x["content"] for x in found["added_tokens"] if x["special"]}
    vocabulary = found["model"]["vocab"]
    ranks = {bytes(letters[c] for c in token): k for token, k in vocabulary.items() if token not in special}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in found["model"]["merges"]]
    # Merging by id is merging by the file's order only if later merges have greater ids.
    if merged != sorted(merged):
        raise ValueError("the ids of the byte-level vocabulary do not follow its merges")
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, k in ranks.items():
        tokens[k] = token
    encoder = tiktoken.Encoding("byte-level", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda texts: [encoder.encode_ordinary(" " + t) for t in texts], tokens)


def _piece_level(path: str) -> Side:
    import sentencepiece

    loaded = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [
        bytes([int(p[3:-1], 16)]) if loaded.is_byte(k) else p.replace("▁", " ").encode()
        for k, p in enumerate(loaded.id_to_piece(list(range(loaded.vocab_size()))))
    ]
    return Side(lambda texts: loaded.encode(texts, num_threads=1), tokens)


def _sides(byte_bpe: str, piece_model: str) -> tuple[Side, Side]:
    return _byte_level(byte_bpe), _piece_level(piece_model)


def _beside(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.stack([one, two], axis=1).ravel()


def shared_cuts(
    a: np.ndarray, b: np.ndarray, first_a: np.ndarray, last_a: np.ndarray, first_b: np.ndarray, last_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of either side that end together, given the intervals to divide.

    ``a`` and ``b`` are ascending byte ends. An interval is a range of tokens on either side (last one included)
    whose last tokens end together.
    """
    cuts_a, cuts_b = [last_a], [last_b]
    while True:
        # An end inside an interval is needed on both sides.
        open_ = np.flatnonzero((last_a > first_a) & (last_b > first_b))
        if not len(open_):
            return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))
        first_a, last_a, first_b, last_b = (x[open_] for x in (first_a, last_a, first_b, last_b))
        begin = np.where(first_a > 0, a[first_a - 1], 0)
        centre = np.clip(np.searchsorted(a, (begin + a[last_a]) // 2), first_a, last_a - 1)
        at_a, at_b = np.full(len(centre), -1), np.full(len(centre), -1)
        waiting, reach, width = np.arange(len(centre)), 0, 1
        while len(waiting):
            near = np.arange(reach, reach + width)
            steps = np.stack([near, -near], axis=1).ravel() if reach else near
            low, high, middle = first_a[waiting], last_a[waiting], centre[waiting]
            place = middle[:, None] + steps
            inside = (place >= low[:, None]) & (place < high[:, None])
            ends = a[np.where(inside, place, low[:, None])]
            other = np.searchsorted(b, ends)
            hit = inside & (b[other] == ends)
            nearest = hit.argmax(axis=1)
            rows = np.arange(len(waiting))
            got = hit[rows, nearest]
            at_a[waiting[got]] = place[rows, nearest][got]
            at_b[waiting[got]] = other[rows, nearest][got]
            reach += width
            more = ~got & ((middle - reach >= low) | (middle + reach < high))
            waiting, width = waiting[more], 2 * width
        cut = np.flatnonzero(at_a >= 0)
        at_a, at_b = at_a[cut], at_b[cut]
        cuts_a.append(at_a)
        cuts_b.append(at_b)
        # Halves side by side: intervals stay in order, so that neighbouring searches take the same way.
        first_a, last_a = _beside(first_a[cut], at_a + 1), _beside(at_a, last_a[cut])
        first_b, last_b = _beside(first_b[cut], at_b + 1), _beside(at_b, last_b[cut])


class Aligned(NamedTuple):
    """A batch: tokens of both sides in a row, where each text's begin, and how many lie up to each cut."""

    a: np.ndarray
    b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    text_cut: np.ndarray
    pair: np.ndarray  # a * |B| + b of every link
    text_pair: np.ndarray


def _cumulated(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


def align_texts(texts: list[str | None], one: Side, two: Side) -> Aligned:
    n = len(texts)
    asked = [k for k, t in enumerate(texts) if t]
    whole = [texts[k] for k in asked]
    found: dict[int, tuple[list[int], list[int]]] = {}
    for k, text, ids_a, ids_b in zip(asked, whole, one.encode(whole), two.encode(whole), strict=True):
        raw = b" " + text.encode()
        if b"".join(map(one.tokens.__getitem__, ids_a)) == raw == b"".join(map(two.tokens.__getitem__, ids_b)):
            found[k] = ids_a, ids_b
    text_a = _cumulated([len(found[k][0]) if k in found else 0 for k in range(n)])
    text_b = _cumulated([len(found[k][1]) if k in found else 0 for k in range(n)])
    a = np.array([i for k in found for i in found[k][0]], np.int64)
    b = np.array([i for k in found for i in found[k][1]], np.int64)
    if not found:
        none, zero = np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        return Aligned(a, b, text_a, text_b, none, none, zero, none, zero)
    ends_a = np.cumsum(np.array([len(t) for t in one.tokens], np.int64)[a])
    ends_b = np.cumsum(np.array([len(t) for t in two.tokens], np.int64)[b])
    full = np.flatnonzero(np.diff(text_a))
    at_a, at_b = shared_cuts(
        ends_a, ends_b, text_a[full], text_a[full + 1] - 1, text_b[full], text_b[full + 1] - 1
    )
    both = np.concatenate([ends_a, ends_b])
    both.sort(kind="stable")
    both = both[np.append(both[1:] != both[:-1], True)]  # each stretch between two ends is one link
    pair = a[np.searchsorted(ends_a, both)] * len(two.tokens) + b[np.searchsorted(ends_b, both)]
    text_end = np.concatenate([[0], ends_a])[text_a]
    text_pair = np.searchsorted(both, text_end, "right")
    return Aligned(
        a, b, text_a, text_b, at_a + 1, at_b + 1, np.searchsorted(at_a + 1, text_a, "right"), pair, text_pair
    )


class _Written:
    """Decimal ids with what follows them in the text form of groups."""

    def __init__(self, one: Side, two: Side):
        self.shift = 2 * len(one.tokens)
        self.table = [b"%d%s" % (k, end) for k in range(len(one.tokens)) for end in (b",", b"|")]
        self.table += [b"%d%s" % (k, end) for k in range(len(two.tokens)) for end in (b",", b";")]

    def __call__(self, found: Aligned) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text; empty without tokens."""
        order = np.empty(len(found.a) + len(found.b), np.int64)
        for ids, cuts, before, shift in (
            (found.a, found.cut_a, np.concatenate([[0], found.cut_b[:-1]]), 0),
            (found.b, found.cut_b, found.cut_a, self.shift),
        ):
            last = np.zeros(len(ids), np.int64)
            last[cuts - 1] = 1
            sizes = np.diff(cuts, prepend=0)
            order[np.arange(len(ids)) + np.repeat(before[: len(sizes)], sizes)] = shift + 2 * ids + last
        where = found.text_a + found.text_b
        get = self.table.__getitem__
        return [b"".join(map(get, order[low:high].tolist()))[:-1] for low, high in zip(where, where[1:], strict=False)]


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))


def align(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    byte_bpe: str = BYTE_BPE,
    piece_model: str = PIECES,
) -> DataFrame:
    """``doc_id, a_ids, b_ids, a_sizes, b_sizes`` of every row: tokens of both sides, and how many each group holds.

    Texts that are null, empty, or that one of the two does not spell byte by byte have empty arrays. Strings of special
    tokens are plain text. Repeated rows and null ids come back once each; other columns do not matter. Empty tables give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _sides(byte_bpe, piece_model)
        for part in pieces(batches, limit=BATCH_BYTES):
            found = align_texts(part.column("text").to_pylist(), one, two)
            sizes = [np.diff(cut, prepend=0) for cut in (found.cut_a, found.cut_b)]
            columns = [_lists(found.a, found.text_a), _lists(found.b, found.text_b)]
            columns += [_lists(x, found.text_cut) for x in sizes]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *columns], names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"]
            )

    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
    return rows.mapInArrow(run, f"doc_id {kind}, {shape}")


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def link_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    byte_bpe: str = BYTE_BPE,
    piece_model: str = PIECES,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``count_sum`` adds up how many links of the whole corpus join the same two ids, over the text's links; ``n_best`` counts
    links whose B id is linked with no A id more often. Rows as in ``align``; without tokens all numbers are 0 and
    the digest is ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _sides(byte_bpe, piece_model)
        form = _Written(one, two)
        number = TaskContext.get().partitionId() << 32
        for part in pieces(batches, limit=BATCH_BYTES):
            found = align_texts(part.column("text").to_pylist(), one, two)
            keys, place = np.unique(found.pair, return_inverse=True)
            links = []
            for low, high in zip(found.text_pair, found.text_pair[1:], strict=False):
                own, times = np.unique(place[low:high], return_counts=True)
                links.append(pack(np.concatenate([np.diff(own, prepend=0), times]).astype(np.uint32)))
            counts = np.bincount(place, minlength=len(keys))
            digest = [hashlib.sha256(g).hexdigest() if g else "" for g in form(found)]
            numbers = [np.diff(x) for x in (found.text_a, found.text_b, found.text_cut, found.text_pair)]
            rest = [None] * (part.num_rows - 1)
            columns = [
                pa.array(np.full(part.num_rows, number)),
                part.column("doc_id"),
                *[pa.array(x) for x in numbers],
                pa.array(digest),
                pa.array(links, pa.binary()),
                pa.array([keys.tolist(), *rest], pa.list_(pa.int64())),
                pa.array([counts.tolist(), *rest], pa.list_(pa.int64())),
            ]
            names = ["batch", "doc_id", *_NUMBERS, "groups_sha256", "links", "pairs", "times"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            number += 1

    def meet(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = np.argsort(answers.column("place").to_numpy())
        counts = answers.column("n").to_numpy()[known]
        best = answers.column("best").to_numpy()[known]
        n_best, count_sum = [], []
        for blob in texts.column("links").to_pylist():
            own, times = unpack(blob, np.uint32).reshape(2, -1).astype(np.int64)
            own = np.cumsum(own)
            n_best.append(int(times[best[own]].sum()))
            count_sum.append(int((times * counts[own]).sum()))
        out = texts.select(["doc_id", *_NUMBERS])
        out = out.append_column("n_best", pa.array(n_best, pa.int64()))
        out = out.append_column("count_sum", pa.array(count_sum, pa.int64()))
        return out.append_column("groups_sha256", texts.column("groups_sha256"))

    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    shape = f"batch long, doc_id {kind}, {numbers}, groups_sha256 string, links binary, pairs array<long>, times array<long>"
    stored = written(rows.mapInArrow(run, shape), "aligned")
    asked = stored.where("pairs IS NOT NULL").select(
        "batch", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "_z")
    )
    asked = asked.select("batch", "place", F.col("_z.pairs").alias("pair"), F.col("_z.times").alias("times"))
    totals = written(asked.groupBy("pair").agg(F.sum("times").alias("n")), "link-counts")
    size = len(_piece_level(piece_model).tokens)
    b_id = F.pmod("pair", F.lit(size)).alias("b_id")
    highest = totals.groupBy(b_id).agg(F.max("n").alias("most"))
    ranked = totals.withColumn("b_id", b_id).join(highest, "b_id")
    ranked = ranked.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.select("batch", "place", "pair").join(ranked, "pair").select("batch", "place", "n", "best")
    texts = stored.select(F.col("batch").alias("held"), "doc_id", *_NUMBERS, "groups_sha256", "links")
    return texts.groupBy("held").cogroup(answers.groupBy("batch")).applyInArrow(
        meet, f"doc_id {kind}, {numbers}, n_best long, count_sum long, groups_sha256 string"
    )
