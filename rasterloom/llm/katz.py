"""Katz backoff language model: counted, normalised and scored as exchanges of packed keys.

Texts are cut into batches, each one row: its tokens as numbers into the batch's own list of words. A batch asks a question once
for each distinct key it holds (a word, a pair, a context); questions go to buckets by hash, a bucket adds up what all
batches report and answers each of them. So a word pair in a third of all texts is one key per batch, never a hot row, and bytes rather than rows move:

1. words: counts over the training texts, and from them discounts and the unigram model;
2. pairs: counts, and which batch is the first to hold a pair;
3. contexts: what the seen followers of a word hold of both models, summed by the batches that own the pairs, gives the weight
   that backing off after that word needs to be normalised exactly.

Answers are tables in the shared folder, partitioned by bucket. A token's probability is then evaluated recursively:
the discounted pair if it was seen, else the backoff weight of its context times the unigram probability.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.session import written

from .text import LOWER, documents, flat, hash_spans, mix, pack, pack_sorted, pieces, unpack, unpack_sorted, word_bounds

#: Counts up to this are discounted by Good-Turing, larger ones by a trifle, so that every context can back off.
RELIABLE = 5
TRIFLE = 0.01
#: Text of a batch, and keys a bucket receives, about.
BATCH_BYTES, BUCKET_KEYS = 5 << 20, 1_000_000
END, START = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
_PARTS = "batch long, bucket int, kind int, p binary, q binary, r binary"
_ROW = ["batch", "bucket", "kind", "p", "q", "r"]
TOKENS, ASK, ANSWER, STATS, WORDS, SCORES = range(6)


class Batch(NamedTuple):
    train: np.ndarray  # by text
    sizes: np.ndarray  # tokens of each text, the end among them
    words: np.ndarray  # distinct hashes, ascending
    ids: np.ndarray  # of every token, into ``words``


def _row(batch: int, bucket: int, kind: int, p: bytes = b"", q: bytes = b"", r: bytes = b"") -> tuple:
    return batch, bucket, kind, p, q, r


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_ROW)


def tokenize(texts: pa.Array, train: np.ndarray) -> Batch:
    """Words are runs without ASCII blanks, A-Z in lower case; every text ends in one end token."""
    hashes, docs = [], []
    row = 0
    for part in pieces(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        data, offsets = flat(part.column("text"))
        data = LOWER[data]
        first, last, doc = word_bounds(data, offsets)
        hashes.append(hash_spans(data, first, last))
        docs.append(doc + row)
        row += part.num_rows
    n = len(texts)
    doc = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
    sizes = np.bincount(doc, minlength=n) + 1
    ends = np.cumsum(sizes) - 1
    every = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(every), dtype=bool)
    inner[ends] = False
    every[inner] = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    every[ends] = END
    words, ids = np.unique(every, return_inverse=True)
    return Batch(train, sizes, words, ids)


def _stored(batch: Batch) -> tuple[bytes, bytes, bytes]:
    head = pack(np.stack([batch.sizes, batch.train.astype(np.int64)]).astype(np.int64).ravel())
    return head, pack_sorted(batch.words), pack(batch.ids.astype(np.uint32))


def _loaded(p: bytes, q: bytes, r: bytes) -> Batch:
    sizes, train = unpack(p, np.int64).reshape(2, -1)
    return Batch(train.astype(bool), sizes, unpack_sorted(q), unpack(r, np.uint32).astype(np.int64))


def pair_keys(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: hash of the pair with its context, and the context's number (-1: the start)."""
    context = np.concatenate([[-1], batch.ids[:-1]]) if len(batch.ids) else batch.ids
    context[np.cumsum(batch.sizes) - batch.sizes] = -1
    hashes = np.append(batch.words, START)
    return mix(mix(hashes[context] + np.uint64(1)) + batch.words[batch.ids]), context, hashes


def _asked(keys: np.ndarray, payload: list[np.ndarray], batch: int, buckets: int) -> list[tuple]:
    """A row per bucket for ascending distinct keys; buckets are ranges of keys."""
    step = np.uint64(-(-(1 << 64) // buckets)) if buckets > 1 else np.uint64(0)
    bucket = (keys // step).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    return [
        _row(batch, b, ASK, pack_sorted(keys[low:high]), *[pack(x[low:high]) for x in payload])
        for b, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))
        if high > low
    ]


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list]:
    """All keys of a bucket sorted, their order, where each distinct one begins; batches and their sizes."""
    batches = group.column("batch").to_pylist()
    parts = [unpack_sorted(p) for p in group.column("p").to_pylist()]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys, order, heads, batches, [len(x) for x in parts]


def _count_bucket(group: pa.Table) -> pa.Table:
    """Answers to counts: total << 1, the last bit set for the first batch with the key in training; and the histogram."""
    keys, order, heads, batches, sizes = _gathered(group)
    counts = np.concatenate([unpack(q, np.uint32) for q in group.column("q").to_pylist()]).astype(np.int64)[order]
    totals = np.add.reduceat(counts, heads)
    of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
    held = counts > 0
    nth = np.cumsum(held)
    first = held & (nth - (nth[heads] - held[heads])[of] == 1)
    answer = np.empty(len(keys), np.uint64)
    answer[order] = ((totals[of] << 1) | first).astype(np.uint64)
    bucket = group.column("bucket")[0].as_py()
    cuts = np.cumsum([0, *sizes])
    rows = [
        _row(b, bucket, ANSWER, pack(answer[low:high]))
        for b, low, high in zip(batches, cuts, cuts[1:], strict=False)
    ]
    seen = totals[totals > 0]
    histogram = np.bincount(np.minimum(seen, RELIABLE + 2), minlength=RELIABLE + 3)
    rows.append(_row(-1, bucket, STATS, np.array([seen.sum(), len(seen), *histogram], np.int64).tobytes()))
    return pa.Table.from_batches([_record(rows)])


def _totals(answers: DataFrame) -> np.ndarray:
    """Tokens, types, and how many types have count 0, 1, ... ; one short row per bucket."""
    total = np.zeros(RELIABLE + 5, np.int64)
    for row in answers.where(F.col("kind") == STATS).select("p").toLocalIterator():
        total += np.frombuffer(row[0], np.int64)
    return total


def discounts(types_by_count: np.ndarray) -> np.ndarray:
    """What remains of a count r = 0..RELIABLE + 1 (the last for all larger), as a factor.

    Good-Turing after Katz; where the counts of counts do not allow it, half a count is taken off.
    """
    n = types_by_count.astype(float)
    k = RELIABLE
    out = np.ones(k + 2)
    out[0] = 0
    for r in range(1, k + 1):
        value = 0.0
        if n[1] > 0 and n[r] > 0:
            tail = (k + 1) * n[k + 1] / n[1]
            value = ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail) if tail < 1 else 0.0
        out[r] = value if 0 < value < 1 else 1 - 0.5 / r
    return out


def _kept(counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    usual = factor[np.minimum(counts, RELIABLE + 1)] * counts
    return np.where(counts > RELIABLE, counts - TRIFLE, usual)


class Model(NamedTuple):
    tokens: int
    types: int
    texts: int
    word_factor: np.ndarray
    pair_factor: np.ndarray
    unseen: float  # probability of a word that training lacks

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Unigram probability by count; all unknown words together are one word."""
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, _kept(counts, self.word_factor) / self.tokens, self.unseen)


def _score(batch: int, rows: pa.Table, model: Model, buckets: int) -> list[tuple]:
    kinds = np.array(rows.column("kind").to_pylist())
    bucket = np.array(rows.column("bucket").to_pylist())
    columns = {c: rows.column(c).to_pylist() for c in "pqr"}
    at = int(np.flatnonzero(kinds == TOKENS)[0])
    own = _loaded(columns["p"][at], columns["q"][at], columns["r"][at])

    def answers(kind: int) -> np.ndarray:
        mine = np.flatnonzero(kinds == kind)
        mine = mine[np.argsort(bucket[mine], kind="stable")]
        return np.concatenate([unpack(columns["p"][k], np.uint64) for k in mine]).astype(np.int64)

    count = answers(WORDS) >> 1
    keys, context, hashes = pair_keys(own)
    _, sample, of = np.unique(keys, return_index=True, return_inverse=True)
    answer = answers(ANSWER)
    pair, first = answer >> 1, (answer & 1).astype(bool)
    before = np.append(count, model.texts)  # by context number; the start is last
    word = model.word(count)
    kept = _kept(pair, model.pair_factor) / np.maximum(before[context[sample]], 1)
    # Followers this batch is the first to hold, summed by context.
    mine = np.flatnonzero(first)
    slot = context[sample[mine]] % len(before)
    held = np.bincount(slot, kept[mine], len(before))
    low = np.bincount(slot, word[own.ids[sample[mine]]], len(before))
    # Tokens whose pair is unseen after a known context need that context's weight.
    c = before[context]
    token_word, seen = word[own.ids], pair[of] > 0
    log = np.log10(np.where(seen, kept[of], token_word))
    waiting = ~seen & (c > 0)
    text = np.repeat(np.arange(len(own.sizes)), own.sizes)
    n = len(own.sizes)
    base = np.log10((count[own.ids] + 1) / (model.tokens + model.types + 1))
    out = np.stack(
        [np.bincount(text, x, n) for x in (log, base, count[own.ids] > 0)] + [own.sizes.astype(float)]
    )
    need = np.flatnonzero(np.bincount(context[waiting] % len(before), minlength=len(before)))
    asked = np.union1d(np.unique(slot), need)
    order = asked[np.argsort(hashes[asked], kind="stable")]
    wanted = np.isin(order, need)
    result = _asked(hashes[order], [np.stack([held[order], low[order]], axis=1).view("V16").ravel(), wanted.astype(np.uint8)], batch, buckets)
    place = np.searchsorted(hashes[order], hashes[context[waiting]])
    pairs, times = np.unique(np.stack([text[waiting], place]), axis=1, return_counts=True)
    return [
        _row(batch, -1, SCORES, out.tobytes(), pack(pairs.astype(np.uint32).ravel()), pack(times.astype(np.uint32))),
        *result,
    ]


def _weigh_bucket(group: pa.Table) -> pa.Table:
    """Backoff weight of every context somebody waits for."""
    keys, order, heads, batches, sizes = _gathered(group)
    sums = np.concatenate([unpack(q, np.dtype("V16")) for q in group.column("q").to_pylist()])
    sums = sums.view(np.float64).reshape(-1, 2)[order]
    total = np.add.reduceat(sums, heads, axis=0)
    weight = (1 - total[:, 0]) / np.maximum(1 - total[:, 1], 1e-12)
    of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
    answer = np.empty(len(keys))
    answer[order] = weight[of]
    wanted = [unpack(r, np.uint8).astype(bool) for r in group.column("r").to_pylist()]
    cuts = np.cumsum([0, *sizes])
    bucket = group.column("bucket")[0].as_py()
    rows = [
        _row(b, bucket, ANSWER, answer[low:high][w].tobytes(), pack(w.astype(np.uint8)))
        for b, low, high, w in zip(batches, cuts, cuts[1:], wanted, strict=False)
    ]
    return pa.Table.from_batches([_record(rows)])


def _grouped(frame: DataFrame, key: str, run, shape: str = _PARTS) -> DataFrame:
    return frame.groupBy(key).applyInArrow(run, shape)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row, from its whole text.

    ``train`` is a condition on the column ``doc_id`` (default: all rows) saying which texts are learned from. Null
    and empty texts are the end token alone. ``score`` is the Katz model's log10 probability of the text, ``base_score`` that of the
    unigram model with one added to each count. Repeated rows are counted and scored once each. Without training texts every token
    has probability one in the Katz model.
    """
    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "text", F.coalesce(train if train is not None else F.lit(True), F.lit(False)).alias("train"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def stored() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            flags = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
            own = tokenize(pa.concat_arrays(table.column("text").chunks), flags)
            number = uuid.uuid4().int >> 66
            p, q, r = _stored(own)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([table.column("doc_id").to_pylist()], pa.list_(table.schema.field("doc_id").type))]
                + [pa.array([x], pa.binary()) for x in (p, q, r)]
                + [pa.array([len(own.ids)], pa.int64()), pa.array([int(flags.sum())], pa.int64())],
                names=["batch", "ids", "p", "q", "r", "n", "texts"],
            )

        for part in pieces(batches):
            held.append(part)
            size += part.column("text").nbytes
            if size >= BATCH_BYTES:
                yield stored()
                held, size = [], 0
        if held:
            yield stored()

    shape = f"batch long, ids array<{kind}>, p binary, q binary, r binary, n long, texts long"
    stored = written(rows.mapInArrow(cut, shape), "lm-batches")
    n, texts = stored.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    buckets = max(8, -(-n // BUCKET_KEYS))

    def ask(of_pairs: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    number, p, q, r = (batch.column(c)[k].as_py() for c in ("batch", "p", "q", "r"))
                    own = _loaded(p, q, r)
                    learned = np.repeat(own.train, own.sizes)
                    if of_pairs:
                        keys, of = np.unique(pair_keys(own)[0], return_inverse=True)
                    else:
                        keys, of = own.words, own.ids
                    counts = np.bincount(of[learned], minlength=len(keys)).astype(np.uint32)
                    yield _record(_asked(keys, [counts], number, buckets))

        return run

    source = stored.select("batch", "p", "q", "r")
    words = written(_grouped(source.mapInArrow(ask(False), _PARTS), "bucket", _count_bucket), "lm-words")
    pairs = written(_grouped(source.mapInArrow(ask(True), _PARTS), "bucket", _count_bucket), "lm-pairs")
    of_words, of_pairs = _totals(words), _totals(pairs)
    word_factor, pair_factor = discounts(of_words[2:]), discounts(of_pairs[2:])
    large = of_words[2 + RELIABLE + 1] + of_words[2 + RELIABLE + 2]
    taken = sum((1 - word_factor[r]) * r * of_words[2 + r] for r in range(1, RELIABLE + 1)) + TRIFLE * large
    unseen = float(taken / of_words[0]) if of_words[0] else 1.0
    model = Model(int(of_words[0]), int(of_words[1]), int(texts), word_factor, pair_factor, unseen)

    def meet(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_record(_score(group.column("batch")[0].as_py(), group, model, buckets))])

    tokens = source.select("batch", F.lit(-1).alias("bucket"), F.lit(TOKENS).alias("kind"), "p", "q", "r")
    told = words.where(F.col("kind") == ANSWER).withColumn("kind", F.lit(WORDS))
    both = tokens.unionByName(told).unionByName(pairs.where(F.col("kind") == ANSWER))
    scored = written(_grouped(both, "batch", meet), "lm-scores")
    weights = _grouped(scored.where(F.col("kind") == ASK), "bucket", _weigh_bucket)
    waiting = scored.where(F.col("kind") == SCORES).join(stored.select("batch", "ids"), "batch")
    parts = waiting.select(*_ROW, "ids").unionByName(weights.withColumn("ids", F.array().cast(f"array<{kind}>")))

    def finish(group: pa.Table) -> pa.Table:
        kinds = np.array(group.column("kind").to_pylist())
        at = int(np.flatnonzero(kinds == SCORES)[0])
        p, q, r = (group.column(c).to_pylist() for c in "pqr")
        bucket = np.array(group.column("bucket").to_pylist())
        log, base, known, sizes = np.frombuffer(p[at]).reshape(4, -1)
        mine = np.flatnonzero(kinds == ANSWER)
        weight = []
        for k in mine[np.argsort(bucket[mine], kind="stable")]:
            wanted = unpack(q[k], np.uint8).astype(bool)
            full = np.ones(len(wanted))
            full[wanted] = np.frombuffer(p[k])
            weight.append(full)
        text, place = unpack(q[at], np.uint32).reshape(2, -1).astype(np.int64)
        if len(text):
            gain = np.log10(np.concatenate(weight)[place]) * unpack(r[at], np.uint32)
            log = log + np.bincount(text, gain, len(log))
        count = len(log)
        ids = group.column("ids")[at].values
        return pa.Table.from_arrays(
            [ids, pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array([model.tokens] * count, pa.int64()), pa.array(base), pa.array(log)],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return _grouped(
        parts, "batch", finish,
        f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
