"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` per label), as packed feature numbers,
and leaves a few thousand non-zero weights, which go to every executor. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.session import written

from .text import LOWER, NO_WORD, documents, flat, hash_spans, mix, pieces, word_bounds

#: Labelled rows of each label that the model sees at most, those with the least hash of their id.
SAMPLE = 6_000
BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 40.0, 1.0
#: How often an equal row can count.
MOST_TIMES = 100
EPOCHS = 4
#: Pairs of words at these distances: 1 is the bigram, others are skip-grams.
DISTANCES = (1, 2, 3)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and text number of every word and pair of words, repeats included.

    Words are runs of letters and digits in lower case (A-Z); no pair spans two texts.
    """
    data, offsets = flat(texts)
    data = LOWER[data]
    first, last, doc = word_bounds(data, offsets, NO_WORD)
    words = hash_spans(data, first, last)
    keys, docs = [words], [doc]
    for d in DISTANCES:
        together = np.flatnonzero(doc[d:] == doc[:-d]) if len(doc) > d else np.zeros(0, np.int64)
        pair = words[together] * np.uint64(2 * d + 1) + np.uint64(d)
        keys.append(mix(mix(pair) + words[together + d]))
        docs.append(doc[together])
    shift = np.uint64(64 - bits)
    return (np.concatenate(keys) >> shift).astype(np.int64), np.concatenate(docs)


def _by_text(keys: np.ndarray, docs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once per text, in the order of texts."""
    both = np.unique((docs << bits) | keys)
    return both & ((1 << bits) - 1), both >> bits


def fit_ftrl(
    rows: list[tuple[np.ndarray, int]], bits: int = BITS, times: list[int] | None = None
) -> tuple[np.ndarray, float]:
    """Weights and bias of FTRL-proximal with a learning rate per coordinate; rows: features, label; how often each counts."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    positive = max(1, sum(y for _, y in rows))
    balance = min(10.0, max(1.0, (len(rows) - positive) / positive))

    def weight(zi, ni):
        shrunk = np.sign(zi) * L1 - zi
        return np.where(np.abs(zi) <= L1, 0.0, shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows[k]
            zi, ni = z[x], n[x]
            w = weight(zi, ni)
            b = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = (p - y) * (balance if y else 1.0) * (times[k] if times else 1)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[x] = zi + g - sigma * w
            n[x] = ni + g * g
            bias_sigma = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA
            bias_z += g - bias_sigma * b
            bias_n += g * g
    return weight(z, n), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    usable: Column | None = None,
    sample: int = SAMPLE,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers of the features with a weight, their weights, and the bias.

    ``usable`` says which labels may be learned (a condition on the labels' ``doc_id``). Null labels, ids and texts
    teach nothing; other labels than 0 and 1 neither. Equal rows of one id, text and label are one row that counts as often as it
    appears, up to ``MOST_TIMES``. The fitting task gets ``sample`` rows of each label at most, whatever the join with ``docs`` gives.
    Without any row all weights are zero.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where("_id IS NOT NULL AND y IN (0, 1)")
    if usable is not None:
        known = known.withColumnRenamed("_id", "doc_id").where(usable).withColumnRenamed("doc_id", "_id")
    order = F.xxhash64("_id")
    # At most 2 x sample rows: a bounded side.
    chosen = known.where("y = 1").orderBy(order, "_id").limit(sample).unionByName(
        known.where("y = 0").orderBy(order, "_id").limit(sample)
    )
    rows = (
        documents(docs, id_col, text_col)
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .where("text IS NOT NULL")
        .select("doc_id", "text", "y")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            keys, doc = _by_text(*features(part.column("text")), BITS)
            ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
            blobs = [keys[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("y"), pa.array(blobs, pa.binary())],
                names=["doc_id", "y", "x"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            seen += list(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "x", "y", "times")], strict=True))
        seen.sort(key=lambda r: r[:3])
        rows = [(np.frombuffer(x, np.int32), y) for _, x, y, _ in seen]
        weights, bias = fit_ftrl(rows, times=[min(t, MOST_TIMES) for *_, t in seen])
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([kept.astype(np.int32).tobytes()]), pa.array([weights[kept].tobytes()]), pa.array([bias])],
            names=["keys", "weights", "bias"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    packed = rows.mapInArrow(extract, f"doc_id {kind}, y int, x binary")
    folded = written(packed.groupBy("doc_id", "y", "x").agg(F.count("*").alias("times")), "labelled-features")
    place = (F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("x"))
    bounded = folded.where("y = 1").orderBy(*place).limit(sample).unionByName(
        folded.where("y = 0").orderBy(*place).limit(sample)
    )
    fitted = bounded.repartition(1).mapInArrow(fit, "keys binary, weights binary, bias double").first()
    if fitted is None:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(fitted[0], np.int32).astype(np.int64), np.frombuffer(fitted[1]), fitted[2]


def toxicity(
    docs: DataFrame,
    model: tuple[np.ndarray, np.ndarray, float],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, score, predicted`` of every row from its whole text.

    Null and empty texts score as texts without features: the bias alone. Repeated rows come back once each.
    """
    keys, weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.float32)
        table[keys] = weights
        for part in pieces(batches):
            found, doc = features(part.column("text"))
            heavy = np.flatnonzero(table[found])
            found, doc = _by_text(found[heavy], doc[heavy], BITS)
            total = bias + np.bincount(doc, table[found], part.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return documents(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
