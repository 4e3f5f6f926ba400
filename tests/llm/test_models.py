"""Toxicity, language identification and the Katz model."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import katz, language, toxicity
from rasterloom.llm.text import chain, flat, hash_spans, unpack, pack, word_bounds

WORDS = [f"{a}{b}{c}" for a, b, c in product("bdgklmnprst", "aeiou", "bdgklmnprst")]


def test_words_of_a_batch_do_not_span_texts():
    texts = pa.array(["one two", None, "", "three ", " four"]).slice(0)
    data, offsets = flat(texts)
    first, last, doc = word_bounds(data, offsets)
    raw = data.tobytes()
    assert [(raw[a:b], d) for a, b, d in zip(first, last, doc, strict=True)] == [
        (b"one", 0), (b"two", 0), (b"three", 3), (b"four", 4),
    ]
    again = hash_spans(np.frombuffer(b"x two", np.uint8), np.array([2]), np.array([5]))
    assert again[0] == hash_spans(data, first, last)[1]
    assert len(chain(again, 2)) == 0
    numbers = np.array([1, 2**40], np.uint64)
    assert (unpack(pack(numbers), np.uint64) == numbers).all()


@pytest.fixture(scope="module")
def labelled(spark):
    random = np.random.default_rng(1)
    bad = ["nasty", "rotten"]
    docs, labels = [], []
    for k in range(900):
        words = random.choice(WORDS, 80).tolist()
        toxic = k % 6 == 0
        if toxic:
            words.insert(random.integers(80), bad[k % 2] + random.choice(["", ",", "!"]))
        docs.append((k, " ".join(words), "en"))
        labels.append((k, int(toxic)))
    docs += [(900, None, None), (901, "", None), (None, "nasty", None)]
    labels += [(900, 1), (None, 1), (5000, 1), (3, None), (4, 7)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, y string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, usable=F.col("doc_id") % 5 != 0)
    assert 0 < len(model[0]) < 5_000
    got = {r[0]: r for r in toxicity.toxicity(docs, model).collect()}
    assert len(got) == 903
    held = [k for k in range(0, 900, 5)]
    right = sum(got[k]["predicted"] == (k % 6 == 0) for k in held)
    assert right >= 0.95 * len(held)
    assert got[900]["score"] == got[901]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.toxicity(docs, model).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_viterbi_against_all_paths():
    random = np.random.default_rng(2)
    sizes = [0, 5, 1, 3, 6]
    doc = np.repeat(np.arange(5), sizes)
    scores = random.normal(0, 3, (len(doc), 3))
    got = language.viterbi(scores, doc, 5, 2.0)

    def worth(path, own):
        switches = sum(a != b for a, b in zip(path, path[1:], strict=False))
        return sum(own[k][s] for k, s in enumerate(path)) - 2.0 * switches

    for d, n in enumerate(sizes):
        own = scores[doc == d]
        best = max(product(range(3), repeat=n), key=lambda p: worth(p, own))
        assert worth(got[doc == d].tolist(), own) == pytest.approx(worth(best, own))


LANGUAGES = {
    "aa": ["the", "and", "thing", "with", "other", "wether"],
    "bb": ["und", "nicht", "schön", "über", "zwei", "straße"],
    "cc": ["один", "слово", "это", "другое", "и", "ещё"],
}


@pytest.fixture(scope="module")
def speech(spark):
    random = np.random.default_rng(4)
    rows = []
    for k in range(300):
        lang = list(LANGUAGES)[k % 3]
        rows.append((k, " ".join(random.choice(LANGUAGES[lang], 12)), lang, "s"))
    rows += [(300, "the AND thing with other und nicht schön über zwei " * 2, None, "s")]
    rows += [(301, None, "aa", None), (302, "", "bb", "s"), (303, "12 34 !?", "cc", "s"), (304, "x", None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)


def test_languages(speech):
    model = language.train(speech.where("doc_id % 2 = 0"))
    got = {r[0]: r for r in language.identify(speech, model).collect()}
    assert all(got[k]["lang_pred"] == list(LANGUAGES)[k % 3] for k in range(300))
    assert [got[k]["lang_pred"] for k in (301, 302, 303)] == ["und"] * 3
    assert [got[k]["score"] for k in (301, 302, 303)] == [0.0] * 3
    spans = [(s["lang"], s["start"], s["end"]) for s in got[300]["spans"]]
    assert spans == [("aa", 0, 24), ("bb", 25, 50), ("aa", 51, 75), ("bb", 76, 101)]
    kept = {r[0] for r in language.filter_languages(speech, model, 0.5).collect()}
    assert kept >= set(range(300)) and not kept & {301, 302, 303}


def test_languages_without_training(speech):
    model = language.train(speech.limit(0))
    assert {r[1] for r in language.identify(speech, model).collect()} == {"und"}
    assert language.identify(speech.limit(0), model).count() == 0


def brute_katz(rows, learned):
    """The model with plain dictionaries; returns scores and the probability function."""
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    words, pairs, starts = Counter(), Counter(), 0
    for i, tokens in texts:
        if learned(i):
            words.update(tokens)
            pairs.update(zip(["<s>", *tokens], tokens, strict=False))
            starts += 1
    n = sum(words.values())

    def factors(counts):
        of = Counter(min(c, katz.RELIABLE + 2) for c in counts.values())
        return katz.discounts(np.array([of[k] for k in range(katz.RELIABLE + 3)]))

    fw, fp = factors(words), factors(pairs)

    def kept(c, f):
        return c - katz.TRIFLE if c > katz.RELIABLE else f[c] * c

    unseen = 1 - sum(kept(c, fw) for c in words.values()) / n

    def word(w):
        return kept(words[w], fw) / n if words[w] else unseen

    followers = defaultdict(list)
    for v, w in pairs:
        followers[v].append(w)

    def count(v):
        return starts if v == "<s>" else words[v]

    def probability(v, w):
        if pairs[v, w]:
            return kept(pairs[v, w], fp) / count(v)
        if not count(v) or v not in followers:
            return word(w)
        left = 1 - sum(kept(pairs[v, x], fp) for x in followers[v]) / count(v)
        return left / (1 - sum(word(x) for x in followers[v])) * word(w)

    out = {}
    for i, tokens in texts:
        score = sum(math.log10(probability(v, w)) for v, w in zip(["<s>", *tokens], tokens, strict=False))
        base = sum(math.log10((words[w] + 1) / (n + len(words) + 1)) for w in tokens)
        out[i] = (len(tokens), sum(words[w] > 0 for w in tokens), n, base, score)
    return out, probability, words


def test_katz_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(katz, "BATCH_BYTES", 2_000)
    monkeypatch.setattr(katz, "BUCKET_KEYS", 300)
    random = np.random.default_rng(6)
    weights = 1 / np.arange(1, len(WORDS) + 1)
    rows = [
        (k, " ".join(random.choice(WORDS, random.integers(1, 40), p=weights / weights.sum())))
        for k in range(300)
    ]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "The SAME the"), (305, "never seen words"), (306, "x" * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected, probability, words = brute_katz(rows, lambda i: i % 7 != 4)
    got = katz.score(frame, train=F.col("doc_id") % 7 != 4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:4] == expected[r[0]][:3]
        assert tuple(r)[4:] == pytest.approx(expected[r[0]][3:], rel=1e-9)
    vocabulary = [*words, b"one unknown word"]
    for v in ("<s>", b"bab", b"never", *list(words)[:5]):
        if v is not None:
            assert sum(probability(v, w) for w in vocabulary) == pytest.approx(1)


def test_katz_without_training_or_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = katz.score(frame, train=F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["score"]) for r in got) == [(1, 0, 0.0), (3, 0, 0.0), (3, 0, 0.0)]
    assert katz.score(frame.limit(0)).count() == 0


def test_discounts_fall_back_where_counts_of_counts_do_not_allow_them():
    assert katz.discounts(np.zeros(8)).tolist() == [0, *[1 - 0.5 / r for r in range(1, 6)], 1]
    usual = katz.discounts(np.array([0, 1000, 300, 150, 90, 60, 40, 200]))
    assert all(0 < d < 1 for d in usual[1:6])


def plain_ftrl(rows, times):
    """FTRL-proximal coordinate by coordinate, as it is published."""
    z, n, bias_z, bias_n = defaultdict(float), defaultdict(float), 0.0, 0.0
    ones = max(1, sum(y for _, y in rows))
    balance = min(10.0, max(1.0, (len(rows) - ones) / ones))

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows[k]
            bias = -bias_z / ((toxicity.BETA + math.sqrt(bias_n)) / toxicity.ALPHA)
            own = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(own.values()) + bias))))
            g = (p - y) * (balance if y else 1.0) * times[k]
            for i, w in own.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w
                n[i] += g * g
            sigma = (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / toxicity.ALPHA
            bias_z += g - sigma * bias
            bias_n += g * g
    return {i: weight(i) for i in z}, -bias_z / ((toxicity.BETA + math.sqrt(bias_n)) / toxicity.ALPHA)


def test_ftrl_equals_a_plain_loop(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 1.5)
    random = np.random.default_rng(2)
    rows = [(np.unique(random.integers(0, 60, 12)), int(random.random() < 0.3)) for _ in range(150)]
    times = random.integers(1, 4, 150).tolist()
    weights, bias = toxicity.fit_ftrl(rows, bits=6, times=times)
    plain, plain_bias = plain_ftrl([(x.tolist(), y) for x, y in rows], times)
    assert bias == pytest.approx(plain_bias)
    assert {i: w for i, w in plain.items() if w} == pytest.approx({i: weights[i] for i in np.flatnonzero(weights)})
    assert 0 < np.count_nonzero(weights) < 60


def test_the_fitting_task_is_bounded_after_the_join(spark, monkeypatch):
    sizes = []
    fit = toxicity.fit_ftrl

    def noted(rows, bits=toxicity.BITS, times=None):
        raise ValueError(f"rows {len(rows)} {sorted(times)}")

    monkeypatch.setattr(toxicity, "fit_ftrl", noted)
    # One id has many texts, another one text many times over, a third a very long one.
    docs = [(1, f"text number {k}") for k in range(40)] + [(2, "always the same")] * 30 + [(3, "long words " * 30_000)]
    labels = [(1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (None, 1), (3, None)]
    frames = (
        spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, y string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )
    with pytest.raises(Exception, match=r"rows 7 \[1, 2, 2, 2, 2, 2, 30\]"):
        toxicity.train(*frames, sample=5)
    monkeypatch.setattr(toxicity, "fit_ftrl", fit)
    scored = toxicity.toxicity(frames[0], toxicity.train(*frames, sample=5))
    assert scored.count() == len(docs) and not sizes


def test_texts_of_unlearned_languages_are_filtered_out(spark):
    words = {
        "en": "the quick brown fox jumps over lazy dogs and runs away with many other things".split(),
        "de": "der schnelle braune fuchs springt über faule hunde und läuft mit anderen dingen davon".split(),
    }
    random = np.random.default_rng(3)
    rows = [(k, " ".join(random.choice(words[lang], 60)), lang) for k, lang in enumerate(["en", "de"] * 60)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    others = [
        (1, "the dogs and the fox"),
        (2, "быстрая коричневая лиса прыгает через ленивых собак"),
        (3, "the fox быстрая коричневая лиса прыгает через собак"),
        (4, "the quick brown fox jumps over лиса"),
        (5, "wszyscy ludzie rodzą się wolni i równi pod względem swej godności"),
        (6, None),
        (7, "12 34"),
        (1, "the dogs and the fox"),
        (8, "der fuchs läuft " * 30_000),
        (9, ""),
    ]
    frame = spark.createDataFrame([(i, t, "x") for i, t in others], "doc_id long, text string, share string")
    kept = language.filter_languages(frame, language.train(learned), 0.5)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 4, 8]
    assert language.filter_languages(frame, language.train(learned.limit(0)), 0.5).count() == 0
