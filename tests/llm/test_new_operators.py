"""N-gram join, periodic runs and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import ngram_join, periodic_runs, queries, shingles, token_alignment

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")

ROWS = [
    (1, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (3, "ONE  two\nthree four five six seven eight nine ten"),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, "Two words"),
    (8, "two Words"),
    (None, "two words"),
    (None, "only here without an id"),
    (9, "la la la la " * 40),
    (9, "la la la la " * 40),
    (10, "word " * 30_000),
    (11, "É été naïve ▁ mark <s> <|endoftext|> 12"),
]


def clashing(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = ("g", "t", "key", "n", "root", "least", "batch", "pairs", "runs", "class_id", "held")
    return frame.withColumns({name: F.lit("clash") for name in names})


def documents_of(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


# N-gram join


def brute_join(rows, width=3, similar=(9, 10)):
    part, of = similar
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for k, own in enumerate(sets):
        for other, shared in Counter(j for s in own for j in held[s]).items():
            if of * shared >= part * (len(own) + len(sets[other]) - shared):
                a, b = sorted((find(k), find(other)))
                root[b] = a
        for s in own:
            held[s].append(k)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    out = []
    for group in members.values():
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), min(ids, default=None)) for k in group]
    return sorted(out, key=repr)


def joined(frame, **how):
    rows = ngram_join.ngram_join(frame, **how).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, rows), key=repr)


def near_texts(seed, groups, members):
    source = random.Random(seed)
    rows = []
    for _ in range(groups):
        own = [f"w{source.randrange(4000)}" for _ in range(source.randrange(30, 160))]
        for _ in range(members):
            words = list(own)
            for _ in range(source.choice([0, 1, 1, 2, 3, 5])):
                words[source.randrange(len(words))] = f"x{source.randrange(1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("tile", [4096, 40])
def test_join_equals_brute_force(spark, monkeypatch, tile):
    # With small tiles every step for large groups runs: tiles, leads, and rows outside the largest component.
    monkeypatch.setattr(shingles.linked, "__defaults__", (tile, 1 << 21))
    line = [f"c{n}" for n in range(400)]
    chain = [(5000 + k, " ".join(line[3 * k : 3 * k + 150])) for k in (3, 0, 7, 4, 1, 6, 5, 2)]
    rows = ROWS + near_texts(1, 6, 8) + [(1000 + k, t) for k, t in near_texts(2, 1, 300)] + chain
    got = joined(clashing(spark, rows))
    assert got == brute_join(rows)
    assert len({r[2] for r in got}) < len(rows) - 100


def test_join_with_other_parameters_and_few_slots(spark):
    rows = near_texts(5, 5, 8)
    assert joined(clashing(spark, rows), width=2, similar=(7, 10), bits=8) == brute_join(rows, 2, (7, 10))


def test_join_of_nothing(spark):
    assert joined(clashing(spark, ROWS).limit(0)) == []


def test_join_names_classes(spark):
    got = ngram_join.ngram_join(clashing(spark, ROWS)).where("doc_id in (1, 2, 3, 8)").collect()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (8, 7)}


@tables
def test_join_query_equals_brute_force(spark):
    got = sorted(map(tuple, queries.op11_ngram_join(spark, FOLDER).collect()), key=repr)
    assert got == brute_join(sorted(documents_of(spark)))


def test_prefixes_of_similar_sets_meet():
    source = np.random.default_rng(3)
    for _ in range(300):
        n = int(source.integers(1, 80))
        one = set(source.choice(10_000, n, replace=False).tolist())
        two = set(one)
        for _ in range(int(source.integers(0, 5))):
            two.discard(next(iter(two), None))
            two.add(int(source.integers(10_000, 20_000)))
        if 10 * len(one & two) >= 9 * len(one | two):
            heads = [set(sorted(s)[: int(ngram_join.prefix_size(np.array([len(s)]), (9, 10))[0])]) for s in (one, two)]
            assert heads[0] & heads[1]


# Periodic runs


def brute_runs(words, least=12):
    n, seen = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                seen.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, length, q) for (s, length), q in seen.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_equal_brute_force():
    source = random.Random(1)
    texts = []
    for _ in range(1500):
        letters, n = source.choice([1, 2, 3, 5, 50]), source.randrange(120)
        text = [source.randrange(letters) for _ in range(n)]
        if n and source.random() < 0.5:
            p, a = source.randrange(1, max(2, n // 3)), source.randrange(n)
            if a + p <= n:
                text = [text[k] if k < a else text[a + (k - a) % p] for k in range(n)]
        texts.append(text)
    hashes = np.array([w for t in texts for w in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = periodic_runs.find_runs(hashes, np.array([len(t) for t in texts]))
    assert got == [brute_runs(t) for t in texts]
    assert sum(map(len, got)) > 500
    # Several runs in each of many texts of two letters with a smaller least length.
    got = periodic_runs.find_runs(hashes, np.array([len(t) for t in texts]), least=4)
    assert got == [brute_runs(t, 4) for t in texts]


def test_runs_of_rows(spark):
    rows = [*ROWS, (20, "a b " * 5), (21, "a b " * 6), (22, "x " + "a b c " * 7 + "a b y"), (23, "A a " * 9)]
    got = periodic_runs.periodic_runs(clashing(spark, rows)).collect()
    expected = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        runs = [(0, len(words), 1)] if len(words) > 1000 else brute_runs(words)
        expected.append((doc_id, runs, brute_collapsed([w.decode() for w in words], runs)))
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert periodic_runs.periodic_runs(clashing(spark, rows).limit(0)).count() == 0


@tables
def test_runs_query_equals_brute_force(spark):
    def row(doc_id, text):
        words = [w for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = brute_collapsed([w.decode() for w in words], runs)
        return (doc_id, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())

    short = [(i, t) for i, t in documents_of(spark) if len(t or "") < 8000]
    expected = {row(*r) for r in short}
    got = {tuple(r) for r in queries.op12_runs(spark, FOLDER).collect()}
    assert expected <= got and len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert sum(r[1] > 0 for r in expected) > 5


# Tokenizer alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(token_alignment.BYTE_BPE)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECES)
    return one, two


def brute_alignment(text, tokenizers):
    """Ids of both sides and the groups, by plain loops over the libraries' own results."""
    one, two = tokenizers
    if not text:
        return [], [], []
    # How byte-level entries spell bytes: visible Latin-1 letters stand for themselves, the others follow from 256 on.
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    spelled = {chr(b): b for b in plain}
    spelled |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    a = one.encode(" " + text, add_special_tokens=False).ids
    b = two.encode(text)
    bytes_a = [bytes(spelled[c] for c in one.id_to_token(k)) for k in a]
    bytes_b = [
        bytes([int(p[3:5], 16)]) if two.is_byte(k) else p.replace("▁", " ").encode()
        for k, p in ((k, two.id_to_piece(k)) for k in b)
    ]
    raw = b" " + text.encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((range(i, k), range(j, m)))
        i, j = k, m
    return list(zip(a, bytes_a, strict=True)), list(zip(b, bytes_b, strict=True)), groups


def brute_links(a, b):
    out, low = [], 0
    spans = []
    for k, raw in b:
        spans.append((low, low + len(raw), k))
        low += len(raw)
    low = 0
    for k, raw in a:
        out += [(k, m) for start, end, m in spans if start < low + len(raw) and low < end]
        low += len(raw)
    return out


def brute_counts(rows, tokenizers):
    found = [brute_alignment(text, tokenizers) for _, text in rows]
    links = [brute_links(a, b) for a, b, _ in found]
    count = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (doc_id, _), (a, b, groups), own in zip(rows, found, links, strict=True):
        text = ";".join(
            ",".join(str(a[k][0]) for k in left) + "|" + ",".join(str(b[k][0]) for k in right) for left, right in groups
        )
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        n_best = sum(count[p] == best[p[1]] for p in own)
        out.append((doc_id, len(a), len(b), len(groups), len(own), n_best, sum(count[p] for p in own), digest))
    return sorted(out, key=repr)


def test_alignment_equals_brute_force(spark, tokenizers):
    rows = [r for r in ROWS if r[0] != 10]
    source = random.Random(2)
    letters = "ab cdeéß€漢字🙂\n\t'0123 .,  "
    rows += [(100 + k, "".join(source.choice(letters) for _ in range(source.randrange(60)))) for k in range(60)]
    got = token_alignment.link_counts(clashing(spark, rows)).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == brute_counts(rows, tokenizers)
    assert token_alignment.link_counts(clashing(spark, rows).limit(0)).count() == 0


def test_alignment_returns_tokens_and_groups(spark, tokenizers):
    rows = [r for r in ROWS if r[0] != 10]
    got = token_alignment.align(clashing(spark, rows)).collect()
    expected = []
    for doc_id, text in rows:
        a, b, groups = brute_alignment(text, tokenizers)
        sizes = [[len(g[side]) for g in groups] for side in (0, 1)]
        expected.append((doc_id, [k for k, _ in a], [k for k, _ in b], *sizes))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_cuts_are_all_found():
    source = np.random.default_rng(5)
    for _ in range(300):
        n = int(source.integers(1, 200))
        a, b = (np.unique(np.append(source.integers(1, n + 1, int(source.integers(0, n + 1))), n)) for _ in range(2))
        at_a, at_b = token_alignment.shared_cuts(a, b, *(np.array([k]) for k in (0, len(a) - 1, 0, len(b) - 1)))
        common = np.intersect1d(a, b)
        assert a[at_a].tolist() == b[at_b].tolist() == common.tolist()
    # No cut but the last in a long text, and many cuts after a long stretch without any.
    a = np.array([*range(1, 200_001, 2), 300_000, *range(300_001, 300_100)])
    b = np.array([*range(2, 200_001, 2), 300_000, *range(300_001, 300_100)])
    assert len(token_alignment.shared_cuts(a, b, *(np.array([k]) for k in (0, len(a) - 1, 0, len(b) - 1)))[0]) == 100


@tables
def test_alignment_query_equals_brute_force(spark, tokenizers):
    rows = documents_of(spark)
    got = {r["doc_id"]: r for r in queries.op13_alignment(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    # Counts run over all texts, so their sum over all links is known from the counts themselves.
    count, of = Counter(), {}
    for doc_id, text in rows:
        a, b, groups = brute_alignment(text, tokenizers)
        i = j = 0
        own, ends = [], [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        while i < len(a) and j < len(b):
            own.append((a[i][0], b[j][0]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        count.update(own)
        of[doc_id] = own, len(a), len(b), len(groups)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    for doc_id, (own, n_a, n_b, n_groups) in of.items():
        r = got[doc_id]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, n_groups, len(own))
        assert r["count_sum"] == sum(count[p] for p in own)
        assert r["n_best"] == sum(count[p] == best[p[1]] for p in own)
