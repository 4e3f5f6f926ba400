"""Exact, line and near deduplication against brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import exact_dedup, line_dedup, simhash

ROWS = [
    (1, "Same text here\nand more", "x", None),
    (2, "same TEXT here\nand more", "x", "y"),
    (3, None, None, None),
    (4, "", "x", "y"),
    (5, "É differs from é", "x", "y"),
    (6, "é differs from é", "x", "y"),
    (None, "same text here\nand more", "x", "y"),
    (7, "alone", None, "y"),
    (7, "alone", None, "y"),
    (8, "word " * 30_000, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that clash with names the operators use.
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, h string, keep_id string").repartition(3)
    return frame.withColumns({name: F.lit("clash") for name in ("fp", "body", "pos", "n_dropped", "root", "_id")})


def lower(text):
    return (text or "").encode().lower().decode()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda t: F.lit(0)])
def test_exact_groups_by_bytes_even_when_hashes_collide(docs, keep, hashed):
    got = exact_dedup.exact_dedup(docs, keep=keep, hashed=hashed).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[lower(text)].append(doc_id)
    expected = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        expected += [(i, best, len(ids), i == best, digest) for i in ids]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def brute_lines(rows, min_chars=10):
    strip = " \t\n\x0b\x0c\r"
    owner = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(strip))
            if len(key) >= min_chars and doc_id is not None:
                owner[key] = min(owner.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if doc_id is None or owner.get(lower(x.strip(strip)), doc_id) == doc_id
        ]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows(frame):
    got = line_dedup.line_dedup(frame).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted(map(tuple, got), key=repr)


def test_lines_edge_cases(docs):
    assert line_rows(docs) == brute_lines([r[:2] for r in ROWS])


def test_lines_one_line_in_most_documents(spark):
    random = np.random.default_rng(3)
    pool = [f"line number {k} of the pool" for k in range(40)]
    rows = []
    for k in range(400):
        own = [str(x) for x in random.choice(pool, 3)] + [f"own line of {k}", " The Frequent Line \t", "short"]
        rows.append((int(k * 7 % 400), "\n".join(random.permutation(own).tolist()) + "\n" * (k % 3)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert line_rows(frame) == brute_lines(rows)


def test_lines_other_line_ends_and_unicode_blanks_stay(spark):
    rows = [(1, "a long enough line  \nsecond line of it"), (2, "a long enough line\n second line of it")]
    assert line_rows(spark.createDataFrame(rows, "doc_id long, text string")) == brute_lines(rows)


def test_bitmap_round_trip():
    bits = line_dedup.unpack_bits(line_dedup.pack_bits(np.array([0, 9]), 10), 21)
    assert np.flatnonzero(~bits).tolist() == [0, 9]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in joined]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_edge_cases(docs):
    got = {(r[0], r[1] & (2**64 - 1)): r[2] for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_fingerprint(t) for _, t, *_ in ROWS]
    roots = brute_components(prints)
    for (doc_id, *_), mark, root in zip(ROWS, prints, roots, strict=True):
        ids = [r[0] for r, other in zip(ROWS, roots, strict=True) if other == root and r[0] is not None]
        assert got[doc_id, mark] == min(ids)


@pytest.mark.parametrize("spread", [0, 3, 64])
def test_forest_of_a_tile_pair_connects_what_its_links_connect(spread):
    random = np.random.default_rng(spread)
    prints = random.integers(0, 2**64, 300, dtype=np.uint64)
    near = prints[random.integers(0, 40, 500)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << random.integers(0, 64, 500, dtype=np.uint64))
    every = np.unique(np.concatenate([prints, near]))
    a, b = every[: len(every) // 2], every[len(every) // 2 :]
    edges = np.concatenate([simhash.link_tiles(a, a, 4), simhash.link_tiles(b, b, 4), simhash.link_tiles(a, b, 4)])
    roots = brute_components([int(x) for x in every])
    place = {int(x): k for k, x in enumerate(every)}
    found = list(range(len(every)))

    def find(i):
        while found[i] != i:
            i = found[i]
        return i

    for u, v in edges.tolist():
        assert (u ^ v).bit_count() <= 4
        x, y = find(place[u]), find(place[v])
        found[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(every))] == roots
    assert len(edges) <= 3 * len(every)


def test_many_tiles_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_TILE", 16)
    random = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(150):
        text = random.choice(words, 60).tolist()
        rows.append((2 * k, " ".join(text)))
        text[random.integers(60)] = "changed"
        rows.append((2 * k + 1, " ".join(text)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    roots = brute_components([brute_fingerprint(t) for _, t in rows])
    assert {r[0]: r[2] for r in got} == dict(enumerate(roots))


@pytest.mark.parametrize(
    "operator", [exact_dedup.exact_dedup, line_dedup.line_dedup, line_dedup.keep_bitmaps, simhash.near_duplicates]
)
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0
