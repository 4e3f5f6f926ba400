"""Registered queries against SQL, and the pipeline stage by stage against brute force."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from check_oracles import connect, differences, entry
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import shingles, simhash
from rasterloom.llm.queries import ORACLES, QUERIES
from test_dedup import brute_lines
from test_texts import brute_contamination

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(FOLDER), FOLDER, name) is None


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(
        [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(extra)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_language_stage_rejects_texts_without_language_only(spark, docs):
    kept = texts(stage("language")(spark, docs, FOLDER))
    before = texts(docs)
    assert set(before) - set(kept) == {9001, 9002, 9003}
    assert all(before[k] == t for k, t in kept.items())


def test_line_stage(spark, docs):
    got = stage("lines")(spark, docs, FOLDER)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    expected = {i: t for i, _, _, t in brute_lines(list(texts(docs).items()))}
    assert texts(got) == expected


def brute_near_copies(rows, width=5):
    """The smallest position reachable over pairs that share 0.8 or more of their shingles."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if root[i] != root[j] and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_near_duplicate_stage_finds_all_copies_of_four_fifths(spark):
    random = np.random.default_rng(4)
    rows = []
    for k in range(12):
        own = [f"w{n}" for n in random.integers(0, 5000, 100 + 20 * k)]
        for share in (0, 0.01, 0.01, 0.015, 0.02, 0.02, 0.03, 0.05):
            words = list(own)
            for at in random.integers(0, len(own), int(share * len(own))):
                words[at] = f"x{random.integers(1 << 30)}"
            rows.append((len(rows), " ".join(words)))
    # A chain: each text is close to its neighbours only.
    line = [f"c{n}" for n in range(220)]
    rows += [(len(rows) + k, " ".join(line[12 * k : 12 * k + 120])) for k in (3, 0, 7, 4, 1, 6, 5, 2)]
    rows += [(9000, None), (9001, " "), (9002, "one Two"), (9003, "one two"), (9004, "one two three"), (9005, "two one")]
    rows = sorted(rows)
    expected = {rows[k][0] for k in set(brute_near_copies(rows))}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("lang", "source", "n_chars"):
        frame = frame.withColumn(name, F.lit(None).cast("long" if name == "n_chars" else "string"))
    got = texts(stage("near_duplicates")(spark, frame.repartition(3), FOLDER))
    assert set(got) == expected and len(expected) < len(rows) - 40


def test_near_duplicate_stage_on_documents(spark, docs):
    rows = sorted(texts(docs).items())
    kept = {rows[k][0] for k in set(brute_near_copies(rows))}
    assert set(texts(stage("near_duplicates")(spark, docs, FOLDER))) == kept


def as_documents(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("lang", "source", "n_chars"):
        frame = frame.withColumn(name, F.lit(None).cast("long" if name == "n_chars" else "string"))
    return frame.repartition(3)


def test_near_duplicate_stage_in_a_large_group(spark, monkeypatch):
    random = np.random.default_rng(8)
    own = [f"w{n}" for n in random.integers(0, 5000, 100)]
    rows = []
    for k in range(2000):
        words = list(own)
        for at in random.integers(0, 100, k % 4):
            words[at] = f"x{random.integers(1 << 30)}"
        rows.append((k, " ".join(words)))
    expected = {rows[k][0] for k in set(brute_near_copies(rows))}
    # Small tiles, so that the group lies in many.
    monkeypatch.setattr(shingles.linked, "__defaults__", (300, 1 << 21))
    monkeypatch.setattr(simhash, "LEAST_WIDE", 256)
    got = texts(stage("near_duplicates")(spark, as_documents(spark, rows), FOLDER))
    # Hardly any of the links lies beyond the radii.
    assert expected <= set(got) and len(set(got) - expected) <= 2 and len(expected) < 600


def test_near_duplicate_stage_judges_rows_not_ids(spark):
    one, two = ("the quick brown fox jumps over the lazy dog again", "an entirely different text of eight words")
    rows = [(3, one), (5, one), (5, two), (None, one), (7, two), (7, two), (8, None), (8, ""), (None, "alone in here"), (9, two + " " * 3)]
    got = stage("near_duplicates")(spark, as_documents(spark, rows), FOLDER).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(3, one), (5, two), (8, None), (None, "alone in here")], key=repr)
    # A smallest row that comes several times stays once.
    got = stage("near_duplicates")(spark, as_documents(spark, [(1, one), (1, one), (1, one + " "), (2, one)]), FOLDER)
    assert [tuple(r) for r in got.select("doc_id", "text").collect()] == [(1, one)]


def test_decontamination_stage(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute_contamination(list(texts(docs).items()), items)}
    assert dirty and set(texts(stage("decontamination")(spark, docs, FOLDER))) == set(texts(docs)) - dirty


def test_whole_pipeline(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and all(r["lossless"] for r in rows)


def test_stages_on_an_empty_table(spark, docs):
    frame = docs.limit(0)
    for name, run in corpus_pipeline.STAGES:
        frame = run(spark, frame, FOLDER)
        assert frame.count() == 0, name
