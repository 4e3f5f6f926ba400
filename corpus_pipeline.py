"""The corpus pipeline: five filtering and encoding stages over ``documents``, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, language, line_dedup, piece_sampling, simhash
from rasterloom.session import fresh_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text stays if one learned language holds this share of its letters.
MIN_SHARE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the labelled texts teach stay; those without letters or without a main language go."""
    model = language.train(docs)
    return language.filter_languages(docs, model, MIN_SHARE).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller id holds go. A document that loses all of them stays as an empty text; the next
    stage keeps one of those."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the smallest id. Near fingerprints propose links, and texts that share
    0.8 or more of their five-word shingles are linked. Rows of one id with different texts are judged apart; null ids count as
    greatest; of repeated rows one stays."""
    return simhash.drop_near_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with sampled pieces, and whether decoding them returns the text."""
    return piece_sampling.encode(docs).select(*COLUMNS, "pieces", "lossless")


STAGES: list[tuple[str, Stage]] = [
    ("language", language_id),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Language scores and sampling are no SQL; the tests hold every stage against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
