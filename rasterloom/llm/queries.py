"""One query per operator over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    exact_dedup,
    html_template,
    katz,
    language,
    line_dedup,
    ngram_join,
    periodic_runs,
    piece_sampling,
    secret_scan,
    simhash,
    token_alignment,
    toxicity,
)
from .text import remainder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.train(docs, labels, usable=remainder("doc_id", 5) != 0)
    return toxicity.toxicity(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted"
    )


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"), keep="largest")


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language.train(docs.where(remainder("doc_id", 3) != 1))
    return language.identify(docs, model).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").alias("n_spans"),
    )


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_template.extract(_table(spark, folder, "pages"))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = secret_scan.secret_scan(_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in secret_scan.BASE_KINDS],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return piece_sampling.encode(docs).select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "lossless"
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op9_katz(spark: SparkSession, folder: str) -> DataFrame:
    scored = katz.score(_table(spark, folder, "documents"), train=remainder("doc_id", 7) != 2)
    return scored.select(
        "doc_id",
        (remainder("doc_id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def with_repeats(docs: DataFrame) -> DataFrame:
    """The documents; in every tenth by crc32 of its id the words from a place on repeat the first few of them. Null ids stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g")).withColumn(
        "w", F.when((F.col("h") % 10 == 0), words)
    )
    n = F.size("w")
    at = chosen.withColumn("n", n).withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    again = F.transform(
        F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))
    )
    changed = F.array_join(F.concat(F.slice("w", 1, F.col("a")), again), " ")
    return at.withColumn("p", period).select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_repeats(_table(spark, folder, "documents")))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    row = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("b")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b.s")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.p")).alias("period"),
        F.floor(1000 * F.col("b.length") / -F.col("b.p")).alias("exponent_milli"),
        F.sha2(F.array_join(row, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.link_counts(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language": op3_language,
    "op4_decontaminate": op4_decontaminate,
    "op5_html": op5_html,
    "op6_secrets": op6_secrets,
    "op7_pieces": op7_pieces,
    "op8_line_dedup": op8_line_dedup,
    "op9_katz": op9_katz,
    "op10_simhash": op10_simhash,
    "op11_ngram_join": op11_ngram_join,
    "op12_runs": op12_runs,
    "op13_alignment": op13_alignment,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)
    """,
    "op4_decontaminate": r"""
        WITH w AS (
            SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS words,
                false AS item FROM documents
            UNION ALL
            SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+'), true FROM benchmark
        ), s AS (
            SELECT DISTINCT id, item, unnest(list_transform(range(len(words) - 4),
                lambda i: array_to_string(words[i + 1 : i + 5], ' '))) AS shingle FROM w
        ), q AS (
            SELECT id AS item_id, shingle, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE item
        )
        SELECT s.id AS doc_id, item_id, count(*)::INTEGER AS n_shared, any_value(n_item)::INTEGER AS n_item,
            count(*) / any_value(n_item) AS containment
        FROM q JOIN s USING (shingle) WHERE NOT s.item
        GROUP BY s.id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
    """,
    "op8_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), raw AS (
            SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM split
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM raw
        ), owned AS (
            SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM owned GROUP BY doc_id
    """,
}
