"""Secret scan with corpus-wide ownership.

Candidates are found per text; their hashes are counted by distinct owners and repositories over the whole corpus.
A value that many owners share is a copied example, one that few owners hold looks live. Base candidates are
always reported; the weaker patterns only where ownership and entropy make them look live. Texts are read once
and never shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import written

from .text import flat, pieces

BASE_KINDS = ("assign", "access", "hex")
#: Weaker candidates, reported only if they look live.
MORE_KINDS = ("vendor", "header", "login", "opaque")
KINDS = BASE_KINDS + MORE_KINDS
#: A value that more owners or more repositories hold is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20
MIN_BITS = 3.0

ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MORE = {
    "vendor": re.compile(r"\b(?:gh[pousr]_|glpat-|xox[abprs]-|sk-|npm_|AIza)[A-Za-z0-9_-]{16,}|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", re.A),
    "header": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*"),
    "login": re.compile(r"://[^\s/:@]+:[^\s/:@]{6,}@"),
    "opaque": re.compile(r"[A-Za-z0-9+/_=-]{24,}"),
}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = np.array([chr(b).isalnum() and b < 128 or chr(b) in "+/_=-" for b in range(256)])
_SHORT, _SPANS = 24, pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())])
)


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and value of the base candidates, by start, then kind as listed."""
    lowered = text.lower()
    found = []
    if any(w in lowered for w in _WORDS):
        found += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def more_spans(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Weaker candidates outside the base spans and outside each other, the earlier kinds first."""
    found: list[tuple[int, int, str, str]] = []
    held = [(s, e) for s, e, _, _ in taken]
    for kind, pattern in MORE.items():
        for m in pattern.finditer(text):
            value = m[0]
            if any(s < m.end() and m.start() < e for s, e in held):
                continue
            if kind == "opaque" and not (
                re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)
            ):
                continue
            if entropy(value) >= MIN_BITS:
                held.append(m.span())
                found.append((*m.span(), kind, value))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        data, offsets = flat(part.column("text"))
        # A text without a long run of token characters and without a key word holds no candidate.
        gaps = np.flatnonzero(np.concatenate([[True], ~_RUN[data], [True]]))
        long = np.flatnonzero(np.diff(gaps) > 16)
        run_from, run_to = gaps[long], gaps[long + 1] - 1
        has_run = np.zeros(part.num_rows, dtype=bool)
        for low, high in zip(
            np.searchsorted(offsets, run_from, "right") - 1, np.searchsorted(offsets, run_to, "left"), strict=True
        ):
            has_run[max(low, 0) : high] = True
        spans = []
        for run, text in zip(has_run, part.column("text").to_pylist(), strict=True):
            if not text:
                spans.append([])
                continue
            lowered = text.lower() if not run else ""
            if not (run or "://" in text or "-----BEGIN" in text or any(w in lowered for w in _WORDS)):
                spans.append([])
                continue
            base = base_spans(text)
            both = sorted(base + more_spans(text, base), key=lambda f: (f[0], KINDS.index(f[2])))
            spans.append(
                [
                    {"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).digest()[:16]}
                    for s, e, k, v in both
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("doc_id"), part.column("owner"), pa.array(spans, _SPANS)],
            names=["row", "doc_id", "owner", "spans"],
        )


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """``doc_id, spans`` of every row; a span has ``start, rank, kind, end, owners, repositories, live`` (code points, end exclusive).

    A repository is a row's id, its owner the value of ``owner_col``. ``live`` means that at most ``max_owners`` owners
    and ``max_repositories`` repositories hold the value: one copied into many is an example, also within one owner. Base kinds are always listed, weaker kinds only if live. Null and empty texts have no span; null
    owners count as one owner, null ids as one repository each owner. Repeated rows come back once each and count once.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"),
        F.col(f"`{text_col}`").alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"row long, doc_id {kind}, owner string, spans array<struct<kind:string,start:int,`end`:int,value:binary>>"
    # Written with its row numbers, which are then fixed.
    scanned = written(rows.mapInArrow(_scan, shape), "secret-candidates")
    each = scanned.select("row", "doc_id", "owner", F.explode("spans").alias("span"))
    # Rows are folded before each shuffle: a value in a third of the corpus is one row per task.
    counted = (
        each.select(F.col("span.value").alias("value"), "owner", "doc_id")
        .distinct()
        .groupBy("value", "owner")
        .agg(F.count("*").alias("n"))
        .groupBy("value")
        .agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    )
    held = written(counted, "secret-owners")
    listed = each.withColumn("value", F.col("span.value")).join(held, "value")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("span.kind")).cast("int")
    shown = listed.where(F.col("span.kind").isin(*BASE_KINDS) | live).select(
        "row",
        F.struct(
            F.col("span.start").alias("start"),
            rank.alias("rank"),
            F.col("span.kind").alias("kind"),
            F.col("span.end").alias("end"),
            "owners",
            "repositories",
            live.alias("live"),
        ).alias("span"),
    )
    listed = shown.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("found"))
    # Most rows have no candidate and skip the join.
    bare = scanned.where(F.size("spans") == 0).select("doc_id")
    bare = bare.withColumn("spans", F.array().cast(listed.schema["found"].dataType))
    full = scanned.where(F.size("spans") > 0).select("row", "doc_id").join(listed, "row", "left")
    none = F.array().cast(listed.schema["found"].dataType)
    return bare.unionByName(full.select("doc_id", F.coalesce("found", none).alias("spans")))
