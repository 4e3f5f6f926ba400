"""Language identification of whole texts, with spans for mixed ones.

Letter trigrams of all labelled texts are counted per language. A word scores the sum of its trigrams' log
probabilities under each language that writes in the word's script; Viterbi with a price on every switch labels
the words of a text. All texts of a piece step through Viterbi together, so no Python runs per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import documents, flat, mix, pieces

UNKNOWN = "und"
BITS = 16
#: How far a text's trigrams may be, on average, on the way from those of its language (0) to ones that it never has (1).
FAR = 0.6
SWITCH = 12.0
#: A language writes in a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
PIECE = 2 << 20
_OUTSIDE = -1e6
_TOP = 0x32400
# First code points of runs of scripts; 0: letters of no named script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"),
)
_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_STARTS = np.array([start for start, _ in SCRIPTS])
_KIND = np.array([_NAMES.index(name) for _, name in SCRIPTS], dtype=np.int8)


class Letters(NamedTuple):
    """By code point: 1 for a letter, 2 for a mark inside words; lower case; script."""

    kind: np.ndarray
    lower: np.ndarray
    script: np.ndarray


def letters() -> Letters:
    """Made once by the caller; the tables go to the tasks with the functions."""
    kind = np.zeros(_TOP + 1, np.uint8)
    lower = np.arange(_TOP + 1, dtype=np.uint32)
    for c in range(_TOP):
        char = chr(c)
        if char.isalpha():
            kind[c] = 1
            small = char.lower()
            if len(small) == 1:
                lower[c] = ord(small)
        elif unicodedata.category(char)[0] == "M":
            kind[c] = 2
    script = _KIND[np.searchsorted(_STARTS, np.arange(_TOP + 1), "right") - 1]
    return Letters(kind, lower, script)


class Words(NamedTuple):
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    offsets: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    trigrams: np.ndarray  # of every place; only those inside words count
    inside: np.ndarray


def _words(texts: pa.Array, tables: Letters) -> Words:
    """Runs of letters (with their marks), in code points; no word spans two texts."""
    kind, lower, script = tables
    data, _ = flat(texts)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    points = np.minimum(points, _TOP)
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    what = kind[points]
    inside = what > 0
    head = np.zeros(len(points) + 1, dtype=bool)
    head[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    if len(points):
        begins[1:] &= ~inside[:-1] | head[1:-1]
        ends[:-1] &= ~inside[1:] | head[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    small = lower[points].astype(np.uint64)
    before = np.where(begins, np.uint64(32), np.roll(small, 1))
    after = np.where(ends, np.uint64(32), np.roll(small, -1))
    key = mix((before << np.uint64(42)) | (small << np.uint64(21)) | after)
    letters = np.concatenate([[0], np.cumsum(what == 1)])
    return Words(
        first, last, np.searchsorted(offsets, first, "right") - 1, offsets, letters[last] - letters[first],
        script[points[first]], (key >> np.uint64(64 - BITS)).astype(np.int32), inside,
    )


class Model(NamedTuple):
    languages: list[str]
    logp: np.ndarray  # trigram bin x language
    allowed: np.ndarray  # script x language
    tables: Letters


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts over all rows with a language and a text; the rest teaches nothing. No rows: no languages."""

    tables = letters()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        size = (1 << BITS) + len(_NAMES)
        for part in pieces(batches, limit=PIECE):
            w = _words(part.column("text"), tables)
            langs = part.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            bounds = np.zeros(len(w.inside), np.int32)
            starts = w.offsets[:-1][np.diff(w.offsets) > 0]
            owners = code[np.diff(w.offsets) > 0]
            of = np.repeat(owners, np.diff(np.append(starts, len(bounds)))) if len(starts) else bounds
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                total = found.setdefault(lang, np.zeros(size, np.int64))
                total[: 1 << BITS] += np.bincount(w.trigrams[w.inside & (of == k)], minlength=1 << BITS)
                own = code[w.doc] == k
                total[1 << BITS :] += np.bincount(
                    w.script[own], w.letters[own], minlength=len(_NAMES)
                ).astype(np.int64)
        for lang, total in found.items():
            bins = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bins), pa.string()), pa.array(bins.astype(np.int32)), pa.array(total[bins])],
                names=["lang", "bin", "n"],
            )

    rows = documents(docs, id_col, text_col, lang_col).where(
        F.col(lang_col).isNotNull() & F.col("text").isNotNull()
    )
    rows = rows.select("text", F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    # Languages times 2^16 bins: bounded whatever the corpus holds.
    known = counts.toPandas()
    languages = sorted(known["lang"].unique())
    table = np.zeros(((1 << BITS) + len(_NAMES), len(languages)))
    table[known["bin"].to_numpy(np.int64), known["lang"].map(languages.index).to_numpy(np.int64)] = known["n"]
    grams, scripts = table[: 1 << BITS] + SMOOTHING, table[1 << BITS :]
    logp = np.log(grams / grams.sum(axis=0)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, logp, share >= SCRIPT_SHARE, tables)


def _scores(w: Words, model: Model) -> np.ndarray:
    """Word by language; languages that do not write in the word's script are out, unless none does."""
    rows = model.logp[w.trigrams]
    rows[~w.inside] = 0
    total = np.add.reduceat(rows, w.first, axis=0) if len(w.first) else np.zeros((0, rows.shape[1]), np.float32)
    allowed = model.allowed[w.script]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    total[~allowed] = _OUTSIDE
    return total


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, switch: float) -> np.ndarray:
    """Best language of every word; ``doc`` ascends. Ties go to staying, then to the first language."""
    if not len(doc):
        return np.zeros(0, np.int64)
    lengths = np.bincount(doc, minlength=n_docs)
    starts = np.cumsum(lengths) - lengths
    longest_first = np.argsort(-lengths, kind="stable")
    rank = np.empty(n_docs, np.int64)
    rank[longest_first] = np.arange(n_docs)
    place = np.arange(len(doc)) - starts[doc]
    # Words in the order (place in text, rank of text): each step is one slice.
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), "right")
    step = np.concatenate([[0], np.cumsum(active)])
    slot = step[place] + rank[doc]
    ordered = np.empty_like(scores)
    ordered[slot] = scores
    value = np.zeros((n_docs, scores.shape[1]), np.float64)
    stay = np.empty(scores.shape, dtype=bool)
    source = np.empty(len(doc), np.int16)
    for t in range(len(active)):
        low, high = step[t], step[t + 1]
        own = value[: high - low]
        best = own.argmax(axis=1)
        moved = own[np.arange(high - low), best] - switch
        kept = own >= moved[:, None]
        stay[low:high], source[low:high] = kept, best
        value[: high - low] = np.where(kept, own, moved[:, None]) + ordered[low:high]
    state = value.argmax(axis=1)
    label = np.empty(len(doc), np.int64)
    for t in range(len(active) - 1, -1, -1):
        low, high = step[t], step[t + 1]
        now = state[: high - low]
        label[low:high] = now
        state[: high - low] = np.where(stay[np.arange(low, high), now], now, source[low:high])
    return label[slot]


def label(texts: pa.Array, model: Model, switch: float) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Spans of every text (a list array), number of its main language, and that language's share of the letters."""
    n, n_lang = len(texts), len(model.languages)
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    w = _words(texts, model.tables)
    keep = w.letters > 0
    if not n_lang:
        keep[:] = False
    doc, first, last = w.doc[keep], w.first[keep], w.last[keep]
    found = viterbi(_scores(w, model)[keep], doc, n, switch) if len(doc) else np.zeros(0, np.int64)
    weight = np.bincount(doc * max(n_lang, 1) + found, w.letters[keep], n * max(n_lang, 1)).reshape(n, -1)
    total = weight.sum(axis=1)
    best = np.where(total > 0, weight.argmax(axis=1), n_lang)
    score = np.where(total > 0, weight.max(axis=1) / np.maximum(total, 1), 0.0)
    # Spans: a new one at each change of text or label.
    opens = np.ones(len(doc), dtype=bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    heads = np.flatnonzero(opens)
    tails = np.append(heads[1:], len(doc))[: len(heads)] - 1
    base = w.offsets[doc[heads]]
    spans = pa.StructArray.from_arrays(
        [
            pa.array(names[found[heads]], pa.string()),
            pa.array((first[heads] - base).astype(np.int32)),
            pa.array((last[tails] - base).astype(np.int32)),
        ],
        names=["lang", "start", "end"],
    )
    ends = np.searchsorted(doc[heads], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), spans), best, score


def identify(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    switch: float = SWITCH,
) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row from its whole text.

    ``lang_pred`` is the language of most letters, ``score`` its share of them; spans (``lang, start, end`` in code
    points) run from the first to the last word of one label. Null texts, texts without a letter, and every text when the
    model has no language: ``und``, 0, no span. Ties go to the first language by name.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for part in pieces(batches, limit=PIECE):
            spans, best, score = label(part.column("text"), model, switch)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), spans],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:int,`end`:int>>"
    return rows.mapInArrow(run, shape)


def learned_share(texts: pa.Array, model: Model, switch: float, far: float) -> np.ndarray:
    """Of every text the share of its letters in its main language, where that is a learned one.

    Words in a script that no learned language writes are in none. A text is in none if the log probability of the trigrams of the
    words in its main language lies, on average, beyond ``far`` of the way from that language's own to that of an unseen trigram.
    """
    n, n_lang = len(texts), len(model.languages)
    w = _words(texts, model.tables)
    keep = np.flatnonzero(w.letters > 0)
    if not n_lang or not len(keep):
        return np.zeros(n)
    doc, letters = w.doc[keep], w.letters[keep]
    scores = _scores(w, model)[keep]
    found = viterbi(scores, doc, n, switch)
    written_ = model.allowed[w.script[keep]].any(axis=1)
    weight = np.bincount(doc * n_lang + found, letters * written_, n * n_lang).reshape(n, n_lang)
    best = weight.argmax(axis=1)
    share = weight.max(axis=1) / np.maximum(np.bincount(doc, letters, n), 1)
    grams = np.add.reduceat(w.inside.astype(np.int64), w.first)[keep]
    own = written_ & (found == best[doc])
    likely = np.bincount(doc[own], scores[own, found[own]], n)
    count = np.bincount(doc[own], grams[own], n)
    usual = (np.exp(model.logp.astype(np.float64)) * model.logp).sum(axis=0)
    least = usual - far * (usual - model.logp.min(axis=0))
    return np.where(likely >= count * least[best], share, 0.0)


def filter_languages(
    docs: DataFrame, model: Model, min_share: float, text_col: str = "text", switch: float = SWITCH, far: float = FAR
) -> DataFrame:
    """The rows, all columns kept, whose text has a learned language with ``min_share`` of all its letters at least.

    Texts without letters go, and those that ``learned_share`` finds in no learned language: in another script, or unlike any of
    them. Decided row by row, without a shuffle; repeated rows stay or go together, texts are read whole.
    """

    def keep(texts: pa.Array) -> pa.Array:
        kept = []
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for part in pieces(iter([batch]), limit=PIECE):
            share = learned_share(part.column("text"), model, switch, far)
            kept.append((share > 0) & (share >= min_share))
        return pa.array(np.concatenate([*kept, np.zeros(0, bool)]))

    return docs.where(F.arrow_udf(keep, "boolean")(F.col(f"`{text_col}`")))
