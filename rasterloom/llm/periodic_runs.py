"""Periodic runs of words by maximal-pair enumeration.

Two occurrences of the same words are a maximal pair if the words before them differ and the words after them differ. A maximal pair
whose occurrences lie no further apart than they are long covers a stretch whose period is their distance, and nothing next to
the stretch continues that period: it is a run, and every run is one. So runs are read off the
enumeration without extending anything.

The pairs come from the tree of LCP intervals of the text's suffix array, bottom up. A node holds the positions below it, listed by
the word before each (the left words); where two children meet, every position of the smaller one looks for positions
of the larger one that are near enough and have another left word. Nodes shorter than half the least run are never built,
which leaves no tree at all for most texts. Suffix ranks are doubled for all texts of a batch together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import chain, documents, flat, hash_spans, pieces, word_bounds

LEAST = 12


class _Node:
    """Positions below an LCP interval: all in order, and in order for each left word."""

    __slots__ = ("every", "lists")

    def __init__(self, place: int, left: int):
        self.every = [place]
        self.lists = {left: [place]}

    def pairs(self, place: int, left: int, length: int) -> Iterator[int]:
        """Positions with another left word, at most ``length`` away."""
        low = bisect_left(self.every, place - length)
        high = bisect_right(self.every, place + length, low)
        if high == low:
            return
        if len(self.lists) == 1:
            if left not in self.lists:
                yield from self.every[low:high]
            return
        for word, places in self.lists.items():
            if word != left:
                at = bisect_left(places, place - length)
                while at < len(places) and places[at] <= place + length:
                    yield places[at]
                    at += 1

    def absorb(self, other: _Node) -> None:
        for word, places in other.lists.items():
            mine = self.lists.setdefault(word, [])
            for place in places:
                insort(mine, place)
                insort(self.every, place)


def _meet(one: _Node, two: _Node, length: int, found: dict[tuple[int, int], int]) -> _Node:
    """Pairs between two children of a node of this length; the children become one."""
    if len(one.every) < len(two.every):
        one, two = two, one
    for left, places in two.lists.items():
        for place in places:
            for other in one.pairs(place, left, length):
                first, period = min(place, other), abs(place - other)
                key = first, length + period
                # Multiples of a period cover the same stretch: the least one is the period.
                if period < found.get(key, period + 1):
                    found[key] = period
    one.absorb(two)
    return one


def maximal_pairs(
    suffixes: list[int], lcp: list[int], left: list[int], shortest: int
) -> dict[tuple[int, int], int]:
    """Least distance by (start, length) of all stretches that maximal pairs no further apart than long cover.

    ``suffixes`` in lexicographic order, ``lcp[k]`` with the one before, ``left`` the word before each position (negative and distinct
    where there is none). Only pairs of at least ``shortest`` words count.
    """
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, _Node]] = []  # the path of open intervals: length, and what lies below so far

    def close(down_to: int, last: _Node) -> _Node:
        while stack and stack[-1][0] > down_to:
            length, node = stack.pop()
            last = _meet(node, last, length, found)
        return last

    node: _Node | None = None
    for place, shared in zip(suffixes, lcp, strict=True):
        if node is not None:
            if shared < shortest:
                close(0, node)
                stack.clear()
            else:
                node = close(shared, node)
                if stack and stack[-1][0] == shared:
                    node = _meet(stack.pop()[1], node, shared, found)
                stack.append((shared, node))
        node = _Node(place, left[place])
    if node is not None:
        close(0, node)
    return found


def _ranks(words: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... words from every position; ``room`` is how many the text has left."""
    levels = [np.unique(words, return_inverse=True)[1].astype(np.int64) + 1]
    width = 1
    while width < room.max():
        rank = levels[-1]
        second = np.zeros(len(rank), np.int64)
        inside = np.flatnonzero(room > width)
        second[inside] = rank[inside + width]
        levels.append(np.unique(rank * (len(rank) + 2) + second, return_inverse=True)[1].astype(np.int64) + 1)
        width *= 2
    return levels


def _common(levels: list[np.ndarray], room: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many words the stretches from two positions share."""
    shared = np.zeros(len(one), np.int64)
    most = np.minimum(room[one], room[two])
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(shared + (1 << k) <= most)
        a, b = one[fits] + shared[fits], two[fits] + shared[fits]
        shared[fits[levels[k][a] == levels[k][b]]] += 1 << k
    return shared


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every text, by start, then period. ``words`` are hashes, text after text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    shortest = -(-least // 2)
    text = np.repeat(np.arange(len(sizes)), sizes)
    if len(words) < shortest:
        return out
    # A text can hold a run only if some stretch of the shortest length comes twice.
    whole = np.flatnonzero(text[: len(text) - shortest + 1] == text[shortest - 1 :])
    key = chain(words, shortest)[whole]
    order = np.lexsort((key, text[whole]))
    a, b = whole[order[:-1]], whole[order[1:]]
    twice = (key[order[:-1]] == key[order[1:]]) & (text[a] == text[b])
    busy = np.zeros(len(sizes), dtype=bool)
    busy[text[a[twice]]] = True
    if not busy.any():
        return out
    chosen = np.flatnonzero(busy)
    held = np.flatnonzero(busy[text])
    repeated = np.zeros(len(words), dtype=bool)
    repeated[a[twice]] = repeated[b[twice]] = True
    words, text, repeated = words[held], text[held], repeated[held]
    ends = np.cumsum(sizes[chosen])
    room = np.repeat(ends, sizes[chosen]) - np.arange(len(words))
    levels = _ranks(words, room)
    active = np.flatnonzero(repeated)
    active = active[np.lexsort((levels[-1][active], text[active]))]
    shared = np.zeros(len(active), np.int64)
    same = np.flatnonzero(text[active[1:]] == text[active[:-1]])
    shared[same + 1] = _common(levels, room, active[same], active[same + 1])
    starts = ends - sizes[chosen]
    left = np.empty(len(words), np.int64)
    left[1:] = levels[0][:-1]
    left[starts] = -1
    cuts = np.searchsorted(text[active], [*chosen, len(sizes)])
    for k, number in enumerate(chosen):
        mine = active[cuts[k] : cuts[k + 1]] - starts[k]
        if len(mine) < 2:
            continue
        before = left[starts[k] : ends[k]].tolist()
        pairs = maximal_pairs(mine.tolist(), shared[cuts[k] : cuts[k + 1]].tolist(), before, shortest)
        runs = [(start, length, period) for (start, length), period in pairs.items() if length >= least]
        out[number] = sorted(runs, key=lambda r: (r[0], r[2]))
    return out


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words outside what runs repeat: of each run its first period stays, unless another run repeats it."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    return " ".join([w for w, away in zip(words, gone.tolist(), strict=True) if not away])


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST
) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: ``runs`` holds start, length and period in words, by start, then period; ``collapsed``
    is the text's words joined by blanks, without those that a run contains after its first period.

    A run has at least ``least`` words and two periods. Words end at ASCII white space. Null and empty texts have no
    runs and an empty ``collapsed``. Repeated rows and null ids come back once each; other columns do not matter.
    Empty tables give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            data, offsets = flat(part.column("text"))
            first, last, of = word_bounds(data, offsets)
            sizes = np.bincount(of, minlength=part.num_rows)
            raw = data.tobytes()
            spans = np.cumsum(sizes) - sizes
            found = find_runs(hash_spans(data, first, last), sizes, least)
            texts = []
            for k, runs in enumerate(found):
                at = slice(spans[k], spans[k] + sizes[k])
                words = [raw[i:j].decode() for i, j in zip(first[at].tolist(), last[at].tolist(), strict=True)]
                texts.append(_collapsed(words, runs) if runs else " ".join(words))
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rows, kind), pa.array(texts, pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )

    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
