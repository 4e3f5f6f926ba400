"""Sets of word shingles as arrays, exact links between them, and what can be told of two sets without comparing them.

``linked`` finds the components of groups of rows under a test of pairs, however large a group is: a group is cut into tiles that
a task holds at once. Every pair inside a tile is settled there, since only rows not yet connected are tested. Of large
groups, the least row of each component of each tile meets its like next, and at last every row outside a group's largest
component meets the group's rows of other components. Each step returns spanning forests, never all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.components import contract
from rasterloom.session import written

from .text import LOWER, chain, flat, hash_spans, mix, pack_sorted, pieces, unpack_sorted, word_bounds

#: Rows of a tile, and shingles of all its sets together.
TILE_ROWS, TILE_SHINGLES = 4096, 1 << 21


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of all texts, and where each text's begin (one entry more than texts).

    Words end at ASCII white space, A-Z count as a-z. Texts of fewer words have one shingle, texts of none have none.
    """
    data, offsets = flat(texts)
    data = LOWER[data]
    first, last, of = word_bounds(data, offsets)
    words = hash_spans(data, first, last)
    sizes = np.bincount(of, minlength=len(texts))
    begins = np.cumsum(sizes) - sizes
    whole = np.flatnonzero(of[: max(0, len(of) - width + 1)] == of[width - 1 :])
    found, owners = [chain(words, width)[whole]], [of[whole]]
    for few in range(1, width):
        short = np.flatnonzero(sizes == few)
        found.append(mix(chain(words, few)[begins[short]] + np.uint64(few)))
        owners.append(short)
    hashes, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def set_keys(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; the empty set has zero."""
    keys = np.zeros(len(cuts) - 1, np.uint64)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        keys[full] = mix(np.add.reduceat(mix(hashes + np.uint64(1)), cuts[full]))
    return keys


def part_counts(hashes: np.ndarray, most_bits: int) -> bytes:
    """How many of the ascending hashes fall into each of equal ranges, 255 standing for more.

    The ranges hold two to four each on average, but are sixteen at least and ``2^most_bits`` at most.
    """
    bits = min(most_bits, max(4, (max(len(hashes), 1) - 1).bit_length() - 2))
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _folded(counts: np.ndarray, size: int) -> np.ndarray:
    return counts.reshape(*counts.shape[:-1], size, -1).sum(axis=-1, dtype=np.int32)


class Sets:
    """Shingle sets of a tile with numbers in place of hashes; one of them meets many at once."""

    def __init__(self, packed: list[bytes], similar: tuple[int, int]):
        parts = [unpack_sorted(p) for p in packed]
        self.similar = similar
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        every = np.concatenate([*parts, np.zeros(0, np.uint64)])
        known, self.numbers = np.unique(every, return_inverse=True)
        self.mark = np.zeros(len(known), dtype=bool)

    def __call__(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others (ascending, not empty) share enough shingles with the one."""
        part, of = self.similar
        n, sizes = int(self.sizes[one]), self.sizes[others]
        fit = np.flatnonzero((of * sizes >= part * n) & (of * n >= part * sizes) & (sizes > 0))
        out = np.zeros(len(others), dtype=bool)
        if not n or not len(fit):
            return out
        mine = self.numbers[self.cuts[one] : self.cuts[one + 1]]
        self.mark[mine] = True
        chosen, sizes = others[fit], sizes[fit]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.cuts[chosen] - (ends - sizes), sizes)
        shared = np.add.reduceat(self.mark[self.numbers[at]].astype(np.int64), ends - sizes)
        self.mark[mine] = False
        out[fit] = of * shared >= part * (n + sizes - shared)
        return out


class Filtered:
    """Rows of a prefix n-gram: length, positional and suffix filter in place of the sets themselves."""

    def __init__(self, n: np.ndarray, pos: np.ndarray, counts: list[bytes], similar: tuple[int, int]):
        self.n, self.pos, self.similar = n, pos, similar
        self.counts = [np.frombuffer(c, np.uint8) for c in counts]
        self.full = np.array([c.max() == 255 for c in self.counts])
        self.size = np.array([len(c) for c in self.counts])

    def __call__(self, one: int, others: np.ndarray) -> np.ndarray:
        part, of = self.similar
        n, m = int(self.n[one]), self.n[others]
        # What both hold before the n-gram in the common order, the n-gram, and what both have left after it.
        here, there = int(self.pos[one]), self.pos[others]
        most = np.minimum(here, there) + 1 + np.minimum(n - here, m - there) - 1
        fits = (of * m >= part * n) & (of * n >= part * m) & ((part + of) * most >= part * (n + m))
        # The counts of two sets differ in sum by no more than the sets do.
        unsure = np.flatnonzero(fits & ~self.full[others]) if not self.full[one] else np.zeros(0, np.int64)
        for size in np.unique(self.size[others[unsure]]).tolist():
            mine = unsure[self.size[others[unsure]] == size]
            least = min(size, int(self.size[one]))
            theirs = _folded(np.stack([self.counts[k] for k in others[mine]]), least)
            apart = np.abs(theirs - _folded(self.counts[one], least)).sum(axis=1)
            fits[mine] = (part + of) * apart <= (of - part) * (n + m[mine])
        return fits


Test = Callable[[int, np.ndarray], np.ndarray]


def _forest(test: Test, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``n`` rows: whoever joins a component meets those still outside."""
    out: list[tuple[int, int]] = []
    outside = np.arange(n)
    while len(outside):
        queue, outside = [int(outside[0])], outside[1:]
        while queue and len(outside):
            one = queue.pop()
            near = test(one, outside)
            got = outside[near]
            out += [(one, int(k)) for k in got]
            queue += got.tolist()
            outside = outside[~near]
    return out


def _across(test: Test, ask: np.ndarray, roots: np.ndarray, keys: np.ndarray) -> list[tuple[int, int]]:
    """Links of the rows that ask to those that do not, or, where all ask, among themselves; inside components none."""
    out: list[tuple[int, int]] = []
    where = np.unique(roots, return_inverse=True)[1]
    all_ask = bool(ask.all())
    for one in np.flatnonzero(ask).tolist():
        others = np.flatnonzero((where != where[one]) & ((keys < keys[one]) if all_ask else ~ask))
        for k in others[test(one, others)].tolist():
            if where[k] != where[one]:
                out.append((one, k))
                where[where == where[one]] = where[k]
    return out


Prepare = Callable[[pa.Table], Test]


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted partitions, group by group."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            mark = tuple(int(c[low]) for c in columns)
            if held and mark != last:
                yield pa.Table.from_batches(held)
                held = []
            last = mark
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


_EDGES = "u long, v long"


def _edges(links: list[tuple[int, int]], keys: np.ndarray) -> pa.RecordBatch:
    pairs = keys[np.array(links, np.int64).reshape(-1, 2)]
    return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["u", "v"])


def _in_tiles(tiled: DataFrame, prepare: Prepare) -> DataFrame:
    """Forests of the tiles ``g, t``; rows of a tile come by size and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _groups(batches, ["g", "t"]):
            if tile.num_rows > 1:
                links = _forest(prepare(tile), tile.num_rows)
                if links:
                    yield _edges(links, tile.column("key").to_numpy())

    sorted_ = tiled.repartition("g", "t").sortWithinPartitions("g", "t", "n", "key")
    return sorted_.mapInArrow(run, _EDGES)


def _between(rows: DataFrame, prepare: Prepare) -> DataFrame:
    """Links between components in the tiles ``g, t, s`` of rows that ``ask`` and rows that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _groups(batches, ["g", "t", "s"]):
            ask = tile.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            roots, keys = tile.column("root").to_numpy(), tile.column("key").to_numpy()
            if ask.any() and roots.min() < roots.max():
                links = _across(prepare(tile), ask, roots, keys)
                if links:
                    yield _edges(links, keys)

    sorted_ = rows.repartition("g", "t", "s").sortWithinPartitions("g", "t", "s", "n", "key")
    return sorted_.mapInArrow(run, _EDGES)


def _tiles(count: Column, weight: Column, rows: int, shingles: int) -> Column:
    return F.greatest(F.ceil(count / rows), F.ceil(weight / shingles), F.lit(1)).cast("int")


def linked(
    members: DataFrame, prepare: Prepare, name: str, rows: int = TILE_ROWS, shingles: int = TILE_SHINGLES
) -> DataFrame:
    """``pair_id, u, v`` (u > v): edges that connect, within each group ``g``, all rows the test links, directly or by others.

    ``members`` has ``g`` and ``key`` (long, a key once per group), ``n`` (size), and what ``prepare`` reads of a tile.
    """
    sizes = members.groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    large = sizes.withColumn("m", _tiles(F.col("c"), F.col("w"), rows, shingles)).where("m > 1")
    large = written(large.select("g", "m"), f"{name}-large")
    tiled = members.join(large, "g", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    place = F.when(F.col("m") > 1, F.pmod(F.xxhash64("key", "g"), F.col("m"))).otherwise(0).cast("int")
    tiled = tiled.withColumn("t", place)
    found = written(_in_tiles(tiled, prepare).distinct(), f"{name}-tiles")
    edges = found.select(F.lit(0).alias("pair_id"), "u", "v")
    if large.isEmpty():
        return edges

    def rooted(links: DataFrame) -> DataFrame:
        roots = written(contract(links).select(F.col("u").alias("key"), F.col("v").alias("root")), f"{name}-roots")
        rows_ = tiled.where("m > 1").join(roots, "key", "left")
        return written(rows_.withColumn("root", F.coalesce("root", "key")), f"{name}-rooted")

    # The least row of each component in each tile stands for it; these are few where tiles hold copies.
    now = rooted(edges)
    leads = now.groupBy("g", "t", "root").agg(F.min("key").alias("key"))
    leads = now.join(leads.select("g", "t", "key"), ["g", "t", "key"], "left_semi")
    mixed = leads.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("c"))
    before = now.groupBy("g").agg(F.count("*").alias("all"))
    # Where leads are not much fewer, they would only repeat the step.
    worth = mixed.where("a < b").join(before, "g").where("2 * c <= all").select("g")
    leads = written(leads.join(worth, "g", "left_semi").drop("m", "t", "root"), f"{name}-leads")
    if not leads.isEmpty():
        edges = edges.unionByName(linked(leads, prepare, name, rows, shingles))
        now = rooted(edges)

    counted = now.groupBy("g", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    major = counted.groupBy("g").agg(
        F.max_by("root", F.struct("c", "root")).alias("major"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.max("c").alias("top"),
        F.max_by("w", F.struct("c", "root")).alias("top_w"),
    )
    rest = major.where("c > top").withColumn("k", _tiles(F.col("c") - F.col("top"), F.col("w") - F.col("top_w"), rows, shingles))
    rest = written(rest.select("g", "major", "k"), f"{name}-rest")
    if rest.isEmpty():
        return edges
    left = now.join(rest, "g").withColumn("ask", F.col("root") != F.col("major"))
    slot = F.pmod(F.xxhash64("g", "key"), F.col("k")).cast("int")
    numbers = F.sequence(F.lit(0), F.col("k") - 1)
    # Rows that do not ask wait in their tiles for each part of those that do; these visit all tiles, and each other.
    waiting = left.where("not ask").withColumn("s", F.explode(numbers))
    asking = left.where("ask").withColumn("s", slot).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    among = left.where("ask").withColumn("j", F.explode(numbers))
    among = among.withColumn("t", -1 - F.least(slot, "j")).withColumn("s", F.greatest(slot, "j")).drop("j")
    parts = waiting.unionByName(asking).unionByName(among)
    more = written(_between(parts, prepare).distinct(), f"{name}-between")
    return edges.unionByName(more.select(F.lit(0).alias("pair_id"), "u", "v"))


def fetched(docs: DataFrame, asked: DataFrame, width: int, name: str) -> DataFrame:
    """``key, shingles`` (packed) of the asked sets: ``asked`` has their ``key`` and ``least``, an id that holds each.

    ``docs`` has ``doc_id`` and ``text``. An id can have several texts: only asked sets stay, each once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            hashes, cuts = shingle_sets(part.column("text"), width)
            packed = [pack_sorted(hashes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            keys = pa.array(set_keys(hashes, cuts).view(np.int64))
            yield pa.RecordBatch.from_arrays([keys, pa.array(packed, pa.binary())], names=["key", "shingles"])

    held = docs.join(asked.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = held.select("text").mapInArrow(run, "key long, shingles binary").join(asked.select("key"), "key", "left_semi")
    return written(sets.groupBy("key").agg(F.first("shingles").alias("shingles")), name)


def verified(
    docs: DataFrame, classes: DataFrame, candidates: DataFrame, width: int, similar: tuple[int, int], name: str
) -> DataFrame:
    """``key, root`` of the sets in ``classes`` (``key, least, n``): components of the exact links inside candidate components.

    ``candidates`` are edges ``pair_id, u, v``. Each set moves once, to the tile of its component.
    """
    stars = contract(candidates)
    blocks = stars.select(F.col("u").alias("key"), F.col("v").alias("g"))
    blocks = blocks.unionByName(stars.select(F.col("v").alias("key"), F.col("v").alias("g"))).distinct()
    asked = written(blocks.join(classes.select("key", "least", "n"), "key"), f"{name}-asked")
    members = written(asked.join(fetched(docs, asked, width, f"{name}-sets"), "key").drop("least"), f"{name}-blocks")

    def prepare(tile: pa.Table) -> Test:
        return Sets(tile.column("shingles").to_pylist(), similar)

    roots = contract(linked(members, prepare, name)).select(F.col("u").alias("key"), F.col("v").alias("root"))
    rooted = classes.select("key", "least").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(rooted.join(named, "root").select("key", "root", "component_id"), f"{name}-components")
