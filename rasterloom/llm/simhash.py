"""SimHash near-deduplication: tiled exact comparison of all fingerprints.

Copies of a fingerprint are folded first. The distinct ones lie in tiles of equal population count; a pair
of tiles meets only if their counts differ by no more than the radius, since a bit that differs changes the
count by one. Inside a pair of tiles the same bound on the counts of the four 16-bit words skips blocks, the
rest is exclusive-or and bit count over numpy arrays. A pair of tiles returns a spanning forest of its
links, never the links themselves, and the forests are contracted by star rounds.

``near_copies`` uses the same comparison as a first step: fingerprints of 128 bits over distinct shingles, with a radius wide enough
for a given Jaccard similarity, propose components of documents, inside which the shingle sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.components import contract
from rasterloom.session import written

from .shingles import set_keys, shingle_sets, verified
from .text import documents, mix, pieces

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Of near copies: words of a shingle, shared shingles of all shingles, and the radii of the first and of both 64-bit words. At a
#: similarity of 0.8 two fingerprints differ in 19.4 of 128 bits, give or take 4.1: of such pairs 0.1 % lie beyond the radii, of closer
#: ones fewer. Unrelated texts lie within them with a probability of 1e-8.
COPY_SHINGLE, COPY_SIMILAR, COPY_RADII = 5, (4, 5), (22, 32)
#: Classes in a tile of near copies.
LEAST_WIDE, MOST_WIDE = 1 << 15, 1 << 20
#: Fingerprints in a tile: the distinct ones spread over TILES tiles, between these sizes.
TILES, LEAST_TILE, MOST_TILE = 64, 1 << 13, 1 << 20
_BLOCK = 128


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority of the bits of XXH64 over word shingles, repeats included; no word gives zero."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 14):
        part = zip(starts[at : at + (1 << 14)], stops[at : at + (1 << 14)], strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row; null and empty texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found = np.array([fingerprint(t.as_py()) for t in part.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _word_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _arranged(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by the counts of their words, with the least and greatest counts of every block."""
    counts = _word_counts(fps)
    order = np.lexsort(counts.T[::-1])
    fps, counts = fps[order], counts[order]
    cuts = np.arange(0, len(fps), _BLOCK)
    return fps, np.minimum.reduceat(counts, cuts), np.maximum.reduceat(counts, cuts)


def _join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Merge the classes of ``label`` along the edges; the edges that merged two classes come back."""
    used: list[tuple[int, int]] = []
    while True:
        a, b = label[u], label[v]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return used
        u, v = u[apart], v[apart]
        high, low = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        # Each class hooks onto one lower class at most, so the edges used form a forest.
        roots, first = np.unique(high, return_index=True)
        used += zip(u[first].tolist(), v[first].tolist(), strict=True)
        parent = np.arange(len(label))
        parent[roots] = low[first]
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
        label[:] = parent[label]


def link_tiles(one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest of the links between (or, given twice the same, inside) two tiles: pairs of fingerprints."""
    same = one is two
    a, a_low, a_high = _arranged(one)
    b, b_low, b_high = (a, a_low, a_high) if same else _arranged(two)
    every = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    label = np.arange(len(every))
    used: list[tuple[int, int]] = []
    index = np.arange(len(b))
    for k in range(len(a_low)):
        gap = np.maximum(0, np.maximum(b_low - a_high[k], a_low[k] - b_high)).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if same:
            near = near[near >= k]
        mine = a[k * _BLOCK : (k + 1) * _BLOCK]
        for at in range(0, len(near), 16):
            picks = np.concatenate([index[j * _BLOCK : (j + 1) * _BLOCK] for j in near[at : at + 16]])
            close = np.bitwise_count(mine[:, None] ^ b[picks][None, :]) <= radius
            if close.any():
                u, v = np.nonzero(close)
                used += _join_labels(label, u + k * _BLOCK, picks[v] + shift)
    return every[np.array(used, dtype=np.int64).reshape(-1, 2)]


def fingerprint_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v`` (u > v): a spanning forest of each tile pair's links between distinct fingerprints ``fp``."""
    weighted = classes.select("fp", F.bit_count("fp").alias("p"))
    counts = {r["p"]: r["count"] for r in weighted.groupBy("p").count().collect()}  # 65 rows at most
    size = min(MOST_TILE, max(LEAST_TILE, -(-sum(counts.values()) // TILES)))
    slots = {p: -(-n // size) for p, n in counts.items()}
    spark = classes.sparkSession
    per_count = spark.createDataFrame([(p, m) for p, m in slots.items()] or [(0, 0)], "p int, m int")
    per_count = per_count.where("m > 0")
    spread = weighted.join(F.broadcast(per_count), "p").withColumn(
        "s", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    )
    tiles = written(spread.groupBy("p", "s").agg(F.collect_list("fp").alias("fps")), "fp-tiles")
    names = tiles.select("p", "s")
    left = names.select(
        F.col("p").alias("p1"),
        F.col("s").alias("s1"),
        F.explode(F.sequence(F.col("p"), F.col("p") + radius)).alias("p"),
    )
    pairs = left.join(names, "p").where("p > p1 OR s >= s1")
    number = sum(
        m * slots.get(p + d, 0) for p, m in slots.items() for d in range(radius + 1)
    )
    both = pairs.join(
        tiles.select(F.col("p").alias("p1"), F.col("s").alias("s1"), F.col("fps").alias("one")),
        ["p1", "s1"],
    ).join(tiles.withColumnRenamed("fps", "two"), ["p", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p1, s1, p, s = (batch.column(c)[k].as_py() for c in ("p1", "s1", "p", "s"))
                one, two = (
                    batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    for c in ("one", "two")
                )
                found = link_tiles(one, one if (p1, s1) == (p, s) else two, radius).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], names=["u", "v"]
                )

    dealt = both.repartition(max(1, min(4096, number)), "p1", "s1", "p", "s")
    return dealt.select("p1", "s1", "p", "s", "one", "two").mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id reachable over links of ``radius`` bits or fewer.

    Null and texts without words have fingerprint zero and link like any other. Null ids take part, but never name
    a component unless it has no other id (then null). Repeated rows come back once each. Empty tables give none.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-classes")
    links = fingerprint_links(classes, radius).select(F.lit(0).alias("pair_id"), "u", "v")
    roots = contract(links.distinct()).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(rooted.join(named, "root").select("fp", "component_id"), "fp-components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def set_fingerprints(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words for each set of distinct shingles: the majority of the bits of two hashes of each shingle."""
    sizes = np.diff(cuts)
    out = []
    for values in (hashes, mix(hashes + np.uint64(1))):
        found = np.zeros(len(sizes), np.uint64)
        full = np.flatnonzero(sizes)
        for bit in range(64 if len(full) else 0):
            ones = np.add.reduceat(((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), cuts[full])
            found[full] |= (2 * ones > sizes[full]).astype(np.uint64) << np.uint64(bit)
        out.append(found)
    return out[0], out[1]


def wide_tile_links(
    one: np.ndarray, two: np.ndarray | None, radii: tuple[int, int], similar: tuple[int, int]
) -> np.ndarray:
    """A spanning forest, as pairs of keys, of the links between two tiles, or inside one.

    A tile has rows of two words, a key and a size. Rows come by size: a block meets the stretch of rows whose sizes allow a link.
    """
    part, of = similar
    one = one[np.argsort(one[:, 3], kind="stable")]
    other = one if two is None else two[np.argsort(two[:, 3], kind="stable")]
    every = one if two is None else np.concatenate([one, other])
    shift = 0 if two is None else len(one)
    label = np.arange(len(every))
    used: list[tuple[int, int]] = []
    f1, f2, sizes = (np.ascontiguousarray(every[:, k]) for k in (0, 1, 3))
    theirs = sizes[shift:]
    for at in range(0, len(one), _BLOCK // 2):
        a1 = f1[at : min(len(one), at + _BLOCK // 2), None]
        least, most = int(sizes[at]), int(sizes[at + len(a1) - 1])
        begin = int(np.searchsorted(theirs, np.uint64(-(-part * least // of))))
        end = int(np.searchsorted(theirs, np.uint64(of * most // part), "right"))
        for low in range(max(begin, at) if two is None else begin, end, 8 * _BLOCK):
            high = min(end, low + 8 * _BLOCK) + shift
            u, v = np.nonzero(np.bitwise_count(a1 ^ f1[None, low + shift : high]) <= radii[0])
            u, v = u + at, v + low + shift
            near = np.bitwise_count(f1[u] ^ f1[v]) + np.bitwise_count(f2[u] ^ f2[v]) <= radii[1]
            near &= u != v
            if near.any():
                used += _join_labels(label, u[near], v[near])
    return every[:, 2][np.array(used, dtype=np.int64).reshape(-1, 2)]


def wide_links(classes: DataFrame, radii: tuple[int, int], similar: tuple[int, int]) -> DataFrame:
    """``pair_id, u, v`` (u > v): forests over the keys of ``classes`` (``key, f1, f2, n``) within the radii, of like sizes."""
    weighted = classes.select("key", "f1", "f2", "n", (F.bit_count("f1") + F.bit_count("f2")).alias("p"))
    counts = {r["p"]: r["count"] for r in weighted.groupBy("p").count().collect()}  # 129 rows at most
    size = min(MOST_WIDE, max(LEAST_WIDE, -(-sum(counts.values()) // TILES)))
    # Neighbouring population counts share a tile until it is full; a count of more rows has several.
    ranges: list[list[int]] = []  # least and greatest count, rows
    for p, n in sorted(counts.items()):
        if ranges and ranges[-1][2] + n <= size:
            ranges[-1][1:] = [p, ranges[-1][2] + n]
        else:
            ranges.append([p, p, n])
    slots = [-(-n // size) for _, _, n in ranges]
    reach = [max(j for j in range(i, len(ranges)) if ranges[j][0] - high <= radii[1]) for i, (_, high, _) in enumerate(ranges)]
    of = [(p, i, slots[i], reach[i]) for i, (low, high, _) in enumerate(ranges) for p in range(low, high + 1)]
    per_count = classes.sparkSession.createDataFrame(of or [(-1, 0, 1, 0)], "p int, r int, m int, reach int")
    spread = weighted.join(F.broadcast(per_count), "p").withColumn(
        "s", F.pmod(F.xxhash64("key"), F.col("m")).cast("int")
    )
    rows = F.collect_list(F.array("f1", "f2", "key", "n"))
    tiles = written(spread.groupBy("r", "s", "reach").agg(F.flatten(rows).alias("fps")), "wide-tiles")
    left = tiles.select(F.col("r").alias("r1"), F.col("s").alias("s1"), F.explode(F.sequence("r", "reach")).alias("r"))
    pairs = left.join(tiles.select("r", "s"), "r").where("r > r1 OR s >= s1")
    number = sum(slots[i] * slots[j] for i in range(len(ranges)) for j in range(i, reach[i] + 1))
    one = tiles.select(F.col("r").alias("r1"), F.col("s").alias("s1"), F.col("fps").alias("one"))
    both = pairs.join(one, ["r1", "s1"]).join(tiles.select("r", "s", F.col("fps").alias("two")), ["r", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r1, s1, r, s = (batch.column(c)[k].as_py() for c in ("r1", "s1", "r", "s"))
                a, b = (
                    batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 4)
                    for c in ("one", "two")
                )
                found = wide_tile_links(a, None if (r1, s1) == (r, s) else b, radii, similar).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], names=["u", "v"]
                )

    dealt = both.repartition(max(1, min(4096, number)), "r1", "s1", "r", "s")
    links = dealt.select("r1", "s1", "r", "s", "one", "two").mapInArrow(run, "u long, v long")
    return links.distinct().select(F.lit(0).alias("pair_id"), "u", "v")


def _set_prints(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            hashes, cuts = shingle_sets(part.column("text"), width)
            numbers = [set_keys(hashes, cuts), *set_fingerprints(hashes, cuts), np.diff(cuts)]
            columns = [pa.array(x.view(np.int64)) for x in numbers]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "key", "f1", "f2", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key long, f1 long, f2 long, n long")


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = COPY_SHINGLE,
    similar: tuple[int, int] = COPY_SIMILAR,
    radii: tuple[int, int] = COPY_RADII,
) -> DataFrame:
    """``doc_id, key, root, component_id`` of every row: hash of its shingle set, of its component, and the smallest id reachable over
    links, which are pairs of near fingerprints that share at least the fraction ``similar`` of their shingles.

    Null and texts without words have one empty set and are copies of each other. Null ids take part, but never name a
    component unless it has no other id (then null). Repeated rows come back once each. Empty tables give none.
    """
    rows = documents(docs, id_col, text_col)
    prints = written(_set_prints(rows, width), "set-prints")
    classes = prints.groupBy("key").agg(
        F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in ("f1", "f2", "n")]
    )
    classes = written(classes, "set-classes")
    links = wide_links(classes.where("n > 0"), radii, similar)
    components = verified(rows, classes, links, width, similar, "copies")
    return prints.select("doc_id", "key").join(components, "key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = COPY_SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, that of the smallest id (null is greater than any),
    then of the smallest set hash, then of the smallest row.

    Rows are judged by id and text, so rows of one id with different texts stay or go each on its own.
    """
    found = near_copies(docs, id_col, text_col, width)
    rows = found.groupBy("doc_id", "key", "root").agg(F.count("*").alias("c"))
    rows = written(rows, "copy-rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("b"))
    marked = rows.join(best, "root").withColumn(
        "stays", F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("key") == F.col("b.key"))
    )
    # Few rows go, and fewer still stay but come several times; the others are not looked up by text.
    marks = marked.where("not stays OR c > 1").select(F.col("doc_id").alias("_of"), F.col("key").alias("_key"), "stays")
    marks = written(marks, "copy-marks")

    @F.arrow_udf("long")
    def key_of(texts: pa.Array) -> pa.Array:
        # A few megabytes at a time: hashing takes many times the bytes of a text.
        parts = pieces(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))
        keys = [set_keys(*shingle_sets(part.column("text"), width)) for part in parts]
        return pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))

    def kept(state: DataFrame, how: str) -> DataFrame:
        keyed = docs.withColumn("_key_of", key_of(F.col(f"`{text_col}`")))
        same = F.col(f"`{id_col}`").eqNullSafe(F.col("_of")) & (F.col("_key_of") == F.col("_key"))
        return keyed.join(state.select("_of", "_key"), same, how)

    out = kept(marks, "left_anti").drop("_key_of")
    again = marks.where("stays")
    if again.isEmpty():
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept(again, "left_semi").groupBy(F.col(f"`{id_col}`").alias("_i"), "_key_of").agg(F.min(row).alias("_row"))
    return out.unionByName(once.select("_row.*"))
