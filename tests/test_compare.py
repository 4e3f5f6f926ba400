from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasters import change_mask, components, pairs, solid, tables

from rasterloom.operators import compare, key_filter
from rasterloom.operators.components import contract, label_components
from rasterloom.operators.digests import differing_tiles, tile_digests
from rasterloom.operators.key_filter import only_keys
from rasterloom.plans import compare as stored_compare
from rasterloom.session import written
from rasterloom_checks import views


def square():
    raster = solid(64, 64)
    raster[4:12, 4:12] = 0
    return raster


def speckles():
    raster = solid(128, 128)
    for i in range(4):
        raster[i * 40, i * 40] = 0
    return raster


@pytest.fixture(scope="module")
def results(spark):
    rasters = {
        "w40": solid(40, 20),
        "w64": solid(64, 64),
        "sq": square(),
        "w16": solid(16, 16),
        "s16": solid(16, 16, (250, 250, 250)),
        "w20": solid(20, 10),
        "w4010": solid(40, 10),
        "tall": solid(10, 20),
        "wide": solid(20, 10),
        "w128": solid(128, 128),
        "spk": speckles(),
    }
    manifest = pairs(
        spark,
        [
            (1, "w40", "w40", 0.05, 20, True),
            (2, "w64", "sq", 0.05, 20, True),
            (3, "w16", "s16", 0.0, 20, False),
            (4, "w16", "s16", 0.5, 20, False),
            (5, "w20", "w4010", 0.05, 20, False),
            (6, "tall", "wide", 0.05, 20, True),
            (7, "w128", "spk", 0.05, 2, False),
            (8, "w64", "absent", 0.05, 2, True),
            (9, "w64", "sq", 1.0, 20, True),
        ],
    )
    tiles, images = tables(spark, rasters)
    rows = {r.pair_id: r for r in compare.compare_images(tiles, images, manifest).collect()}
    return rows, (tiles, images, manifest)


def test_identical_pair(results):
    row = results[0][1]
    assert (row.similarity, row.changed_pixels, row.changed_ratio) == (1.0, 0, 0.0)
    assert row.regions == [] and row.has_diff is False and row.truncated is False
    assert row.warnings == ["diff image was not produced because no pixels changed"]


def test_square_change_has_a_tight_box(results):
    row = results[0][2]
    assert row.changed_pixels == 64
    assert [tuple(r) for r in row.regions] == [(4, 4, 8, 8, 64)]
    assert row.has_diff is True and row.warnings == []


def test_threshold_controls_sensitivity(results):
    strict, lenient, never = results[0][3], results[0][4], results[0][9]
    assert strict.changed_pixels == 256
    assert lenient.changed_pixels == 0 and lenient.similarity < 1.0
    assert never.changed_pixels == 0


def test_unequal_sizes(results):
    row = results[0][5]
    assert row.dimensions_changed and row.comparison_width == 20
    assert row.changed_pixels == 200 and row.changed_ratio == 0.5
    assert row.warnings == ["images differ in size; non-overlapping pixels count as changed"]


def test_crossed_sizes_use_the_true_union(results):
    row = results[0][6]
    assert row.changed_pixels == 200 and row.changed_ratio == round(2 / 3, 6)
    assert sum(r.changed_pixels for r in row.regions) == 200


def test_region_list_is_truncated(results):
    row = results[0][7]
    assert len(row.regions) == 2 and row.truncated
    assert row.warnings == ["changed region list truncated to 2 entries"]
    assert row.changed_pixels == 4


def test_missing_image(results):
    row = results[0][8]
    assert row.error_code == "not_found" and row.regions is None and row.similarity is None


def test_crossed_diff_is_black_in_the_corner(results):
    tiles, images, manifest = results[1]
    diff = compare.diff_raster(tiles, images, manifest).where("pair_id = 6").collect()
    canvas = np.full((20, 20, 3), -1)
    for t in diff:
        for i, channel in enumerate("rgb"):
            block = np.array(t[channel]).reshape(t.th, t.tw)
            canvas[t.ty * 16 : t.ty * 16 + t.th, t.tx * 16 : t.tx * 16 + t.tw, i] = block
    assert canvas[15, 15].tolist() == [0, 0, 0]
    assert canvas[15, 5].tolist() == [255, 0, 0]
    assert canvas[5, 5].tolist() == [255, 255, 255]
    assert (canvas >= 0).all()


def test_diff_skips_pairs_without_change(results):
    tiles, images, manifest = results[1]
    drawn = compare.diff_raster(tiles, images, manifest).select("pair_id").distinct().collect()
    assert {r.pair_id for r in drawn} == {2, 6}


@pytest.mark.parametrize("rows_per_slot", [1, 10_000])
def test_random_pairs_against_brute_force(spark, rows_per_slot):
    """One image takes part in every pair, so its key is hot with a slot size of one."""
    random = np.random.default_rng(7)
    rasters = {"hub": random.integers(0, 256, (70, 50, 3))}
    manifest = []
    for i in range(6):
        height, width = random.integers(20, 90, 2)
        rasters[f"r{i}"] = random.integers(0, 256, (height, width, 3))
        manifest.append((i, "hub", f"r{i}", 0.93 + 0.01 * i, 3, False))
        manifest.append((10 + i, f"r{i}", "hub", 0.93 + 0.01 * i, 3, False))
    tiles, images = tables(spark, rasters)
    compared = compare.compare_images(
        tiles, images, pairs(spark, manifest), rows_per_slot=rows_per_slot
    )
    rows = {r.pair_id: r for r in compared.collect()}
    for pair_id, first, second, threshold, limit, _ in manifest:
        before, after = rasters[first], rasters[second]
        mask = change_mask(before, after, threshold)
        h, w = min(before.shape[0], after.shape[0]), min(before.shape[1], after.shape[1])
        union = before.shape[0] * before.shape[1] + after.shape[0] * after.shape[1] - h * w
        delta = np.abs(before[:h, :w] - after[:h, :w]).sum() / 3 + 255 * (union - h * w)
        row = rows[pair_id]
        assert row.changed_pixels == mask.sum()
        assert row.changed_ratio == round(int(mask.sum()) / union, 6)
        assert row.similarity == pytest.approx(max(0.0, 1 - delta / (255 * union)), abs=1e-6)
        wanted = sorted(components(mask), key=lambda c: (-c[0], c[1], c[2]))
        got = [(r.changed_pixels, r.y, r.x, r.width, r.height) for r in row.regions]
        assert got == wanted[:limit]
        assert row.truncated == (len(wanted) > limit)
    for i in range(6):
        assert rows[i].similarity == rows[10 + i].similarity


def test_components_across_blocks_match_brute_force(spark):
    """Masks larger than one block of 64 x 64 tiles: noise, a snake, and one full sheet."""
    random = np.random.default_rng(3)
    noise = random.random((150, 200)) < 0.55
    snake = np.zeros((140, 140), bool)
    snake[::2] = True
    for row in range(1, 140, 2):
        snake[row, 139 if row // 2 % 2 == 0 else 0] = True
    masks = {1: noise, 2: snake, 3: np.ones((130, 70), bool)}
    rows = [
        (p, int(ty), int(tx), 1, int(tx) * 16, int(ty) * 16, int(tx) * 16, int(ty) * 16, 1)
        for p, mask in masks.items()
        for ty, tx in zip(*np.nonzero(mask), strict=True)
    ]
    stats = spark.createDataFrame(
        rows,
        "pair_id int, ty int, tx int, n long, min_x int, min_y int, max_x int, max_y int, "
        "channel_sum long",
    )
    labelled = label_components(stats)
    got = {
        (r.pair_id, r.label): r.n
        for r in labelled.groupBy("pair_id", "label").agg(F.sum("n").alias("n")).collect()
    }
    for p, mask in masks.items():
        sizes = sorted(n for (pair, _), n in got.items() if pair == p)
        assert sizes == sorted(c[0] for c in components(mask, tile=1))
    assert (2, 0) in got and (3, 0) in got


def test_contract_points_every_label_at_the_least(spark):
    edges = spark.createDataFrame(
        [(1, i + 1, i) for i in range(40)] + [(2, 9, 5), (2, 9, 7), (2, 4, 3)],
        "pair_id int, u long, v long",
    )
    stars = {(r.pair_id, r.u): r.v for r in contract(edges).collect()}
    assert all(stars[(1, i)] == 0 for i in range(1, 41))
    assert stars[(2, 9)] == 5 and stars[(2, 7)] == 5 and stars[(2, 4)] == 3


def test_only_the_first_thousand_components_count(spark):
    labelled = spark.createDataFrame(
        [(1, i * 2, 0, 1 + (i >= 1000), 0, i * 32, 0, i * 32, 1, i * 2 * 2**20) for i in range(1200)],
        "pair_id int, ty int, tx int, n long, min_x int, min_y int, max_x int, max_y int, "
        "channel_sum long, label long",
    )
    regions = compare.changed_regions(labelled)
    assert regions.count() == 1000
    top = compare.largest_regions(regions, 3).orderBy("rank").collect()
    assert [(r.y, r.changed_pixels) for r in top] == [(0, 1), (32, 1), (64, 1)]


def test_results_do_not_depend_on_partitions(spark, results):
    tiles, images, manifest = results[1]
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    answers = []
    for count in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", count)
        rows = compare.compare_totals(tiles, images, manifest).orderBy("pair_id").collect()
        answers.append([tuple(r) for r in rows])
    spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert answers[0] == answers[1]


def test_region_limits_are_applied_before_the_shuffle(spark):
    labelled = spark.createDataFrame(
        [],
        "pair_id int, ty int, tx int, n long, min_x int, min_y int, max_x int, max_y int, "
        "channel_sum long, label long",
    )
    plan = compare.changed_regions(labelled)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_pixels_travel_for_differing_tiles_only(spark):
    """A pair of 32 x 32 tiles of which one in ten differs, and tiles in one image alone."""
    random = np.random.default_rng(5)
    before = random.integers(0, 256, (512, 512, 3))
    after = np.concatenate([before, solid(16, 512)], axis=1)
    places = random.choice(32 * 32, 102, replace=False)
    for place in places:
        after[place // 32 * 16, place % 32 * 16, 0] ^= 1
    tiles, images = tables(spark, {"a": before, "b": after})
    tiles = written(tiles, "tiles")
    manifest = pairs(spark, [(1, "a", "b", 0.0, 5, True), (2, "b", "b", 0.0, 5, True)])
    aligned = compare.align_tiles(tiles, manifest)
    rows = aligned.select("pair_id", "ty", "tx", F.col("before_r").isNotNull().alias("pixels")).collect()
    assert {r.pair_id for r in rows} == {1}
    assert sorted(r.ty * 32 + r.tx for r in rows if r.pixels) == sorted(places.tolist())
    assert sorted(r.ty for r in rows if not r.pixels) == list(range(32)) and len(rows) == 102 + 32

    # What passes the filter, and with it every exchange with channels, is a tenth of the tiles.
    keys = aligned.where("before_r IS NOT NULL").select(F.lit("a").alias("image_id"), "ty", "tx")
    passed = only_keys(tiles, keys, ["image_id", "ty", "tx"]).where("image_id = 'a'").count()
    assert 102 <= passed <= 112
    plan = aligned._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert plan.count("ArrowEvalPython") == 2 and joins
    for part in plan.split("ArrowEvalPython")[1:]:
        # Between the filter and the scan it tests there is no join.
        head = part[: part.index("Relation")]
        assert "Join" not in head


def test_digests_tell_geometry_and_order(spark):
    flat, tall = solid(16, 8, (1, 2, 3)), solid(8, 16, (1, 2, 3))
    turned = solid(16, 8, (3, 2, 1))
    tiles, _ = tables(spark, {"flat": flat, "tall": tall, "turned": turned, "again": flat})
    found = {r.image_id: (r.d1, r.d2) for r in tile_digests(tiles).collect()}
    assert found["flat"] == found["again"] and len(set(found.values())) == 3
    stored = tile_digests(tiles.withColumns({"d1": F.lit(1), "d2": F.lit(2)})).select("d1", "d2").distinct().collect()
    assert [tuple(r) for r in stored] == [(1, 2)]


def test_swapped_tiles_of_a_block_differ(spark):
    one = np.concatenate([solid(16, 16, (1, 1, 1)), solid(16, 16, (2, 2, 2))], axis=1)
    tiles, _ = tables(spark, {"a": one, "b": one[:, ::-1].copy()})
    manifest = pairs(spark, [(1, "a", "b", 0.0, 5, True)])
    assert differing_tiles(tile_digests(tiles), manifest, 10).count() == 2


def test_a_full_key_filter_only_lets_more_rows_pass(spark, monkeypatch):
    keys = spark.range(5000).select((F.col("id") * 7).alias("k"))
    rows = spark.range(40_000).select(F.col("id").alias("k"))
    few = only_keys(rows, keys, ["k"])
    assert few.join(keys, "k").count() == 5000 and few.count() < 6000
    monkeypatch.setattr(key_filter, "MOST_BITS", key_filter.LEAST_BITS // 8)
    monkeypatch.setattr(key_filter, "LEAST_BITS", key_filter.LEAST_BITS // 8)
    many = only_keys(rows, keys, ["k"])
    assert many.join(keys, "k").count() == 5000 and many.count() > 6000
    assert only_keys(rows, keys.limit(0), ["k"]).count() == 0


def test_stored_diffs_are_kept_once_and_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    random = np.random.default_rng(9)
    one = random.integers(0, 256, (40, 40, 3))
    two, three = one.copy(), one.copy()
    two[5, 5] = 255 - two[5, 5]
    three[20:30, 3:9] = 0
    tiles, images = tables(spark, {"a": one, "b": two, "c": three})
    first = pairs(spark, [(1, "a", "b", 0.0, 5, True), (2, "a", "b", 0.0, 5, True), (3, "a", "a", 0.0, 5, True), (4, "a", "c", 0.0, 5, False)])
    later = pairs(spark, [(7, "a", "b", 0.0, 5, True), (8, "a", "c", 0.0, 5, True)])
    path = str(tmp_path / "diffs")
    answers = {r.pair_id: r.diff_artifact_id for r in stored_compare.compare_and_store(tiles, images, first, path, "r1").collect()}
    assert answers[1] == answers[2] and answers[1].startswith("a") and len(answers[1]) == 33
    assert answers[3] is None and answers[4] is None
    for _ in range(2):  # the second time as a run that was repeated
        more = {r.pair_id: r.diff_artifact_id for r in stored_compare.compare_and_store(tiles, images, later, path, "r2").collect()}
    assert more[7] == answers[1] and more[8] not in (None, answers[1])
    held = stored_compare.read_diffs(spark, path).groupBy("artifact_id").count().collect()
    assert {(r.artifact_id, r["count"]) for r in held} == {(answers[1], 9), (more[8], 9)}
    # Tiles of a run that broke off before its ids are not read.
    stored = spark.read.parquet(f"{path}/tiles/run=r1").withColumn("artifact_id", F.lit("a" + "0" * 32))
    stored.write.parquet(f"{path}/tiles/run=r3")
    assert stored_compare.read_diffs(spark, path).count() == 18


def test_wide_tiles_are_made_of_lines(spark, tmp_path):
    """Pixels of the large pair against brute force; no expression counts through the pixels of a tile."""
    rows = [(k, n, float(7 * k + 5 * n)) for k in (0, 1, 13, 250, 251) for n in (1, 2, 16, 17)]
    rows += [(1, 3, -4.0), (1, 3, 2.0), (13, 5, None)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    wanted = {}
    for key, number, quantity in rows:
        if (key * 7 + key // 13 * 5) % 9 < 4:
            spot = wanted.setdefault((key // 100, key % 100), {}).setdefault(number % 16, [])
            spot += [] if quantity is None else [int(quantity)]
    assert wanted
    tiles = views.wide_tiles(spark, str(tmp_path))
    assert "sequence(0, 255" not in tiles._jdf.queryExecution().analyzed().toString()
    found = tiles.collect()
    assert {(t.image_id, t.ty, t.tx) for t in found} == {(i, *place) for i in (0, 1) for place in wanted}
    for t in found:
        runs = {row: 1 + max(q) % 16 for row, q in wanted[t.ty, t.tx].items() if q}
        red = [255 if t.image_id and x < runs.get(row, 0) else 0 for row in range(16) for x in range(16)]
        assert (t.r, t.g, t.b) == (red, [0] * 256, [0] * 256)
