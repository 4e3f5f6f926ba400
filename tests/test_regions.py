from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from rasters import pairs, solid, tables

from rasterloom.operators import compare, regions, resample
from rasterloom.plans.optimize import optimize_regions, region_rasters
from rasterloom.sources import tile_store

SCHEMA = (
    "request_id int, image_id string, x int, y int, width int, height int, max_width int, "
    "max_height int, quality int, output_format string"
)


def crops(spark, rows):
    return spark.createDataFrame([(*row, 80, "png") for row in rows], SCHEMA)


@pytest.fixture(scope="module")
def world(spark):
    random = np.random.default_rng(5)
    rasters = {
        "a": random.integers(0, 256, (100, 200, 3)),
        "b": random.integers(0, 256, (400, 400, 3)),
        "c": random.integers(0, 256, (50, 100, 3)),
    }
    return rasters, *tables(spark, rasters)


def test_sizes_errors_and_warnings(spark, world):
    _, _, images = world
    wanted = crops(
        spark,
        [
            (1, "a", 10, 10, 50, 20, 4000, 4000),
            (2, "b", 0, 0, 400, 400, 100, 100),
            (3, "c", 500, 0, 10, 10, 64, 64),
            (4, "c", 0, 0, 500, 10, 64, 64),
            (5, "c", 90, 0, 20, 10, 64, 64),
            (6, "zz", 0, 0, 1, 1, 64, 64),
            (7, "b", 0, 0, 400, 1, 16, 16),
            (8, "b", 0, 0, 48, 25, 24, 4000),
        ],
    )
    rows = {r.request_id: r for r in optimize_regions(wanted, images).collect()}
    assert (rows[1].output_width, rows[1].box_x, rows[1].warnings) == (50, 0.05, [])
    assert rows[2].output_width == 100
    assert rows[2].warnings == ["crop was downscaled to fit the requested maximum dimensions"]
    assert rows[3].error.message == "Bounding box starts outside the image"
    assert rows[3].error.details == {}
    for i in (4, 5):
        assert rows[i].error.code == "invalid_input"
        assert rows[i].error.details == {"imageWidth": "100", "imageHeight": "50"}
    assert rows[6].error.code == "not_found"
    assert rows[7].output_height == 1
    # 25 / 2 rounds half to even.
    assert (rows[8].output_width, rows[8].output_height) == (24, 12)


@pytest.mark.parametrize("rows_per_slot", [1, 10_000])
def test_crop_pixels(spark, world, rows_per_slot):
    rasters, tiles, images = world
    wanted = crops(spark, [(1, "a", 13, 30, 40, 35, 999, 999), (2, "a", 13, 30, 5, 5, 999, 999)])
    fitted = regions.fit_sizes(regions.box_gate(wanted, images))
    rows = regions.crop_pixels(fitted, tiles, rows_per_slot).collect()
    got = {(r.request_id, r.x, r.y): (r.r, r.g, r.b) for r in rows}
    assert len(rows) == len(got) == 40 * 35 + 25
    for (request, x, y), colour in got.items():
        assert colour == tuple(rasters["a"][30 + y, 13 + x]), (request, x, y)


def lanczos(line, target):
    """The definition, one output position at a time."""
    size, out = len(line), []
    scale = size / target
    for o in range(target):
        centre = (o + 0.5) * scale
        low = max(0, int(centre - 3 * scale + 0.5))
        high = min(size, int(centre + 3 * scale + 0.5))

        def weight(i, centre=centre):
            d = (i - centre + 0.5) / scale
            if d == 0:
                return 1.0
            if abs(d) >= 3:
                return 0.0
            a, b = math.pi * d, math.pi * d / 3
            return math.sin(a) / a * math.sin(b) / b

        weights = [weight(i) for i in range(low, high)]
        value = sum(w * v for w, v in zip(weights, line[low:high], strict=True)) / sum(weights)
        out.append(min(255, max(0, math.floor(value + 0.5))))
    return out


def test_resample_follows_the_definition(spark, world):
    rasters, tiles, images = world
    wanted = crops(
        spark, [(1, "a", 3, 5, 90, 61, 33, 40), (2, "b", 0, 0, 400, 100, 40, 40), (3, "c", 0, 0, 9, 9, 99, 99)]
    )
    fitted = regions.fit_sizes(regions.box_gate(wanted, images))
    pixels = resample.strip_pixels(resample.resample(fitted, tiles)).collect()
    assert {p.request_id for p in pixels} == {1, 2}
    for request, image, box, size in (
        (1, "a", (3, 5, 90, 61), (33, 22)),
        (2, "b", (0, 0, 400, 100), (40, 10)),
    ):
        x, y, width, height = box
        crop = rasters[image][y : y + height, x : x + width]
        got = np.full((size[1], size[0], 3), -1)
        for p in pixels:
            if p.request_id == request:
                got[p.y, p.x] = (p.r, p.g, p.b)
        for channel in range(3):
            lines = [lanczos(line.tolist(), size[0]) for line in crop[:, :, channel]]
            columns = [lanczos(list(column), size[1]) for column in zip(*lines, strict=True)]
            assert np.abs(np.array(columns).T - got[:, :, channel]).max() <= 1


def test_rasters_cover_every_request(spark, world):
    rasters, tiles, images = world
    wanted = crops(spark, [(1, "a", 3, 5, 90, 61, 33, 40), (2, "c", 7, 9, 37, 20, 99, 99)])
    strips = region_rasters(wanted, images, tiles).collect()
    plain = np.full((20, 37, 3), -1)
    for s in strips:
        assert len(s.r) == s.tw * s.th
        if s.request_id == 2:
            for i, channel in enumerate("rgb"):
                plain[:, s.strip * 16 : s.strip * 16 + s.tw, i] = np.array(s[channel]).reshape(s.th, s.tw)
    assert np.array_equal(plain, rasters["c"][9:29, 7:44])
    assert {s.strip for s in strips if s.request_id == 1} == {0, 1, 2}


def test_crops_from_changes(spark):
    changed = solid(64, 64)
    changed[4:12, 4:12] = 0
    tiles, images = tables(spark, {"w": solid(64, 64), "s": changed})
    manifest = pairs(spark, [(1, "w", "s", 0.05, 20, False)])
    compared = compare.compare_images(tiles, images, manifest)
    row = regions.crops_from_changes(compared, manifest).first()
    assert (row.request_id, row.image_id, row.x, row.y, row.width, row.height) == ("1:0", "s", 4, 4, 8, 8)


def test_orientation_moves_every_pixel(spark):
    from rasterloom.functions.pixels import oriented_position, oriented_size
    from rasterloom.sources.images import upright

    raster = np.arange(40 * 20).reshape(20, 40, 1)
    points = spark.range(800).select(
        (F.col("id") % 40).cast("int").alias("x"), F.floor(F.col("id") / 40).cast("int").alias("y"), "id"
    )
    for turn in range(1, 9):
        wanted = upright(raster, turn)[:, :, 0]
        x, y = oriented_position(F.lit(turn), F.col("x"), F.col("y"), F.lit(40), F.lit(20))
        got = np.full(wanted.shape, -1)
        for p in points.select(x.alias("nx"), y.alias("ny"), "id").collect():
            got[p.ny, p.nx] = p.id
        assert np.array_equal(got, wanted), turn
        size = points.select(*oriented_size(F.lit(turn), F.lit(40), F.lit(20))).first()
        assert (size[1], size[0]) == wanted.shape


def test_morton_codes_take_bits_in_turn_and_never_fall(spark):
    def plain(ty, tx):
        return sum((ty >> k & 1) << (2 * k + 1) | (tx >> k & 1) << (2 * k) for k in range(16))

    places = [(ty, tx) for ty in (0, 1, 2, 5, 255, 256, 40_000, 65_535) for tx in (0, 1, 3, 77, 1024, 65_535)]
    frame = spark.createDataFrame(places, "ty int, tx int").withColumn("code", tile_store.morton(F.col("ty"), F.col("tx")))
    codes = {(r.ty, r.tx): r.code for r in frame.collect()}
    assert codes == {place: plain(*place) for place in places}
    assert all(codes[a] <= codes[b] for a in places for b in places if a[0] <= b[0] and a[1] <= b[1])


def test_small_boxes_meet_few_row_groups_of_a_store(spark, tmp_path):
    random = np.random.default_rng(6)
    rasters = {"big": random.integers(0, 256, (1200, 1200, 3)), "small": random.integers(0, 256, (40, 40, 3))}
    tiles, _ = tables(spark, rasters)
    path = str(tmp_path / "store")
    tile_store.write_tile_store(tiles, path, row_group_bytes=64 << 10)
    box = crops(spark, [(1, "big", 500, 330, 40, 30, 40, 30)])
    read = tile_store.read_tiles_for(spark, path, box)
    assert sorted((r.ty, r.tx) for r in read.collect()) == [(ty, tx) for ty in (20, 21, 22) for tx in (31, 32, 33)]
    plan = spark._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in plan and "LessThanOrEqual(code" in plan and "GreaterThanOrEqual(ty" in plan
    code = read.withColumn("code", tile_store.morton(F.col("ty"), F.col("tx"))).agg(F.min("code"), F.max("code")).first()
    met = groups = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for k in range(meta.num_row_groups):
            held = {meta.row_group(k).column(c).path_in_schema: meta.row_group(k).column(c).statistics for c in range(meta.num_columns)}
            groups += 1
            reach = {"code": code, "ty": (20, 22), "tx": (31, 33), "image_id": ("big", "big")}
            met += all(held[c].min <= high and held[c].max >= low for c, (low, high) in reach.items())
    assert groups >= 20 and met <= groups / 5
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in tile_store.stored_crop_pixels(spark, path, box).collect()}
    assert got == {(x, y): tuple(rasters["big"][330 + y, 500 + x]) for x in range(40) for y in range(30)}


def test_stores_without_tiles_and_without_crops(spark, tmp_path):
    tiles, _ = tables(spark, {"a": solid(20, 20)})
    tile_store.write_tile_store(tiles.limit(0), str(tmp_path / "none"))
    tile_store.write_tile_store(tiles, str(tmp_path / "one"))
    box = crops(spark, [(1, "a", 0, 0, 5, 5, 5, 5)])
    assert tile_store.stored_crop_pixels(spark, str(tmp_path / "none"), box).count() == 0
    assert tile_store.stored_crop_pixels(spark, str(tmp_path / "one"), box.limit(0)).count() == 0
    assert tile_store.stored_crop_pixels(spark, str(tmp_path / "one"), box).count() == 25
