"""The queries the driver checks, over the views of its tables."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import errors, gates, media
from rasterloom.functions import pixels as px
from rasterloom.operators import admission, assets, compare, layout, regions, requests, resample
from rasterloom.operators.components import label_blocks, label_components, tile_adjacency
from rasterloom.plans import compare as stored_compare
from rasterloom.plans import extract as extraction
from rasterloom.plans.extract import extract_layout as extract
from rasterloom.plans.optimize import optimize_regions, region_rasters
from rasterloom.session import apply_defaults, fresh_path, written
from rasterloom.settings import MAX_DETAIL_ENTRIES, TILE
from rasterloom.sources import catalogue, folders, image_source, payloads, sinks, tile_store
from rasterloom.sources import images as image_files
from rasterloom.streaming import jobs

from . import views

AS_OF = "2024-01-15 12:00:00"
TTL = 86_400
QUOTA_BYTES = 90_000
QUOTA_COUNT = 3
MAX_UPLOAD = 60_000
MAX_BYTES = 4_000
FOLDER_FILES = 4_000
ROOTS = ("/en", "/es")

Query = Callable[[SparkSession, str], DataFrame]


def _joined(values: Column, separator: str = "|") -> Column:
    return F.array_join(values, separator)


def _naive(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


# -- image comparison ---------------------------------------------------------


def compare_totals(spark: SparkSession, folder: str) -> DataFrame:
    return compare.compare_totals(
        views.tiles(spark, folder), views.images(spark, folder), views.pairs(spark, folder)
    )


def compare_totals_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return compare.compare_totals(
        views.tiles(spark, folder), views.images(spark, folder), views.pairs(spark, folder, 0.6)
    )


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return compare.tile_stats(
        compare.align_tiles(views.tiles(spark, folder), views.pairs(spark, folder))
    )


def compare_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return _stats(spark, folder)


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return label_components(_stats(spark, folder))


def compare_regions(spark: SparkSession, folder: str) -> DataFrame:
    return compare.changed_regions(_labelled(spark, folder))


def compare_topk(spark: SparkSession, folder: str) -> DataFrame:
    return compare.largest_regions(compare.changed_regions(_labelled(spark, folder)), 2)


def _compared(spark: SparkSession, folder: str, max_regions: int) -> DataFrame:
    return compare.compare_images(
        views.tiles(spark, folder),
        views.images(spark, folder),
        views.pairs(spark, folder, max_regions=max_regions),
    )


def _answer(found: DataFrame) -> DataFrame:
    box = lambda r: F.concat_ws(",", *[r[c] for c in ("x", "y", "width", "height", "changed_pixels")])
    return found.select(
        *compare.TOTALS,
        _joined(F.transform("regions", box)).alias("regions"),
        "has_diff",
        "truncated",
        _joined(F.col("warnings")).alias("warnings"),
        "error_code",
    )


def compare_images(spark: SparkSession, folder: str) -> DataFrame:
    return _answer(_compared(spark, folder, 20))


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    aligned = compare.align_tiles(views.wide_tiles(spark, folder), views.wide_pairs(spark))
    return compare.tile_stats(aligned)


def compare_regions_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of a large pair: they cross the borders of blocks."""
    return compare.changed_regions(label_components(_wide(spark, folder)))


def adjacent_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Changed tiles that touch across the border of a block, as edges between components of blocks."""
    edges = tile_adjacency(label_blocks(_wide(spark, folder)))
    return edges.select("pair_id", F.col("u").alias("upper"), F.col("v").alias("lower"))


def compare_images_wide(spark: SparkSession, folder: str) -> DataFrame:
    found = compare.compare_images(
        views.wide_tiles(spark, folder), views.wide_images(spark, folder), views.wide_pairs(spark)
    )
    return _answer(found)


def gated_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Crop requests with every kind of bad box, and images that were refused before."""
    images = views.images(spark, folder).withColumn(
        "error_code", F.when(F.pmod("image_id", F.lit(3)) == 1, "payload_too_large")
    )
    shift = F.pmod("request_id", F.lit(5)).cast("int")
    crops = (
        views.crops(spark, folder)
        .withColumn("x", F.when(shift == 1, -F.col("x") - 1).otherwise(F.col("x")))
        .withColumn("width", F.when(shift == 2, 0).otherwise(F.col("width")))
        .withColumn("quality", F.when(shift == 3, 101).otherwise(F.col("quality")))
        .withColumn("image_id", F.when(shift == 4, F.lit(-1)).otherwise(F.col("image_id")))
    )
    return optimize_regions(crops, images).select("request_id", F.col("error.code").alias("error_code"))


def diff_raster(spark: SparkSession, folder: str) -> DataFrame:
    tiles = compare.diff_raster(
        views.tiles(spark, folder), views.images(spark, folder), views.pairs(spark, folder)
    )
    at = F.posexplode(F.arrays_zip("r", "g", "b")).alias("_i", "_p")
    return tiles.select("pair_id", "ty", "tx", "tw", at).select(
        "pair_id",
        (F.col("tx") * TILE + F.pmod("_i", "tw")).alias("x"),
        (F.col("ty") * TILE + F.floor(F.col("_i") / F.col("tw"))).cast("int").alias("y"),
        *[F.col(f"_p.{c}").cast("int").alias(c) for c in ("r", "g", "b")],
    )


def diff_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs that store diffs, the second over each pair twice: what each answers, and what is stored after both."""
    path = fresh_path(spark, "artifacts")
    tiles, images, pairs = views.tiles(spark, folder), views.images(spark, folder), views.pairs(spark, folder)
    again = pairs.unionByName(pairs.withColumn("pair_id", F.col("pair_id") + 1000))
    tiles = written(tiles, "tiles")
    first = written(stored_compare.compare_and_store(tiles, images, pairs, path, "one"), "first").withColumn("run", F.lit(1))
    second = stored_compare.compare_and_store(tiles, images, again, path, "two").withColumn("run", F.lit(2))
    held = stored_compare.read_diffs(spark, path).groupBy("artifact_id").agg(F.count("*").alias("stored_tiles"))
    of = first.where("diff_artifact_id IS NOT NULL").select("diff_artifact_id", F.col("pair_id").alias("first_pair"))
    both = first.unionByName(second).join(of, "diff_artifact_id", "left")
    held = held.withColumnRenamed("artifact_id", "diff_artifact_id")
    return both.join(held, "diff_artifact_id", "left").select("run", "pair_id", "first_pair", "stored_tiles", "has_diff")


def orient_pixels(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.raster_rows(spark, folder).join(
        views.images(spark, folder).select("image_id", "width", "height"), "image_id"
    )
    turn = F.pmod("image_id", F.lit(8)).cast("int") + 1
    at = F.posexplode(F.arrays_zip("r", "g", "b")).alias("_x", "_p")
    x, y = px.oriented_position(turn, F.col("_x"), F.col("y"), F.col("width"), F.col("height"))
    return rows.select("image_id", "y", "width", "height", at).select(
        "image_id", x.alias("x"), y.alias("y"), *[F.col(f"_p.{c}").cast("int").alias(c) for c in ("r", "g", "b")]
    )


# -- crops --------------------------------------------------------------------


def _gated(spark: SparkSession, folder: str) -> DataFrame:
    return regions.box_gate(views.crops(spark, folder), views.images(spark, folder))


def box_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _gated(spark, folder).select(
        "request_id",
        F.col("error.code").alias("error_code"),
        F.col("error.message").alias("message"),
        F.col("error.details")["imageHeight"].alias("image_height"),
    )


FIT = (
    "request_id",
    "output_width",
    "output_height",
    "box_x",
    "box_y",
    "box_width",
    "box_height",
)


def fit_scale(spark: SparkSession, folder: str) -> DataFrame:
    return regions.fit_sizes(_gated(spark, folder)).select(
        *FIT, "downscaled", _joined(F.col("warnings")).alias("warnings")
    )


def crop_pixels(spark: SparkSession, folder: str) -> DataFrame:
    fitted = regions.fit_sizes(_gated(spark, folder))
    return regions.crop_pixels(fitted, views.tiles(spark, folder))


def crop_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same crops from tiles that were stored first, and read by folder, place and code."""
    path = fresh_path(spark, "tiles")
    tile_store.write_tile_store(views.tiles(spark, folder), path)
    return tile_store.stored_crop_pixels(spark, path, regions.fit_sizes(_gated(spark, folder)))


def resample_crops(spark: SparkSession, folder: str) -> DataFrame:
    fitted = regions.fit_sizes(_gated(spark, folder))
    return resample.strip_pixels(resample.resample(fitted, views.tiles(spark, folder)))


def requested_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of all accepted requests, downscaled or not."""
    strips = region_rasters(views.crops(spark, folder), views.images(spark, folder), views.tiles(spark, folder))
    return resample.strip_pixels(strips)


def asset_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads written to the ledger in two runs and read back."""
    path = fresh_path(spark, "ledger")
    uploads = views.assets(spark, folder).drop("expires_at")
    early = F.col("created_at") < AS_OF
    for part in (uploads.where(early), uploads.where(~early)):
        sinks.write_assets(part, path, TTL)
    return sinks.read_assets(spark, path).select(
        "asset_id", "principal", "kind", "byte_count", _naive("created_at"), _naive("expires_at")
    )


def content_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted content written by output format and read back."""
    path = fresh_path(spark, "content")
    rows = [
        _content(form)(spark, folder).withColumn("output_format", F.lit(form)) for form in ("text", "csv")
    ]
    sinks.write_content(rows[0].unionByName(rows[1]), path)
    return spark.read.parquet(path).select(
        F.col("image_id").cast("long").alias("image_id"), "output_format", F.sha2("content", 256).alias("digest")
    )


def _raw_raster(content: bytes) -> np.ndarray | None:
    """A decoder as a caller would pass one in: a JSON list of image lines."""
    lines = json.loads(content)
    return np.array(lines, dtype=np.uint8) if lines else None


def decoder_hook(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles through the caller's decoder, as pixels; every fifth content is nothing."""
    pixels = F.transform(F.arrays_zip("r", "g", "b"), lambda z: F.array(z["r"], z["g"], z["b"]))
    lines = (
        views.raster_rows(spark, folder)
        .groupBy("image_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("y", pixels.alias("p")))), lambda z: z["p"]).alias("l"))
    )
    empty = F.pmod("image_id", F.lit(5)) == 4
    text = F.when(empty, "[]").otherwise(F.to_json("l"))
    files = lines.select("image_id", F.encode(text, "UTF-8").alias("content"))
    at = F.posexplode(F.arrays_zip("r", "g", "b")).alias("_i", "_p")
    return image_files.decode_with(files, _raw_raster).select("image_id", "ty", "tx", "tw", at).select(
        F.col("image_id").cast("long").alias("image_id"),
        (F.col("tx") * TILE + F.pmod("_i", "tw")).alias("x"),
        (F.col("ty") * TILE + F.floor(F.col("_i") / F.col("tw"))).cast("int").alias("y"),
        *[F.col(f"_p.{c}").cast("int").alias(c) for c in ("r", "g", "b")],
    )


def _numbered(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(\d+)(\.[a-z]+)?$", 1).cast("long")


def _header_files(spark: SparkSession, folder: str) -> str:
    """A file per document, behind the first bytes of an image format; some are empty or too large. They lie in folders by
    the hash of their names, about ``FOLDER_FILES`` in each."""
    path = fresh_path(spark, "uploads")
    docs = views.documents(spark, folder)
    name = F.substring_index("path", "/", -1)
    place = F.pmod(F.xxhash64(name), F.lit(1 + docs.count() // FOLDER_FILES))
    sinks.write_files(views.headers(docs).select(F.concat(place, F.lit("/"), name).alias("name"), "content"), path)
    return path


def scan_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Real files through the image data source and the gate; too large ones are listed, not opened."""
    files = image_source.image_files(spark, [_header_files(spark, folder)], MAX_BYTES)
    return image_source.gated(files, MAX_BYTES).select(
        F.concat(F.lit("/uploads/"), _numbered()).alias("path"), "byte_count", "content_type", "error_code"
    )


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """The same files through Spark's file source, which does not list empty ones; some folders at a time."""

    def verdicts(paths: list[str]) -> DataFrame:
        good = image_files.gate_files(image_files.scan_images(spark, paths, MAX_BYTES), MAX_BYTES)
        large = image_files.oversized_files(spark, paths, MAX_BYTES)
        return good.select("path", "byte_count", "error_code").unionByName(large)

    found = folders.by_folders(spark, [_header_files(spark, folder)], verdicts, "verdicts")
    return found.withColumn("path", F.concat(F.lit("/uploads/"), _numbered()))


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same files as they arrive in folders, a few hundred per micro-batch."""
    target, mark = fresh_path(spark, "arrived"), fresh_path(spark, "arrived-mark")
    jobs.intake_folders(spark, _header_files(spark, folder), target, mark, MAX_BYTES, 300)
    columns = ("path", "byte_count", "error_code")
    good = spark.read.parquet(f"{target}/accepted").withColumn("error_code", F.lit(None).cast("string"))
    bad = spark.read.parquet(f"{target}/quarantine")
    return good.select(*columns).unionByName(bad.select(*columns)).withColumn(
        "path", F.concat(F.lit("/uploads/"), _numbered())
    )


def _png_bytes(lines: list) -> bytes:
    raster = np.array(lines, dtype=np.uint8)
    rows = b"".join(b"\0" + line.tobytes() for line in raster)
    parts = [
        (b"IHDR", struct.pack(">IIBBBBB", raster.shape[1], raster.shape[0], 8, 2, 0, 0, 0)),
        (b"IDAT", zlib.compress(rows)),
        (b"IEND", b""),
    ]
    chunks = [struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts]
    return b"\x89PNG\r\n\x1a\n" + b"".join(chunks)


def _plain_png(content: bytes) -> tuple[np.ndarray, int]:
    """A decoder as a caller would pass one in: 8-bit RGB without line filters."""
    width, height = struct.unpack(">II", content[16:24])
    data = content[content.index(b"IDAT") + 4 :]
    rows = np.frombuffer(zlib.decompressobj().decompress(data), np.uint8).reshape(height, 1 + 3 * width)
    return rows[:, 1:].reshape(height, width, 3), 1


def _png_files(spark: SparkSession, folder: str) -> str:
    """Every raster as a PNG file; of every fifth the end is missing."""

    @F.udf("binary")
    def encode(lines: list, whole: bool) -> bytes:
        content = _png_bytes(lines)
        return content if whole else content[:60]

    pixels = F.transform(F.arrays_zip("r", "g", "b"), lambda z: F.array(z["r"], z["g"], z["b"]))
    lines = views.raster_rows(spark, folder).groupBy("image_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("y", pixels.alias("p")))), lambda z: z["p"]).alias("l")
    )
    path = fresh_path(spark, "rasters")
    named = lines.select(
        F.concat("image_id", F.lit(".png")).alias("name"), encode("l", F.pmod("image_id", F.lit(5)) != 4).alias("content")
    )
    sinks.write_files(named, path)
    return path


def _tile_pixels(tiles: DataFrame) -> DataFrame:
    at = F.posexplode(F.arrays_zip("r", "g", "b")).alias("_i", "_p")
    return tiles.select(_numbered("image_id").alias("image_id"), "ty", "tx", "tw", at).select(
        "image_id",
        (F.col("tx") * TILE + F.pmod("_i", "tw")).alias("x"),
        (F.col("ty") * TILE + F.floor(F.col("_i") / F.col("tw"))).cast("int").alias("y"),
        *[F.col(f"_p.{c}").cast("int").alias(c) for c in ("r", "g", "b")],
    )


def decode_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of PNG files: read, gated, decoded and cut in one task."""
    files = image_source.image_files(spark, [_png_files(spark, folder)])
    return _tile_pixels(image_source.decode_files(image_source.gated(files), _plain_png))


def decoded_files(spark: SparkSession, folder: str) -> DataFrame:
    """Dimensions of the same files, or why there are none."""
    files = image_source.image_files(spark, [_png_files(spark, folder)])
    found = image_source.decoded_dimensions(image_source.gated(files), _plain_png)
    return found.select(_numbered().alias("image_id"), "content_type", "width", "height", "error_code")


def image_rgb(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of the same files through Spark's image source, whose bytes are turned to RGB."""
    return _tile_pixels(image_files.raster_tiles(image_files.decode_images(spark, [_png_files(spark, folder)])))


def stored_assets(spark: SparkSession, folder: str) -> DataFrame:
    """A file store with an asset per user: metadata, payloads, a broken record in seven and a lost payload in five."""
    root = fresh_path(spark, "store")
    users = views.table(spark, folder, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.max("ts").alias("created")
    )
    owned = users.select(
        "user_id",
        "n",
        F.concat(F.lit("i"), F.lpad(F.col("user_id").cast("string"), 32, "0")).alias("id"),
        F.concat(F.col("user_id").cast("string"), F.lit("/")).alias("at"),
        F.date_trunc("second", "created").alias("created"),
    )
    shown = F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = {
        "assetId": F.col("id"),
        "principal": F.concat(F.lit("p_"), F.col("user_id").cast("string")),
        "contentType": F.lit("image/png"),
        "byteCount": F.col("n"),
        "createdAt": F.when(F.pmod("user_id", F.lit(7)) != 3, shown),
        "expiresAt": shown,
    }
    about = owned.select(
        F.concat("at", "id", F.lit(".json")).alias("name"),
        F.encode(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])), "UTF-8").alias("content"),
    )
    held = owned.where(F.pmod("user_id", F.lit(5)) != 2).select(
        F.concat("at", "id", F.lit(".bin")).alias("name"),
        F.encode(F.repeat(F.lit("x"), F.col("n").cast("int")), "UTF-8").alias("content"),
    )
    sinks.write_files(about.unionByName(held), root)
    store = catalogue.scan_store(spark, root)
    good = catalogue.scan_assets(spark, root, store).select(
        "asset_id", "principal_bucket", "byte_count", "stored_bytes", _naive("created_at"), F.lit(False).alias("orphan")
    )
    none = F.lit(None)
    lost = catalogue.orphan_files(spark, root, store).select(
        F.col("file_id").alias("asset_id"), "principal_bucket", none.cast("long").alias("byte_count"),
        F.col("byte_count").alias("stored_bytes"), none.cast("timestamp_ntz").alias("created_at"), F.lit(True).alias("orphan"),
    )
    return good.unionByName(lost)


_TRIANGLE = [[0, 0], [9, 0], [9, 9]]


def _line_engine(language: str) -> Callable[[bytes], str]:
    """An engine as a caller would pass one in: it reads lines off a text and gives up on long ones."""

    def engine(content: bytes) -> str:
        lines = content.decode().split("\n")
        if len(lines) > 40:
            raise TimeoutError
        return json.dumps({"res": {"rec_texts": lines, "rec_scores": [0.5] * len(lines), "rec_polys": [_TRIANGLE] * len(lines)}})

    return engine


def engine_hook(spark: SparkSession, folder: str) -> DataFrame:
    """Payload rows through the caller's engine, parsed."""
    files = views.documents(spark, folder).select(
        F.col("doc_id").alias("image_id"), F.col("lang").alias("language"), F.encode("text", "UTF-8").alias("content")
    )
    saved = image_files.recognize_with(files, "local", _line_engine)
    sized = saved.withColumns({"width": F.lit(640), "height": F.lit(600)})
    return payloads.parse_local(sized).select(
        F.col("image_id").cast("long").alias("image_id"), "status", "error_code", F.size("blocks").alias("block_count")
    )


def _patient_engine(language: str) -> Callable[[bytes], str]:
    def engine(content: bytes) -> str:
        lines = content.decode().split("\n")
        return json.dumps({"res": {"rec_texts": lines, "rec_scores": [0.5] * len(lines), "rec_polys": [_TRIANGLE] * len(lines)}})

    return engine


def fallback_run(spark: SparkSession, folder: str) -> DataFrame:
    """Two engines over all documents; the run goes on from a first phase that broke off after three slices of four."""
    files = views.documents(spark, folder).select(
        F.col("doc_id").alias("image_id"), F.col("lang").alias("language"), F.encode("text", "UTF-8").alias("content")
    )

    def parsed(rows: DataFrame) -> DataFrame:
        return payloads.parse_local(rows.withColumns({"width": F.lit(640), "height": F.lit(600)}))

    def first(rows: DataFrame) -> DataFrame:
        return image_files.recognize_with(rows, "local", _line_engine)

    path = fresh_path(spark, "fallback")
    for k in range(3):
        part = files.where(F.pmod(F.xxhash64("image_id"), F.lit(4)) == k)
        first(part).write.parquet(f"{path}/primary/slice={k}")
    found = extraction.fallback_run(
        files, first, lambda rows: image_files.recognize_with(rows, "local", _patient_engine), parsed, parsed, path, 4
    )
    return found.select(
        F.col("image_id").cast("long").alias("image_id"), "fallback_used", "error_code", F.size("blocks").alias("block_count")
    )


def optimize_requests(spark: SparkSession, folder: str) -> DataFrame:
    return optimize_regions(views.crops(spark, folder), views.images(spark, folder)).select(
        "request_id",
        "image_id",
        "image_width",
        "image_height",
        "crop_width",
        "crop_height",
        "output_width",
        "output_height",
        "byte_count",
        "original_byte_count",
        "output_format",
        F.col("error.code").alias("error_code"),
    )


def changed_crops(spark: SparkSession, folder: str) -> DataFrame:
    crops = regions.crops_from_changes(
        _compared(spark, folder, 20), views.pairs(spark, folder), 16, 16
    )
    gated = regions.box_gate(crops, views.images(spark, folder))
    return regions.fit_sizes(gated).select(
        *FIT, "image_id", "x", "y", "width", "height", "downscaled"
    )


def byte_savings(spark: SparkSession, folder: str) -> DataFrame:
    return regions.byte_savings(regions.fit_sizes(_gated(spark, folder)))


# -- text and layout ----------------------------------------------------------


def _managed(spark: SparkSession, folder: str, width: int = 640, height: int = 600) -> DataFrame:
    sized = (
        views.managed_payloads(spark, folder)
        .withColumn("width", F.lit(width))
        .withColumn("height", F.lit(height))
    )
    return payloads.parse_managed(sized)


def _block_rows(parsed: DataFrame) -> DataFrame:
    return payloads.explode_blocks(parsed).select(
        "image_id",
        "ord",
        "text",
        "block_type",
        "page",
        _joined(F.transform("polygon", lambda v: v.cast("int")), ",").alias("polygon"),
        "confidence",
    )


def ocr_managed(spark: SparkSession, folder: str) -> DataFrame:
    return _block_rows(_managed(spark, folder, 320, 300))


def ocr_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _managed(spark, folder).select(
        "image_id",
        "status",
        "error_code",
        "state",
        "markdown",
        _joined(F.col("warnings")).alias("warnings"),
        F.size("blocks").alias("block_count"),
    )


def ocr_local(spark: SparkSession, folder: str) -> DataFrame:
    return _block_rows(payloads.parse_local(views.local_payloads(spark, folder)))


def ocr_local_legacy(spark: SparkSession, folder: str) -> DataFrame:
    saved = views.local_payloads(spark, folder, "legacy")
    return _block_rows(payloads.parse_local(saved, "legacy"))


def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    ordered = layout.reading_order(views.blocks(spark, folder))
    return ordered.select("image_id", "position", "ord", "page", "text")


def _shaped(spark: SparkSession, folder: str, max_blocks: int = 500) -> DataFrame:
    ordered = layout.reading_order(views.blocks(spark, folder), max_blocks)
    return layout.shaped_blocks(ordered, F.lit(640), F.lit(600))


def normalized_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return _shaped(spark, folder).select(
        "image_id",
        "id",
        "type",
        "page",
        "confidence",
        *[F.col(f"box.{c}").alias(f"box_{c}") for c in ("x", "y", "width", "height")],
        F.element_at("polygon", 5).alias("third_x"),
        F.element_at("polygon", 6).alias("third_y"),
        F.length("text").alias("text_length"),
    )


def block_cap(spark: SparkSession, folder: str) -> DataFrame:
    blocks = views.blocks(spark, folder)
    shaped = _shaped(spark, folder, 20)
    kept = shaped.groupBy("image_id").agg(
        F.count("*").alias("kept"), F.max("id").alias("last_id")
    )
    return layout.block_counts(blocks, 20).join(kept, "image_id")


def _content(output_format: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return layout.assemble_content(_shaped(spark, folder), output_format)

    return query


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    local = payloads.parse_local(views.local_payloads(spark, folder))
    return layout.fall_back(_managed(spark, folder), local)


def provider_fallback(spark: SparkSession, folder: str) -> DataFrame:
    code = F.col("error_code")
    return _routed(spark, folder).select(
        "image_id",
        *[F.col(f"provider.{c}").alias(f"provider_{c}") for c in ("name", "mode", "model", "api_version")],
        "fallback_used",
        "error_code",
        errors.error_status(code).alias("http_status"),
        errors.is_retryable(code).alias("retryable"),
        _joined(F.col("warnings")).alias("warnings"),
        F.size("blocks").alias("block_count"),
    )


def extract_layout(spark: SparkSession, folder: str) -> DataFrame:
    result = extract(_routed(spark, folder), views.page_images(spark, folder), "csv")
    return result.select(
        "image_id",
        "content",
        F.size("blocks").alias("block_count"),
        "width",
        "height",
        F.col("provider.name").alias("provider_name"),
        "fallback_used",
        "truncated",
        _joined(F.col("warnings")).alias("warnings"),
        "error_code",
    )


# -- gates --------------------------------------------------------------------


def sniff(spark: SparkSession, folder: str) -> DataFrame:
    files = views.headers(views.documents(spark, folder))
    return files.select(
        "path", "byte_count", media.sniff_content_type(F.col("content")).alias("content_type")
    )


def payload_gate(spark: SparkSession, folder: str) -> DataFrame:
    files = views.headers(views.documents(spark, folder))
    code = media.payload_gate(F.col("content"), MAX_BYTES)
    return files.select(
        "path",
        code.alias("error_code"),
        errors.error_status(code).alias("http_status"),
        errors.is_retryable(code).alias("retryable"),
    )


def path_gate(spark: SparkSession, folder: str) -> DataFrame:
    return views.page_paths(spark, folder).select(
        "page_id", gates.path_gate(F.col("path"), ROOTS, F.col("present")).alias("error_code")
    )


def contained_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Containment in a table of roots: the roots are the language folders in use, loosely written."""
    languages = views.documents(spark, folder)
    roots = languages.select(F.concat(F.lit("//"), "lang", F.lit("/./")).alias("root")).distinct()
    paths = views.page_paths(spark, folder).select("page_id", "path")
    return assets.contained_paths(paths, roots).select("page_id")


def reference_gate(spark: SparkSession, folder: str) -> DataFrame:
    parsed = gates.parsed_reference(F.col("reference"))
    return (
        views.references(spark, folder)
        .withColumn("_ref", parsed)
        .select(
            "page_id",
            F.col("_ref.kind").alias("kind"),
            F.col("_ref.path").alias("path"),
            F.col("_ref.asset_id").alias("asset_id"),
            F.when(F.col("_ref").isNull(), "invalid_input").alias("error_code"),
        )
    )


def param_gate(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    compare_errors = gates.compare_param_errors((size - 5) / 40.0, (size * 3 - 6).cast("int"))
    crop_errors = gates.crop_param_errors(
        (size - 3).cast("int"),
        F.when(size == 7, 2_000_000).otherwise(size),
        (size - 2).cast("int"),
        (size - 4).cast("int"),
        (size * 2).cast("int"),
        (size * 400).cast("int"),
        (size * 3).cast("int"),
    )
    return views.table(spark, folder, "part").select(
        key.alias("request_id"),
        F.size(compare_errors).alias("compare_error_count"),
        errors.first_errors(compare_errors).alias("compare_errors"),
        F.size(crop_errors).alias("crop_error_count"),
        errors.first_errors(crop_errors).alias("crop_errors"),
    )


def language_gate(spark: SparkSession, folder: str) -> DataFrame:
    asked = F.when(F.pmod("doc_id", F.lit(4)) != 0, F.col("lang"))
    language = gates.language_or_default(asked)
    local = F.pmod("doc_id", F.lit(2)) == 0
    return views.documents(spark, folder).select(
        "doc_id",
        language.alias("language"),
        gates.language_gate(language, ("en", "fr"), local).alias("error_code"),
        errors.first_errors(
            gates.language_param_errors(
                F.when(F.pmod("doc_id", F.lit(5)) == 0, F.substring("lang", 1, 1))
                .when(F.pmod("doc_id", F.lit(5)) == 1, F.concat(F.col("lang"), F.lit(" !")))
                .when(F.pmod("doc_id", F.lit(5)) == 2, F.repeat("lang", 9))
                .otherwise(F.col("lang"))
            )
        ).alias("errors"),
    )


def content_type_gate(spark: SparkSession, folder: str) -> DataFrame:
    gated = assets.gate_uploads(views.assets(spark, folder), MAX_UPLOAD)
    return gated.select("asset_id", "content_type", "error_code")


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    gated = assets.gate_uploads(views.assets(spark, folder), MAX_UPLOAD)
    bad = assets.quarantine(gated)
    return bad.groupBy(
        F.col("error.code").alias("code"), F.col("error.retryable").alias("retryable")
    ).agg(F.count("*").alias("uploads"), F.sum("byte_count").alias("bytes"))


def error_details(spark: SparkSession, folder: str) -> DataFrame:
    """Details of a refused document: its words by position, cut as an error response cuts them."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    keyed = F.transform(
        F.slice(words, 1, MAX_DETAIL_ENTRIES),  # the keys are ordered: later ones would be cut
        lambda w, i: F.struct(
            F.concat(F.lit("word "), F.lpad(i.cast("string"), 6, "0")).alias("key"),
            F.repeat(w, 40).alias("value"),
        ),
    )
    details = errors.bounded_details(F.map_from_entries(keyed))
    return views.documents(spark, folder).select(
        "doc_id",
        _joined(F.map_keys(details)).alias("keys"),
        _joined(F.map_values(details)).alias("details"),
    )


# -- assets -------------------------------------------------------------------


def asset_expiry(spark: SparkSession, folder: str) -> DataFrame:
    rows = assets.with_expiry(views.assets(spark, folder).drop("expires_at", "kind"), TTL)
    return rows.select(
        "asset_id", "kind", "principal_bucket", _naive("created_at"), _naive("expires_at")
    )


def visible_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Every asset is asked for once, one time in four by somebody else."""
    held = views.assets(spark, folder)
    number = F.substring("asset_id", 2, 12).cast("long")
    stranger = F.concat("principal", F.lit("x"))
    asked = held.select(
        number.alias("request_id"),
        "asset_id",
        F.when(F.pmod(number, F.lit(4)) == 0, stranger).otherwise(F.col("principal")).alias("principal"),
    )
    return assets.resolve_assets(asked, held, AS_OF).select(
        "request_id", "asset_id", "byte_count", "error_code"
    )


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """References of pages to other pages' paths and to the event log's assets, and the files there are."""
    page = F.col("page_id")
    files = (
        views.page_paths(spark, folder)
        .where("present AND path LIKE '/%' AND page_id % 10 > 4")
        .groupBy(F.rtrim("path", F.lit("/")).alias("path"))
        .agg(F.max("page_id").alias("byte_count"))
    )
    wanted = F.to_json(
        F.struct(
            F.when(F.pmod(page, F.lit(2)) == 0, "local_path").otherwise(F.lit("asset")).alias("kind"),
            F.when(F.pmod(page, F.lit(2)) == 0, F.col("path")).alias("path"),
            F.when(
                F.pmod(page, F.lit(2)) == 1,
                F.concat(F.lit("a"), F.lpad(page.cast("string"), 12, "0")),
            ).alias("assetId"),
        )
    )
    owners = views.table(spark, folder, "events").select(
        F.col("event_id").alias("page_id"),
        F.concat(F.lit("p_"), F.col("user_id").cast("string")).alias("principal"),
    )
    asked = (
        views.page_paths(spark, folder)
        .join(owners, "page_id")
        .select(page.alias("reference_id"), "principal", wanted.alias("reference"))
    )
    return asked, files


REFERENCED_AT = "2024-01-01 18:00:00"


def resolve_references(spark: SparkSession, folder: str) -> DataFrame:
    asked, files = _references(spark, folder)
    return assets.resolve_references(asked, files, views.assets(spark, folder), ROOTS, REFERENCED_AT).select(
        "reference_id", "source_kind", "path", "asset_id", "byte_count", "error_code"
    )


def reference_contents(spark: SparkSession, folder: str) -> DataFrame:
    """The same references with contents: every file and asset has one, of which some are no image and some are lost."""
    asked, files = _references(spark, folder)
    owned = views.assets(spark, folder)
    ids = files.select(F.col("path").alias("content_id")).unionByName(owned.select(F.col("asset_id").alias("content_id")))
    size = F.length("content_id")
    head = F.when(size % 5 == 0, F.unhex(F.lit("474946383961"))).otherwise(F.unhex(F.lit("FFD8FF")))
    held = ids.where(size % 7 != 3).select("content_id", F.concat(head, F.encode("content_id", "UTF-8")).alias("content"))
    path = fresh_path(spark, "contents")
    sinks.write_contents(held, path)
    found = assets.reference_contents(asked, files, owned, spark.read.parquet(path), ROOTS, REFERENCED_AT)
    return found.select(
        "reference_id",
        "source_kind",
        "content_type",
        "byte_count",
        F.decode(F.substring("content", 4, 1000), "UTF-8").alias("says"),
        "error_code",
    )


def purge_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger after a purge that rewrote it, run twice."""
    path = fresh_path(spark, "purged")
    sinks.write_assets(views.assets(spark, folder).drop("expires_at"), path, TTL)
    for _ in range(2):
        sinks.purge_ledger(spark, path, AS_OF, "first")
    return sinks.read_assets(spark, path).select("asset_id", "principal", "kind", "byte_count")


def purge_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What that purge says of each kind of asset in the partitions it replaced."""
    path = fresh_path(spark, "purged")
    sinks.write_assets(views.assets(spark, folder).drop("expires_at"), path, TTL)
    counted = sinks.purge_ledger(spark, path, AS_OF, "first")
    return counted.groupBy("kind").agg(F.sum("removed").alias("removed"))


def quota_usage(spark: SparkSession, folder: str) -> DataFrame:
    both = assets.quota_usage(views.assets(spark, folder), AS_OF)
    return both


def container_usage(spark: SparkSession, folder: str) -> DataFrame:
    held = views.assets(spark, folder).drop("kind")
    artifact = F.col("asset_id").startswith("a")
    both = assets.catalogue(held.where(~artifact), held.where(artifact))
    return assets.quota_usage(both, AS_OF, "container")


def purge_expired(spark: SparkSession, folder: str) -> DataFrame:
    return assets.purge_counts(views.assets(spark, folder), AS_OF)


def purge_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """What a rewrite of the ledger keeps."""
    kept = assets.purge_expired(views.assets(spark, folder), AS_OF)
    return kept.select("asset_id", "principal", "kind", "byte_count")


def retention(spark: SparkSession, folder: str) -> DataFrame:
    old = assets.beyond_retention(views.assets(spark, folder), AS_OF, TTL)
    return old.select("asset_id", "age_days")


def orphan_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth asset lost its metadata."""
    blobs = views.assets(spark, folder).select("asset_id", "principal", "byte_count")
    lost = F.pmod(F.substring("asset_id", 2, 12).cast("long"), F.lit(5)) == 0
    return assets.orphan_blobs(blobs, views.assets(spark, folder).where(~lost))


def quota_admission(spark: SparkSession, folder: str) -> DataFrame:
    decided = admission.quota_admission(
        views.assets(spark, folder), TTL, QUOTA_BYTES, QUOTA_COUNT, MAX_UPLOAD
    )
    return decided.select("asset_id", "principal", "byte_count", _naive("created_at"), "decision")


def quota_admission_held(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth event is an asset that the store holds already, every twentieth an orphan that never expires."""
    number = F.substring("asset_id", 2, 12).cast("long")
    every = views.assets(spark, folder)
    held = every.where(number % 10 == 0).withColumn("expires_at", F.when(number % 20 != 0, F.col("expires_at")))
    decided = admission.quota_admission(
        every.where(number % 10 != 0), TTL, QUOTA_BYTES, QUOTA_COUNT, MAX_UPLOAD, held=held
    )
    return decided.select("asset_id", "principal", "byte_count", _naive("created_at"), "decision")


def request_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rolled = requests.request_rollup(views.requests(views.table(spark, folder, "events")))
    return rolled.withColumn("window_start", _naive("window_start"))


def rollup_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days from stored hours; quantiles are near if their ranks among all requests of the day are within one in a hundred."""
    asked = views.requests(views.table(spark, folder, "events"))
    path = fresh_path(spark, "hours")
    requests.request_sketches(asked).write.parquet(path)
    days = requests.merged_rollup(spark.read.parquet(path))
    keys = ["window_start", "path", "status"]
    raw = asked.select(F.date_trunc("day", "ts").alias("window_start"), "path", "status", "duration_ms")
    ranks = raw.join(days.select(*keys, "p50_ms", "p95_ms", "mean_ms"), keys).groupBy(*keys)
    found = {}
    for name, rank in (("p50", 0.5), ("p95", 0.95)):
        below = F.avg((F.col("duration_ms") < F.col(f"{name}_ms")).cast("int"))
        upto = F.avg((F.col("duration_ms") <= F.col(f"{name}_ms")).cast("int"))
        found[f"{name}_near"] = (below <= rank + 0.01) & (upto >= rank - 0.01)
    # Sums of hours and of requests differ in their last bits, so means are compared up to their rounding.
    exact = F.abs(F.avg("duration_ms") - F.first("mean_ms")) <= 0.0000501
    near = ranks.agg(*[c.alias(name) for name, c in found.items()], exact.alias("mean_near"))
    return days.drop("p50_ms", "p95_ms", "mean_ms").join(near, keys).withColumn("window_start", _naive("window_start"))


# -- streams ------------------------------------------------------------------


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = views.table(spark, folder, name).schema
    # The last letter as a pattern lets one path serve a file and a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def stream_intake(spark: SparkSession, folder: str) -> DataFrame:
    target, mark = fresh_path(spark, "intake"), fresh_path(spark, "intake-mark")
    gated = jobs.gated_intake(views.headers(_stream(spark, folder, "documents")), MAX_BYTES)
    jobs.start_intake(gated, target, mark).awaitTermination()
    columns = ("path", "byte_count", "content_type", "error_code")
    good = spark.read.parquet(f"{target}/accepted").withColumn(
        "error_code", F.lit(None).cast("string")
    )
    bad = spark.read.parquet(f"{target}/quarantine")
    return good.select(*columns).unionByName(bad.select(*columns))


def _in_time_order(spark: SparkSession, folder: str, parts: int = 6, rows_per_file: int = 100_000) -> DataFrame:
    """The event log as a stream of parts, written one after the other by time; a part per micro-batch.

    All parts have the same number of files, so that many tasks write and read one and a micro-batch still holds a whole part.
    """
    events = views.table(spark, folder, "events")
    path = fresh_path(spark, "event-files")
    cuts = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).approxQuantile(
        "t", [k / parts for k in range(1, parts)], 0.01
    )
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    within = [(F.lit(low is None) | (at > low)) & (F.lit(high is None) | (at <= high)) for low, high in bounds]
    least = min(events.agg(*[F.count_if(w).alias(f"n{k}") for k, w in enumerate(within)]).first())
    # Rows are dealt in turn, so no file of a part is empty, and empty ones would not be written.
    files = max(1, least // rows_per_file)
    for w in within:
        part = events.where(w)
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_quota(spark: SparkSession, folder: str) -> DataFrame:
    """Six micro-batches, each of them replayed."""
    ledger = jobs.AdmissionLedger(fresh_path(spark, "quota"), TTL, QUOTA_BYTES, QUOTA_COUNT, MAX_UPLOAD)
    uploads = views.uploads(_in_time_order(spark, folder))
    def twice(batch: DataFrame, number: int) -> None:
        """As if the query broke off after each batch and before its commit."""
        ledger.decide(batch, number)
        ledger.decide(batch, number)

    writer = uploads.writeStream.foreachBatch(twice).option("checkpointLocation", fresh_path(spark, "quota-mark"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return ledger.decisions(spark).select("asset_id", "principal", "byte_count", _naive("created_at"), "decision")


def stream_quota_held(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a store that holds every tenth event already, every twentieth as an orphan that never expires."""
    number = F.substring("asset_id", 2, 12).cast("long")
    held = views.assets(spark, folder).where(number % 10 == 0)
    held = held.withColumn("expires_at", F.when(number % 20 != 0, F.col("expires_at")))
    ledger = jobs.AdmissionLedger(
        fresh_path(spark, "quota"), TTL, QUOTA_BYTES, QUOTA_COUNT, MAX_UPLOAD, held=held
    )
    uploads = views.uploads(_in_time_order(spark, folder)).where(number % 10 != 0)
    ledger.start(uploads, fresh_path(spark, "quota-mark")).awaitTermination()
    return ledger.decisions(spark).select("asset_id", "principal", "byte_count", _naive("created_at"), "decision")


def stream_rollup(spark: SparkSession, folder: str) -> DataFrame:
    target, mark = fresh_path(spark, "rollup"), fresh_path(spark, "rollup-mark")
    rolled = jobs.stream_rollup(views.requests(_stream(spark, folder, "events")))
    jobs.start_table(rolled, target, mark).awaitTermination()
    return spark.read.parquet(target).withColumn("window_start", _naive("window_start"))


_ALL: dict[str, Query] = {
    "compare_totals": compare_totals,
    "compare_totals_sparse": compare_totals_sparse,
    "compare_tiles": compare_tiles,
    "compare_regions": compare_regions,
    "compare_topk": compare_topk,
    "compare_images": compare_images,
    "compare_regions_wide": compare_regions_wide,
    "compare_images_wide": compare_images_wide,
    "tile_adjacency": adjacent_tiles,
    "diff_raster": diff_raster,
    "diff_artifacts": diff_artifacts,
    "orient_pixels": orient_pixels,
    "box_gate": box_gate,
    "gated_requests": gated_requests,
    "fit_scale": fit_scale,
    "crop_pixels": crop_pixels,
    "crop_stored": crop_stored,
    "resample": resample_crops,
    "region_rasters": requested_rasters,
    "asset_ledger": asset_ledger,
    "content_sink": content_sink,
    "decoder_hook": decoder_hook,
    "scan_gate": scan_gate,
    "scan_images": scan_images,
    "stream_files": stream_files,
    "decode_tiles": decode_tiles,
    "decoded_files": decoded_files,
    "image_rgb": image_rgb,
    "stored_assets": stored_assets,
    "engine_hook": engine_hook,
    "fallback_run": fallback_run,
    "optimize_regions": optimize_requests,
    "changed_crops": changed_crops,
    "byte_savings": byte_savings,
    "ocr_managed": ocr_managed,
    "ocr_documents": ocr_documents,
    "ocr_local": ocr_local,
    "ocr_local_legacy": ocr_local_legacy,
    "reading_order": reading_order,
    "normalized_boxes": normalized_boxes,
    "block_cap": block_cap,
    "content_text": _content("text"),
    "content_markdown": _content("markdown"),
    "content_csv": _content("csv"),
    "provider_fallback": provider_fallback,
    "extract_layout": extract_layout,
    "sniff": sniff,
    "payload_gate": payload_gate,
    "path_gate": path_gate,
    "contained_paths": contained_paths,
    "reference_gate": reference_gate,
    "param_gate": param_gate,
    "language_gate": language_gate,
    "content_type_gate": content_type_gate,
    "quarantine": quarantine,
    "error_details": error_details,
    "asset_expiry": asset_expiry,
    "visible_assets": visible_assets,
    "resolve_references": resolve_references,
    "reference_contents": reference_contents,
    "quota_usage": quota_usage,
    "container_usage": container_usage,
    "purge_expired": purge_expired,
    "purge_survivors": purge_survivors,
    "purge_rewrite": purge_rewrite,
    "purge_manifest": purge_manifest,
    "retention": retention,
    "orphan_blobs": orphan_blobs,
    "quota_admission": quota_admission,
    "quota_admission_held": quota_admission_held,
    "request_rollup": request_rollup,
    "rollup_days": rollup_days,
    "stream_intake": stream_intake,
    "stream_quota": stream_quota,
    "stream_quota_held": stream_quota_held,
    "stream_rollup": stream_rollup,
}


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(apply_defaults(spark), folder)

    run.__name__ = query.__name__
    return run


QUERIES = {name: _configured(query) for name, query in _ALL.items()}
