from __future__ import annotations

import json
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasters import png, solid

from rasterloom.functions.errors import error_struct
from rasterloom.operators.admission import quota_admission
from rasterloom.operators.requests import merged_rollup, request_rollup, request_sketches
from rasterloom.sources import images as sources
from rasterloom.sources import catalogue, folders, image_source, payloads, sinks
from rasterloom.streaming import jobs
from rasterloom_checks import queries as checks


def assembled(rows, shape):
    raster = np.full(shape, -1)
    for t in rows:
        for i, channel in enumerate("rgb"):
            part = np.array(t[channel]).reshape(t.th, t.tw)
            raster[t.ty * 16 : t.ty * 16 + t.th, t.tx * 16 : t.tx * 16 + t.tw, i] = part
    return raster


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "images"
    (root / "sub").mkdir(parents=True)
    raster = np.random.default_rng(1).integers(0, 256, (20, 40, 3))
    (root / "a.png").write_bytes(png(raster))
    (root / "sub" / "b.png").write_bytes(png(raster)[:60])
    (root / "c.gif").write_bytes(b"GIF89a..")
    (root / "big.png").write_bytes(png(solid(9, 9)) + b"0" * 9000)
    return root, raster


def test_scan_gate_and_decode(spark, folder):
    root, raster = folder
    files = sources.scan_images(spark, [str(root)], 5000)
    assert "LessThanOrEqual(length,5000)]" in files._jdf.queryExecution().toString()
    codes = {r.path: r.error_code for r in sources.gate_files(files, 5000).collect()}
    assert codes == {f"{root}/a.png": None, f"{root}/sub/b.png": None, f"{root}/c.gif": "unsupported_media"}
    assert [r.path for r in sources.oversized_files(spark, [str(root)], 5000).collect()] == [f"{root}/big.png"]
    turned = spark.createDataFrame([(f"{root}/a.png", 6)], "path string, orientation int")
    for orientations, wanted in ((None, raster), (turned, sources.upright(raster, 6))):
        decoded = sources.decode_images(spark, [str(root)], orientations)
        dims = {r.path: (r.width, r.height, r.error_code) for r in sources.image_dimensions(decoded).collect()}
        assert dims[f"{root}/a.png"] == (wanted.shape[1], wanted.shape[0], None)
        assert dims[f"{root}/sub/b.png"][2] == "invalid_input"
        rows = [t for t in sources.raster_tiles(decoded).collect() if t.image_id == f"{root}/a.png"]
        assert np.array_equal(assembled(rows, wanted.shape), wanted)


def test_the_gate_decides_over_the_decoder(spark, folder):
    root, _ = folder
    gated = sources.gate_files(sources.scan_images(spark, [str(root)], 5000), 5000)
    decoded = sources.decode_images(spark, [str(root)], gated=gated)
    codes = {r.path: r.error_code for r in sources.image_dimensions(decoded).collect()}
    assert codes == {
        f"{root}/a.png": None,
        f"{root}/sub/b.png": "invalid_input",
        f"{root}/c.gif": "unsupported_media",
        f"{root}/big.png": "payload_too_large",
    }
    assert {t.image_id for t in sources.raster_tiles(decoded).collect()} == {f"{root}/a.png"}


def test_decoder_and_engine_hooks(spark):
    raster = solid(20, 17, (1, 2, 3))
    files = spark.createDataFrame([("x", b"ok"), ("y", b"bad")], "image_id string, content binary")
    tiles = sources.decode_with(files, lambda content: raster if content == b"ok" else None).collect()
    assert {t.image_id for t in tiles} == {"x"}
    assert np.array_equal(assembled(tiles, raster.shape), raster)

    def engine(language):
        def run(content):
            if content == b"bad":
                raise TimeoutError
            return json.dumps({"res": {"rec_texts": [language], "rec_scores": [1], "rec_polys": [[[1, 2]]]}})

        return run

    saved = sources.recognize_with(files.withColumn("language", F.lit("fr")), "local", engine)
    rows = {r.image_id: r for r in saved.collect()}
    assert rows["y"].error_code == "timeout"
    assert payloads.parse_local(saved.where("image_id = 'x'")).first().blocks[0].text == "fr"


def test_sinks(spark, tmp_path):
    content = spark.createDataFrame([(1, "text", "a\nb"), (2, "csv", "c")], "image_id int, output_format string, content string")
    sinks.write_content(content, str(tmp_path / "content"))
    assert spark.read.parquet(str(tmp_path / "content")).where("output_format = 'csv'").first().content == "c"
    sinks.write_content_text(content, str(tmp_path / "texts"))
    assert next((tmp_path / "texts").glob("bucket=*/image_id=1/*.txt")).read_text() == "a\nb\n"
    sinks.write_json(content, str(tmp_path / "json"))
    assert "imageId" in spark.read.json(str(tmp_path / "json")).columns
    mixed = spark.createDataFrame([(1, None), (2, "busy")], "id int, error_code string")
    sinks.split_errors(mixed, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).columns == ["id"]
    assert spark.read.parquet(str(tmp_path / "bad")).first().error_code == "busy"
    error = mixed.select(error_struct(F.col("error_code"), F.lit("m")).alias("e")).where("e IS NOT NULL").first().e
    assert (error.code, error.retryable, error.details) == ("busy", True, {})


def test_intake_stream(spark, folder, tmp_path):
    root, _ = folder
    target = str(tmp_path / "out")
    gated = jobs.gated_intake(jobs.stream_images(spark, str(root), 5000), 5000)
    jobs.start_intake(gated, target, str(tmp_path / "mark")).awaitTermination()
    (root / "late.png").write_bytes(png(solid(3, 3)))
    again = jobs.gated_intake(jobs.stream_images(spark, str(root), 5000), 5000)
    jobs.start_intake(again, target, str(tmp_path / "mark")).awaitTermination()
    good = {r.path for r in spark.read.parquet(f"{target}/accepted").collect()}
    bad = {r.path: r.error_code for r in spark.read.parquet(f"{target}/quarantine").collect()}
    assert good == {f"{root}/a.png", f"{root}/sub/b.png", f"{root}/late.png"}
    assert bad == {f"{root}/c.gif": "unsupported_media", f"{root}/big.png": "payload_too_large"}


def test_folders_are_taken_in_one_by_one(spark, folder, tmp_path):
    """Every folder is a stream of its own; a later run takes new files and new folders alone."""
    root, _ = folder
    with pytest.raises(ValueError, match="3 files"):
        jobs.intake_folders(spark, str(root), str(tmp_path / "out"), str(tmp_path / "mark"))
    (root / "x[1]").mkdir()
    for name in ("a.png", "c.gif", "big.png"):
        (root / name).rename(root / "x[1]" / name)
    target, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    (root / "_hidden").mkdir()
    (root / "_hidden" / "x.png").write_bytes(b"x")
    (root / "a b=1" / "deep").mkdir(parents=True)
    for k in range(5):
        (root / "a b=1" / "deep" / f"{k}.png").write_bytes(png(solid(3, 3)))
    wanted = {f"{root}/x[1]/a.png", f"{root}/sub/b.png", *[f"{root}/a b=1/deep/{k}.png" for k in range(5)]}
    for late in ((), ("sub/late.png", "new/late.png")):
        for name in late:
            (root / name).parent.mkdir(exist_ok=True)
            (root / name).write_bytes(png(solid(3, 3)))
        jobs.intake_folders(spark, str(root), target, mark, 5000, 2, 3)
        good = [unquote(r.path) for r in spark.read.parquet(f"{target}/accepted").collect()]
        bad = {unquote(r.path): r.error_code for r in spark.read.parquet(f"{target}/quarantine").collect()}
        assert sorted(good) == sorted(wanted | {f"{root}/{name}" for name in late})
        assert bad == {f"{root}/x[1]/c.gif": "unsupported_media", f"{root}/x[1]/big.png": "payload_too_large"}
    numbers = sorted((tmp_path / "out" / "accepted").glob("part=a*/batch=*"))
    assert [p.name for p in numbers] == ["batch=0", "batch=1", "batch=2"]


def test_checked_files_lie_in_bounded_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checks, "FOLDER_FILES", 10)
    rows = [(k, f"text {k}", "en", "web", 6) for k in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    found = image_source.listed([checks._header_files(spark, str(tmp_path))])
    assert sorted(int(path.rpartition("/")[2]) for path, _ in found) == list(range(100))
    folders = [path.rpartition("/")[0] for path, _ in found]
    assert max(folders.count(name) for name in folders) < 30


def test_small_files_share_tasks(spark, tmp_path):
    """Thousands of small files are a few tasks, through either source; large ones keep a task each."""
    for k in range(400):
        (tmp_path / f"{k}.png").write_bytes(b"x")
    assert image_source.image_files(spark, [str(tmp_path)]).rdd.getNumPartitions() == 1
    # Spark never plans fewer partitions than cores; 400 files at 4 MB each would be 13.
    assert sources.scan_images(spark, [str(tmp_path)]).rdd.getNumPartitions() <= 9
    large = [(f"/f{k}", 128 << 20) for k in range(3)]
    assert [len(p.files) for p in image_source.planned(large, image_source.PARTITION_BYTES)] == [1, 1, 1]


def test_parts_of_the_event_log_have_equal_numbers_of_files(spark, tmp_path):
    """Many tasks write a part, and each micro-batch is one whole part."""
    rows = spark.range(1200).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        (F.col("id") % 7).alias("user_id"),
        F.lit("click").alias("event_type"),
        F.lit(0.01).alias("value"),
        F.lit("").alias("props"),
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    stream = checks._in_time_order(spark, str(tmp_path), 6, 50)

    def note(batch, number):
        rows = batch.withColumn("file", F.input_file_name())
        seen.append(rows.agg(F.min("event_id"), F.max("event_id"), F.count("*"), F.countDistinct("file")).first())

    writer = stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "mark"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 6 and sum(n for _, _, n, _ in seen) == 1200
    assert all(high - low + 1 == n for low, high, n, _ in seen)
    assert seen == sorted(seen) and {files for *_, files in seen} <= {3, 4}


def test_quota_stream_equals_the_batch(spark, tmp_path):
    """Six micro-batches in time order, some replayed, decide like one batch; a third of the uploads has one owner."""
    number = F.col("id")
    rows = spark.range(3000).select(
        F.concat(F.lit("i"), F.lpad(number.cast("string"), 8, "0")).alias("asset_id"),
        F.lit("input").alias("kind"),
        F.concat(F.lit("p_"), F.when(number % 3 == 0, 0).otherwise(number % 7).cast("string")).alias("principal"),
        F.lit("image/png").alias("content_type"),
        (1 + F.pmod(F.xxhash64("id"), F.lit(90))).alias("byte_count"),
        F.timestamp_micros(number * 350_000 + F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("created_at"),
    )
    held = spark.createDataFrame(
        [("p_0", "input", 200, None), ("p_1", "input", 390, 500), ("p_2", "input", 5, 10)],
        "principal string, kind string, byte_count long, second long",
    ).withColumn("expires_at", F.timestamp_seconds("second")).drop("second")
    source = str(tmp_path / "uploads")
    for part in range(6):
        rows.where(F.floor(F.col("asset_id").substr(2, 8).cast("int") / 500) == part).coalesce(1).write.mode(
            "append"
        ).parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ledger = jobs.AdmissionLedger(str(tmp_path / "ledger"), 60, 400, 6, held=held)
    numbers = []

    def decide(batch, n):
        numbers.append(n)
        ledger.decide(batch, n)
        if n in (2, 5):
            ledger.decide(batch, n)

    query = stream.writeStream.foreachBatch(decide).option("checkpointLocation", str(tmp_path / "mark"))
    query.trigger(availableNow=True).start().awaitTermination()
    got = {r.asset_id: r.decision for r in ledger.decisions(spark).collect()}
    wanted = {r.asset_id: r.decision for r in quota_admission(rows, 60, 400, 6, held=held).collect()}
    assert numbers == [0, 1, 2, 3, 4, 5]
    assert len(wanted) == 3000 and set(wanted.values()) == {"accepted", "quota_exceeded"}
    assert got == wanted
    # Snapshots do not pile up, and hold what is live alone.
    assert sorted(p.name for p in (tmp_path / "ledger" / "live").iterdir()) == ["batch=4", "batch=5"]
    assert spark.read.parquet(str(tmp_path / "ledger" / "live" / "batch=5")).count() <= 7 * 6 + 3


def test_files_are_planned_by_bytes():
    files = [(f"/f{k}", size) for k, size in enumerate([10, 90, 5, 200, 1, 1, 1])]
    parts = [[path for path, _ in p.files] for p in image_source.planned(files, 100, 0)]
    assert parts == [["/f0", "/f1"], ["/f2"], ["/f3"], ["/f4", "/f5", "/f6"]]
    assert [len(p.files) for p in image_source.planned(files, 100, 60)] == [1] * 7
    assert image_source.planned([], 100) == []


def test_image_source_decodes_what_passed_the_gate_alone(spark, folder, tmp_path):
    root, raster = folder
    (root / "empty.png").write_bytes(b"")
    (root / "_skipped").mkdir()
    (root / "_skipped" / "x.png").write_bytes(b"x")
    log = str(tmp_path / "decoded")

    def decoder(content):
        with open(log, "a") as file:
            file.write(f"{len(content)}\n")
        if len(content) < 100:
            raise ValueError("cut off")
        return raster.astype(np.uint8), 6

    files = image_source.image_files(spark, [str(root)], 5000, 1)
    assert files.rdd.getNumPartitions() == 5
    verdicts = image_source.gated(files, 5000)
    codes = {r.path.rpartition("/")[2]: (r.byte_count > 0, r.error_code) for r in verdicts.collect()}
    assert codes == {
        "a.png": (True, None),
        "b.png": (True, None),
        "c.gif": (True, "unsupported_media"),
        "big.png": (True, "payload_too_large"),
        "empty.png": (False, "invalid_input"),
    }
    tiles = image_source.decode_files(verdicts, decoder)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = tiles.collect()
    wanted = sources.upright(raster, 6)
    assert np.array_equal(assembled(rows, wanted.shape), wanted)
    # The file that was cut off passed the gate; neither the refused ones nor the large one came to the decoder.
    with open(log) as file:
        assert sorted(map(int, file)) == [60, len((root / "a.png").read_bytes())]
    sized = {r.path.rpartition("/")[2]: r for r in image_source.decoded_dimensions(verdicts, decoder).collect()}
    assert (sized["a.png"].width, sized["a.png"].height, sized["a.png"].error_code) == (20, 40, None)
    assert sized["b.png"].error_code == "invalid_input" and sized["a.png"].content_type == "image/png"
    few = image_source.decoded_dimensions(verdicts, decoder, 100).where("path LIKE '%a.png'").first()
    assert few.error_code == "payload_too_large"


def test_image_source_applies_filters_to_the_listing(spark, folder):
    root, _ = folder
    conf = "spark.sql.python.filterPushdown.enabled"
    usual = spark.conf.get(conf)
    for pushed in ("true", "false"):
        spark.conf.set(conf, pushed)
        files = image_source.image_files(spark, [str(root)], partition_bytes=1)
        some = files.where(F.col("path").startswith(f"{root}/sub"))
        assert [r.path for r in some.collect()] == [f"{root}/sub/b.png"]
        large = image_source.image_files(spark, [str(root)], partition_bytes=1).where("byte_count >= 9000")
        assert [r.path for r in large.collect()] == [f"{root}/big.png"]
        assert large.rdd.getNumPartitions() == (1 if pushed == "true" else 4)
        either = files.where(F.col("path").isin(f"{root}/a.png", f"{root}/c.gif") & (F.col("byte_count") < 9))
        assert [r.path for r in either.collect()] == [f"{root}/c.gif"]
    spark.conf.set(conf, usual)


def test_rollup_stream_equals_the_batch(spark, tmp_path):
    rows = spark.range(2000).select(
        F.timestamp_micros(F.col("id") * 9_000_000).alias("ts"),
        F.concat(F.lit("/tools/"), (F.col("id") % 3).cast("string")).alias("path"),
        F.element_at(F.array(F.lit(200), F.lit(404), F.lit(503)), (F.col("id") % 3 + 1).cast("int")).alias("status"),
        (F.col("id") % 100).cast("double").alias("duration_ms"),
    )
    source = str(tmp_path / "requests")
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    rolled = jobs.stream_rollup(stream)
    jobs.start_table(rolled, str(tmp_path / "out"), str(tmp_path / "mark"), "complete").awaitTermination()
    columns = ["window_start", "path", "status", "calls", "error_share", "retryable_share", "mean_ms", "max_ms", "p50_ms", "p95_ms"]
    got = set(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    assert got == set(map(tuple, request_rollup(rows).select(*columns).collect()))


def test_merged_sketches_stand_for_the_requests(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.timestamp_seconds(F.col("id") * 3).alias("ts"),
        F.lit("/tools/x").alias("path"),
        F.when(F.col("id") % 10 == 0, 503).otherwise(200).alias("status"),
        F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("duration_ms"),
    )
    rows = rows.withColumn("duration_ms", F.when(F.col("ts") < "1970-01-02", F.col("duration_ms")))
    request_sketches(rows).write.parquet(str(tmp_path / "hours"))
    stored = spark.read.parquet(str(tmp_path / "hours"))
    assert stored.count() == 2 * 50
    days = merged_rollup(stored).orderBy("window_start", "status").collect()
    day = F.date_trunc("day", "ts")
    for row in days:
        mine = rows.where((day == F.lit(row.window_start)) & (F.col("status") == row.status))
        exact = sorted(r[0] for r in mine.select("duration_ms").where("duration_ms IS NOT NULL").collect())
        assert row.calls == mine.count() and row.error_share == (row.status == 503)
        if not exact:
            assert row.p50_ms is None and row.mean_ms is None
            continue
        assert row.max_ms == exact[-1] and row.mean_ms == pytest.approx(np.mean(exact), abs=1e-3)
        for value, rank in ((row.p50_ms, 0.5), (row.p95_ms, 0.95)):
            assert abs(np.searchsorted(exact, value) / len(exact) - rank) < 0.005
    assert len(days) == 6 and merged_rollup(stored.limit(0)).count() == 0


def test_scans_list_a_bounded_number_of_files(spark, tmp_path):
    """Folders of any size, files beside them, names with signs of patterns: all is read once, a few files at a time."""
    root = tmp_path / "root"
    wanted = set()
    for k in range(30):
        part = root / ("x[1] {a,b}*" if k == 7 else "p=1 %20" if k == 8 else f"_k={k}" if k == 9 else f"f{k}") / "deep"
        part.mkdir(parents=True)
        for n in range(25 if k == 20 else 2):
            (part / f"{n}.png").write_bytes(b"x")
            wanted.add(f"{part}/{n}.png")
    (root / "loose.png").write_bytes(b"x")
    for name in ("_hidden/x.png", ".hidden/x.png", "_x.png"):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(b"x")
    seen = []

    def scan(paths):
        frame = sources.scan_images(spark, paths).select("path")
        seen.append((len(paths), folders._listed(frame)))
        return frame

    usual = {key: spark.conf.get(key) for key in folders._OPTIONS}
    plain = sources.scan_images(spark, [str(root)]).select("path")
    for given in ([str(root)], [f"{tmp_path}/ro*"]):
        found = folders.by_folders(spark, given, scan, "seen", 10)
        assert sorted(r.path for r in found.collect()) == sorted(r.path for r in plain.collect())
    assert {r.path for r in found.collect()} == wanted | {f"{root}/loose.png"}
    # Two files a folder: rounds of two, then of four or five; the one of 25 is listed as a whole, and a round of one follows.
    assert sum(n for _, n in seen) == 2 * (len(wanted) + 1)
    assert max(n for _, n in seen) <= 25 + 2 * 4 and 1 in [n for n, _ in seen]
    assert {key: spark.conf.get(key) for key in usual} == usual
    (tmp_path / "empty").mkdir()
    assert folders.by_folders(spark, [str(tmp_path / "empty")], scan, "seen", 10).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        folders.by_folders(spark, [str(tmp_path / "missing")], scan, "seen", 10)


def test_checked_scans_never_list_all_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checks, "FOLDER_FILES", 10)
    rows = [(k, f"text {k}", "en", "web", 6) for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    events = spark.range(120).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 60 AS user_id")
    events.write.parquet(str(tmp_path / "events.parquet"))
    usual, held = folders.by_folders, []

    def watched(spark, roots, scan, name, files=0):
        def noted(paths):
            frame = scan(paths)
            held.append(folders._listed(frame))
            return frame

        return usual(spark, roots, noted, name, 30)

    monkeypatch.setattr(folders, "by_folders", watched)
    monkeypatch.setattr(catalogue, "by_folders", watched)
    found = checks.QUERIES["scan_images"](spark, str(tmp_path))
    assert sorted(int(r.path.rpartition("/")[2]) for r in found.collect()) == [k for k in range(200) if k % 5 != 4]
    # Each of two scans lists the files of a round.
    assert sum(held) == 2 * 200 and max(held) <= 130
    held.clear()
    rows = checks.QUERIES["stored_assets"](spark, str(tmp_path)).collect()
    assert {int(r.asset_id[1:]): r.orphan for r in rows} == {k: k % 7 == 3 for k in range(60) if k % 5 != 2}
    assert sum(held) == 2 * (60 + 48) and max(held) <= 50


def test_micro_batches_of_small_files_are_one_task(spark, folder, tmp_path):
    """A file of each kind per micro-batch, however many cores there are; options of the caller's session hold, and stay as they are."""
    root, _ = folder
    (root / "one").mkdir()
    for k in range(60):
        (root / "one" / f"{k}.png").write_bytes(png(solid(3, 3)) if k % 2 else b"GIF89a..")
    target = tmp_path / "out"
    own = jobs._intake_session(spark)
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert own.conf.get("spark.sql.files.openCostInBytes") == spark.conf.get("spark.sql.files.openCostInBytes")
    before = spark.conf.getAll
    for name in ("a.png", "c.gif", "big.png"):
        (root / name).rename(root / "sub" / name)
    jobs.intake_folders(spark, str(root), str(target), str(tmp_path / "mark"), 5000, 30, 2)
    assert spark.conf.getAll == before
    for kind in ("accepted", "quarantine"):
        assert spark.read.parquet(str(target / kind / "part=one")).count() == 30
        for number in (0, 1):
            assert len(list((target / kind / "part=one" / f"batch={number}").glob("*.parquet"))) == 1
