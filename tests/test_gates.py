from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from rasters import png, solid

from rasterloom.functions import errors, gates, media
from rasterloom.operators import assets
from rasterloom.settings import STATUS_BY_CODE


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("content", "code"),
    [
        (b"", "invalid_input"),
        (b"GIF89a" + b"0" * 50, "unsupported_media"),
        (b"\x89PNG\r\n\x1a\n", "invalid_input"),
        (b"\xff\xd8\xff" + b"0" * 5000, "payload_too_large"),
        (b"x" * 5000, "payload_too_large"),
        (b"RIFF0000WEBPxxxx", None),
        (b"RIFF0000WAVExxxx", "unsupported_media"),
        (png(solid(8, 8)), None),
        (png(solid(40, 30)), "payload_too_large"),
        (png(solid(8, 8))[:16] + b"\xff" * 8, "payload_too_large"),
    ],
)
def test_payload_gate(spark, content, code):
    assert one(spark, content, lambda c: media.payload_gate(c, 4096, 1000), "binary") == code


def test_decoded_gate(spark):
    rows = spark.createDataFrame([(40, 30), (-1, -1), (10, 10)], "w int, h int")
    got = [r.c for r in rows.select(media.decoded_gate(F.col("w"), F.col("h"), 1000).alias("c")).collect()]
    assert got == ["payload_too_large", "invalid_input", None]


def test_content_types(spark):
    for text, code in (
        ("image/png", None), (" IMAGE/JPEG ; q=1", None), ("image/webp;", None),
        ("application/pdf", "unsupported_media"), ("", "unsupported_media"), (None, "unsupported_media"),
    ):
        assert one(spark, text, media.content_type_gate) == code
    upload = lambda t, n: spark.range(1).select(
        media.upload_gate(F.lit(t), F.lit(n), 100).alias("c")
    ).first().c
    assert upload("application/pdf", 500) == "unsupported_media"
    assert upload("image/png", 500) == "payload_too_large"
    assert upload("image/png", 0) == "invalid_input"
    assert upload("image/png", 100) is None


@pytest.mark.parametrize(
    ("path", "code"),
    [
        ("relative.png", "invalid_input"),
        ("/data/a\0.png", "invalid_input"),
        ("/data/../etc/passwd", "forbidden"),
        ("/data/a/../b.png", None),
        ("/data", None),
        ("/data/", None),
        ("/database/x.png", "forbidden"),
        ("/other/./x.png", None),
        ("/../../data/x", None),
    ],
)
def test_path_gate(spark, path, code):
    assert one(spark, path, lambda p: gates.path_gate(p, ["/data", "/other"])) == code


def test_path_gate_without_roots_and_for_missing_files(spark):
    assert one(spark, "/data/x", lambda p: gates.path_gate(p, [])) == "invalid_input"
    assert one(spark, "/etc/x", lambda p: gates.path_gate(p, ["/data"], F.lit(False))) == "not_found"


def test_contained_paths(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/a/b",), ("/x/../a/b/d",), ("/",)], "path string")
    roots = spark.createDataFrame([("/a/b",), ("/q",), ("/a/b",)], "root string")
    got = {r.path for r in assets.contained_paths(paths, roots).collect()}
    assert got == {"/a/b/c", "/a/b", "/x/../a/b/d"}


def test_contained_paths_come_once_below_nested_roots_and_the_top(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/a/b/c",), ("/q/r",), ("a/b",), (None,), ("/z",)], "path string")

    def inside(*roots):
        found = assets.contained_paths(paths, spark.createDataFrame([(r,) for r in roots], "root string"))
        return sorted(r.path for r in found.collect())

    assert inside("/a", "/a/b", "/a/b/c", None) == ["/a/b/c", "/a/b/c"]
    assert inside("/", "/a", "/q") == ["/a/b/c", "/a/b/c", "/q/r", "/z"]
    assert inside() == []


@pytest.mark.parametrize(
    ("reference", "accepted"),
    [
        ({"kind": "local_path", "path": "/x"}, True),
        ({"kind": "asset", "assetId": "i2345678"}, True),
        ({"kind": "asset", "asset_id": "i2345678"}, True),
        ({"kind": "asset", "assetId": "i234567"}, False),
        ({"kind": "asset", "assetId": "i" * 129}, False),
        ({"kind": "asset", "assetId": "../escape"}, False),
        ({"kind": "asset", "assetId": "i2345678\n"}, False),
        ({"kind": "base64", "data": "aGk="}, False),
        ({"kind": "url", "url": "https://example.invalid/a.png"}, False),
        ("https://example.invalid/a.png", False),
        ({"kind": "local_path", "path": ""}, False),
        ({"kind": "local_path", "path": "x" * 4097}, False),
        ({"kind": "local_path", "path": 5}, False),
        ({"kind": "local_path", "path": "/x", "extra": 1}, False),
        ({"kind": "local_path", "assetId": "i2345678"}, False),
        ({"path": "/x"}, False),
        (None, False),
        ([], False),
    ],
)
def test_references(spark, reference, accepted):
    assert (one(spark, json.dumps(reference), gates.parsed_reference) is not None) == accepted


def test_ids_and_languages(spark):
    assert one(spark, "i-_45678", gates.asset_id_valid) is True
    for bad in ("../escape", "a/b", "", ".", "a\\b"):
        assert one(spark, bad, gates.stored_id_gate) == "not_found"
    assert one(spark, None, lambda v: gates.language_or_default(v)) == "en"
    assert one(spark, "", lambda v: gates.language_or_default(v)) == "en"
    assert one(spark, "fr", lambda v: gates.language_gate(v, ["en"])) == "invalid_input"
    assert one(spark, "fr", lambda v: gates.language_gate(v, ["en"], False)) is None
    assert one(spark, "x", lambda v: errors.first_errors(gates.language_param_errors(v))) == (
        "language: String should have at least 2 characters"
    )


def test_parameter_errors_are_reported_five_at_most(spark):
    row = spark.range(1).select(
        errors.first_errors(gates.compare_param_errors(F.lit(1.5), F.lit(0))).alias("a"),
        errors.first_errors(gates.compare_param_errors(F.lit(1.0), F.lit(100))).alias("b"),
        errors.first_errors(gates.crop_param_errors(*[F.lit(v) for v in (-1, -1, 0, 0, 1, 1, 0)])).alias("c"),
    ).first()
    assert row.a == (
        "threshold: Input should be less than or equal to 1; "
        "maxRegions: Input should be greater than or equal to 1"
    )
    assert row.b is None
    assert row.c.count(";") == 4 and row.c.endswith("maxWidth: Input should be greater than or equal to 16")


def test_error_table_and_details(spark):
    rows = errors.error_codes(spark)
    checked = rows.select(
        "code", "status", "retryable",
        errors.error_status(F.col("code")).alias("s"), errors.is_retryable(F.col("code")).alias("r"),
    ).collect()
    assert len(checked) == len(STATUS_BY_CODE) == 12
    assert all((r.status, r.retryable) == (r.s, r.r) for r in checked)
    long_key = "k" * 200
    entries = {f"{long_key}{i}": f"{i}" * 300 for i in range(3)} | {f"d{i}": "v" for i in range(12)}
    given = F.create_map(*[F.lit(v) for entry in entries.items() for v in entry])
    details = spark.range(1).select(errors.bounded_details(given).alias("d")).first().d
    assert details[long_key] == "2" * 200
    assert sorted(details) == sorted([long_key, *[f"d{i}" for i in range(7)]])


def test_roots_may_be_written_loosely(spark):
    gate = lambda p: gates.path_gate(p, ["/data/", "/srv/./x/../y"])
    assert one(spark, "/data/x.png", gate) is None
    assert one(spark, "/srv/y/z.png", gate) is None
    assert one(spark, "/database/x.png", gate) == "forbidden"


@pytest.mark.parametrize(
    ("box", "wrong"),
    [((0, 0, 10, 10), False), ((-1, 0, 5, 5), True), ((0, 0, 0, 5), True), ((3, 3, 5, -1), True), ((6, 6, 5, 5), True)],
)
def test_boxes(spark, box, wrong):
    sides = [F.lit(v) for v in (*box, 10, 10)]
    assert (spark.range(1).select(gates.box_error(*sides)).first()[0] is not None) == wrong


def test_object_ids(spark):
    for text, code in (("abc-1_2", None), ("-_-", "not_found"), ("a/b", "not_found"), ("", "not_found"), ("a b", "not_found")):
        assert one(spark, text, gates.object_id_gate) == code
