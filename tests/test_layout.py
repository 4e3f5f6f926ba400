from __future__ import annotations

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import layout as lay
from rasterloom.functions.numeric import round_exact
from rasterloom.operators import layout
from rasterloom.plans import extract as extraction
from rasterloom.plans.extract import extract_layout
from rasterloom.settings import BLOCK
from rasterloom.sources import payloads
from rasterloom.sources.images import recognize_with

PAYLOAD = "image_id int, provider string, status int, error_code string, body string"


def test_rounding_follows_the_binary_value(spark):
    numbers = [k / 640 for k in range(641)] + [k * 5e-7 for k in range(1, 500)]
    numbers += [random.Random(1).random() for _ in range(2000)] + [0.0, 1.0, -0.25, 12.0000005]
    rows = spark.createDataFrame([(v,) for v in numbers], "v double")
    got = rows.select("v", round_exact(F.col("v")).alias("r"), round_exact(F.col("v"), 4).alias("q"))
    for r in got.collect():
        assert (r.r, r.q) == (round(r.v, 6), round(r.v, 4)), r.v


def managed(spark, documents, width=100, height=50):
    rows = [(i, "m", status, None, body) for i, (status, body) in enumerate(documents)]
    frame = spark.createDataFrame(rows, PAYLOAD)
    return frame.withColumn("width", F.lit(width)).withColumn("height", F.lit(height))


def parsed_managed(spark, *documents):
    texts = [d if isinstance(d, tuple) else (200, json.dumps(d)) for d in documents]
    rows = payloads.parse_managed(managed(spark, texts)).orderBy("image_id").collect()
    return rows[0] if len(rows) == 1 else rows


def page(**kinds):
    return {"result": {"contents": [kinds]}}


def test_managed_payload(spark):
    row = parsed_managed(
        spark,
        {
            "status": "Succeeded",
            "result": {
                "contents": [
                    {"markdown": "| a | b |", "lines": [{"content": "left", "confidence": 1}]},
                    {
                        "markdown": "tail",
                        "lines": [{"content": "\t"}, {"text": "right", "polygon": [[4, 4], [9, 4], [9, 8]]}],
                        "words": [{"content": "lost to the lines"}],
                    },
                ]
            },
        },
    )
    assert (row.markdown, row.warnings, row.state) == ("| a | b |\n\ntail", [], "ok")
    shown = [(b.text, b.block_type, b.page, b.confidence, b.polygon) for b in row.blocks]
    assert shown == [("left", "line", 1, 1.0, []), ("right", "line", 2, None, [4.0, 4.0, 9.0, 4.0, 9.0, 8.0])]


def test_managed_polygons_of_written_numbers(spark):
    def answer(polygon):
        return parsed_managed(spark, page(lines=[{"content": "t", "polygon": polygon}]))

    (block,) = answer([["12", "3"], [4, " 5 "], [6, 7]]).blocks
    assert block.polygon == [12.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    broken = answer([["12", "3"], ["abc", 4], [5, 6]])
    assert (broken.blocks, broken.error_code) == (None, "internal")


def test_managed_texts(spark):
    items = [
        {"content": "", "text": "second"},
        {"content": "  ", "text": "not reached"},
        {"content": 5, "text": "not reached"},
        {"content": 0, "text": "zero is falsy"},
        {"content": [], "text": "so is an empty list"},
        {"content": None, "text": "and null"},
        {"text": 7},
        "no object",
        {"content": " kept "},
        {"content": "　 "},
    ]
    row = parsed_managed(spark, page(lines=items))
    assert [b.text for b in row.blocks] == [
        "second", "zero is falsy", "so is an empty list", "and null", " kept ",
    ]


def test_managed_polygons(spark):
    shapes = [
        [[1, 2], [3, 4, 9], [5, 60]],
        [1, 2, 3, 4],
        [1, 2, 3, 4, 5, 6, 7],
        [-5, 2, 300, 4, 5.5, [6, 7]],
        [True, 2, "x", 3, 4, {"a": 1}, 5, [6]],
        list(range(40)),
        None,
    ]
    items = [{"content": "t", "polygon": s, "source": {"polygon": [0, 0, 1, 1, 2, 2]}} for s in shapes]
    row = parsed_managed(spark, page(words=items))
    assert [b.polygon for b in row.blocks] == [
        [1.0, 2.0, 3.0, 4.0, 5.0, 50.0],
        [],
        [],
        [],
        [],
        [float(min(v, 100 if v % 2 == 0 else 50)) for v in range(32)],
        [0.0, 0.0, 1.0, 1.0, 2.0, 2.0],
    ]


def test_managed_pages_and_kinds(spark):
    contents = [
        7,
        {"paragraphs": [{"content": " "}], "lines": [{"content": "hidden by a blank paragraph"}]},
        {"lines": [], "words": [{"content": "w", "confidence": 3}]},
        {"markdown": "m1"},
        {"other": 1},
        {"markdown": "m2", "lines": [{"content": "l", "confidence": "high"}]},
    ]
    row = parsed_managed(spark, {"result": {"contents": contents}})
    assert [(b.text, b.block_type, b.page, b.confidence) for b in row.blocks] == [
        ("w", "word", 3, 3.0),
        ("l", "line", 6, None),
    ]
    assert row.markdown == "m1\n\nm2"
    assert row.warnings == ["provider returned no positional blocks"] * 2


def test_managed_states(spark):
    cases = [
        ((401, None), "failed", "forbidden"),
        ((403, None), "failed", "forbidden"),
        ((429, None), "failed", "quota_exceeded"),
        ((400, None), "failed", "invalid_input"),
        ((415, None), "failed", "invalid_input"),
        ((500, None), "failed", "provider_unavailable"),
        ((408, None), "failed", "provider_unavailable"),
        ((302, None), "failed", "provider_error"),
        ((200, "[]"), "provider_error", "provider_error"),
        ((200, "{"), "provider_error", "provider_error"),
        ((200, '{"result": 5}'), "ok", "provider_error"),
        ((200, '{"status": "RUNNING"}'), "pending", None),
        ((200, '{"status": "Canceled"}'), "provider_error", "provider_error"),
        ((202, "{}"), "provider_error", "provider_error"),
        ((200, '{"contents": []}'), "ok", None),
    ]
    rows = parsed_managed(spark, *[c[0] for c in cases])
    assert [(r.state, r.error_code) for r in rows] == [(c[1], c[2]) for c in cases]
    assert rows[-1].warnings == ["provider returned no content"]
    assert rows[-1].blocks == []


def local(spark, body, variant="modern"):
    frame = spark.createDataFrame([(0, "l", 200, None, json.dumps(body))], PAYLOAD)
    return payloads.parse_local(frame, variant).first().blocks


def test_local_payloads(spark):
    square = [[0, 0], [10, 0], [10, 5], [0, 5]]
    result = {
        "res": {
            "rec_texts": ["hello", "", " ", "no polygon", 0, 12, "bad point", "beyond the shortest"],
            "rec_scores": [0.9, 0.5, "NaN", 1, 1, 7, None],
            "rec_polys": [square, square, [[1, "2"]], [], square, square, [[1, 2], [3]], square],
        }
    }
    blocks = local(spark, result)
    assert [(b.text, b.confidence) for b in blocks] == [("hello", 0.9), (" ", 1.0), ("12", 1.0)]
    assert blocks[1].polygon == [1.0, 2.0]
    assert local(spark, [result, {"rec_texts": ["x"], "rec_scores": [-1], "dt_polys": [square]}])[-1].confidence == 0.0
    legacy = [[[square, ["legacy", 0.75]], [square, ["three", 1, 2]], 5], "no page"]
    (block,) = local(spark, legacy, "legacy")
    assert (block.text, block.confidence) == ("legacy", 0.75)


def blocks_frame(spark, rows):
    return spark.createDataFrame(rows, "image_id int, ord int, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in BLOCK
    ))


SECOND = ("second", "line", 1, [20.0, 20.0, 50.0, 20.0, 50.0, 30.0, 20.0, 30.0], 0.8)
FIRST = ("first", "line", 1, [10.0, 2.0, 40.0, 2.0, 40.0, 12.0, 10.0, 12.0], 0.95)


def shaped(spark, rows, max_blocks=500, coordinates=True):
    ordered = layout.reading_order(blocks_frame(spark, rows), max_blocks)
    return layout.shaped_blocks(ordered, F.lit(100), F.lit(50), coordinates)


def test_order_ids_boxes_and_formats(spark):
    both = shaped(spark, [(1, 0, *SECOND), (1, 1, *FIRST)])
    rows = both.orderBy("position").collect()
    assert [(r.id, r.text) for r in rows] == [("b0000", "first"), ("b0001", "second")]
    assert (rows[0].box.x, rows[0].box.y) == (0.1, 0.04)
    content = {f: layout.assemble_content(both, f).first().content for f in ("text", "markdown", "csv")}
    assert content["text"] == "first\nsecond" and content["markdown"] == "- first\n- second"
    assert content["csv"].splitlines()[1] == "b0000,first,0.9500,0.100000,0.040000,0.300000,0.200000"
    bare = shaped(spark, [(1, 0, *FIRST)], coordinates=False).first()
    assert bare.box is None and bare.polygon is None


def test_ties_keep_their_order_and_empty_polygons_come_first(spark):
    rows = [(1, i, f"t{i}", "odd", 1, [0.0, 5.0, 1.0, 6.0], None) for i in range(5)]
    rows += [(1, 9, "nowhere", "word", 1, [], None), (1, 10, "page two", "word", 2, [], None)]
    got = shaped(spark, rows).orderBy("position").collect()
    assert [r.text for r in got] == ["nowhere", "t0", "t1", "t2", "t3", "t4", "page two"]
    assert got[0].box is None and got[1].type == "line"


def test_long_lists_are_cut(spark):
    rows = [(1, i, f"line-{i}", "line", 1, [0.0, float(i), 5.0, i + 1.0, 5.0, i + 2.0], 0.5) for i in range(600)]
    assert shaped(spark, rows).count() == 500
    counts = layout.block_counts(blocks_frame(spark, rows)).first()
    assert (counts.block_count, counts.truncated) == (600, True)


def test_csv_equals_the_standard_writer(spark):
    texts = ["plain", 'say "hi"', "a,b", "two\nlines", "cr\rhere", "", " lead", "é;ü"]
    rows = [(1, i, t, "line", 1, [], [None, 0.00005, 0.12345, 1.0][i % 4]) for i, t in enumerate(texts)]
    content = layout.assemble_content(shaped(spark, rows), "csv").first().content
    stream = io.StringIO()
    writer = csv.writer(stream, lineterminator="\n")
    writer.writerow("id,text,confidence,x,y,width,height".split(","))
    for i, t in enumerate(texts):
        c = rows[i][-1]
        writer.writerow((f"b{i:04d}", t, "" if c is None else f"{c:.4f}", "", "", "", ""))
    assert content == stream.getvalue()


def test_content_limit_counts_characters(spark):
    rows = [(1, i, "é" * 5000, "line", 1, [], None) for i in range(60)]
    row = layout.assemble_content(shaped(spark, rows), "text").first()
    assert len(row.content) == 200_000 and row.content_truncated


@pytest.fixture(scope="module")
def routed(spark):
    good = json.dumps({"result": {"contents": [{"markdown": "# T", "lines": [{"content": "x", "confidence": 2}]}]}})
    fine = json.dumps({"result": {"contents": [{"markdown": "# T", "lines": [{"content": "x"}] * 3}]}})
    primary = payloads.parse_managed(
        managed(spark, [(503, None), (401, None), (200, fine), (200, good), (503, None), (503, None)])
    )
    answer = json.dumps({"res": {"rec_texts": ["local"], "rec_scores": [1], "rec_polys": [[[1, 2]]]}})
    second = spark.createDataFrame(
        [(i, "l", 429 if i == 4 else 200, None, answer) for i in (0, 1, 2, 3, 4)], PAYLOAD
    )
    return primary, payloads.parse_local(second)


def test_fallback_only_after_retryable_failures(spark, routed):
    rows = {r.image_id: r for r in layout.fall_back(*routed).collect()}
    assert rows[0].fallback_used and rows[0].provider.name == "local_paddleocr"
    assert rows[0].warnings == [
        "fell back to the local provider after a retryable failure: provider_unavailable"
    ]
    assert (rows[1].error_code, rows[1].fallback_used) == ("forbidden", False)
    assert rows[2].provider.mode == "azure" and rows[2].error_code is None
    assert rows[4].error_code == "quota_exceeded"
    assert rows[5].error_code == "provider_unavailable"
    forced = {r.image_id: r for r in layout.fall_back(*routed, mode="azure").collect()}
    assert forced[0].error_code == "provider_unavailable" and not forced[0].fallback_used


def test_extract_in_the_payload_row(spark, routed):
    images = spark.createDataFrame([(i, 100, 50) for i in range(5)], "image_id int, width int, height int")
    results = layout.fall_back(*routed)
    rows = {r.image_id: r for r in extract_layout(results, images, max_blocks=2).collect()}
    assert rows[2].content == "# T" and len(rows[2].blocks) == 2 and rows[2].truncated
    assert rows[2].warnings == ["block list truncated to 2 entries"]
    assert rows[0].content == "- local" and rows[0].blocks[0].box.x == 0.01
    assert rows[3].error_code == "internal" and rows[3].blocks is None
    assert rows[5].error_code == "not_found"
    text = {r.image_id: r for r in extract_layout(results, images, "text", False).collect()}
    assert text[2].content == "x\nx\nx" and text[0].blocks[0].box is None


def test_unpaired_values_do_not_shift_axes(spark):
    row = spark.range(1).select(
        lay.normalized_polygon(F.array(*map(F.lit, (10.0, 10.0, 20.0))), F.lit(100), F.lit(50)).alias("p")
    ).first()
    assert row.p == [0.1, 0.2]


def test_block_limit_is_applied_before_the_shuffle(spark):
    ordered = layout.reading_order(blocks_frame(spark, [(1, i, *FIRST) for i in range(9)]))
    plan = ordered._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_a_fallback_run_goes_on_and_calls_each_engine_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def engine(name, fails):
        def make(language):
            def run(content):
                with open(log, "a") as file:
                    file.write(f"{name} {content.decode()}\n")
                if fails(content):
                    raise TimeoutError
                return json.dumps({"res": {"rec_texts": [name], "rec_scores": [1], "rec_polys": [[[0, 0], [9, 0], [9, 9]]]}})

            return run

        return lambda rows: recognize_with(rows, name, make)

    files = spark.createDataFrame([(str(k), "en", str(k).encode()) for k in range(40)], "image_id string, language string, content binary")
    primary = engine("first", lambda content: int(content) % 4 == 0)
    secondary = engine("second", lambda content: content == b"8")

    def parsed(rows):
        return payloads.parse_local(rows.withColumns({"width": F.lit(100), "height": F.lit(100)}))

    broken = iter([False, False, True])

    def interrupted(rows):
        if next(broken):
            raise RuntimeError("lost")
        return primary(rows)

    path = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        extraction.fallback_run(files, interrupted, secondary, parsed, parsed, path, 4)
    for _ in range(2):
        found = extraction.fallback_run(files, primary, secondary, parsed, parsed, path, 4)
        rows = {r.image_id: r for r in found.collect()}
    assert {k for k, r in rows.items() if r.fallback_used} == {str(k) for k in range(0, 40, 4)}
    assert rows["3"].blocks[0].text == "first" and rows["4"].blocks[0].text == "second"
    assert rows["8"].error_code == "timeout"
    with open(log) as file:
        calls = sorted(line.strip() for line in file)
    assert calls == sorted([f"first {k}" for k in range(40)] + [f"second {k}" for k in range(0, 40, 4)])
