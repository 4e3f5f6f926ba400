"""Tables of the shapes the operators need, derived from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def raster_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per image line: channel arrays of 64 values."""

    def channel(shift: int):
        spots = F.sequence(F.lit(0), F.lit(SIDE - 1))
        value = lambda i: F.get("embedding", F.pmod(i + shift, F.lit(SIDE))).cast("double")
        byte = lambda i: F.floor(
            F.least(F.greatest(value(i) + 0.5, F.lit(0.0)), F.lit(1.0)) * 255
        ).cast("short")
        return F.transform(spots, byte)

    return table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / SIDE).alias("image_id"),
        F.pmod("vec_id", F.lit(SIDE)).cast("int").alias("y"),
        channel(0).alias("r"),
        channel(21).alias("g"),
        channel(42).alias("b"),
    )


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = raster_rows(spark, folder).withColumn("ty", F.floor(F.col("y") / 16).cast("int"))
    bands = rows.groupBy("image_id", "ty").agg(
        F.array_sort(F.collect_list(F.struct("y", "r", "g", "b"))).alias("rows")
    )

    def cut(channel: str):
        part = lambda row: F.slice(row[channel], F.col("tx") * 16 + 1, F.lit(16))
        return F.flatten(F.transform("rows", part)).alias(channel)

    return bands.withColumn("tx", F.explode(F.array(*[F.lit(i) for i in range(4)]))).select(
        "image_id",
        "ty",
        "tx",
        F.lit(16).alias("tw"),
        F.size("rows").alias("th"),
        cut("r"),
        cut("g"),
        cut("b"),
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "embeddings")
        .groupBy(F.floor(F.col("vec_id") / SIDE).alias("image_id"))
        .agg(F.lit(SIDE).alias("width"), F.count("*").cast("int").alias("height"))
        .withColumn("byte_count", F.col("height").cast("long") * (3 * SIDE))
    )


def pairs(
    spark: SparkSession, folder: str, threshold: float = 0.55, max_regions: int = 20
) -> DataFrame:
    number = F.floor(F.col("vec_id") / (2 * SIDE)).alias("pair_id")
    ids = table(spark, folder, "embeddings").select(number).distinct()
    return ids.select(
        "pair_id",
        (F.col("pair_id") * 2).alias("before_id"),
        (F.col("pair_id") * 2 + 1).alias("after_id"),
        F.lit(threshold).alias("threshold"),
        F.lit(max_regions).alias("max_regions"),
        F.lit(True).alias("include_diff"),
    )


def crops(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    last = table(spark, folder, "embeddings").agg(F.floor(F.max("vec_id") / SIDE)).scalar()
    key = F.col("p_partkey")
    return part.select(
        key.alias("request_id"),
        F.pmod(key, last + 1).alias("image_id"),
        F.pmod(key * 7, F.lit(70)).cast("int").alias("x"),
        F.pmod(key, F.lit(60)).cast("int").alias("y"),
        (1 + F.pmod("p_size", F.lit(40))).cast("int").alias("width"),
        (1 + F.pmod(key, F.lit(30))).cast("int").alias("height"),
        F.lit(16).alias("max_width"),
        F.lit(16).alias("max_height"),
        F.lit(80).alias("quality"),
        F.element_at(
            F.array(F.lit("png"), F.lit("jpeg"), F.lit("webp")), (F.pmod(key, F.lit(3)) + 1).cast("int")
        ).alias("output_format"),
    )


def assets(spark: SparkSession, folder: str) -> DataFrame:
    return uploads(table(spark, folder, "events"))


def uploads(events: DataFrame) -> DataFrame:
    """Uploads of the event log; ``expires_at`` follows from a life of one day."""
    kind = F.element_at(
        F.create_map(
            *[
                F.lit(v)
                for v in (
                    *("click", "image/png"),
                    *("view", "IMAGE/JPEG; q=1"),
                    *("purchase", "image/webp"),
                    *("signup", "application/pdf"),
                    *("error", "image/png"),
                )
            ]
        ),
        F.col("event_type"),
    )
    artifact = F.pmod("event_id", F.lit(2)) == 1
    day = F.expr("INTERVAL '86400' SECOND")
    return events.select(
        F.concat(
            F.when(artifact, "a").otherwise(F.lit("i")), F.lpad(F.col("event_id").cast("string"), 12, "0")
        ).alias("asset_id"),
        F.when(artifact, "artifact").otherwise(F.lit("input")).alias("kind"),
        F.concat(F.lit("p_"), F.col("user_id").cast("string")).alias("principal"),
        kind.alias("content_type"),
        F.when(F.col("event_type") == "error", F.lit(0))
        .otherwise(F.floor(F.col("value") * 1000))
        .cast("long")
        .alias("byte_count"),
        F.col("ts").cast("timestamp").alias("created_at"),
        (F.date_trunc("second", F.col("ts").cast("timestamp")) + day).alias("expires_at"),
    )


def _lines():
    """All lines of a document as structs; blank ones keep their number."""
    return F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            i.alias("ord"),
            line.alias("text"),
            (12 * F.pmod(i * 17, F.lit(50))).cast("double").alias("top"),
            F.pmod(i * 7, F.lit(40)).cast("double").alias("left"),
            F.least(F.lit(600), 6 * F.length(line)).cast("double").alias("width"),
            (F.pmod(F.length(line), F.lit(101)) / 100.0).alias("confidence"),
        ),
    )


def _corners(line):
    right, low = line["left"] + line["width"], line["top"] + 10.0
    return [(line["left"], line["top"]), (right, line["top"]), (right, low), (line["left"], low)]


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    line = F.col("line")
    return (
        documents(spark, folder)
        .select(F.col("doc_id").alias("image_id"), F.explode(_lines()).alias("line"))
        .where(F.trim("line.text") != "")
        .select(
            "image_id",
            F.col("line.ord").alias("ord"),
            F.col("line.text").alias("text"),
            F.lit("line").alias("block_type"),
            (1 + F.floor(F.col("line.ord") / 50)).cast("int").alias("page"),
            F.array(*[v for point in _corners(line) for v in point]).alias("polygon"),
            F.col("line.confidence").alias("confidence"),
        )
    )


def page_images(spark: SparkSession, folder: str, width: int = 640, height: int = 600) -> DataFrame:
    return documents(spark, folder).select(
        F.col("doc_id").alias("image_id"),
        F.lit(width).alias("width"),
        F.lit(height).alias("height"),
        F.col("n_chars").cast("long").alias("byte_count"),
    )


def managed_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """One page per 50 lines; the kind of the items and the status follow from the document id."""
    doc = F.col("doc_id")
    item = lambda line: F.struct(
        line["text"].alias("content"),
        line["confidence"].alias("confidence"),
        F.struct(F.array(*[v for p in _corners(line) for v in p]).alias("polygon")).alias("source"),
    )
    last = F.floor((F.size("_lines") - 1) / 50).cast("int")

    def page(number):
        items = F.transform(F.slice("_lines", number * 50 + 1, F.lit(50)), item)
        return F.struct(
            F.concat(F.lit("# "), doc.cast("string"), F.lit("."), number.cast("string")).alias("markdown"),
            *[
                F.when(F.pmod(doc, F.lit(3)) == i, items).alias(name)
                for i, name in enumerate(("paragraphs", "lines", "words"))
            ],
        )

    body = F.to_json(
        F.struct(
            F.lit("Succeeded").alias("status"),
            F.struct(F.transform(F.sequence(F.lit(0), last), page).alias("contents")).alias("result"),
        )
    )
    status = F.when(F.pmod(doc, F.lit(7)) == 0, 500).when(F.pmod(doc, F.lit(11)) == 0, 401).otherwise(200)
    return (
        documents(spark, folder)
        .withColumn("_lines", _lines())
        .select(
            doc.alias("image_id"),
            F.lit("managed").alias("provider"),
            status.alias("status"),
            F.lit(None).cast("string").alias("error_code"),
            F.when(status == 200, body).alias("body"),
        )
    )


def local_payloads(spark: SparkSession, folder: str, variant: str = "modern") -> DataFrame:
    """The same lines from a local engine; every fifth document was throttled."""
    doc = F.col("doc_id")
    points = lambda line: F.array(*[F.array(*p) for p in _corners(line)])
    if variant == "modern":
        body = F.to_json(
            F.struct(
                F.struct(
                    F.transform("_lines", lambda line: line["text"]).alias("rec_texts"),
                    F.transform("_lines", lambda line: line["confidence"]).alias("rec_scores"),
                    F.transform("_lines", points).alias("rec_polys"),
                ).alias("res")
            )
        )
    else:
        quoted = lambda line: F.regexp_replace(
            F.to_json(F.array(line["text"])), r"^\[|\]$", ""
        )
        entry = lambda line: F.concat(
            F.lit("["),
            F.to_json(points(line)),
            F.lit(",["),
            quoted(line),
            F.lit(","),
            line["confidence"].cast("string"),
            F.lit("]]"),
        )
        body = F.concat(F.lit("[["), F.array_join(F.transform("_lines", entry), ","), F.lit("]]"))
    status = F.when(F.pmod(doc, F.lit(5)) == 0, 429).otherwise(200)
    return (
        documents(spark, folder)
        .withColumn("_lines", _lines())
        .select(
            doc.alias("image_id"),
            F.lit("local").alias("provider"),
            status.alias("status"),
            F.lit(None).cast("string").alias("error_code"),
            F.when(status == 200, body).alias("body"),
        )
    )


def headers(frame: DataFrame) -> DataFrame:
    """Documents behind the first bytes of an image format, chosen by the document id."""
    doc = F.col("doc_id")
    text = F.encode("text", "UTF-8")
    big = lambda v: F.unhex(F.lpad(F.hex(v), 8, "0"))
    fixed = lambda digits: F.unhex(F.lit(digits))
    content = (
        F.when(
            F.pmod(doc, F.lit(5)) == 0,
            F.concat(
                fixed("89504E470D0A1A0A0000000D49484452"),
                big(1 + F.pmod(doc * 37, F.lit(9000))),
                big(1 + F.pmod(doc * 53, F.lit(9000))),
                text,
            ),
        )
        .when(F.pmod(doc, F.lit(5)) == 1, F.concat(fixed("FFD8FF"), text))
        .when(F.pmod(doc, F.lit(5)) == 2, F.concat(fixed("524946460000000057454250"), text))
        .when(F.pmod(doc, F.lit(5)) == 3, F.concat(fixed("474946383961"), text))
        .otherwise(F.encode(F.lit(""), "UTF-8"))
    )
    return frame.select(
        F.concat(F.lit("/uploads/"), doc.cast("string")).alias("path"), content.alias("content")
    ).withColumn("byte_count", F.length("content").cast("long"))


def requests(frame: DataFrame) -> DataFrame:
    status = F.array(*[F.lit(s) for s in (200, 200, 200, 200, 400, 404, 413, 429, 503, 504)])
    return frame.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("/tools/"), F.col("event_type")).alias("path"),
        F.lit("POST").alias("method"),
        F.get(status, F.pmod("event_id", F.lit(10)).cast("int")).alias("status"),
        F.col("value").alias("duration_ms"),
    )


def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the page addresses; some relative, with a NUL, leaving their root, or missing."""
    page = F.col("page_id")
    clean = F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)", 1)
    path = (
        F.when(F.pmod(page, F.lit(10)) == 0, F.substr(clean, F.lit(2)))
        .when(F.pmod(page, F.lit(10)) == 1, F.concat(clean, F.lit("\u0000")))
        .when(F.pmod(page, F.lit(10)) == 2, F.concat(F.lit("/en/.."), clean))
        .when(F.pmod(page, F.lit(10)) == 3, F.concat(F.lit("/en/./../private"), clean))
        .when(F.pmod(page, F.lit(10)) == 4, F.lit("/en"))
        .otherwise(clean)
    )
    return table(spark, folder, "pages").select(
        "page_id", path.alias("path"), (F.pmod(page, F.lit(7)) != 0).alias("present")
    )


def references(spark: SparkSession, folder: str) -> DataFrame:
    """Image references in accepted and refused forms, by page id."""
    page = F.col("page_id")
    ident = F.concat(F.lit("i"), F.lpad(page.cast("string"), 12, "0"))
    form = F.pmod(page, F.lit(9))
    obj = lambda *fields: F.to_json(F.struct(*fields))
    kind = lambda name: F.lit(name).alias("kind")
    reference = (
        F.when(form == 0, obj(kind("local_path"), F.col("url").alias("path")))
        .when(form == 1, obj(kind("asset"), ident.alias("assetId")))
        .when(form == 2, obj(kind("base64"), F.lit("aGk=").alias("data")))
        .when(form == 3, obj(kind("url"), F.col("url").alias("url")))
        .when(form == 4, F.concat(F.lit('"'), F.col("url"), F.lit('"')))
        .when(form == 5, obj(kind("asset"), ident.alias("assetId"), F.lit(1).alias("extra")))
        .when(form == 6, obj(kind("asset"), F.concat(F.lit("../"), ident).alias("assetId")))
        .when(form == 7, obj(kind("asset"), F.concat(F.lit("i"), page.cast("string")).alias("assetId")))
        .otherwise(obj(kind("local_path"), page.alias("path")))
    )
    return table(spark, folder, "pages").select("page_id", reference.alias("reference"))


# -- large rasters: one pair, a tile per order, more than one block of tiles on a side ------------

WIDE_TILES = 100


def wide_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of changed pixels: an order is a tile, a line of it a pixel row, its quantity the run's length.

    Tiles of four ninths of the orders change, so components are many and of all sizes.
    """
    spot = F.col("l_orderkey").cast("long")
    return (
        table(spark, folder, "lineitem")
        .where(F.pmod(F.col("l_orderkey") * 7 + F.floor(F.col("l_orderkey") / 13) * 5, F.lit(9)) < 4)
        .groupBy(
            F.floor(spot / WIDE_TILES).cast("int").alias("ty"),
            F.pmod(spot, F.lit(WIDE_TILES)).cast("int").alias("tx"),
            F.pmod(F.col("l_linenumber"), F.lit(16)).cast("int").alias("row"),
        )
        .agg((1 + F.pmod(F.max("l_quantity").cast("int"), F.lit(16))).alias("run"))
    )


def wide_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Image 0 is black; image 1 is red along the runs."""
    grouped = wide_runs(spark, folder).groupBy("ty", "tx").agg(
        F.map_from_entries(F.collect_list(F.struct("row", "run"))).alias("runs")
    )
    black = F.array_repeat(F.lit(0).cast("short"), 256)
    # The lines that a run can make, by its length: a tile is sixteen of them, looked up, not 256 pixels computed one by one.
    line = lambda run: F.array(*[F.lit(255 if x < run else 0).cast("short") for x in range(16)])
    lines = F.array(*[line(run) for run in range(17)])
    length = lambda row: F.coalesce(F.try_element_at("runs", row), F.lit(0))
    rows = F.sequence(F.lit(0), F.lit(15))
    red = F.flatten(F.transform(rows, lambda row: F.get(lines, length(row))))
    shape = ["ty", "tx", F.lit(16).alias("tw"), F.lit(16).alias("th")]
    one = grouped.select(F.lit(0).cast("long").alias("image_id"), *shape, *[black.alias(c) for c in ("r", "g", "b")])
    two = grouped.select(
        F.lit(1).cast("long").alias("image_id"), *shape, red.alias("r"), black.alias("g"), black.alias("b")
    )
    return one.unionByName(two)


def wide_images(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").agg(F.floor(F.max("l_orderkey") / WIDE_TILES).alias("last"))
    return rows.select(
        F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("image_id"),
        F.lit(WIDE_TILES * 16).alias("width"),
        ((F.col("last") + 1) * 16).cast("int").alias("height"),
    )


def wide_pairs(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.col("id").alias("pair_id"),
        F.lit(0).cast("long").alias("before_id"),
        F.lit(1).cast("long").alias("after_id"),
        F.lit(0.5).alias("threshold"),
        F.lit(20).alias("max_regions"),
        F.lit(False).alias("include_diff"),
    )
