"""Saved OCR responses: ``payloads(image_id, provider, status, error_code, body)`` to blocks.

A payload stays one row; its blocks are an array column. Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import capped_warnings, operation_state, provider_error_code
from ..functions.layout import clamped_polygon, local_confidence, points_flat
from ..functions.numeric import bind
from ..settings import (
    BLOCK,
    LOCAL_MODE,
    LOCAL_MODEL,
    MANAGED_API_VERSION,
    MANAGED_MODE,
    MANAGED_MODEL,
    MANAGED_PROVIDER,
    MSG_NO_BLOCKS,
    MSG_NO_CONTENT,
)

# Fixed value: any character that is no Unicode white space.
NON_BLANK = (
    r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


FLAT_NUMBERS = r"^ARRAY<(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))>$"
NESTED_NUMBERS = r"^ARRAY<ARRAY<(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))>>$"
_BLOCKS = f"array<{BLOCK.simpleString()}>"
_NUMBERS = "array<double>"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _at(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", _as(value, "string"))


def _falsy(value: Column) -> Column:
    """Null, false, zero, and empty texts and containers."""
    return F.to_json(value).isin('""', "0", "0.0", "-0.0", "false", "null", "[]", "{}")


def _number(value: Column) -> Column:
    """A JSON number or boolean as a double, anything else as null."""

    def converted(kind: Column) -> Column:
        return F.when(kind == "BOOLEAN", _as(value, "boolean").cast("double")).when(
            kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
            _as(value, "double"),
        )

    return bind(_kind(value), converted)


def _written_number(value: Column) -> Column:
    return _text(value).try_cast("double")


def _entry_values(entry: Column) -> Column:
    """What a polygon entry adds: a number, or the first two numbers of a pair, null for what is none."""
    pair = _as(entry, "array<variant>")
    return (
        F.when(_number(entry).isNotNull(), F.array(_number(entry)))
        .when(
            _kind(entry).startswith("ARRAY") & (F.size(pair) >= 2),
            F.transform(F.slice(pair, 1, 2), lambda v: F.coalesce(_number(v), _written_number(v))),
        )
        .otherwise(_empty(_NUMBERS))
    )


def _managed_polygon(item: Column, width: Column, height: Column) -> Column:
    direct = _at(item, "polygon")
    given = F.when(direct.isNull() | F.is_variant_null(direct), _at(item, "source.polygon")).otherwise(
        direct
    )

    def values(polygon: Column) -> Column:
        mixed = F.coalesce(_as(polygon, "array<variant>"), _empty("array<variant>"))
        return (
            F.when(_kind(polygon).rlike(FLAT_NUMBERS), _as(polygon, _NUMBERS))
            .when(
                _kind(polygon).startswith("ARRAY"),
                F.flatten(F.transform(mixed, lambda e: _entry_values(e))),
            )
            .otherwise(_empty(_NUMBERS))
        )

    return clamped_polygon(bind(given, values), width, height)


def _managed_text(item: Column) -> Column:
    """``content``, or ``text`` where content is falsy; only strings count."""

    def chosen(content: Column) -> Column:
        written = _text(content)
        return (
            F.when(F.length(written) > 0, written)
            .when(content.isNull() | written.isNotNull() | _falsy(content), _text(_at(item, "text")))
        )

    return bind(_at(item, "content"), chosen)


def _managed_block(
    item: Column, kind: Column, page: Column, width: Column, height: Column
) -> Column:
    def block(text: Column) -> Column:
        return F.when(
            text.rlike(NON_BLANK),
            F.struct(
                text.alias("text"),
                kind.alias("block_type"),
                page.alias("page"),
                _managed_polygon(item, width, height).alias("polygon"),
                _number(_at(item, "confidence")).alias("confidence"),
            ),
        ).cast(BLOCK)

    return bind(_managed_text(item), block)


def _page(content: Column, index: Column, width: Column, height: Column) -> Column:
    """Markdown, blocks and the missing-blocks flag of one page, null for what is no page.

    The first kind with a non-empty list wins, even if all its items are blank.
    """
    wanted = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"), _at(content, name, "array<variant>").alias("items")
            )
            for name, kind in (("paragraphs", "paragraph"), ("lines", "line"), ("words", "word"))
        ]
    )
    filled = F.slice(F.filter(wanted, lambda w: F.size(w["items"]) > 0), 1, 1)

    def blocks(group: Column) -> Column:
        return F.filter(
            F.transform(
                group["items"],
                lambda item: _managed_block(item, group["kind"], index + 1, width, height),
            ),
            lambda b: b.isNotNull(),
        )

    def page(parts: Column) -> Column:
        empty = (F.size(parts["groups"]) == 0) & parts["markdown"].isNull()
        return F.when(
            ~empty | _kind(content).startswith("OBJECT"),
            F.struct(
                parts["markdown"].alias("markdown"),
                F.flatten(parts["groups"]).alias("blocks"),
                (F.size(parts["groups"]) == 0).alias("bare"),
            ),
        )

    parts = F.struct(
        _text(_at(content, "markdown")).alias("markdown"),
        F.transform(filled, blocks).alias("groups"),
    )
    return bind(parts, page)


def parse_managed(payloads: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Managed payloads: adds ``blocks``, ``markdown``, ``warnings``, ``state`` and ``error_code``.

    ``payloads`` carries the image dimensions, because polygons are clamped to the image. The page
    number is the position in the page list, malformed pages included.
    """
    document = F.col("_document")
    saved = F.col("status")
    is_object = F.coalesce(document.isNotNull() & F.ltrim("body").startswith("{"), F.lit(False))
    own = _at(document, "result")
    result = F.when(own.isNull(), document).otherwise(own)
    contents = F.col("_contents")
    # A pair that holds no number fails the whole answer.
    unreadable = F.exists("blocks", lambda b: F.exists(b["polygon"], lambda v: v.isNull()))
    malformed = contents.isNull() & ~_kind(result).startswith("OBJECT")
    # A synchronous 200 answer carries no operation status.
    pending = (saved != 200) | _at(document, "status").isNotNull()
    done = F.col("state") == "ok"
    sound = done & ~malformed
    pages = F.filter(
        F.transform(
            F.when(sound, contents), lambda c, i: _page(c, i, F.col(width), F.col(height))
        ),
        lambda p: p.isNotNull(),
    )
    bare = F.transform(F.filter("_pages", lambda p: p["bare"]), lambda p: F.lit(MSG_NO_BLOCKS))
    empty = F.coalesce(F.size(contents), F.lit(0)) <= 0
    notes = F.when(empty, F.array(F.lit(MSG_NO_CONTENT))).otherwise(bare)
    markdown = F.array_join(F.transform("_pages", lambda p: p["markdown"]), "\n\n")
    return (
        payloads.withColumn("_document", F.try_parse_json("body"))
        .withColumn("_code", F.coalesce(F.col("error_code"), provider_error_code(saved)))
        .withColumn(
            "state",
            F.when(F.col("_code").isNotNull(), "failed")
            .when(~is_object, "provider_error")
            .when(pending, operation_state(_at(document, "status", "string")))
            .otherwise("ok"),
        )
        .withColumn("_contents", F.when(done, _at(result, "contents", "array<variant>")))
        .withColumn("_sound", sound)
        .withColumn("_pages", pages)
        .withColumn("warnings", F.when(F.col("_sound"), capped_warnings(notes)))
        .withColumn("blocks", F.flatten(F.transform("_pages", lambda p: p["blocks"])))
        .withColumn("blocks", _known_blocks(F.col("_sound")))
        .withColumn("_bad", F.coalesce(unreadable, F.lit(False)))
        .withColumn("blocks", F.when(~F.col("_bad"), F.col("blocks")))
        .withColumn("warnings", F.when(~F.col("_bad"), F.col("warnings")))
        .withColumn("markdown", F.nullif(markdown, F.lit("")))
        .withColumn(
            "error_code",
            F.coalesce(
                F.col("_code"),
                F.when(
                    (F.col("state") == "provider_error") | (done & ~F.col("_sound")),
                    "provider_error",
                ),
                F.when(F.col("_bad"), "internal"),
            ),
        )
        .drop("_document", "_code", "_contents", "_sound", "_pages", "_bad")
    )


def _known_blocks(known: Column) -> Column:
    return F.when(known, F.coalesce(F.col("blocks"), _empty(_BLOCKS)))


def _points(polygon: Column) -> Column:
    """Flat points of a polygon given as a list of lists."""
    nested = F.transform(
        _as(polygon, "array<variant>"),
        lambda p: F.when(
            _kind(p).startswith("ARRAY"),
            F.transform(
                F.slice(_as(p, "array<variant>"), 1, 2),
                lambda v: _as(v, "string").try_cast("double"),
            ),
        ),
    )
    plain = _kind(polygon).rlike(NESTED_NUMBERS)
    return points_flat(F.when(plain, _as(polygon, "array<array<double>>")).otherwise(nested))


def _local_block(text: Column, score: Column, polygon: Column) -> Column:
    written = F.when(_kind(text) == "STRING", _as(text, "string")).when(
        ~_falsy(text), F.to_json(text)
    )

    def block(parts: Column) -> Column:
        return F.when(
            (F.length(parts["text"]) > 0) & (F.size(parts["polygon"]) > 0),
            F.struct(
                parts["text"].alias("text"),
                F.lit("line").alias("block_type"),
                F.lit(1).alias("page"),
                parts["polygon"].alias("polygon"),
                parts["confidence"].alias("confidence"),
            ),
        ).cast(BLOCK)

    parts = F.struct(
        written.alias("text"),
        _points(polygon).alias("polygon"),
        bind(_as(score, "string"), local_confidence).alias("confidence"),
    )
    return bind(parts, block)


def _kept(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b.isNotNull())


def _modern_result(result: Column) -> Column:
    """Blocks of one result: its three lists side by side, as far as the shortest goes."""

    def blocks(lists: Column) -> Column:
        shortest = F.least(*[F.size(lists[c]) for c in ("texts", "scores", "polygons")])
        whole = (
            lists["texts"].isNotNull()
            & lists["scores"].isNotNull()
            & lists["polygons"].isNotNull()
        )
        side_by_side = F.slice(
            F.arrays_zip(lists["texts"], lists["scores"], lists["polygons"]), 1, shortest
        )
        return F.when(
            whole,
            _kept(
                F.transform(
                    side_by_side, lambda z: _local_block(z["texts"], z["scores"], z["polygons"])
                )
            ),
        ).otherwise(_empty(_BLOCKS))

    def lists(inner: Column) -> Column:
        polygons = F.when(
            _at(inner, "rec_polys").isNotNull(), _at(inner, "rec_polys", "array<variant>")
        ).otherwise(_at(inner, "dt_polys", "array<variant>"))
        return F.struct(
            _at(inner, "rec_texts", "array<variant>").alias("texts"),
            _at(inner, "rec_scores", "array<variant>").alias("scores"),
            polygons.alias("polygons"),
        )

    inner = F.coalesce(_at(result, "res"), result)
    return bind(bind(inner, lists), blocks)


def _legacy_page(page: Column) -> Column:
    def block(line: Column) -> Column:
        def pair(parts: Column) -> Column:
            recognition = _as(F.get(parts, 1), "array<variant>")
            return F.when(
                F.size(parts) == 2,
                bind(
                    recognition,
                    lambda r: F.when(
                        F.size(r) == 2, _local_block(F.get(r, 0), F.get(r, 1), F.get(parts, 0))
                    ),
                ),
            )

        return bind(_as(line, "array<variant>"), pair)

    lines = F.coalesce(_as(page, "array<variant>"), _empty("array<variant>"))
    return _kept(F.transform(lines, block))


def parse_local(payloads: DataFrame, variant: str = "modern") -> DataFrame:
    """Local engine payloads, ``modern`` (text, score and polygon lists) or ``legacy`` (nested)."""
    document = F.try_parse_json("body")
    if variant == "modern":
        listed = F.when(F.ltrim("body").startswith("["), _as(document, "array<variant>"))
        results = F.coalesce(listed, F.array(document))
        blocks = F.flatten(F.transform(results, _modern_result))
    else:
        pages = F.coalesce(_as(document, "array<variant>"), _empty("array<variant>"))
        blocks = F.flatten(F.transform(pages, _legacy_page))
    code = F.coalesce(F.col("error_code"), provider_error_code(F.col("status")))
    return (
        payloads.withColumn("error_code", code)
        .withColumn("state", F.when(F.col("error_code").isNull(), "ok").otherwise("failed"))
        .withColumn("blocks", blocks)
        .withColumn("blocks", _known_blocks(F.col("error_code").isNull()))
        .withColumn("markdown", F.lit(None).cast("string"))
        .withColumn(
            "warnings",
            F.when(F.col("error_code").isNull(), F.array().cast("array<string>")),
        )
    )


def provenance(provider: Column) -> Column:
    """Provider name, mode, model and API version of a result."""
    managed = provider == MANAGED_PROVIDER
    return F.struct(
        provider.alias("name"),
        F.when(managed, MANAGED_MODE).otherwise(LOCAL_MODE).alias("mode"),
        F.when(managed, MANAGED_MODEL).otherwise(LOCAL_MODEL).alias("model"),
        F.when(managed, MANAGED_API_VERSION).alias("api_version"),
    )


def explode_blocks(results: DataFrame) -> DataFrame:
    """One row per block with its position in the provider's list.

    The outer form keeps Spark from deriving a filter on the array, which would parse every payload
    once more to test it.
    """
    rows = results.select("image_id", F.posexplode_outer("blocks").alias("ord", "_block"))
    return rows.where("_block IS NOT NULL").select("image_id", "ord", "_block.*")
