"""Text blocks: polygons, normalized boxes, reading order inside a row, and content formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import (
    BLOCK_TYPES,
    CSV_HEADER,
    MAX_BLOCK_CHARS,
    MAX_BLOCKS,
    MAX_CONTENT_CHARS,
    MAX_POLYGON_VALUES,
)
from .numeric import bind, clamp, clamp01, round_exact


def _axis(polygon: Column, axis: int) -> Column:
    return F.filter(polygon, lambda v, i: F.pmod(i, F.lit(2)) == axis)


def order_top(polygon: Column) -> Column:
    return F.coalesce(F.array_min(_axis(polygon, 1)), F.lit(0.0))


def order_left(polygon: Column) -> Column:
    return F.coalesce(F.array_min(_axis(polygon, 0)), F.lit(0.0))


def clamped_polygon(values: Column, width: Column, height: Column) -> Column:
    """Flat polygon inside the image, empty for fewer than three points or an odd count.

    A value that could not be read leaves one null.
    """

    def inside(flat: Column) -> Column:
        usable = (F.size(flat) >= 6) & (F.pmod(F.size(flat), F.lit(2)) == 0)
        limit = lambda i: F.when(F.pmod(i, F.lit(2)) == 0, width).otherwise(height)
        clamped = F.transform(
            F.slice(flat, 1, MAX_POLYGON_VALUES),
            lambda v, i: clamp(v, F.lit(0.0), limit(i).cast("double")),
        )
        unread = F.array(F.lit(None).cast("double"))
        return (
            F.when(F.exists(flat, lambda v: v.isNull()), unread)
            .when(usable, clamped)
            .otherwise(F.array().cast("array<double>"))
        )

    return bind(values, inside)


def points_flat(points: Column) -> Column:
    """``array<array<double>>`` of points as flat x, y values; one bad point empties the list."""

    def flat(given: Column) -> Column:
        bad = F.exists(
            given,
            lambda p: p.isNull() | (F.size(p) < 2) | F.get(p, 0).isNull() | F.get(p, 1).isNull(),
        )
        pairs = F.flatten(F.transform(given, lambda p: F.slice(p, 1, 2)))
        return F.when(~F.coalesce(bad, F.lit(True)), pairs).otherwise(
            F.array().cast("array<double>")
        )

    return bind(points, flat)


def local_confidence(score: Column) -> Column:
    """Score as a double in 0..1; NaN counts as 1, what is no number is null."""
    value = score.try_cast("double")
    return F.when(F.isnan(value), F.lit(1.0)).otherwise(
        F.when(value.isNotNull(), clamp01(value))
    )


def block_type(kind: Column) -> Column:
    return F.when(kind.isin(*BLOCK_TYPES), kind).otherwise(F.lit("line"))


def block_id(order: Column) -> Column:
    return F.format_string("b%04d", order)


def block_text(text: Column) -> Column:
    return F.substring(text, 1, MAX_BLOCK_CHARS)


def normalized_box(polygon: Column, width: Column, height: Column) -> Column:
    """Bounding fractions of a polygon, null for an empty one."""

    def box(axes: Column) -> Column:
        left, top = F.array_min(axes["xs"]), F.array_min(axes["ys"])
        edges = F.array(left, top, F.array_max(axes["xs"]) - left, F.array_max(axes["ys"]) - top)
        return bind(
            F.transform(edges, lambda v: round_exact(v)),
            lambda e: F.struct(
                *[F.get(e, i).alias(n) for i, n in enumerate(("x", "y", "width", "height"))]
            ),
        )

    axes = F.struct(
        F.transform(_axis(polygon, 0), lambda v: clamp01(v / width)).alias("xs"),
        F.transform(_axis(polygon, 1), lambda v: clamp01(v / height)).alias("ys"),
    )
    return F.when(F.size(polygon) > 0, bind(axes, box))


def normalized_polygon(polygon: Column, width: Column, height: Column) -> Column:
    """Fractions of a polygon; an unpaired last value is dropped."""
    paired = F.slice(polygon, 1, F.size(polygon) - F.pmod(F.size(polygon), F.lit(2)))
    side = lambda i: F.when(F.pmod(i, F.lit(2)) == 0, width).otherwise(height)
    fractions = F.transform(paired, lambda v, i: clamp01(v / side(i)))
    return F.when(
        F.size(polygon) > 0,
        F.transform(F.slice(fractions, 1, MAX_POLYGON_VALUES), lambda v: round_exact(v)),
    )


def ordered_blocks(blocks: Column, max_blocks: int = MAX_BLOCKS) -> Column:
    """Blocks of one row in reading order, cut to the block limit."""
    keyed = F.transform(
        blocks,
        lambda b, i: F.struct(
            b["page"].alias("page"),
            order_top(b["polygon"]).alias("top"),
            order_left(b["polygon"]).alias("left"),
            i.alias("ord"),
            b.alias("block"),
        ),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, max_blocks), lambda k: k["block"])


def text_blocks(ordered: Column, width: Column, height: Column, coordinates: bool = True) -> Column:
    """Ordered provider blocks as response blocks with ids, boxes and polygons."""

    def shaped(block: Column, order: Column) -> Column:
        polygon = block["polygon"] if coordinates else F.array().cast("array<double>")
        return F.struct(
            block_id(order).alias("id"),
            block_type(block["block_type"]).alias("type"),
            block_text(block["text"]).alias("text"),
            block["page"].alias("page"),
            normalized_box(polygon, width, height).alias("box"),
            normalized_polygon(polygon, width, height).alias("polygon"),
            block["confidence"].alias("confidence"),
        )

    return F.transform(ordered, shaped)


def _csv_field(text: Column) -> Column:
    special = text.rlike('[,"\r\n]')
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _fixed(value: Column, digits: int, rounded: bool = True) -> Column:
    """A number from 0 on with a fixed count of decimals, empty for null."""
    exact = value if rounded else round_exact(value, digits)
    units = F.rint(exact * F.lit(float(10**digits))).cast("long")
    whole = F.floor(units / 10**digits).cast("string")
    rest = F.lpad(F.pmod(units, F.lit(10**digits)).cast("string"), digits, "0")
    return F.when(value.isNotNull(), F.concat(whole, F.lit("."), rest)).otherwise(F.lit(""))


def csv_line(
    block_id: Column,
    text: Column,
    confidence: Column,
    x: Column,
    y: Column,
    width: Column,
    height: Column,
) -> Column:
    return F.concat_ws(
        ",",
        block_id,
        _csv_field(text),
        _fixed(confidence, 4, rounded=False),
        *[_fixed(v, 6) for v in (x, y, width, height)],
    )


def content_line(output_format: str, block: Column) -> Column:
    if output_format == "csv":
        box = block["box"]
        return csv_line(
            block["id"],
            block["text"],
            block["confidence"],
            box["x"],
            box["y"],
            box["width"],
            box["height"],
        )
    if output_format == "markdown":
        return F.concat(F.lit("- "), block["text"])
    return block["text"]


def joined_content(output_format: str, lines: Column, markdown: Column | None = None) -> Column:
    """Uncut content: lines of text, a list, or CSV with header; provider markdown wins."""
    if output_format == "csv":
        return F.concat(
            F.array_join(F.concat(F.array(F.lit(CSV_HEADER)), lines), "\n"), F.lit("\n")
        )
    content = F.array_join(lines, "\n")
    if output_format == "markdown" and markdown is not None:
        content = F.when(F.length(markdown) > 0, markdown).otherwise(content)
    return content


def cut_content(content: Column) -> Column:
    return F.substring(content, 1, MAX_CONTENT_CHARS)


def content_is_cut(content: Column) -> Column:
    return F.length(content) > MAX_CONTENT_CHARS
