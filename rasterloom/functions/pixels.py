"""Per-pixel expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import round_exact


def oriented_position(
    orientation: Column, x: Column, y: Column, width: Column, height: Column
) -> tuple[Column, Column]:
    """Where a stored pixel lies in the upright image, per EXIF orientation 1..8."""
    right = width - 1 - x
    low = height - 1 - y
    new_x = (
        F.when(orientation.isin(2, 3), right)
        .when(orientation.isin(5, 8), y)
        .when(orientation.isin(6, 7), low)
        .otherwise(x)
    )
    new_y = (
        F.when(orientation.isin(3, 4), low)
        .when(orientation.isin(5, 6), x)
        .when(orientation.isin(7, 8), right)
        .otherwise(y)
    )
    return new_x, new_y


def oriented_size(orientation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    swapped = F.coalesce(orientation.between(5, 8), F.lit(False))
    return (
        F.when(swapped, height).otherwise(width),
        F.when(swapped, width).otherwise(height),
    )


def fit_scale(width: Column, height: Column, max_width: Column, max_height: Column) -> Column:
    """Factor that fits a crop into its limits; crops are never enlarged."""
    return F.least(
        max_width / width.cast("double"), max_height / height.cast("double"), F.lit(1.0)
    )


def fitted(side: Column, scale: Column) -> Column:
    return F.when(
        scale < 1.0, F.greatest(F.lit(1), F.rint(side * scale).cast("int"))
    ).otherwise(side)


def box_fraction(part: Column, whole: Column) -> Column:
    return round_exact(part.cast("double") / whole.cast("double"), 6)


def union_area(
    before_width: Column, before_height: Column, after_width: Column, after_height: Column
) -> Column:
    overlap = overlap_area(before_width, before_height, after_width, after_height)
    return (
        before_width.cast("long") * before_height.cast("long")
        + after_width.cast("long") * after_height.cast("long")
        - overlap
    )


def overlap_area(
    before_width: Column, before_height: Column, after_width: Column, after_height: Column
) -> Column:
    return F.least(before_width, after_width).cast("long") * F.least(
        before_height, after_height
    ).cast("long")


def changed_ratio(changed: Column, union: Column) -> Column:
    return F.when(union > 0, round_exact(changed / union.cast("double"), 6)).otherwise(F.lit(0.0))


def similarity(channel_sum: Column, outside: Column, union: Column) -> Column:
    """One minus the mean of the per-pixel mean channel delta; positions outside count in full."""
    difference = channel_sum / F.lit(3.0) + outside * F.lit(255.0)
    return round_exact(F.greatest(F.lit(0.0), F.lit(1.0) - difference / (union * F.lit(255.0))), 6)
