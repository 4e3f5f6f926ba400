"""Lanczos downscaling of crops in two separable passes.

The horizontal pass sees one crop line per row, the vertical pass one strip of 16 output columns per
row, so no row ever holds a whole image. Within an Arrow batch all rows of the same geometry are
multiplied with one weight matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .regions import CHANNELS, crop_segments, field
from .spread import ROWS_PER_SLOT

STRIP = 16
LOBES = 3.0
WEIGHT_BITS = 22


def lanczos_weights(size: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """First input position and fixed-point weights ``(target, support)`` of every output position."""
    scale = size / target
    stretch = max(scale, 1.0)
    reach = LOBES * stretch
    centre = (np.arange(target) + 0.5) * scale
    first = np.maximum((centre - reach + 0.5).astype(np.int64), 0)
    end = np.minimum((centre + reach + 0.5).astype(np.int64), size)
    offset = np.arange(int((end - first).max()))
    at = first[:, None] + offset[None, :]
    distance = (at - centre[:, None] + 0.5) / stretch
    weight = np.where(np.abs(distance) < LOBES, np.sinc(distance) * np.sinc(distance / LOBES), 0.0)
    weight = np.where(at < end[:, None], weight, 0.0)
    weight /= weight.sum(axis=1, keepdims=True)
    fixed = np.floor(weight * 2**WEIGHT_BITS + 0.5).astype(np.int64)
    return first, fixed


def shrink_lines(lines: np.ndarray, target: int) -> np.ndarray:
    """Lines ``(n, size)`` of 0..255 to ``(n, target)``, rounded and clamped to 0..255."""
    size = lines.shape[1]
    if size == target:
        return lines
    first, weights = lanczos_weights(size, target)
    out = np.empty((lines.shape[0], target), dtype=np.int64)
    for column in range(target):
        start = first[column]
        stop = min(start + weights.shape[1], size)
        out[:, column] = lines[:, start:stop] @ weights[column, : stop - start]
    return np.clip((out + 2 ** (WEIGHT_BITS - 1)) >> WEIGHT_BITS, 0, 255)


def _by_geometry(sizes: pd.Series, targets: pd.Series) -> Iterator[tuple[int, int, np.ndarray]]:
    keys = pd.DataFrame({"size": sizes.to_numpy(), "target": targets.to_numpy()})
    for (size, target), rows in keys.groupby(["size", "target"]).indices.items():
        yield int(size), int(target), rows


@F.pandas_udf(T.ArrayType(T.ShortType()))
def _shrink_across(values: pd.Series, width: pd.Series, target: pd.Series) -> pd.Series:
    """The three channels of a line one after another, each of ``width`` values."""
    out = np.empty(len(values), dtype=object)
    for size, goal, rows in _by_geometry(width, target):
        stacked = np.concatenate([np.asarray(values.iloc[i], dtype=np.int64) for i in rows])
        shrunk = shrink_lines(stacked.reshape(-1, size), goal).astype(np.int16)
        for i, line in zip(rows, shrunk.reshape(len(rows), -1), strict=True):
            out[i] = line
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.ShortType()))
def _shrink_down(values: pd.Series, height: pd.Series, target: pd.Series) -> pd.Series:
    """A strip line by line, each line of equal length; the result is line by line as well."""
    out = np.empty(len(values), dtype=object)
    for size, goal, rows in _by_geometry(height, target):
        for i in rows:
            strip = np.asarray(values.iloc[i], dtype=np.int64).reshape(size, -1)
            out[i] = shrink_lines(strip.T, goal).T.astype(np.int16).ravel()
    return pd.Series(out)


def resample(
    fitted: DataFrame, tiles: DataFrame, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Strips of the downscaled crops: ``(request_id, strip, tw, th, r, g, b)``, arrays by line.

    ``fitted`` are requests with output sizes; those that need no downscaling do not take part.
    """
    small = fitted.where("scale < 1.0")
    sizes = small.select("request_id", "width", "height", "output_width", "output_height")
    lines = (
        crop_segments(small, tiles, rows_per_slot)
        .groupBy("request_id", "crop_y")
        .agg(F.array_sort(F.collect_list(F.struct("crop_x", *CHANNELS))).alias("_parts"))
        .select(
            "request_id",
            "crop_y",
            F.concat(
                *[F.flatten(F.transform("_parts", field(c))) for c in CHANNELS]
            ).alias("_line"),
        )
        .join(sizes, "request_id")
        .withColumn("_line", _shrink_across("_line", "width", "output_width"))
    )
    strips = F.sequence(F.lit(0), F.floor((F.col("output_width") - 1) / STRIP).cast("int"))
    span = F.least(F.lit(STRIP), F.col("output_width") - F.col("strip") * STRIP)
    cut = F.concat(
        *[
            F.slice("_line", F.col("output_width") * i + F.col("strip") * STRIP + 1, F.col("tw"))
            for i in range(3)
        ]
    )
    stacked = (
        lines.withColumn("strip", F.explode(strips))
        .withColumn("tw", span)
        .withColumn("_cut", cut)
        .groupBy("request_id", "strip", "tw", "height", "output_height")
        .agg(F.array_sort(F.collect_list(F.struct("crop_y", "_cut"))).alias("_lines"))
        .withColumn("_strip", F.flatten(F.transform("_lines", lambda e: e["_cut"])))
        .withColumn("_strip", _shrink_down("_strip", "height", "output_height"))
    )

    def channel(index: int, name: str):
        rows = F.sequence(F.lit(0), F.col("output_height") - 1)
        part = lambda row: F.slice(
            "_strip", (row * 3 + index) * F.col("tw") + 1, F.col("tw")
        )
        return F.flatten(F.transform(rows, part)).alias(name)

    return stacked.select(
        "request_id",
        "strip",
        "tw",
        F.col("output_height").alias("th"),
        *[channel(i, c) for i, c in enumerate(CHANNELS)],
    )


def strip_pixels(strips: DataFrame) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip(*CHANNELS)).alias("_i", "_p")
    return strips.select("request_id", "strip", "tw", zipped).select(
        "request_id",
        (F.col("strip") * STRIP + F.pmod("_i", "tw")).alias("x"),
        F.floor(F.col("_i") / F.col("tw")).cast("int").alias("y"),
        *[F.col(f"_p.{c}").cast("int").alias(c) for c in CHANNELS],
    )
