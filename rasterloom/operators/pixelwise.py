"""Pixel arithmetic on aligned tile pairs, one Arrow batch of tiles at a time.

Spark joins, partitions and filters the tiles; these helpers turn the channel lists of a batch into
dense arrays per tile geometry and give back one row per tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHANNELS = ("r", "g", "b")


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)


def _stack(batch: pa.RecordBatch, side: str, rows: np.ndarray, height: int, width: int) -> np.ndarray:
    """Channels of one side as ``(rows, 3, height, width)``."""
    picked = pa.array(rows)
    planes = [
        batch.column(f"{side}_{c}").take(picked).flatten().to_numpy(zero_copy_only=False)
        for c in CHANNELS
    ]
    return np.stack([p.reshape(len(rows), height, width) for p in planes], axis=1).astype(np.int16)


def _geometries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple[int, int, int, int]]]:
    """Rows of equal tile geometry ``(before height, width, after height, width)``; 0 is absent."""
    names = ("before_th", "before_tw", "after_th", "after_tw")
    shapes = np.stack([_numbers(batch, name) for name in names], axis=1)
    kinds, which = np.unique(shapes, axis=0, return_inverse=True)
    for number, kind in enumerate(kinds):
        yield np.nonzero(which.ravel() == number)[0], tuple(int(v) for v in kind)


def _changed(
    batch: pa.RecordBatch, rows: np.ndarray, shape: tuple[int, int, int, int], size: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Mask of changed positions on a canvas of ``size``, and channel sums of the overlap."""
    before_h, before_w, after_h, after_w = shape
    lone = np.zeros(size, dtype=bool)
    lone[:before_h, :before_w] = True
    lone[:after_h, :after_w] ^= True
    mask = np.broadcast_to(lone, (len(rows), *size)).copy()
    sums = np.zeros(len(rows), dtype=np.int64)
    height, width = min(before_h, after_h), min(before_w, after_w)
    if height and width:
        after = _stack(batch, "after", rows, after_h, after_w)
        before = _stack(batch, "before", rows, before_h, before_w)
        delta = np.abs(before[:, :, :height, :width] - after[:, :, :height, :width])
        cutoff = _numbers(batch, "threshold")[rows] * 255.0
        mask[:, :height, :width] = delta.max(axis=1) > cutoff[:, None, None]
        sums = delta.sum(axis=(1, 2, 3), dtype=np.int64)
    return mask, sums


def _edges(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last true position of every row."""
    return hits.argmax(axis=1), hits.shape[1] - 1 - hits[:, ::-1].argmax(axis=1)


def measure_tiles(tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Changed count, bounds in image coordinates and channel sum of every tile pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            n, sums = np.zeros(count, np.int64), np.zeros(count, np.int64)
            bounds = np.zeros((4, count), np.int32)
            for rows, shape in _geometries(batch):
                size = (max(shape[0], shape[2]), max(shape[1], shape[3]))
                mask, sums[rows] = _changed(batch, rows, shape, size)
                n[rows] = mask.sum(axis=(1, 2))
                bounds[0, rows], bounds[2, rows] = _edges(mask.any(axis=1))
                bounds[1, rows], bounds[3, rows] = _edges(mask.any(axis=2))
            origin = [_numbers(batch, name) * tile for name in ("tx", "ty", "tx", "ty")]
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("pair_id"),
                    batch.column("ty"),
                    batch.column("tx"),
                    pa.array(n),
                    *[
                        pa.array((bounds[i] + origin[i]).astype(np.int32), mask=none)
                        for i in range(4)
                    ],
                    pa.array(sums),
                ],
                names=["pair_id", "ty", "tx", "n", "min_x", "min_y", "max_x", "max_y", "channel_sum"],
            )

    return run


def luma(raster: np.ndarray) -> np.ndarray:
    """ITU-R 601 grey of ``(rows, 3, height, width)`` in 16-bit fixed point, rounded."""
    red, green, blue = (raster[:, i].astype(np.int64) for i in range(3))
    return (red * 19595 + green * 38470 + blue * 7471 + 32768) >> 16


def paint_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Diff tiles of size ``(th, tw)``: grey after-image, changed positions red, the rest black; and how many changed.

    Where one image has no such tile, all of the other's positions are changed, so no pixel is read.
    """
    for batch in batches:
        canvas = np.stack([_numbers(batch, name) for name in ("th", "tw")], axis=1)
        order, planes, counts = [], [[], [], []], []
        for rows, shape in _geometries(batch):
            sizes, which = np.unique(canvas[rows], axis=0, return_inverse=True)
            for number, size in enumerate(sizes):
                some = rows[which.ravel() == number]
                mask, _ = _changed(batch, some, shape, (int(size[0]), int(size[1])))
                grey = np.zeros(mask.shape, np.int16)
                if shape[0] and shape[2]:
                    after = _stack(batch, "after", some, shape[2], shape[3])
                    grey[:, : shape[2], : shape[3]] = luma(after)
                order.append(some)
                counts.append(mask.sum(axis=(1, 2), dtype=np.int64))
                planes[0].append(np.where(mask, 255, grey).astype(np.int16).ravel())
                for i in (1, 2):
                    planes[i].append(np.where(mask, 0, grey).astype(np.int16).ravel())
        if not order:
            continue
        picked = np.concatenate(order)
        lengths = canvas[picked].prod(axis=1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        head = [batch.column(c).take(pa.array(picked)) for c in ("pair_id", "ty", "tx", "tw", "th")]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(p))) for p in planes]
        yield pa.RecordBatch.from_arrays(
            [*head, *lists, pa.array(np.concatenate(counts))],
            names=["pair_id", "ty", "tx", "tw", "th", *CHANNELS, "n"],
        )


def grey_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same tiles in grey."""
    for batch in batches:
        channels = [batch.column(c) for c in CHANNELS]
        flat = np.stack([c.flatten().to_numpy(zero_copy_only=False) for c in channels])[None]
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(channels[0]).to_numpy())])
        grey = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(luma(flat)[0].astype(np.int16)))
        head = [batch.column(c) for c in ("pair_id", "ty", "tx", "tw", "th")]
        yield pa.RecordBatch.from_arrays([*head, grey, grey, grey], names=["pair_id", "ty", "tx", "tw", "th", *CHANNELS])
