"""Small rasters for tests: numpy arrays to tiles, PNG bytes, and brute-force comparison."""

from __future__ import annotations

import struct
import zlib
from collections import deque

import numpy as np

from rasterloom.settings import TILES
from rasterloom.sources.images import cut_tiles


def solid(width, height, colour=(255, 255, 255)):
    raster = np.zeros((height, width, 3), dtype=np.int64)
    raster[:, :] = colour
    return raster


def tables(spark, rasters):
    """``tiles`` and ``images`` of a dict from image id to raster."""
    rows = []
    for image_id, raster in rasters.items():
        for tile in cut_tiles(str(image_id), raster):
            rows += [tuple(row.values()) for row in tile.to_pylist()]
    tiles = spark.createDataFrame(rows, TILES)
    images = spark.createDataFrame(
        [(i, r.shape[1], r.shape[0], int(r.size)) for i, r in rasters.items()],
        "image_id string, width int, height int, byte_count long",
    )
    return tiles, images


def pairs(spark, rows):
    return spark.createDataFrame(
        rows,
        "pair_id int, before_id string, after_id string, threshold double, max_regions int, "
        "include_diff boolean",
    )


def png(raster):
    height, width = raster.shape[:2]
    lines = b"".join(b"\0" + raster[y].astype(np.uint8).tobytes() for y in range(height))

    def chunk(kind, data):
        return (
            struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        )

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", header)
        + chunk(b"IDAT", zlib.compress(lines))
        + chunk(b"IEND", b"")
    )


def change_mask(before, after, threshold):
    height = max(before.shape[0], after.shape[0])
    width = max(before.shape[1], after.shape[1])
    has_before, has_after = np.zeros((height, width), bool), np.zeros((height, width), bool)
    has_before[: before.shape[0], : before.shape[1]] = True
    has_after[: after.shape[0], : after.shape[1]] = True
    mask = has_before ^ has_after
    h, w = min(before.shape[0], after.shape[0]), min(before.shape[1], after.shape[1])
    mask[:h, :w] = np.abs(before[:h, :w] - after[:h, :w]).max(axis=2) > threshold * 255.0
    return mask


def components(mask, tile=16):
    """(count, y, x, width, height) of every component of changed tiles, in discovery order."""
    rows, cols = -(-mask.shape[0] // tile), -(-mask.shape[1] // tile)
    hit = {
        (ty, tx)
        for ty in range(rows)
        for tx in range(cols)
        if mask[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile].any()
    }
    found = []
    for start in sorted(hit):
        if start not in hit:
            continue
        hit.discard(start)
        queue, members = deque([start]), []
        while queue:
            ty, tx = queue.popleft()
            members.append((ty, tx))
            for near in ((ty - 1, tx), (ty + 1, tx), (ty, tx - 1), (ty, tx + 1)):
                if near in hit:
                    hit.discard(near)
                    queue.append(near)
        own = np.zeros_like(mask)
        for ty, tx in members:
            part = np.s_[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
            own[part] = mask[part]
        ys, xs = np.nonzero(own)
        found.append(
            (
                int(own.sum()),
                int(ys.min()),
                int(xs.min()),
                int(xs.max() - xs.min() + 1),
                int(ys.max() - ys.min() + 1),
            )
        )
    return found
