"""Masks as blocks of bits: what lies within one tile is worked on in a task, many images' grids at once.

A block is 8 x 8 cells in a whole number, so the cells of a mask are added up (bit_or) before they are shuffled, and an image
of a few hundred cells is one row of a few blocks. split() parts images that lie within a tile from larger ones: the first
are grids in NumPy, the others take their operator's way over rows of cells, so a mask may still be larger than a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.stored import stored

#: Cells of a tile's side, cells that a task lays out at a time.
TILE, LAID_OUT = 256, 1 << 21


def split(*masks: DataFrame, odd: Column | None = None, tile: int = TILE) -> tuple[DataFrame, list[DataFrame] | None]:
    """The images that lie within a tile (image_id, blocks), stored; and the others' cells (image_id, x, y) by mask, None if there are none.

    Nulls are no cells, repeated ones are one. odd: a condition on x and y; an image with such a cell is one of the others.
    """
    cells = None
    for kind, mask in enumerate(masks):
        one = mask.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.lit(kind).alias("kind")).where("image_id is not null and x is not null and y is not null")
        cells = one if cells is None else cells.unionByName(one)
    bit = F.expr("shiftleft(1L, cast((y & 7) * 8 + (x & 7) as int))")
    own = F.lit(False) if odd is None else odd
    found = cells.groupBy("image_id", "kind", F.expr("shiftright(x, 3)").alias("bx"), F.expr("shiftright(y, 3)").alias("by")).agg(F.bit_or(bit).alias("bits"), F.max(own).alias("odd"))
    across = lambda c: F.floor(F.col(c) / (tile // 8))
    tiles = stored(found.groupBy("image_id", across("bx").alias("tx"), across("by").alias("ty")).agg(F.collect_list(F.struct("kind", "bx", "by", "bits")).alias("blocks"), F.max("odd").alias("odd")), "tiles")
    larger = stored(tiles.groupBy("image_id").agg(F.count("*").alias("n"), F.max("odd").alias("odd")).where("n > 1 or odd").select("image_id"), "larger")
    if larger.isEmpty():
        return tiles.select("image_id", "blocks"), None
    rest = tiles.join(larger.hint("merge"), "image_id", "left_semi").select("image_id", F.inline("blocks"))
    places = rest.withColumn("i", F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(bits, i) & 1L = 1L)")))
    rows = stored(places.select("image_id", "kind", F.expr("bx * 8 + i % 8").alias("x"), F.expr("by * 8 + i div 8").alias("y")), "cells")
    return tiles.join(larger.hint("merge"), "image_id", "left_anti").select("image_id", "blocks"), [rows.where(F.col("kind") == k).drop("kind") for k in range(len(masks))]


def _grids(blocks: pa.ListArray, kinds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, grid[row, mask, y, x], and the x and y of its corner, for rows of one size."""
    offsets, flat = blocks.offsets.to_numpy(), blocks.flatten()
    rows = np.repeat(np.arange(len(blocks)), np.diff(offsets))
    kind, bx, by, bits = (flat.field(c).to_numpy() for c in ("kind", "bx", "by", "bits"))
    cells = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), bitorder="little").reshape(-1, 8, 8).astype(bool)
    starts = offsets[:-1] - offsets[0]
    x0, y0 = np.minimum.reduceat(bx, starts), np.minimum.reduceat(by, starts)
    wide, high = np.maximum.reduceat(bx, starts) - x0 + 1, np.maximum.reduceat(by, starts) - y0 + 1
    for size in np.unique(high << 32 | wide):
        h, w = int(size >> 32), int(size & 0xFFFFFFFF)
        alike = np.flatnonzero((high == h) & (wide == w))
        for some in np.array_split(alike, -(-len(alike) * h * w * 64 * kinds // LAID_OUT)):
            place = np.full(len(blocks), -1)
            place[some] = np.arange(len(some))
            mine = np.flatnonzero(place[rows] >= 0)
            r = rows[mine]
            grid = np.zeros((len(some), kinds, h, 8, w, 8), bool)
            grid[place[r], kind[mine], by[mine] - y0[r], :, bx[mine] - x0[r], :] = cells[mine]
            yield some, grid.reshape(len(some), kinds, h * 8, w * 8), x0[some] * 8, y0[some] * 8


def on_grids(tiles: DataFrame, kinds: int, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """image_id and the schema's columns. fn gets grid[row, mask, y, x] and the corners' x and y, and returns the columns and, if they are not the rows in turn, their rows; a float that is no number is null."""
    image = tiles.schema["image_id"].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for some, grid, x, y in _grids(batch.column(1), kinds):
                found = fn(grid, x, y)
                rows = some[found["row"]] if "row" in found else some
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *[pa.array(found[c], from_pandas=True) for c in names]], names=["image_id", *names])

    return tiles.mapInArrow(run, f"image_id {image}, {schema}")


def least_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least of the nodes 0 to n - 1 that each reaches by the edges (u, v)."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further


def pieces(grid: np.ndarray) -> tuple[np.ndarray, ...]:
    """image, y, x and component (its first cell's number) of the cells of grid[image, y, x]; cells touch at corners too."""
    at = np.flatnonzero(grid)
    number = np.full(grid.shape, -1)
    number.reshape(-1)[at] = np.arange(len(at))
    u, v = [], []
    for a, b in ((number[:, :, :-1], number[:, :, 1:]), (number[:, :-1], number[:, 1:]), (number[:, :-1, :-1], number[:, 1:, 1:]), (number[:, :-1, 1:], number[:, 1:, :-1])):
        both = (a >= 0) & (b >= 0)
        u.append(a[both])
        v.append(b[both])
    return *np.unravel_index(at, grid.shape), least_roots(len(at), np.concatenate(u), np.concatenate(v))


def piece_counts(grid: np.ndarray) -> np.ndarray:
    """[image, mask]: the components of each mask; not a number if it has no cell."""
    image, _, _, root = pieces(grid.reshape(-1, *grid.shape[2:]))
    found = np.bincount(image[root == np.arange(len(root))], minlength=grid.shape[0] * grid.shape[1]).astype(float)
    return np.where(found > 0, found, np.nan).reshape(grid.shape[:2])


def piece_boxes(grid: np.ndarray, longest: int | None) -> tuple[np.ndarray, ...]:
    """image, x1, y1, x2, y2, cells of the components, those longer than longest cut along their longer side."""
    image, y, x, root = pieces(grid)
    _, key = np.unique(root, return_inverse=True)

    def spans(key: np.ndarray) -> list[np.ndarray]:
        out = []
        for c in (x, y):
            low, high = np.full(key.max(initial=-1) + 1, np.iinfo(np.int64).max), np.full(key.max(initial=-1) + 1, -1)
            np.minimum.at(low, key, c)
            np.maximum.at(high, key, c)
            out += [low, high]
        return out

    if longest:
        x1, x2, y1, y2 = spans(key)
        along = np.where((x2 - x1 >= y2 - y1)[key], x - x1[key], y - y1[key]) // longest
        _, key = np.unique(key * (along.max(initial=0) + 1) + along, return_inverse=True)
    x1, x2, y1, y2 = spans(key)
    of = np.zeros(len(x1), np.int64)
    of[key] = image
    return of, x1, y1, x2 + 1, y2 + 1, np.bincount(key, minlength=len(x1))


def padded(grid: np.ndarray, by: int) -> np.ndarray:
    return np.pad(grid, ((0, 0), (by, by), (by, by)))


def edges_of(grid: np.ndarray) -> np.ndarray:
    """The cells of grid[image, y, x] with a side neighbour that is not in the mask."""
    g = padded(grid, 1)
    return grid & ~(g[:, :-2, 1:-1] & g[:, 2:, 1:-1] & g[:, 1:-1, :-2] & g[:, 1:-1, 2:])


def share_near(own: np.ndarray, other: np.ndarray, tolerance: int) -> np.ndarray:
    """[image]: the share of own cells with one of the other mask within the tolerance; not a number without an own cell."""
    g, near = padded(other, tolerance), np.zeros_like(other)
    for dy in range(2 * tolerance + 1):
        for dx in range(2 * tolerance + 1):
            if (dx - tolerance) ** 2 + (dy - tolerance) ** 2 <= tolerance**2:
                near |= g[:, dy : dy + own.shape[1], dx : dx + own.shape[2]]
    n = own.sum(axis=(1, 2)).astype(float)
    n[n == 0] = np.nan
    return (own & near).sum(axis=(1, 2)) / n


def depths(grid: np.ndarray, x0: np.ndarray, y0: np.ndarray, width: int, height: int, far: int) -> np.ndarray:
    """Steps from each cell of grid[image, y, x] to the nearest that is in the image and not in the mask (far if none)."""
    g = padded(grid, 1)
    x, y = np.arange(g.shape[2]) + x0[:, None] - 1, np.arange(g.shape[1]) + y0[:, None] - 1
    within = ((x >= 0) & (x < width))[:, None, :] & ((y >= 0) & (y < height))[:, :, None]
    d = np.where(~g & within, 0, far).astype(np.int64)
    for axis, n in ((2, g.shape[2]), (1, g.shape[1])):
        step = np.arange(n)[None, None, :] if axis == 2 else np.arange(n)[None, :, None]
        behind = np.minimum.accumulate(d - step, axis=axis) + step
        ahead = np.flip(np.minimum.accumulate(np.flip(d + step, axis), axis=axis), axis) - step
        d = np.minimum(behind, ahead)
    return np.where(d < far // 2, d, far)[:, 1:-1, 1:-1]


def highest(grid: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The cells of grid no side neighbour of which is deeper."""
    d = padded(np.where(grid, depth, 0), 1)
    most = np.maximum(np.maximum(d[:, :-2, 1:-1], d[:, 2:, 1:-1]), np.maximum(d[:, 1:-1, :-2], d[:, 1:-1, 2:]))
    return grid & (most <= d[:, 1:-1, 1:-1])
