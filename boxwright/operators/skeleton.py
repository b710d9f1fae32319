"""Centre lines of masks by iterated thinning, and the metrics of lines and pieces. Masks are rows of cells (image_id, x, y).

A thinning step looks at a cell's eight neighbours as a number of eight bits and at a table whether a cell with such
neighbours may go (Zhang and Suen's two half steps). A mask is dealt into tiles with a margin of its neighbours' cells; what
a cell becomes after as many half steps as the margin is wide depends on nothing beyond it. So a task takes that many half
steps, then the tiles exchange margins, until no tile changes. A tile whose outermost margin is empty depends on no other
tile and is thinned to the end at once, as most images are. Each exchange is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions.stored import own_tables, stored
from boxwright.operators import blocks
from boxwright.operators.distance import in_common, ridge_overlap
from boxwright.operators.rasters import component_counts, f_of_shares, share_within

#: Cells of a tile's side and of its margin, cells that a task lays out at a time.
TILE, MARGIN, LAID_OUT = 256, 32, 1 << 22
#: Neighbours in turn from the one above, clockwise: bit k of a neighbourhood's number.
AROUND = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def removable() -> np.ndarray:
    """[half step, neighbourhood]: whether a cell goes. It has 2 to 6 neighbours in one row around it, and an open side among three."""
    out = np.zeros((2, 256), bool)
    for code in range(256):
        n = [code >> k & 1 for k in range(8)]
        rises = sum(a == 0 and b == 1 for a, b in zip(n, n[1:] + n[:1], strict=True))
        if 2 <= sum(n) <= 6 and rises == 1:
            out[0, code] = not (n[0] and n[2] and n[4]) and not (n[2] and n[4] and n[6])
            out[1, code] = not (n[0] and n[2] and n[6]) and not (n[0] and n[4] and n[6])
    return out


def half_step(grid: np.ndarray, table: np.ndarray) -> np.ndarray:
    """grid[tile, y, x] (0, 1; the outermost ring empty) after a half step."""
    code = np.zeros_like(grid)
    for k, (dx, dy) in enumerate(AROUND):
        code[:, 1:-1, 1:-1] |= grid[:, 1 + dy : grid.shape[1] - 1 + dy, 1 + dx : grid.shape[2] - 1 + dx] << np.uint8(k)
    return grid & ~table[code]


def _thin(margin: int, tile: int):
    """A tile's cells (numbered within it and its margin) after the half steps; and whether another exchange is needed."""
    side, table = tile + 2 * margin, removable().astype(np.uint8)

    def thinned(grid: np.ndarray, alone: np.ndarray) -> np.ndarray:
        steps = 0
        while True:
            before = grid
            for half in (0, 1):
                grid = half_step(grid, table[half])
            steps += 2
            if not alone.any() and steps + 2 > margin:
                return grid
            if not (grid != before).any():
                return grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            rows, flat = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            y, x = flat // side, flat % side
            edge = (x == 0) | (y == 0) | (x == side - 1) | (y == side - 1)
            alone = np.bincount(rows, weights=edge, minlength=len(lists)) == 0
            low, high = np.full((2, len(lists)), side), np.zeros((2, len(lists)), int)
            for i, c in enumerate((y, x)):
                np.minimum.at(low[i], rows, c)
                np.maximum.at(high[i], rows, c)
            size = high - low + 3
            order = np.lexsort((size[1], size[0], alone))  # tiles of a kind and size together
            kept, changed = np.zeros(len(flat), bool), np.zeros(len(lists), bool)
            first = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
            at = 0
            while at < len(order):
                end, span = at + 1, size[:, order[at]]
                while end < len(order) and alone[order[end]] == alone[order[at]] and (end + 1 - at) * np.prod(np.maximum(span, size[:, order[end]])) <= LAID_OUT:
                    span, end = np.maximum(span, size[:, order[end]]), end + 1
                some = order[at:end]
                cells = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
                tile_no = np.repeat(np.arange(len(some)), first[some + 1] - first[some])
                cy, cx = y[cells] - low[0][rows[cells]] + 1, x[cells] - low[1][rows[cells]] + 1
                grid = np.zeros((len(some), *span), np.uint8)
                grid[tile_no, cy, cx] = 1
                kept[cells] = thinned(grid, alone[some])[tile_no, cy, cx] > 0
                at = end
            own = (x >= margin) & (x < side - margin) & (y >= margin) & (y < side - margin)
            np.logical_or.at(changed, rows, own & ~kept & ~alone[rows])
            kept &= own
            survivors = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows[kept], minlength=len(lists)))], pa.int32()), pa.array(flat[kept], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], survivors, pa.array(changed)], names=["image_id", "tx", "ty", "cells", "changed"])

    return run


def thinned(cells: DataFrame, tile: int = TILE, margin: int = MARGIN) -> DataFrame:
    """The centre lines (image_id, x, y): cells thinned until no half step takes another. Nulls are no cells, repeated ones are one."""
    if margin < 2 or margin % 2 or tile < margin:
        raise ValueError("the margin is even, no wider than a tile")
    whole = cells.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).where("image_id is not null and x is not null and y is not null").distinct()
    side = tile + 2 * margin
    image = cells.schema["image_id"].dataType.simpleString()
    spread = lambda c: F.sequence(F.floor((F.col(c) - margin) / tile), F.floor((F.col(c) + margin) / tile))
    number = ((F.col("y") - F.col("ty") * tile + margin) * side + F.col("x") - F.col("tx") * tile + margin).cast("int")
    is_own = (F.floor(F.col("x") / tile) == F.col("tx")) & (F.floor(F.col("y") / tile) == F.col("ty"))
    corner = lambda c, t: F.col(t) * tile - margin + c

    def exchanged(now: DataFrame) -> DataFrame:
        dealt = now.withColumn("tx", F.explode(spread("x"))).withColumn("ty", F.explode(spread("y")))
        tiles = dealt.groupBy("image_id", "tx", "ty").agg(F.collect_list(number).alias("cells"), F.bool_or(is_own).alias("_own")).where("_own").drop("_own")
        return stored(tiles.mapInArrow(_thin(margin, tile), f"image_id {image}, tx bigint, ty bigint, cells array<int>, changed boolean"), "tiles")

    def cells_of(tiles: DataFrame) -> DataFrame:
        c = tiles.select("image_id", "tx", "ty", F.explode("cells").alias("c"))
        return c.select("image_id", corner(F.col("c") % side, "tx").alias("x"), corner(F.floor(F.col("c") / side), "ty").alias("y"))

    with own_tables() as own:
        now, parts = whole, []
        while True:
            tiles = exchanged(now)
            going = tiles.where("changed").select("image_id").distinct()
            done = stored(cells_of(tiles.join(going.hint("merge"), "image_id", "left_anti")), "thinned")
            parts.append(done)
            left = cells_of(tiles.join(going.hint("merge"), "image_id", "left_semi"))
            if left.isEmpty():
                own.discard_all_but(*parts)
                break
            own.discard_all_but(*parts, tiles)
            now = left
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def thinned_grids(grid: np.ndarray) -> np.ndarray:
    """The centre lines of grid[image, y, x]."""
    now, table = blocks.padded(grid, 1).astype(np.uint8), removable().astype(np.uint8)
    while True:
        before = now
        for half in (0, 1):
            now = half_step(now, table[half])
        if not (now != before).any():
            return now[:, 1:-1, 1:-1] > 0


def centre_line_f(predicted: DataFrame, truth: DataFrame, tolerance: int = 2) -> DataFrame:
    """image_id, f: F1 of the centre lines' cells with one of the other line within the tolerance, of images in either mask; 0 if one has none.

    Images that lie within a tile are grids in a task, from the mask to the shares; larger ones are thinned in tiles.
    """
    tiles, larger = blocks.split(predicted, truth)

    def shares(grid, x, y):
        lines = thinned_grids(grid.reshape(-1, *grid.shape[2:])).reshape(grid.shape)
        p, t = lines[:, 0], lines[:, 1]
        p, r = blocks.share_near(p, t, tolerance), blocks.share_near(t, p, tolerance)
        rows = np.flatnonzero(~(np.isnan(p) & np.isnan(r)))
        return {"row": rows, "p": p[rows], "r": r[rows]}

    found = blocks.on_grids(tiles, 2, shares, "p double, r double")
    if larger is not None:
        p, t = map(thinned, larger)
        found = found.unionByName(share_within(p, t, tolerance, "p").join(share_within(t, p, tolerance, "r").hint("merge"), "image_id", "full"))
    return f_of_shares(found)


def overlap(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, precision, recall, dice of the cells of two masks, of images in either; 0 if one has none."""
    return overlap_of(in_common(predicted, truth))


def ridge_metrics(predicted: DataFrame, truth: DataFrame, width: int, height: int) -> DataFrame:
    """overlap() of the ridges of two masks."""
    return overlap_of(ridge_overlap(predicted, truth, width, height))


def overlap_of(n: DataFrame) -> DataFrame:
    share = lambda over: F.coalesce(F.col("both") / F.nullif(over, F.lit(0)), F.lit(0.0))
    return n.select("image_id", share(F.col("p")).alias("precision"), share(F.col("t")).alias("recall"), (2 * F.col("both") / (F.col("p") + F.col("t"))).alias("dice"))


def fragmentation(predicted: DataFrame, truth: DataFrame, most: float = 10.0) -> DataFrame:
    """image_id, fragmentation: pieces of the prediction for each of the truth, of images in either mask; so many at most, and if the truth has none."""
    both = component_counts(predicted, truth)
    return both.select("image_id", F.when(F.col("t").isNull(), most).otherwise(F.least(F.coalesce("p", F.lit(0)) / F.col("t"), F.lit(most))).alias("fragmentation"))
