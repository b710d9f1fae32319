"""Distances between masks and within them, in time linear in the pixels. Masks are rows of cells (image_id, x, y)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.operators import blocks

#: Lines of an image that are taken together, cells that a task lays out at a time.
LINES, LAID_OUT = 64, 1 << 21
#: Beyond every coordinate.
FAR = 1 << 40


def envelope(g: np.ndarray) -> np.ndarray:
    """For every line g and place q the least of g[p] + (q - p)**2 (infinite where g has nothing): the lower envelope of parabolas, all lines at once."""
    lines, width = g.shape
    top, at, start = np.full(lines, -1), np.zeros((lines, width), np.int64), np.full((lines, width + 1), np.inf)
    for q in range(width):
        new = np.flatnonzero(np.isfinite(g[:, q]))
        begins = np.full(len(new), -np.inf)
        look = np.flatnonzero(top[new] >= 0)
        while len(look):
            r = new[look]
            p = at[r, top[r]]
            meet = (g[r, q] + q * q - g[r, p] - p * p) / (2 * (q - p))
            hidden = meet <= start[r, top[r]]
            begins[look] = np.where(hidden, -np.inf, meet)
            top[r[hidden]] -= 1
            look = look[hidden][top[r[hidden]] >= 0]
        top[new] += 1
        at[new, top[new]], start[new, top[new]], start[new, top[new] + 1] = q, begins, np.inf
    out, now, rows = np.full((lines, width), np.inf), np.zeros(lines, np.int64), np.flatnonzero(top >= 0)
    for q in range(width):
        while len(behind := rows[start[rows, now[rows] + 1] < q]):
            now[behind] += 1
        p = at[rows, now[rows]]
        out[rows, q] = g[rows, p] + (q - p) ** 2
    return out


def _laid_out(rows: np.ndarray, line: np.ndarray, x: np.ndarray, column: dict[str, np.ndarray], first: np.ndarray) -> np.ndarray:
    """Squared distances of own cells (row, line, x) of some blocks from the columns of the other mask."""
    low = np.full(rows.max() + 1, FAR)
    np.minimum.at(low, rows, x)
    np.minimum.at(low, column["row"], column["x"])
    x, cx, ix = x - low[rows], column["x"] - low[column["row"]], column["inside_x"] - low[column["inside_row"]]
    width = int(max(x.max(initial=0), cx.max(initial=0))) + 1
    lines = int(max(line.max(initial=0), column["inside_line"].max(initial=0))) + 1
    up = np.full((len(low), lines + 2, width), -float(FAR))
    down = np.full((len(low), lines + 2, width), float(FAR))
    up[column["row"], 0, cx] = np.where(np.isnan(column["above"]), -FAR, column["above"] - first[column["row"]])
    down[column["row"], lines + 1, cx] = np.where(np.isnan(column["below"]), FAR, column["below"] - first[column["row"]])
    for side in (up, down):
        side[column["inside_row"], column["inside_line"] + 1, ix] = column["inside_line"]
    up, down = np.maximum.accumulate(up, axis=1), np.minimum.accumulate(down[:, ::-1], axis=1)[:, ::-1]
    asked, own = np.unique(rows * lines + line, return_inverse=True)
    r, y = asked // lines, asked % lines
    away = np.minimum(y[:, None] - up[r, y + 1], down[r, y + 1] - y[:, None])
    return envelope(np.where(away > FAR / 2, np.inf, away * away))[own, x]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """image_id, first, own (x, y), columns (x, above, below, inside) to image_id, own, squares."""
    for batch in batches:
        if not batch.num_rows:
            continue
        wide = []
        for own, cols in zip(batch.column(2), batch.column(3), strict=True):
            xs = [own.values.field("x")] + ([cols.values.field("x")] if cols.is_valid else [])
            wide.append(max(max(c.to_numpy().max(initial=-FAR) for c in xs) - min(c.to_numpy().min(initial=FAR) for c in xs) + 1, 1) * (LINES + 2))
        at = 0
        while at < batch.num_rows:
            end, largest = at + 1, wide[at]
            while end < batch.num_rows and max(largest, wide[end]) * (end + 1 - at) <= LAID_OUT:
                largest, end = max(largest, wide[end]), end + 1
            some = batch.slice(at, end - at)
            own, cols, first = some.column(2), some.column(3).fill_null([]), some.column(1).to_numpy()
            rows = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
            cells, columns = own.flatten(), cols.flatten()
            of = np.repeat(np.arange(len(cols)), np.diff(cols.offsets.to_numpy()))
            inside = columns.field("inside")
            times = np.diff(inside.offsets.to_numpy()) if len(inside) else np.zeros(0, int)
            cx = columns.field("x").to_numpy()
            inside_row = np.repeat(of, times)
            column = {"row": of, "x": cx, "inside_row": inside_row, "inside_x": np.repeat(cx, times), "inside_line": inside.flatten().to_numpy() - first[inside_row]}
            column |= {c: columns.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("above", "below")}
            squares = _laid_out(rows, cells.field("y").to_numpy() - first[rows], cells.field("x").to_numpy(), column, first)
            found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=len(own)))], pa.int32()), pa.array(squares, pa.float64(), mask=np.isinf(squares)))
            yield pa.RecordBatch.from_arrays([some.column(0), own, found], names=["image_id", "own", "squares"])
            at = end


def nearest(own: DataFrame, other: DataFrame) -> DataFrame:
    """own (image_id, x, y) with square: each cell's squared distance to the nearest cell of the other mask (null if that has none in the image).

    Columns first: the nearest cell above and below in each column; then rows: the lower envelope of the columns' parabolas.
    A task takes a block of lines, which meets every column once. Nulls are no cells; repeated cells of own stay.
    """
    whole = ["image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")]
    own, other = (m.select(*whole).where("image_id is not null and x is not null and y is not null") for m in (own, other))
    first = (F.floor(F.col("y") / LINES) * LINES).alias("first")
    blocks = own.groupBy("image_id", first).agg(F.collect_list(F.struct("x", "y")).alias("own"))  # LINES lines of an image
    columns = other.groupBy("image_id", "x").agg(F.collect_set("y").alias("ys"))  # a column of an image
    within = lambda test: F.filter("ys", test)
    lo, hi = F.col("first"), F.col("first") + LINES
    near = columns.join(own.select("image_id", first).distinct(), "image_id")  # columns and blocks: a LINES-th of the pixels
    column = F.struct("x", F.array_max(within(lambda y: y < lo)).alias("above"), F.array_min(within(lambda y: y >= hi)).alias("below"), F.array_sort(within(lambda y: (y >= lo) & (y < hi))).alias("inside"))
    gathered = near.groupBy("image_id", "first").agg(F.collect_list(column).alias("columns"))
    j = blocks.join(gathered, ["image_id", "first"], "left").select("image_id", "first", "own", "columns")
    image = own.schema["image_id"].dataType.simpleString()
    found = j.mapInArrow(_blocks, f"image_id {image}, own array<struct<x:bigint,y:bigint>>, squares array<double>")
    return found.select("image_id", F.inline(F.arrays_zip("own", "squares"))).select("image_id", "own.x", "own.y", F.col("squares").cast("long").alias("square"))


def _squares(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """image and squared distance to the nearest cell of the other mask (infinite if it has none) of the cells of own[image, y, x]."""
    n, high, wide = own.shape
    g = _upright(other)
    if wide <= 32:
        across = (np.arange(wide)[:, None] - np.arange(wide)[None, :]) ** 2
        d = np.full(own.shape, np.inf)
        for x in range(wide):
            d = np.minimum(d, g[:, :, x : x + 1] + across[x])
    else:
        d = envelope(g.reshape(n * high, wide)).reshape(own.shape)
    image, y, x = np.nonzero(own)
    return image, d[image, y, x]


def _upright(other: np.ndarray) -> np.ndarray:
    """Squared distance of each place to the nearest cell of its column."""
    y = np.arange(other.shape[1])[None, :, None]
    above = np.maximum.accumulate(np.where(other, y, -FAR), axis=1)
    below = np.flip(np.minimum.accumulate(np.flip(np.where(other, y, FAR), 1), axis=1), 1)
    away = np.minimum(y - above, below - y)
    return np.where(away < FAR // 2, away.astype(float) ** 2, np.inf)


def squares_between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """image and squared distance to the other mask of the cells of either grid[image, y, x]."""
    return tuple(np.concatenate(v) for v in zip(_squares(a, b), _squares(b, a), strict=True))


def _beyond(width: int, height: int):
    return (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= width) | (F.col("y") >= height)


def depth_totals(cells: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, deepest, total: the largest depth() and the sum, of the masks that are not the whole image."""
    tiles, larger = blocks.split(cells, odd=_beyond(width, height))

    def totals(grid, x, y):
        mask = grid[:, 0]
        d = np.where(mask, blocks.depths(mask, x, y, width, height, FAR), 0)
        rows = np.flatnonzero(d.max(axis=(1, 2)) < FAR)
        return {"row": rows, "deepest": d[rows].max(axis=(1, 2)), "total": d[rows].sum(axis=(1, 2))}

    found = blocks.on_grids(tiles, 1, totals, "deepest bigint, total bigint")
    if larger is None:
        return found
    rest = depth(larger[0], width, height).where("depth is not null")
    return found.unionByName(rest.groupBy("image_id").agg(F.max("depth").alias("deepest"), F.sum("depth").alias("total")))


def depth(cells: DataFrame, width: int, height: int) -> DataFrame:
    """cells with depth: steps along rows and columns to the nearest cell of the image that is not in the mask (null in a mask that is the whole image).

    Along rows first, to the ends of a run of cells; then along columns, the least of that and the steps, as running minima. What
    lies beyond the image counts as mask. Nulls are no cells, repeated ones are one.
    """
    rows = cells.select("image_id", "x", "y").where("image_id is not null and x is not null and y is not null").distinct()
    far = F.lit(FAR)

    def ends(df: DataFrame, along: str, across: str, edge: int) -> DataFrame:
        line = Window.partitionBy("image_id", across).orderBy(along)
        df = df.withColumn("_run", F.col(along) - F.row_number().over(line))
        run = Window.partitionBy("image_id", across, "_run")
        lo, hi = F.min(along).over(run), F.max(along).over(run)
        back = F.when(lo > 0, F.col(along) - lo + 1).otherwise(far)
        ahead = F.when(hi < edge - 1, hi - F.col(along) + 1).otherwise(far)
        return df.withColumns({"_back": back, "_ahead": ahead})

    level = ends(rows, "x", "y", width).select("image_id", "x", "y", F.least("_back", "_ahead").alias("_level"))
    upright = ends(level, "y", "x", height)
    run = Window.partitionBy("image_id", "x", "_run").orderBy("y")
    y = F.col("y")
    above = F.min(F.col("_level") - y).over(run.rowsBetween(Window.unboundedPreceding, 0)) + y
    below = F.min(F.col("_level") + y).over(run.rowsBetween(0, Window.unboundedFollowing)) - y
    least = F.least(above, below, "_back", "_ahead")
    return upright.select("image_id", "x", "y", F.when(least < FAR // 2, least).alias("depth"))


def ridges(cells: DataFrame, width: int, height: int) -> DataFrame:
    """The cells that erosion by a cross leaves behind as what its opening loses, at any step: those no side neighbour of which is deeper. All cells of a mask that is the whole image."""
    d = depth(cells, width, height).withColumn("depth", F.coalesce("depth", F.lit(FAR)))

    def deepest(df: DataFrame, along: str, across: str, name: str) -> DataFrame:
        w = Window.partitionBy("image_id", across).orderBy(along)
        beside = lambda f, step: F.when(f(along).over(w) == F.col(along) + step, f("depth").over(w))
        return df.withColumn(name, F.greatest(F.coalesce(beside(F.lag, -1), F.lit(0)), F.coalesce(beside(F.lead, 1), F.lit(0))))

    both = deepest(deepest(d, "y", "x", "_v"), "x", "y", "_h")
    return both.where(F.greatest("_v", "_h") <= F.col("depth")).select("image_id", "x", "y")


def ridge_overlap(predicted: DataFrame, truth: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, p, t, both: the ridges()' cells of two masks and those in common, of images in either."""
    tiles, larger = blocks.split(predicted, truth, odd=_beyond(width, height))

    def counted(grid, x, y):
        p, t = (blocks.highest(grid[:, k], blocks.depths(grid[:, k], x, y, width, height, FAR)) for k in (0, 1))
        return {"p": p.sum(axis=(1, 2)), "t": t.sum(axis=(1, 2)), "both": (p & t).sum(axis=(1, 2))}

    found = blocks.on_grids(tiles, 2, counted, "p bigint, t bigint, both bigint")
    return found if larger is None else found.unionByName(in_common(*(ridges(m, width, height) for m in larger)))


def in_common(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, p, t, both: the cells of two masks and those in common, of images in either."""
    marked = predicted.select("image_id", "x", "y").distinct().withColumn("p", F.lit(1)).join(truth.select("image_id", "x", "y").distinct().withColumn("t", F.lit(1)).hint("merge"), ["image_id", "x", "y"], "full")
    return marked.groupBy("image_id").agg(F.count("p").alias("p"), F.count("t").alias("t"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("both"))


def summed(values: DataFrame, value: str = "value") -> DataFrame:
    """image_id, x, y, total: the sum over all cells up to (x, y) of a whole grid, by running sums along rows, then columns."""
    along = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    lines = values.select("image_id", "x", "y", F.sum(value).over(along).alias("_line"))
    return lines.select("image_id", "x", "y", F.sum("_line").over(down).alias("total"))


def box_sums(values: DataFrame, boxes: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """The distinct boxes (image_id and names: x1, y1, x2, y2; x2 and y2 beyond the last cell) with total: the sum over their cells, four lookups a box.

    values: image_id, x, y, value of a whole grid that holds the boxes. Null values are 0; boxes without a cell have 0.
    """
    x1, y1, x2, y2 = map(F.col, names)
    corner = lambda x, y, sign: F.struct((x - 1).cast("long").alias("x"), (y - 1).cast("long").alias("y"), F.lit(sign).alias("sign"))
    corners = boxes.select("image_id", *names).distinct().select("image_id", *names, F.inline(F.array(corner(x2, y2, 1), corner(x1, y2, -1), corner(x2, y1, -1), corner(x1, y1, 1))))
    met = corners.join(summed(values, value), ["image_id", "x", "y"], "left")
    total = F.sum(F.col("sign") * F.coalesce("total", F.lit(0)))
    return met.groupBy("image_id", *names).agg(F.when((F.first(x2) > F.first(x1)) & (F.first(y2) > F.first(y1)), total).otherwise(F.lit(0)).alias("total"))


def _best_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles' boxes (det_id, score, x1, y1, x2, y2) to det_id, total, n: the best scores of their cells, and how many these are."""
    for batch in batches:
        boxes = batch.column(0)
        for at in chunks(np.array([len(b) for b in boxes], np.int64) * 64):
            some = boxes.slice(at[0], len(at))
            flat, tile = some.flatten(), np.repeat(np.arange(len(at)), np.diff(some.offsets.to_numpy()))
            score, x1, y1, x2, y2 = (flat.field(c).to_numpy() for c in ("score", "x1", "y1", "x2", "y2"))
            low_x, low_y, wide, high = (np.zeros(len(at), np.int64) for _ in range(4))
            low_x += blocks.TILE
            low_y += blocks.TILE
            for least, c in ((low_x, x1), (low_y, y1)):
                np.minimum.at(least, tile, c)
            for most, c in ((wide, x2 - low_x[tile]), (high, y2 - low_y[tile])):
                np.maximum.at(most, tile, c)
            base = np.cumsum(wide * high) - wide * high
            best, w = np.full(int((wide * high).sum()), -np.inf), x2 - x1
            n = w * (y2 - y1)
            total = np.zeros(len(n))

            def places(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                of = np.repeat(own, n[own])
                k = np.arange(len(of)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                t = tile[of]
                return of, base[t] + (y1[of] - low_y[t] + k // w[of]) * wide[t] + x1[of] - low_x[t] + k % w[of]

            pieces = chunks(n)
            for own in pieces:
                of, place = places(own)
                np.maximum.at(best, place, score[of])
            for own in pieces:
                of, place = places(own)
                total += np.bincount(of, best[place], len(n))
            yield pa.RecordBatch.from_arrays([flat.field("det_id"), pa.array(total), pa.array(n)], names=["det_id", "total", "n"])


def chunks(sizes: np.ndarray) -> list[np.ndarray]:
    """Places in turn, so many together that their sizes come to about LAID_OUT."""
    part = (np.cumsum(sizes) - sizes) // LAID_OUT
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1) if len(sizes) else []


def best_means(boxes: DataFrame, tile: int = blocks.TILE) -> DataFrame:
    """det_id, mean: the mean, over each box's cells, of the best score that covers a cell. boxes: image_id, det_id, score, x1, y1, x2, y2 in whole cells.

    Boxes are cut along tiles of their image; a tile's are together, and the map of the best scores is never written out.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor((F.col(hi) - 1) / tile)))
    cut = boxes.where("image_id is not null and x2 > x1 and y2 > y1").withColumn("tx", span("x1", "x2")).withColumn("ty", span("y1", "y2"))
    local = lambda c, t: F.least(F.greatest(F.col(c) - F.col(t) * tile, F.lit(0)), F.lit(tile)).cast("long").alias(c)
    box = F.struct("det_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), local("x1", "tx"), local("y1", "ty"), local("x2", "tx"), local("y2", "ty"))
    tiles = cut.groupBy("image_id", "tx", "ty").agg(F.collect_list(box).alias("boxes")).select("boxes")
    sums = tiles.mapInArrow(_best_sums, f"det_id {boxes.schema['det_id'].dataType.simpleString()}, total double, n bigint")
    return sums.groupBy("det_id").agg((F.sum("total") / F.sum("n")).alias("mean"))
