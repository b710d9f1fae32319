"""Masks and score maps as rows of cells (image_id, x, y, value): components, regions, boundaries, statistics.

A cell is named once in a mask; null cells and images take no part in any join. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions import boxes as B
from boxwright.operators import blocks
from boxwright.operators.components import components
from boxwright.operators.distance import box_sums, chunks, nearest, squares_between
from boxwright.operators.suppress import greedy


def labelled(cells: DataFrame) -> DataFrame:
    """cells (image_id, x, y) with component: the least (x, y) of the cells that each touches, also at corners. A mask may be larger than a task."""
    node = F.struct("image_id", "x", "y")
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1))])).alias("d")
    near = cells.select("image_id", "x", "y", steps).select(node.alias("u"), F.struct("image_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).alias("v"))
    edges = near.join(cells.select(node.alias("v")), "v", "left_semi").select("u", "v")
    roots = components(edges).select(F.col("node.image_id").alias("image_id"), F.col("node.x").alias("x"), F.col("node.y").alias("y"), F.struct("root.x", "root.y").alias("component"))
    return cells.join(roots, ["image_id", "x", "y"], "left").withColumn("component", F.coalesce("component", F.struct("x", "y")))


def component_boxes(cells: DataFrame, least: int = 1, longest: int | None = None) -> DataFrame:
    """image_id, x1, y1, x2, y2, cells of the components of at least so many cells; those longer than longest are cut along their longer side.

    Images that lie within a tile are grids in a task; of larger ones the cells are linked.
    """
    tiles, larger = blocks.split(cells)

    def boxed(grid, x, y):
        of, x1, y1, x2, y2, n = blocks.piece_boxes(grid[:, 0], longest)
        keep = n >= least
        return {"row": of[keep]} | {k: v[keep] for k, v in {"x1": x1 + x[of], "y1": y1 + y[of], "x2": x2 + x[of], "y2": y2 + y[of], "cells": n}.items()}

    found = blocks.on_grids(tiles, 1, boxed, "x1 bigint, y1 bigint, x2 bigint, y2 bigint, cells bigint")
    return found if larger is None else found.unionByName(_linked_boxes(larger[0], least, longest))


def component_counts(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, p, t: the number of components of each mask (null without one), of images in either."""
    tiles, larger = blocks.split(predicted, truth)

    def counted(grid, x, y):
        n = blocks.piece_counts(grid)
        return {"p": n[:, 0], "t": n[:, 1]}

    whole = [F.col(c).cast("long").alias(c) for c in "pt"]
    found = blocks.on_grids(tiles, 2, counted, "p double, t double").select("image_id", *whole)
    if larger is None:
        return found
    p, t = (_linked_boxes(m).groupBy("image_id").agg(F.count("*").alias(name)) for m, name in zip(larger, "pt", strict=True))
    return found.unionByName(p.join(t.hint("merge"), "image_id", "full"))


def _linked_boxes(cells: DataFrame, least: int = 1, longest: int | None = None) -> DataFrame:
    """component_boxes() by an edge between every two cells that touch."""
    parts = labelled(cells)
    w = Window.partitionBy("image_id", "component")
    if longest:
        sized = parts.withColumns({"_x": F.min("x").over(w), "_y": F.min("y").over(w), "_w": F.max("x").over(w) - F.min("x").over(w) + 1, "_h": F.max("y").over(w) - F.min("y").over(w) + 1})
        along = F.when(F.col("_w") >= F.col("_h"), F.col("x") - F.col("_x")).otherwise(F.col("y") - F.col("_y"))
        parts = sized.withColumn("piece", F.floor(along / longest)).drop("_x", "_y", "_w", "_h")
    keys = ["image_id", "component", *(["piece"] if longest else [])]
    boxed = parts.groupBy(*keys).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count("*").alias("cells"))
    return boxed.where(F.col("cells") >= least).drop("component", *(["piece"] if longest else []))


def heat(values: DataFrame, threshold: float, low: float = 0.20, high: float = 0.90) -> DataFrame:
    """values with heat: .6 of the uncertainty about the threshold and .4 of the value, within a band of values; 0 beyond."""
    v = F.col("value")
    uncertain = B.clip01(1 - F.abs(v - threshold) / 0.5)
    return values.withColumn("heat", F.when((v >= low) & (v <= high), B.clip01(0.6 * uncertain + 0.4 * v)).otherwise(0.0))


def fixed_box(cx, cy, size: int, w: int, h: int) -> B.Box:
    """A box of a size about a centre, moved into the image."""
    half = size // 2
    x1 = F.greatest(F.lit(0), F.least(cx - half, F.lit(max(0, w - size))))
    y1 = F.greatest(F.lit(0), F.least(cy - half, F.lit(max(0, h - size))))
    return B.Box(x1, y1, F.least(x1 + size, F.lit(w)), F.least(y1 + size, F.lit(h)))


def refine_regions(values: DataFrame, width: int, height: int, threshold: float, size: int, most: int, padding: int = 1, least: float = 0.15, overlap: float = 0.3) -> DataFrame:
    """image_id, x1, y1, x2, y2, score: boxes about hot components (score: mean heat), filled up about the hottest cells, the best that overlap little.

    values: image_id, x, y, value of all cells of width x height.
    """
    hot = heat(values, threshold)
    over = hot.where(F.col("heat") >= least)
    c = component_boxes(over.select("image_id", "x", "y"))
    mid = lambda lo, hi, edge: F.bround((F.greatest(F.col(lo) - padding, F.lit(0)) + F.least(F.col(hi) + padding, F.lit(edge))) / 2).cast("int")
    box = fixed_box(mid("x1", "x2", width), mid("y1", "y2", height), size, width, height)
    own = c.select("image_id", *[v.alias(f"b_{k}") for k, v in box._asdict().items()]).distinct()
    names = [f"b_{k}" for k in B.Box._fields]
    area = (F.col("b_x2") - F.col("b_x1")) * (F.col("b_y2") - F.col("b_y1"))
    scored = box_sums(hot, own, names, "heat").select("image_id", *names, (F.col("total") / area).alias("score"))
    few = c.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") < most)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("heat"), "y", "x"))
    about = fixed_box(F.col("x").cast("int"), F.col("y").cast("int"), size, width, height)
    more = over.join(few, "image_id").withColumn("k", rank).where(F.col("k") + F.col("n") <= 4 * most).select("image_id", *[v.alias(f"b_{k}") for k, v in about._asdict().items()], F.col("heat").alias("score"))
    every = scored.unionByName(more)
    boxes = every.select("image_id", *[F.col(f"b_{k}").cast("double").alias(k) for k in B.Box._fields], F.round("score", 9).alias("score"), F.lit("roi").alias("label")).distinct()
    keyed = boxes.withColumn("det_id", (F.col("y1") * 100000 + F.col("x1")).cast("long"))
    return greedy(keyed, lambda k, b: B.iou(B.of(k), B.of(b)) > overlap, ["image_id"], max_kept=most).select("image_id", *B.Box._fields, "score")


def _hot(v: np.ndarray, threshold: float, low: float = 0.20, high: float = 0.90) -> np.ndarray:
    """heat() of an array."""
    uncertain = np.clip(1 - np.abs(v - threshold) / 0.5, 0, 1)
    return np.where((v >= low) & (v <= high), np.clip(0.6 * uncertain + 0.4 * v, 0, 1), 0.0)


def _first_apart(image: np.ndarray, box: np.ndarray, score: np.ndarray, most: int, overlap: float) -> np.ndarray:
    """Places of the boxes that greedy() keeps: of each image the best, then the best that overlaps it little, so many times."""
    order = np.lexsort((box[:, 0], box[:, 1], -score, image))
    kept = []
    for _ in range(most):
        if not len(order):
            break
        own = image[order]
        begins = np.r_[True, own[1:] != own[:-1]]
        first = order[begins]
        kept.append(first)
        a, b = box[first[np.cumsum(begins) - 1]], box[order]
        shared = np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None).prod(axis=1)
        union = (a[:, 2:] - a[:, :2]).prod(axis=1) + (b[:, 2:] - b[:, :2]).prod(axis=1) - shared
        order = order[~begins & (np.where(union > 0, shared / np.maximum(union, 1), 0.0) <= overlap)]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _regions(grid: np.ndarray, threshold: float, size: int, most: int, padding: int, least: float, overlap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """image, box (x1, y1, x2, y2) and score of the regions of score maps grid[image, y, x]."""
    n, height, width = grid.shape
    hot = _hot(grid, threshold)
    over = hot >= least
    of, x1, y1, x2, y2, _ = blocks.piece_boxes(over, None)

    def fixed(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        left, top = np.clip(cx - size // 2, 0, max(0, width - size)), np.clip(cy - size // 2, 0, max(0, height - size))
        return np.stack([left, top, np.minimum(left + size, width), np.minimum(top + size, height)], axis=1)

    middle = lambda lo, hi, edge: np.rint((np.maximum(lo - padding, 0) + np.minimum(hi + padding, edge)) / 2).astype(np.int64)
    own = fixed(middle(x1, x2, width), middle(y1, y2, height))
    sums = np.pad(hot.cumsum(axis=2).cumsum(axis=1), ((0, 0), (1, 0), (1, 0)))
    total = sums[of, own[:, 3], own[:, 2]] - sums[of, own[:, 3], own[:, 0]] - sums[of, own[:, 1], own[:, 2]] + sums[of, own[:, 1], own[:, 0]]
    mean = total / (own[:, 2:] - own[:, :2]).prod(axis=1)
    found = np.bincount(of, minlength=n)
    image, y, x = np.nonzero(over & ((found > 0) & (found < most))[:, None, None])
    heat = hot[image, y, x]
    order = np.lexsort((x, y, -heat, image))
    image, y, x, heat = (c[order] for c in (image, y, x, heat))
    place = np.arange(len(image)) - np.searchsorted(image, image) + 1
    few = place + found[image] <= 4 * most
    image, box = np.r_[of, image[few]], np.concatenate([own, fixed(x[few], y[few])])
    score = np.round(np.r_[mean, heat[few]], 9)
    kept = _first_apart(image, box, score, most, overlap)
    return image[kept], box[kept], score[kept]


def refine_box_regions(boxes: DataFrame, width: int, height: int, threshold: float, size: int, most: int, padding: int = 1, least: float = 0.15, overlap: float = 0.3) -> DataFrame:
    """refine_regions() of the map of the best scores that cover each cell (0 where none does). boxes: image_id, score, x1, y1, x2, y2 in whole cells.

    A map that fits a tile is made where its image's boxes are (equal boxes are one, with their best score), so no cell is
    shuffled; larger maps take the way over cells.
    """
    side = lambda c, edge: F.greatest(F.lit(0), F.least(F.col(c), F.lit(edge))).cast("int").alias(c)
    value = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    own = boxes.where("image_id is not null").select("image_id", value, side("x1", width), side("y1", height), side("x2", width), side("y2", height)).where("x2 > x1 and y2 > y1")
    if max(width, height) > blocks.TILE:
        span = lambda lo, hi: F.explode(F.sequence(F.col(lo).cast("long"), F.col(hi).cast("long") - 1))
        best = own.withColumn("x", span("x1", "x2")).withColumn("y", span("y1", "y2")).groupBy("image_id", "x", "y").agg(F.max("score").alias("value"))
        line = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        whole = own.select("image_id").distinct().withColumn("x", line(width)).withColumn("y", line(height))
        values = whole.join(best, ["image_id", "x", "y"], "left").na.fill(0.0, ["value"])
        return refine_regions(values, width, height, threshold, size, most, padding, least, overlap)
    names = ["x1", "y1", "x2", "y2"]
    one = own.groupBy("image_id", *names).agg(F.max("score").alias("score"))
    lists = one.groupBy("image_id").agg(F.collect_list(F.struct("score", *names)).alias("boxes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, blocks.LAID_OUT // (width * height))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                flat, of = some.column(1).flatten(), np.repeat(np.arange(some.num_rows), np.diff(some.column(1).offsets.to_numpy()))
                score, x1, y1, x2, y2 = (flat.field(c).to_numpy() for c in ("score", *names))
                grid = np.zeros(some.num_rows * height * width)
                wide = x2 - x1
                n = (wide * (y2 - y1)).astype(np.int64)
                for own in chunks(n):
                    row = np.repeat(own, n[own])
                    k = np.arange(len(row)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                    np.maximum.at(grid, (of[row] * height + y1[row] + k // wide[row]) * width + x1[row] + k % wide[row], score[row])
                grid = grid.reshape(-1, height, width)
                image, box, found = _regions(grid, threshold, size, most, padding, least, overlap)
                columns = [pa.array(box[:, k].astype(float)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(image)), *columns, pa.array(found)], names=["image_id", *names, "score"])

    image = boxes.schema["image_id"].dataType.simpleString()
    return lists.mapInArrow(run, f"image_id {image}, x1 double, y1 double, x2 double, y2 double, score double")



def boundary(cells: DataFrame) -> DataFrame:
    """Cells with a side neighbour that is not in the mask."""
    sides = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("d")
    near = cells.select("image_id", "x", "y", sides).select("image_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    inside = near.groupBy("image_id", "x", "y").agg(F.count("*").alias("n")).where("n = 4").select("image_id", "x", "y")
    return cells.join(inside, ["image_id", "x", "y"], "left_anti")


def share_within(own: DataFrame, other: DataFrame, tolerance: int, name: str) -> DataFrame:
    """image_id and, under the name, the share of an image's own cells with one of the other mask within the tolerance."""
    offsets = [(dx, dy) for dx in range(-tolerance, tolerance + 1) for dy in range(-tolerance, tolerance + 1) if dx * dx + dy * dy <= tolerance * tolerance]
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])).alias("d")
    reach = other.select("image_id", "x", "y", around).select("image_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).distinct().withColumn("near", F.lit(1))
    return own.join(reach.hint("merge"), ["image_id", "x", "y"], "left").groupBy("image_id").agg(F.avg(F.coalesce("near", F.lit(0))).alias(name))


def f_of_shares(shares: DataFrame) -> DataFrame:
    """image_id, f of the shares p and r; 0 if there is none of one."""
    f = F.when(F.col("p").isNull() | F.col("r").isNull() | (F.col("p") + F.col("r") == 0), 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return shares.select("image_id", f.alias("f"))


def boundary_f(predicted: DataFrame, truth: DataFrame, tolerance: int = 2) -> DataFrame:
    """image_id, f: F1 of boundary cells with one of the other mask within the tolerance, of images in either; 0 if one has none."""
    tiles, larger = blocks.split(predicted, truth)

    def shares(grid, x, y):
        p, t = blocks.edges_of(grid[:, 0]), blocks.edges_of(grid[:, 1])
        return {"p": blocks.share_near(p, t, tolerance), "r": blocks.share_near(t, p, tolerance)}

    found = blocks.on_grids(tiles, 2, shares, "p double, r double")
    if larger is not None:
        p, t = map(boundary, larger)
        found = found.unionByName(share_within(p, t, tolerance, "p").join(share_within(t, p, tolerance, "r").hint("merge"), "image_id", "full"))
    return f_of_shares(found)


def hausdorff(predicted: DataFrame, truth: DataFrame, share: float = 0.95) -> DataFrame:
    """image_id, distance: the percentile of all cells' distances to the other mask, of images in either; null if one has no cell there."""
    tiles, larger = blocks.split(predicted, truth)

    def percentiles(grid, x, y):
        image, squares = squares_between(grid[:, 0], grid[:, 1])
        order = np.lexsort((squares, image))
        n = np.bincount(image, minlength=len(grid))
        d, place = np.sqrt(squares[order]), (n - 1) * share
        low, high = np.floor(place), np.ceil(place)
        first = np.cumsum(n) - n
        below, above = d[first + low.astype(int)], d[first + high.astype(int)]
        between = np.where(low == high, below, (high - place) * below + (place - low) * above)
        one = ~(grid.any(axis=(2, 3)).all(axis=1))
        return {"distance": np.where(one, np.nan, between)}

    found = blocks.on_grids(tiles, 2, percentiles, "distance double")
    if larger is None:
        return found
    p, t = larger
    both = nearest(p, t).unionByName(nearest(t, p)).withColumn("d", F.sqrt("square"))
    rest = F.when(F.count_if(F.col("d").isNull()) == 0, F.percentile("d", F.lit(share)))
    return found.unionByName(both.groupBy("image_id").agg(rest.alias("distance")))


def betti_error(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, error: difference in the number of components."""
    none = F.lit(0)
    return component_counts(predicted, truth).select("image_id", F.abs(F.coalesce("p", none) - F.coalesce("t", none)).alias("error"))


def mask_stats(cells: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, area, x1..y2 (tight), outside_ratio, full_ratio, fill_ratio of each mask. cells: image_id, x, y; boxes: image_id, b_x1..b_y2."""
    j = cells.join(boxes, "image_id")
    inside = (F.col("x") >= F.col("b_x1")) & (F.col("x") < F.col("b_x2")) & (F.col("y") >= F.col("b_y1")) & (F.col("y") < F.col("b_y2"))
    box_area = F.first((F.col("b_x2") - F.col("b_x1")) * (F.col("b_y2") - F.col("b_y1")))
    g = j.groupBy("image_id").agg(F.count("*").alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count_if(~inside).alias("outside"), box_area.alias("box"))
    return g.select("image_id", "area", "x1", "y1", "x2", "y2", (F.col("outside") / F.col("area")).alias("outside_ratio"), (F.col("area") / F.lit(float(width * height))).alias("full_ratio"), ((F.col("area") - F.col("outside")) / F.greatest(F.col("box"), F.lit(1))).alias("fill_ratio"))


def without(cells: DataFrame, negative: DataFrame) -> DataFrame:
    """The mask without the cells of negative regions."""
    return cells.join(negative, ["image_id", "x", "y"], "left_anti")
