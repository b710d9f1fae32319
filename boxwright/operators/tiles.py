"""Tiles of images, and fusion of what tiles say."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(size: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles along a side: regular ones, then one that ends with the image."""
    step = tile - overlap
    regular = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)).cast("int"), F.lit(step)), lambda x: x + tile < size)
    return F.array_distinct(F.concat(regular, F.array(F.greatest(size - tile, F.lit(0)).cast("int"))))


def grid(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """image_id, x1, y1, x2, y2 of the tiles that cover each image (w, h)."""
    xs = images.withColumn("x1", F.explode(_starts(F.col("w"), tile, overlap)))
    xy = xs.withColumn("y1", F.explode(_starts(F.col("h"), tile, overlap)))
    return xy.select("image_id", "x1", "y1", F.least(F.col("x1") + tile, F.col("w")).alias("x2"), F.least(F.col("y1") + tile, F.col("h")).alias("y2"))


def roi_grid(regions: DataFrame, tile: int, overlap: int) -> DataFrame:
    """roi_id, x1, y1, x2, y2 of the tiles of regions (left, top, w, h) in the image's coordinates."""
    g = grid(regions.withColumnRenamed("roi_id", "image_id"), tile, overlap).withColumnRenamed("image_id", "roi_id")
    moved = g.join(regions.select("roi_id", "left", "top"), "roi_id")
    return moved.select("roi_id", *[(F.col(c) + F.col(by)).alias(c) for c, by in (("x1", "left"), ("y1", "top"), ("x2", "left"), ("y2", "top"))])


def scan_grid(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """image_id, x1, y1, x2, y2: tiles that start every tile - overlap up to the overlap before the end; one cut off by the end is moved back."""
    step = max(1, tile - overlap)
    starts = lambda size: F.sequence(F.lit(0), F.greatest(size - overlap, F.lit(1)).cast("int") - 1, F.lit(step))
    at = images.withColumn("x", F.explode(starts(F.col("w")))).withColumn("y", F.explode(starts(F.col("h"))))
    first = lambda at, size: F.when(F.col(at) + tile > F.col(size), F.greatest(F.col(size) - tile, F.lit(0))).otherwise(F.col(at))
    end = lambda at, size: F.least(F.col(size), F.col(at) + tile)
    return at.select("image_id", first("x", "w").cast("int").alias("x1"), first("y", "h").cast("int").alias("y1"), end("x", "w").alias("x2"), end("y", "h").alias("y2"))


#: Longest side up to which the sizes hold, sizes of tiles, sizes where small tiles are wanted.
PLANS = [(1024, [256, 384], [256, 320, 384]), (1800, [384, 640, 896], [320, 512, 768]), (None, [512, 768, 1152], [384, 640, 1024])]


def adaptive_plan(images: DataFrame, small: bool = False) -> DataFrame:
    """image_id, size, overlap of the tile passes that suit an image: sizes by its longest side, cut to it, equal ones once; a quarter overlaps, 64 at least."""
    longest = F.greatest("w", "h")
    sizes = F.coalesce(*[F.when(longest <= most if most else F.lit(True), F.array(*map(F.lit, few if small else usual))) for most, usual, few in PLANS])
    size = F.explode(F.array_distinct(F.transform(sizes, lambda s: F.least(s, longest)))).alias("size")
    return images.select("image_id", size).select("image_id", "size", F.greatest(F.lit(64), F.bround(F.col("size") * 0.25).cast("int")).alias("overlap"))


def hann(place: Column, n: int) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * place / (n - 1))


def fuse(values: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of value by weight."""
    return values.groupBy(*keys).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))
