"""Box algebra as column expressions; a box is four columns or a struct with x1, y1, x2, y2."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = namedtuple("Box", "x1 y1 x2 y2")


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in Box._fields))


def of(struct: Column) -> Box:
    return Box(*(struct[c] for c in Box._fields))


def side(lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0.0), hi - lo)


def width(b: Box) -> Column:
    return side(b.x1, b.x2)


def height(b: Box) -> Column:
    return side(b.y1, b.y2)


def area(b: Box) -> Column:
    return width(b) * height(b)


def intersection(a: Box, b: Box) -> Column:
    return side(F.greatest(a.x1, b.x1), F.least(a.x2, b.x2)) * side(F.greatest(a.y1, b.y1), F.least(a.y2, b.y2))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def containment(a: Box, b: Box) -> Column:
    """Share of the smaller box within the other; 0 for an empty one."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(0.0)


def area_ratio(a: Box, b: Box) -> Column:
    large = F.greatest(area(a), area(b))
    return F.when(large > 0, F.least(area(a), area(b)) / large).otherwise(0.0)


def aspect(b: Box) -> Column:
    return width(b) / F.greatest(height(b), F.lit(1e-6))


def elongation(b: Box) -> Column:
    return F.greatest(aspect(b), 1 / F.greatest(aspect(b), F.lit(1e-6)))


def clip(b: Box, w: Column, h: Column) -> Box:
    """Clamped to the image; all null if nothing is left."""
    x1, x2 = (F.least(F.greatest(v, F.lit(0.0)), w) for v in (b.x1, b.x2))
    y1, y2 = (F.least(F.greatest(v, F.lit(0.0)), h) for v in (b.y1, b.y2))
    left = (x2 > x1) & (y2 > y1)
    return Box(*(F.when(left, v) for v in (x1, y1, x2, y2)))


def expand(b: Box, ratio: float, w: Column, h: Column) -> Box:
    dx, dy = width(b) * (ratio / 2), height(b) * (ratio / 2)
    return clip(Box(b.x1 - dx, b.y1 - dy, b.x2 + dx, b.y2 + dy), w, h)


def padded(b: Box, pad: float, w: Column, h: Column) -> Box:
    """Whole pixels around the box (towards zero, then up), clamped."""
    x1, y1 = (F.greatest((v - pad).cast("int"), F.lit(0)) for v in (b.x1, b.y1))
    x2 = F.least((b.x2 + pad + 0.999999).cast("int"), w)
    y2 = F.least((b.y2 + pad + 0.999999).cast("int"), h)
    left = (x2 > x1) & (y2 > y1)
    return Box(*(F.when(left, v) for v in (x1, y1, x2, y2)))


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def yolo(b: Box, w: Column, h: Column) -> Box:
    """Normalised centre form (cx, cy, w, h)."""
    cx, cy = centre(b)
    return Box(cx / w, cy / h, width(b) / w, height(b) / h)


def touch(a: Box, b: Box) -> Column:
    """Closed intervals meet."""
    return (a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2)


def rotate_back(b: Box, m: list[Column]) -> Box:
    """The bounding box of the four corners under the affine map (m0 m1 m2; m3 m4 m5)."""
    corners = [(x, y) for x in (b.x1, b.x2) for y in (b.y1, b.y2)]
    xs = [m[0] * x + m[1] * y + m[2] for x, y in corners]
    ys = [m[3] * x + m[4] * y + m[5] for x, y in corners]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def clip01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
