"""Suppression and fusion of detections.

Greedy rules are sequential within an image: an image's boxes are one sorted array and an aggregate() over it, one
exchange by image, no Python. Rows: image_id, det_id, label, score, x1..y2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions import boxes as B

from .components import components_within
from .pairs import meeting, overlapping_pairs_grid

_FIELDS = ["det_id", "label", "score", "x1", "y1", "x2", "y2"]


def greedy(detections: DataFrame, drops: Callable[[Column, Column], Column], keys: list[str], rank: list[Column] | None = None, max_kept: int | None = None, extra: list[str] | None = None, per_label: int | None = None) -> DataFrame:
    """The rows kept: in order of rank (score descending), then id, a row goes if drops(kept, row) for one kept before, or if so many (of its label) are kept."""
    extra = extra or []
    fields = [f for f in [*_FIELDS, *extra] if f not in keys]
    rank = rank or [-F.col("score")]
    entry = F.struct(*[r.alias(f"_r{i}") for i, r in enumerate(rank)], *fields)
    kind = None

    def step(kept: Column, b: Column) -> Column:
        full = F.exists(kept, lambda k: drops(k, b))
        if max_kept is not None:
            full = full | (F.size(kept) >= max_kept)
        if per_label is not None:
            full = full | (F.size(F.filter(kept, lambda k: k["label"] == b["label"])) >= per_label)
        return F.when(full, kept).otherwise(F.concat(kept, F.array(b)))

    grouped = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("boxes"))
    kind = grouped.schema["boxes"].dataType.simpleString()
    kept = grouped.withColumn("kept", F.aggregate("boxes", F.array().cast(kind), step))
    return kept.select(*keys, F.explode("kept").alias("b")).select(*keys, *[F.col(f"b.{f}") for f in fields])


def nms(detections: DataFrame, threshold: float, per_label: bool = False, strict: bool = False, max_kept: int | None = None) -> DataFrame:
    """strict: only overlaps over the threshold suppress, else those equal to it too."""
    over = (lambda v: v > threshold) if strict else (lambda v: v >= threshold)
    return greedy(detections, lambda k, b: over(B.iou(B.of(k), B.of(b))), ["image_id", "label"] if per_label else ["image_id"], max_kept=max_kept)


def cap(detections: DataFrame, n: int) -> DataFrame:
    """The n best of each image."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    return detections.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def pairs(detections: DataFrame, columns: list[str], met: Column) -> DataFrame:
    """Boxes of an image that share an area and meet a condition, side by side (a_, b_)."""
    side = lambda p: detections.select("image_id", *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return side("a").join(side("b"), "image_id").where(met & meeting("a_", "b_"))


def parent_filter(detections: DataFrame, share: float = 0.7) -> DataFrame:
    """Drops a box if a smaller one that comes before it (by score, id) has the share of its own area inside."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    placed = detections.withColumn("pos", F.row_number().over(w))
    p = pairs(placed, ["det_id", "pos", "x1", "y1", "x2", "y2"], F.col("b_pos") < F.col("a_pos"))
    a, b = B.box("a_"), B.box("b_")
    parents = p.where((B.area(b) < B.area(a)) & (B.area(b) > 0) & (B.intersection(a, b) / F.greatest(B.area(b), F.lit(1e-9)) >= share)).select("image_id", F.col("a_det_id").alias("det_id"))
    return detections.join(parents, ["image_id", "det_id"], "left_anti")


def quality(detections: DataFrame) -> Column:
    """.68 score + .14 shape + .10 size + .08 source, by label."""
    elong, ratio = B.elongation(B.box()), B.area(B.box()) / (F.col("width") * F.col("height"))
    crack, blob = F.col("label") == "crack", F.col("label").isin("mold", "spall")
    shape = F.when(crack, B.clip01(F.log(elong) / F.log(F.lit(10.0)))).when(blob, 1 - B.clip01((elong - 1) / 8)).otherwise(0.5)
    size = F.when(crack, 1 - B.clip01(ratio / 0.06)).otherwise(1 - B.clip01(ratio / 0.20))
    return 0.68 * F.col("score") + 0.14 * shape + 0.10 * size + 0.08 * F.when(F.col("detector") == "F", 1.0).otherwise(0.92)


def adaptive_thresholds(detections: DataFrame) -> DataFrame:
    """image_id, iou_t, contain_t, area_t of images with two boxes or more: clipped quantiles of the overlaps of all pairs; fixed values where none overlap."""
    p = pairs(detections, ["det_id", "x1", "y1", "x2", "y2"], F.col("a_det_id") < F.col("b_det_id"))
    a, b = B.box("a_"), B.box("b_")
    f = p.select("image_id", B.iou(a, b).alias("iou"), B.containment(a, b).alias("con"), B.area_ratio(a, b).alias("ratio"))
    clip = lambda v, lo, hi, default: F.coalesce(F.least(F.greatest(v, F.lit(lo)), F.lit(hi)), F.lit(default))
    q = lambda cond, c, x: F.percentile(F.when(cond, F.col(c)), F.lit(x))
    found = f.groupBy("image_id").agg(q(F.col("iou") > 0.02, "iou", 0.72).alias("i"), q(F.col("con") > 0.50, "con", 0.80).alias("c"), q(F.col("con") > 0.50, "ratio", 0.35).alias("r"))
    several = detections.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1").select("image_id")
    return several.join(found, "image_id", "left").select("image_id", clip(F.col("i"), 0.38, 0.62, 0.50).alias("iou_t"), clip(F.col("c"), 0.82, 0.94, 0.88).alias("contain_t"), clip(F.col("r"), 0.25, 0.55, 0.35).alias("area_t"))


def adaptive_filter(detections: DataFrame, per_label: int | None = None) -> DataFrame:
    """Drops by quality: same label at the image's own threshold, another label at .42 of it at least; per_label: most of a label that stay."""
    t = adaptive_thresholds(detections).select("image_id", "iou_t")
    rows = detections.withColumn("quality", quality(detections)).join(t, "image_id", "left").withColumn("iou_t", F.coalesce("iou_t", F.lit(0.5)))
    drops = lambda k, b: B.iou(B.of(k), B.of(b)) >= F.when(k["label"] == b["label"], b["iou_t"]).otherwise(F.greatest(F.lit(0.42), b["iou_t"]))
    return greedy(rows, drops, ["image_id"], [-F.round("quality", 9)], extra=["prompt_key", "quality", "iou_t"], per_label=per_label)


def weighted_fusion(detections: DataFrame, threshold: float, max_dets: int | None = None) -> DataFrame:
    """Boxes of a prompt go to the first seed that they overlap; a seed's cluster is their score-weighted mean box. max_dets: an image's first seeds alone."""
    keys = ["image_id", "prompt_key"]
    seeds = greedy(detections, lambda k, b: B.iou(B.of(k), B.of(b)) >= threshold, keys)
    if max_dets is not None:
        seeds = cap(seeds, max_dets)
    s = seeds.select(*keys, *[F.col(c).alias(f"s_{c}") for c in ("det_id", "score", "x1", "y1", "x2", "y2")])
    both = detections.join(s, keys).where((F.col("det_id") == F.col("s_det_id")) | (B.iou(B.box(), B.box("s_")) >= threshold))
    own = F.row_number().over(Window.partitionBy(*keys, "det_id").orderBy(F.desc("s_score"), "s_det_id"))
    members = both.withColumn("_n", own).where("_n = 1")
    weight = F.sum(F.greatest(F.col("score"), F.lit(1e-6)))
    mean = lambda c: (F.sum(F.col("score") * F.col(c)) / weight).alias(c)
    return members.groupBy("image_id", "prompt_key", "s_det_id").agg(*[mean(c) for c in ("x1", "y1", "x2", "y2")], F.max("score").alias("score"), F.count("*").alias("fused_count")).withColumnRenamed("s_det_id", "seed_id")


def embedding_dedup(detections: DataFrame, iou_t: float, cos_t: float) -> DataFrame:
    """image_id, det_id, kept, merged_into: as NMS, but a kept box must be alike in box and vector (column v)."""
    from boxwright.functions.vectors import dot

    drops = lambda k, b: (B.iou(B.of(k), B.of(b)) >= iou_t) & (dot(k["v"], b["v"]) >= cos_t)
    kept = greedy(detections, drops, ["image_id"], extra=["v"])
    k = kept.select("image_id", *[F.col(c).alias(f"k_{c}") for c in ("det_id", "score", "x1", "y1", "x2", "y2", "v")])
    both = detections.join(k, "image_id").where((F.col("det_id") == F.col("k_det_id")) | ((B.iou(B.box(), B.box("k_")) >= iou_t) & (dot(F.col("v"), F.col("k_v")) >= cos_t)))
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("image_id", "det_id").orderBy(F.desc("k_score"), "k_det_id"))).where("_n = 1")
    same = F.col("det_id") == F.col("k_det_id")
    return first.select("image_id", "det_id", same.alias("kept"), F.when(~same, F.col("k_det_id")).alias("merged_into"))


def quantised_dedupe(detections: DataFrame, step: float = 2.0) -> DataFrame:
    """The first (by id) of the boxes with equal coordinates in steps."""
    cell = [F.floor(F.col(c) / step).alias(f"q_{c}") for c in ("x1", "y1", "x2", "y2")]
    w = Window.partitionBy("image_id", *[f"q_{c}" for c in ("x1", "y1", "x2", "y2")]).orderBy("det_id")
    return detections.select("*", *cell).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*detections.columns)


def merge_touching(detections: DataFrame, most: float = 0.45) -> DataFrame:
    """Boxes of a label whose expanded forms touch merge into their bounding box, unless it spans over 45 % of the image.

    Touching pairs are a table of edges, however many boxes an image has; components are found until they are whole.
    """
    pad = lambda lo, hi: F.greatest(F.lit(8.0), (F.col(hi) - F.col(lo)) * 0.15)
    group = F.struct("image_id", "label")
    grown = detections.select(group.alias("group"), "det_id", *[(F.col(lo) - pad(lo, hi)).alias(lo) for lo, hi in (("x1", "x2"), ("y1", "y2"))], *[(F.col(hi) + pad(lo, hi)).alias(hi) for lo, hi in (("x1", "x2"), ("y1", "y2"))])
    touching = overlapping_pairs_grid(grown, [], cell=512.0, key="group", inclusive=True)
    roots = components_within(touching.select("group.image_id", "group.label", F.col("a_det_id").alias("u"), F.col("b_det_id").alias("v")), ["image_id", "label"]).withColumnRenamed("node", "det_id")
    rows = detections.join(roots.hint("merge"), ["image_id", "label", "det_id"], "left").withColumn("root", F.coalesce("root", "det_id"))
    w = Window.partitionBy("image_id", "label", "root")
    spans = ((F.max("x2").over(w) - F.min("x1").over(w)) > most * F.col("width")) | ((F.max("y2").over(w) - F.min("y1").over(w)) > most * F.col("height"))
    keyed = rows.withColumn("part", F.when(spans, F.col("det_id")).otherwise(F.col("root")))
    return keyed.groupBy("image_id", "label", "part").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("score").alias("score"), F.count("*").alias("members"))


def _nested(detections: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """The boxes (a_), the others of their image (b_), and whether a nested pair of one label drops the first: long cracks keep the parent, else scores that are close keep the child, else the better stays."""
    columns = ["image_id", "det_id", "label", "score", "x1", "y1", "x2", "y2"]
    own, other = (detections.select(*[F.col(c).alias(f"{p}{c}") for c in columns]) for p in ("a_", "b_"))
    a, b = B.box("a_"), B.box("b_")
    parent = (B.area(a) > B.area(b)) | ((B.area(a) == B.area(b)) & (F.col("a_det_id") < F.col("b_det_id")))
    of_parent, of_child = (lambda x, y: F.when(parent, x).otherwise(y)), (lambda x, y: F.when(parent, y).otherwise(x))
    long_crack = (F.col("a_label") == "crack") & of_parent(B.elongation(a) >= 3, B.elongation(b) >= 3)
    parent_q, child_q = of_parent(F.col("a_score"), F.col("b_score")), of_child(F.col("a_score"), F.col("b_score"))
    drops = F.when(long_crack, ~parent).when(F.abs(parent_q - child_q) < 0.05, parent).when(parent_q < child_q, parent).otherwise(~parent)
    inside = B.intersection(a, b) / F.greatest(F.least(B.area(a), B.area(b)), F.lit(1e-6)) >= 0.9
    met = (F.col("a_image_id") == F.col("b_image_id")) & (F.col("a_det_id") != F.col("b_det_id")) & (F.col("a_label") == F.col("b_label")) & meeting("a_", "b_")
    return own, other, met & inside & drops


def nested_drops(detections: DataFrame) -> DataFrame:
    """det_id of the boxes that nested pairs drop, each pair by itself: boxes meet in their image and are not joined again by their ids."""
    own, other, dropped = _nested(detections)
    return own.join(other, dropped, "left_semi").select(F.col("a_det_id").alias("det_id"))


def nested_kept(detections: DataFrame) -> DataFrame:
    """det_id of the boxes that nested_drops() leaves."""
    own, other, dropped = _nested(detections)
    return own.join(other, dropped, "left_anti").select(F.col("a_det_id").alias("det_id"))
