"""Spatial joins, pairwise geometry and the box graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions import boxes as B

XY = ["x1", "y1", "x2", "y2"]


def meeting(a: str, b: str) -> Column:
    """Whether two boxes, given by the prefixes of their columns, share an area."""
    c = F.col
    return (c(f"{a}x1") < c(f"{b}x2")) & (c(f"{b}x1") < c(f"{a}x2")) & (c(f"{a}y1") < c(f"{b}y2")) & (c(f"{b}y1") < c(f"{a}y2"))


def overlapping_pairs(detections: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a_, b_; a's id below b's) of an image that share an area."""
    side = lambda p: detections.select("image_id", *[F.col(c).alias(f"{p}_{c}") for c in ["det_id", *XY, *columns]])
    return side("a").join(side("b"), "image_id").where((F.col("a_det_id") < F.col("b_det_id")) & meeting("a_", "b_"))


def overlapping_pairs_grid(detections: DataFrame, columns: list[str], cell: float = 128.0, key: str = "image_id", inclusive: bool = False) -> DataFrame:
    """The same pairs for images with very many boxes: an equi-join on (image, cell), each pair kept in the cell of its intersection's first corner. inclusive: boxes that share an edge meet too."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    celled = detections.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    side = lambda p: celled.select(key, "cx", "cy", *[F.col(c).alias(f"{p}_{c}") for c in ["det_id", *XY, *columns]])
    before = lambda p, q: F.col(p) <= F.col(q) if inclusive else F.col(p) < F.col(q)
    meet = (F.col("a_det_id") < F.col("b_det_id")) & before("a_x1", "b_x2") & before("b_x1", "a_x2") & before("a_y1", "b_y2") & before("b_y1", "a_y2")
    home = (F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("cy"))
    return side("a").join(side("b"), [key, "cx", "cy"]).where(meet & home).drop("cx", "cy")


def geometry_features(detections: DataFrame) -> DataFrame:
    """det_id, area_ratio, aspect, elongation, max_containment, max_iou_same_label, contains_count, contained_by_count."""
    a, b = B.box("a_"), B.box("b_")
    p = overlapping_pairs(detections, ["label"]).select("a_det_id", "b_det_id", B.iou(a, b).alias("iou"), B.containment(a, b).alias("con"), (F.col("a_label") == F.col("b_label")).alias("same"), (B.area(a) >= B.area(b)).alias("a_first"))
    one = lambda own, first: p.select(F.col(own).alias("det_id"), "iou", "con", "same", first.alias("first"))
    both = one("a_det_id", F.col("a_first")).unionByName(one("b_det_id", ~F.col("a_first")))
    agg = both.groupBy("det_id").agg(F.max("con").alias("max_containment"), F.max(F.when(F.col("same"), F.col("iou"))).alias("max_iou_same_label"), F.count_if((F.col("con") >= 0.9) & F.col("first")).alias("contains_count"), F.count_if((F.col("con") >= 0.9) & ~F.col("first")).alias("contained_by_count"))
    own = B.box()
    scalar = detections.select("det_id", (B.area(own) / (F.col("width") * F.col("height"))).alias("area_ratio"), B.aspect(own).alias("aspect"), B.elongation(own).alias("elongation"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("max_containment", "max_iou_same_label", "contains_count", "contained_by_count")}
    return scalar.join(agg, "det_id", "left").withColumns(zero)


def _edges(detections: DataFrame) -> DataFrame:
    """box_graph() with what its parents' statistics need besides."""
    p = overlapping_pairs(detections, ["label", "width", "height"])
    a, b = B.box("a_"), B.box("b_")
    larger = B.area(a) >= B.area(b)
    (ax, ay), (bx, by) = B.centre(a), B.centre(b)
    inter, big, small = B.intersection(a, b), F.greatest(B.area(a), B.area(b)), F.least(B.area(a), B.area(b))
    con = inter / F.greatest(small, F.lit(1e-6))
    child = lambda x, y: F.when(larger, y).otherwise(x)
    return p.select(
        "image_id",
        F.when(larger, F.col("a_det_id")).otherwise(F.col("b_det_id")).alias("parent_id"),
        child(F.col("a_det_id"), F.col("b_det_id")).alias("child_id"),
        (inter / F.greatest(big + small - inter, F.lit(1e-6))).alias("iou"),
        inter.alias("inter"),
        con.alias("containment"),
        (inter / F.greatest(big, F.lit(1e-6))).alias("child_coverage"),
        (small / F.greatest(big, F.lit(1e-6))).alias("area_ratio"),
        (F.hypot(ax - bx, ay - by) / F.hypot(F.col("a_width").cast("double"), F.col("a_height").cast("double"))).alias("centre_distance"),
        (F.least(B.aspect(a), B.aspect(b)) / F.greatest(B.aspect(a), B.aspect(b), F.lit(1e-6))).alias("aspect_similarity"),
        (F.col("a_label") == F.col("b_label")).alias("label_agreement"),
        F.when(con >= 0.9, "containment").otherwise("overlap").alias("edge_type"),
        child(F.col("a_label"), F.col("b_label")).alias("child_label"),
        child(ax, bx).alias("cx"),
        child(ay, by).alias("cy"),
        big.alias("parent_area"),
    ).where((F.col("containment") >= 0.5) | (F.col("iou") >= 0.1))


def box_graph(detections: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller box (the smaller id of equal ones) with their features."""
    return _edges(detections).drop("child_label", "cx", "cy", "parent_area")


def _nested(detections: DataFrame) -> DataFrame:
    """det_id, and the statistics of its children (null without one), of the boxes at either end of a containment: the graph is built and grouped once."""
    e = _edges(detections).where("containment >= 0.9")
    features = ["child_label", "cx", "cy", "inter", "parent_area"]
    end = lambda own, is_parent: F.struct(F.col(own).alias("det_id"), *[(F.col(c) if is_parent else F.lit(None)).alias(c) for c in features])
    rows = e.select(F.inline(F.array(end("parent_id", True), end("child_id", False))))
    s = rows.groupBy("det_id").agg(F.count("inter").alias("children"), F.size(F.collect_set("child_label")).alias("diversity"), F.sum("inter").alias("inter"), F.max("parent_area").alias("parent_area"), F.var_pop("cx").alias("vx"), F.var_pop("cy").alias("vy"), F.covar_pop("cx", "cy").alias("vxy"), F.avg((F.col("child_label") == "crack").cast("double")).alias("crack_ratio"))
    half, root = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, F.lit(2)) + F.pow(F.col("vxy"), F.lit(2)))
    l1, l2 = half + root, half - root
    aligned = F.when(F.col("children") == 1, 1.0).when(l1 <= 1e-6, 0.0).otherwise(1 - F.greatest(l2, F.lit(0.0)) / F.greatest(l1, F.lit(1e-6)))
    return s.select("det_id", "children", F.col("diversity").cast("long").alias("diversity"), F.least(F.lit(1.0), F.col("inter") / F.greatest("parent_area", F.lit(1e-6))).alias("coverage"), aligned.alias("alignment"), "crack_ratio")


def child_stats(detections: DataFrame) -> DataFrame:
    """parent_id, children, diversity, coverage, alignment of the centres (1 - smaller over larger eigenvalue), crack_ratio."""
    return _nested(detections).where("children > 0").withColumnRenamed("det_id", "parent_id")


def box_quality(detections: DataFrame, semantic: Column, margin: Column) -> DataFrame:
    """det_id, quality, decision, reason of each box. semantic, margin: its label's score and lead."""
    stats = _nested(detections).withColumn("involved", F.lit(True))
    rows = detections.withColumns({"sem": semantic, "margin": margin, "elong": B.elongation(B.box()), "ratio": B.area(B.box()) / (F.col("width") * F.col("height"))}).join(stats, "det_id", "left")
    n = F.coalesce("children", F.lit(0))
    composite = (n >= 2) & (F.coalesce("diversity", F.lit(0)) > 1)
    broad = (F.col("ratio") >= 0.25) & (F.when(n > 0, F.col("coverage")).otherwise(0.0) <= 0.35) & (F.col("sem") <= 0.65)
    long_crack = (F.col("label") == "crack") & (F.col("elong") >= 3) & F.when(n == 0, (F.col("sem") >= 0.75) & (F.col("margin") >= 0.05)).otherwise((F.col("crack_ratio") >= 0.75) & (F.col("alignment") >= 0.60))
    lead = F.least(F.lit(1.0), F.col("margin") / 0.10)
    quality = B.clip01(0.25 * F.col("score") + 0.25 * F.col("sem") + 0.15 * lead - 0.20 * broad.cast("double") - 0.20 * composite.cast("double"))
    decision = F.when(long_crack, "keep_long_crack").when(composite, "composite_parent").when(broad, "broad_box").otherwise("keep")
    reason = F.when(decision != "keep", decision).when(F.col("involved"), "box_graph_checked").otherwise("no_box_conflict")
    return rows.select("det_id", quality.alias("quality"), decision.alias("decision"), reason.alias("reason"))


def best_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """pred_id, best_iou, truth_id: each prediction's best truth box of its image and label (0, null if none)."""
    p = predictions.select("image_id", "label", *[F.col(c).alias(f"a_{c}") for c in ["det_id", *XY]])
    t = truth.select("image_id", "label", *[F.col(c).alias(f"b_{c}") for c in ["det_id", *XY]])
    j = p.alias("p").join(t.alias("t"), (F.col("p.image_id") == F.col("t.image_id")) & (F.col("p.label") == F.col("t.label")) & meeting("a_", "b_"), "left").withColumn("iou", F.coalesce(B.iou(B.box("a_"), B.box("b_")), F.lit(0.0)))
    best = F.max_by(F.struct("b_det_id", "iou"), F.struct("iou", -F.col("b_det_id")))
    return j.groupBy(F.col("a_det_id").alias("pred_id")).agg(best.alias("m")).select("pred_id", F.col("m.iou").alias("best_iou"), F.when(F.col("m.iou") > 0, F.col("m.b_det_id")).alias("truth_id"))


def _ranks(tile: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of each coordinate among the distinct ones of its tile."""
    order = np.lexsort((c, tile))
    t, v = tile[order], c[order]
    new = np.r_[True, t[1:] != t[:-1]]
    steps = np.cumsum(new | np.r_[True, v[1:] != v[:-1]])
    out = np.empty(len(c), np.int64)
    out[order] = steps - np.maximum.accumulate(np.where(new, steps, 0))
    return out


#: Places between edges that a task lays out at a time.
LAID_OUT = 1 << 21


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """image_id, corners (kind, x, y, n) of a tile to image_id, size, hit: the area of truth, and of truth that predictions cover. Tiles of about as many edges are laid out together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        tile = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        kind, x, y, n = (lists.flatten().field(c).to_numpy() for c in ("kind", "x", "y", "n"))
        at_x, at_y = _ranks(tile, x), _ranks(tile, y)
        wide, high = np.zeros((2, len(lists)), np.int64)
        np.maximum.at(wide, tile, at_x + 1)
        np.maximum.at(high, tile, at_y + 1)
        starts, counts = np.cumsum(np.bincount(tile, minlength=len(lists))) - np.bincount(tile, minlength=len(lists)), np.bincount(tile, minlength=len(lists))
        sizes, hits = np.zeros((2, len(lists)), np.int64)
        order, at = np.argsort(np.maximum(wide, high), kind="stable"), 0
        while at < len(order):
            end, most = at + 1, max(wide[order[at]], high[order[at]])
            while end < len(order) and max(most, wide[order[end]], high[order[end]]) ** 2 * (end + 1 - at) * 2 <= LAID_OUT:
                most, end = max(most, wide[order[end]], high[order[end]]), end + 1
            some = order[at:end]
            mine = np.repeat(starts[some] - np.cumsum(counts[some]) + counts[some], counts[some]) + np.arange(counts[some].sum())
            row = np.repeat(np.arange(len(some)), counts[some])
            over = np.zeros((len(some), 2, high[some].max(), wide[some].max()), np.int64)
            np.add.at(over, (row, kind[mine], at_y[mine], at_x[mine]), n[mine])
            xs, ys = np.zeros((len(some), over.shape[3])), np.zeros((len(some), over.shape[2]))
            xs[row, at_x[mine]], ys[row, at_y[mine]] = x[mine], y[mine]
            over = over.cumsum(axis=2).cumsum(axis=3)[:, :, :-1, :-1] > 0  # how many boxes lie over each place between edges; none beyond the last edge
            area = np.diff(ys)[:, :, None] * np.diff(xs)[:, None, :]
            sizes[some] = (area * over[:, 0]).sum(axis=(1, 2))
            hits[some] = (area * (over[:, 0] & over[:, 1])).sum(axis=(1, 2))
            at = end
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(hits)], names=["image_id", "size", "hit"])


def coverage(truth: DataFrame, predictions: DataFrame, tile: int = 512) -> DataFrame:
    """image_id, covered: area of (union of truth) within (union of predictions) over the former, edges on whole pixels.

    Boxes are cut along tiles of an image. In a tile a box is four signed corners, added up before they are shuffled, so a tile
    has as many as its pixels at most, whatever the boxes; running sums of the corners tell which cells between edges are
    covered. No pixel is written out. Boxes without an area and images without truth have no row.
    """

    def corners(df: DataFrame, kind: int) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor((F.col(hi) - 1) / tile)))
        whole = df.select("image_id", F.floor("x1").alias("x1"), F.floor("y1").alias("y1"), F.ceil("x2").alias("x2"), F.ceil("y2").alias("y2")).where("x2 > x1 and y2 > y1")
        cut = whole.withColumn("tx", span("x1", "x2")).withColumn("ty", span("y1", "y2"))
        local = lambda c, t: F.least(F.greatest(F.col(c) - F.col(t) * tile, F.lit(0)), F.lit(tile))
        x1, y1, x2, y2 = local("x1", "tx"), local("y1", "ty"), local("x2", "tx"), local("y2", "ty")
        corner = lambda x, y, n: F.struct(x.alias("x"), y.alias("y"), F.lit(n).alias("n"))
        return cut.select("image_id", "tx", "ty", F.lit(kind).alias("kind"), F.inline(F.array(corner(x1, y1, 1), corner(x2, y1, -1), corner(x1, y2, -1), corner(x2, y2, 1))))

    keys = ["image_id", "tx", "ty"]
    summed = corners(truth, 0).unionByName(corners(predictions, 1)).groupBy(*keys, "kind", "x", "y").agg(F.sum("n").alias("n")).where("n <> 0")
    tiles = summed.groupBy(*keys).agg(F.collect_list(F.struct("kind", "x", "y", "n")).alias("corners"), F.min("kind").alias("least")).where("least = 0").select("image_id", "corners")
    image = truth.schema["image_id"].dataType.simpleString()
    areas = tiles.mapInArrow(_covered, f"image_id {image}, size bigint, hit bigint")
    return areas.groupBy("image_id").agg((F.sum("hit") / F.sum("size")).alias("covered"))


def without_overlap(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions that share no area with any truth box of their image."""
    t = truth.select(F.col("image_id").alias("t_image"), *[F.col(c).alias(f"t_{c}") for c in XY])
    meet = (F.col("image_id") == F.col("t_image")) & (F.col("x1") < F.col("t_x2")) & (F.col("t_x1") < F.col("x2")) & (F.col("y1") < F.col("t_y2")) & (F.col("t_y1") < F.col("y2"))
    return predictions.join(t, meet, "left_anti")


def score_order(image: str = "image_id") -> Window:
    return Window.partitionBy(image).orderBy(F.desc("score"), "det_id")
