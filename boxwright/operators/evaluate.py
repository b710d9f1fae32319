"""Matching and metrics of detections, and paired statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions import boxes as B
from boxwright.functions.stored import stored
from boxwright.operators.numbering import running_max, running_sums


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(empty)


def overlaps(predictions: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """image_id, label, score, pred_id, truth_id, iou of the pairs of an image and label that overlap enough."""
    p = predictions.select("image_id", "label", "score", F.col("det_id").alias("pred_id"), *[F.col(c).alias(f"p_{c}") for c in B.Box._fields])
    t = truth.select("image_id", "label", F.col("det_id").alias("truth_id"), *[F.col(c).alias(f"t_{c}") for c in B.Box._fields])
    met = p.join(t, ["image_id", "label"]).where("p_x1 < t_x2 and t_x1 < p_x2 and p_y1 < t_y2 and t_y1 < p_y2")
    return met.select("image_id", "label", "score", "pred_id", "truth_id", B.iou(B.box("p_"), B.box("t_")).alias("iou")).where(F.col("iou") >= threshold)


def greedy_matches(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, label, pred_id, truth_id: predictions by score (then id) take their best free truth box of at least that IoU.

    Only pairs that overlap meet in an array, one for each image and label.
    """
    return _taken(overlaps(predictions, truth, threshold), ["image_id", "label"]).drop("score")


def matches_at(predictions: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """image_id, label, threshold, score, pred_id, truth_id: greedy_matches() at each threshold; boxes meet once, pairs are told apart after."""
    at = F.filter(F.array(*map(F.lit, sorted(thresholds))), lambda t: t <= F.col("iou"))
    pairs = overlaps(predictions, truth, min(thresholds)).withColumn("threshold", F.explode(at))
    return _taken(pairs, ["image_id", "label", "threshold"])


def _taken(pairs: DataFrame, keys: list[str]) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pred_id", (-F.col("iou")).alias("o"), "truth_id")))
    start = F.expr("cast(array() as array<struct<pred_id: bigint, truth_id: bigint, score: double>>)")

    def step(held: Column, x: Column) -> Column:
        free = ~F.exists(held, lambda h: (h["pred_id"] == x["pred_id"]) | (h["truth_id"] == x["truth_id"]))
        return F.when(free, F.concat(held, F.array(F.struct(x["pred_id"].alias("pred_id"), x["truth_id"].alias("truth_id"), (-x["s"]).cast("double").alias("score"))))).otherwise(held)

    return pairs.groupBy(*keys).agg(order.alias("rows")).select(*keys, F.inline(F.aggregate("rows", start, step)))


def image_counts(predictions: DataFrame, truth: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp, fp, fn, precision, recall, f1."""
    count = lambda df, p, t, m: df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, *[F.when(F.lit(x), F.col("n")).otherwise(0).alias(c) for x, c in ((p, "p"), (t, "t"), (m, "m"))])
    both = count(predictions, True, False, False).unionByName(count(truth, False, True, False)).unionByName(count(matches, False, False, True))
    n = both.groupBy(*keys).agg(F.sum("m").alias("tp"), (F.sum("p") - F.sum("m")).alias("fp"), (F.sum("t") - F.sum("m")).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def average_precision(flagged: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ap: area under the precision envelope of each key. flagged: keys, score, hit; truths: keys, truths."""
    steps = flagged.groupBy(*keys, "score").agg(F.count_if("hit").alias("h"), F.count_if(~F.col("hit")).alias("m"))
    return average_precision_of_steps(steps, truths, keys)


def mean_average_precision(predictions: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """label, map: the mean average precision over the thresholds. Boxes are matched in one pass, predictions counted by score once for all thresholds."""
    at = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    hits = matches_at(predictions, truth, thresholds).groupBy("label", "threshold", "score").agg(F.count("*").alias("h"))
    said = predictions.groupBy("label", F.col("score").cast("double").alias("score")).agg(F.count("*").alias("n")).select("label", "score", "n", at)
    h = F.coalesce("h", F.lit(0))
    steps = said.join(hits, ["label", "threshold", "score"], "left").select("label", "threshold", "score", h.alias("h"), (F.col("n") - h).alias("m"))
    truths = truth.groupBy("label").agg(F.count("*").alias("truths")).select("label", "truths", at)
    return average_precision_of_steps(steps, truths, ["label", "threshold"]).groupBy("label").agg(F.avg("ap").alias("map"))


def average_precision_of_steps(steps: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """average_precision() of hits and misses (h, m) counted by keys and score.

    Predictions of equal score are one step of the curve. Running sums and the envelope come from ranges of (keys, score), so
    no task sees a whole curve; keys with truth and no hit have 0.
    """
    of = [F.col(k) for k in keys]
    summed = stored(running_sums(steps, [*of, F.desc("score")], {"tp": F.col("h"), "fp": F.col("m")}), "curve")
    # what lies before a key's own steps
    base = summed.groupBy(*keys).agg(F.min(F.struct(F.col("tp") + F.col("fp"), "tp", "fp", "h", "m")).alias("b")).select(*keys, (F.col("b.tp") - F.col("b.h")).alias("tp0"), (F.col("b.fp") - F.col("b.m")).alias("fp0"))
    own = summed.join(base, keys).join(truths, keys).withColumns({"tp": F.col("tp") - F.col("tp0"), "fp": F.col("fp") - F.col("fp0")})
    curve = own.select(*keys, "score", "h", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.greatest("truths", F.lit(1)).alias("truths"))
    # the best precision at this score or a lower one: a running maximum over the reverse order, of (key's number, precision)
    number = curve.select(*keys).distinct().withColumn("key", F.xxhash64(*keys))  # keys are few: labels, thresholds
    ranked = stored(curve.join(number, keys), "curve")
    envelope = running_max(ranked, [F.col("key"), F.asc("score")], "top", F.struct("key", "precision"))
    area = F.sum(F.col("top.precision") * F.col("h") / F.col("truths"))
    found = envelope.groupBy(*keys).agg(area.alias("ap"))
    return truths.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(tp > 0, (1 + b) * tp / ((1 + b) * tp + b * fn + fp)).when((fp == 0) & (fn == 0), 1.0).otherwise(0.0)


def mask_metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Two empty masks agree wholly, one empty mask not at all."""
    both, one = (tp + fp + fn) == 0, ((tp + fp) == 0) | ((tp + fn) == 0)
    of = lambda x: F.when(both, 1.0).when(one, 0.0).otherwise(x)
    return {"precision": of(tp / (tp + fp)), "recall": of(tp / (tp + fn)), "dice": of(2 * tp / (2 * tp + fp + fn)), "iou": of(tp / (tp + fp + fn))}


def smoothed_metrics(tp: Column, fp: Column, fn: Column, tn: Column, eps: float = 1e-8) -> dict[str, Column]:
    """Dice, IoU, precision, recall, specificity and accuracy with eps on both sides of each ratio: two empty masks give 1."""
    of = lambda a, b: (a + F.lit(eps)) / (b + F.lit(eps))
    return {"dice": of(2 * tp, 2 * tp + fp + fn), "iou": of(tp, tp + fp + fn), "precision": of(tp, tp + fp), "recall": of(tp, tp + fn), "specificity": of(tn, tn + fp), "accuracy": of(tp + tn, tp + fp + fn + tn)}


def confusion_filled(rows: DataFrame) -> DataFrame:
    """rows (precision, recall, predicted_px, truth_px, width, height, and tp, fp, fn, tn, specificity, accuracy that may be null) with what is null worked out from the rest.

    tp is the mean of precision x predicted and recall x truth (or the one of the two whose mask is not empty, or 0), rounded
    half up; then fp, fn and tn, none below 0; then the ratios, null where a denominator is 0.
    """
    c = F.col
    by_p, by_r = c("precision") * c("predicted_px"), c("recall") * c("truth_px")
    tp = F.when((c("predicted_px") > 0) & (c("truth_px") > 0), (by_p + by_r) / 2).when(c("predicted_px") > 0, by_p).when(c("truth_px") > 0, by_r).otherwise(0.0)
    least0 = lambda x: F.greatest(x, F.lit(0)).cast("long")
    known = lambda name, value: rows_now.withColumn(name, F.coalesce(name, value))
    rows_now = rows
    area = c("width") * c("height")
    for name, value in (("tp", F.floor(tp + 0.5).cast("long")), ("fp", least0(c("predicted_px") - c("tp"))), ("fn", least0(c("truth_px") - c("tp"))), ("tn", least0(area - c("tp") - c("fp") - c("fn"))), ("specificity", c("tn") / F.nullif(c("tn") + c("fp"), F.lit(0))), ("accuracy", (c("tp") + c("tn")) / F.nullif(area, F.lit(0)))):
        rows_now = known(name, value)
    return rows_now


#: Pairs up to which the distribution of the rank sum is taken whole.
EXACT = 50


def signed_rank_p(n: int, w: float, z: float | None, ties: int) -> float | None:
    """Two-sided p of the smaller rank sum: exact for up to EXACT pairs without ties, else by the normal approximation."""
    if n <= EXACT and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)  # subsets of 1..n by their sum
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """n, w, rank_biserial, z, p, note of the signed ranks of column delta, zeros left out.

    Ranks are running sums over ranges of the differences' sizes, equal ones a row. Under ten pairs nothing is told but a note.
    """
    d = pairs.where("delta is not null and not isnan(delta)").select(F.col("delta").alias("d")).where("d <> 0")
    sizes = d.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running_sums(sizes, [F.col("size")], {"upto": F.col("n")}).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    sums = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("minus"), F.sum(F.col("n") * (F.col("n") * F.col("n") - 1)).alias("ties"))
    r = sums.first()  # one row
    n, w = r["n"], None if r["plus"] is None else min(r["plus"], r["minus"])
    enough = n >= 10
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - r["ties"] / 48) if enough else 0.0
    z = (w - n * (n + 1) / 4) / spread if spread > 0 else None
    note = None if enough else "no differences" if n == 0 else "too few pairs"
    row = (n, w if enough else None, 1 - 2 * w / (n * (n + 1) / 2) if enough else None, z, signed_rank_p(n, w, z, r["ties"]) if enough else None, note)
    return pairs.sparkSession.createDataFrame([row], "n long, w double, rank_biserial double, z double, p double, note string")
