"""Queries of evaluation: matching, curves, masks, thresholds, paired statistics, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.operators import evaluate as E
from boxwright.plans.core import query
from boxwright.sources.views import SQL_DETECTIONS, SQL_IMAGES, detections, images

DET = f"WITH {SQL_DETECTIONS}"
BOTH = f"{DET}, {SQL_IMAGES}"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = detections(spark, sf_dir)
    return d.where("detector = 'O'"), d.where("detector = 'F'")


@query("e1_greedy_matches")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.greedy_matches(*sides(spark, sf_dir))


@query("a14_image_counts")
def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = sides(spark, sf_dir)
    return E.image_counts(p, t, E.greedy_matches(p, t), ["image_id"])


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = sides(spark, sf_dir)
    hit = E.greedy_matches(p, t).select(F.col("pred_id").alias("det_id"), F.lit(True).alias("hit"))
    return p.join(hit, "det_id", "left").select("label", "score", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("e2_average_precision")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label, at an IoU of .5."""
    truths = sides(spark, sf_dir)[1].groupBy("label").agg(F.count("*").alias("truths"))
    return E.average_precision(_flagged(spark, sf_dir), truths, ["label"])


@query("e2_mean_average_precision")
def mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label, the mean over IoU thresholds .50 to .95."""
    return E.mean_average_precision(*sides(spark, sf_dir), [round(0.5 + 0.05 * k, 2) for k in range(10)])


_HIT = "CASE WHEN label = 'crack' THEN 1 ELSE 0 END"


@query(
    "w9_precision_envelope",
    f"""{DET}, s AS (SELECT score, count(*) FILTER (label = 'crack') AS tp, count(*) FILTER (label <> 'crack') AS fp FROM det GROUP BY score),
c AS (SELECT score, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(tp) OVER () AS n FROM s WINDOW w AS (ORDER BY score DESC)),
e AS (SELECT score, tp / n AS recall, max(tp / (tp + fp)) OVER (ORDER BY score) AS envelope FROM c)
SELECT score, round(recall, 6) AS recall, round(envelope, 6) AS envelope FROM e""",
)
def precision_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a distinct score: windows are over a hundred rows, however many detections there are."""
    s = detections(spark, sf_dir).groupBy("score").agg(F.count_if(F.col("label") == "crack").alias("tp"), F.count_if(F.col("label") != "crack").alias("fp"))
    down = Window.orderBy(F.desc("score"))
    c = s.select("score", F.sum("tp").over(down).alias("tp"), F.sum("fp").over(down).alias("fp"), F.sum("tp").over(Window.partitionBy()).alias("n"))
    return c.select("score", F.round(F.col("tp") / F.col("n"), 6).alias("recall"), F.round(F.max(F.col("tp") / (F.col("tp") + F.col("fp"))).over(Window.orderBy("score")), 6).alias("envelope"))


THRESHOLDS = [0.1, 0.3, 0.5, 0.7, 0.9]
_COUNTS = f"""c AS (SELECT image_id, t, count(*) FILTER (score >= t AND label = 'crack') AS tp, count(*) FILTER (score >= t AND label <> 'crack') AS fp, count(*) FILTER (score < t AND label = 'crack') AS fn
  FROM det CROSS JOIN (VALUES {", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)}) x(t) GROUP BY image_id, t)"""
_OF = lambda x: f"CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 OR tp + fn = 0 THEN 0.0 ELSE {x} END"
_METRICS = f"m AS (SELECT image_id, t, {_OF('tp / (tp + fp)')} AS precision, {_OF('tp / (tp + fn)')} AS recall, {_OF('2 * tp / (2 * tp + fp + fn)')} AS dice, {_OF('tp / (tp + fp + fn)')} AS iou FROM c)"


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each image at each threshold: one pass, no row for each pair of detection and threshold leaves a task."""
    d = detections(spark, sf_dir).select("image_id", "score", (F.col("label") == "crack").alias("is"), F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("t"))
    over = F.col("score") >= F.col("t")
    c = d.groupBy("image_id", "t").agg(F.count_if(over & F.col("is")).alias("tp"), F.count_if(over & ~F.col("is")).alias("fp"), F.count_if(~over & F.col("is")).alias("fn"))
    return c.withColumns(E.mask_metrics(F.col("tp"), F.col("fp"), F.col("fn")))


@query("e3_mask_metrics", f"{DET}, {_COUNTS}, {_METRICS} SELECT image_id, t, round(precision, 6) AS precision, round(recall, 6) AS recall, round(dice, 6) AS dice, round(iou, 6) AS iou FROM m")
def mask_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(spark, sf_dir).select("image_id", "t", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "dice", "iou")])


_SWEEP = "s AS (SELECT t, avg(dice) AS dice, avg(iou) AS iou FROM m GROUP BY t)"


_SMOOTH = lambda a, b: f"round(({a} + 1e-8) / ({b} + 1e-8), 6)"


@query("e3_smoothed_metrics", f"{DET}, {_COUNTS}, n AS (SELECT c.*, image_id % 400 AS tn FROM c) SELECT image_id, t, {_SMOOTH('2 * tp', '2 * tp + fp + fn')} AS dice, {_SMOOTH('tp', 'tp + fp + fn')} AS iou, {_SMOOTH('tp', 'tp + fp')} AS precision, {_SMOOTH('tp', 'tp + fn')} AS recall, {_SMOOTH('tn', 'tn + fp')} AS specificity, {_SMOOTH('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM n")
def smoothed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = swept(spark, sf_dir).select("image_id", "t", "tp", "fp", "fn", (F.col("image_id") % 400).alias("tn"))
    return rows.select("image_id", "t", *[F.round(v, 6).alias(k) for k, v in E.smoothed_metrics(*map(F.col, ("tp", "fp", "fn", "tn"))).items()])


_PX = f"""m AS (SELECT image_id, count(*) FILTER (detector = 'O') AS predicted_px, count(*) FILTER (detector = 'F') AS truth_px, count(*) FILTER (detector = 'O' AND label = 'crack') AS b, image_id % 3 = 0 AS known FROM det GROUP BY image_id),
r AS (SELECT *, coalesce(b / nullif(predicted_px, 0), 0) AS precision, least(coalesce(b / nullif(truth_px, 0), 0), 1) AS recall FROM m),
f AS (SELECT *, CASE WHEN known THEN b ELSE floor(CASE WHEN predicted_px > 0 AND truth_px > 0 THEN (precision * predicted_px + recall * truth_px) / 2 WHEN predicted_px > 0 THEN precision * predicted_px WHEN truth_px > 0 THEN recall * truth_px ELSE 0 END + 0.5)::BIGINT END AS tp FROM r),
g AS (SELECT *, greatest(predicted_px - tp, 0) AS fp, greatest(truth_px - tp, 0) AS fn FROM f), h AS (SELECT *, greatest(20 - tp - fp - fn, 0) AS tn FROM g)"""


@query("f8_confusion_backfill", f"{DET}, {_PX} SELECT image_id, tp, fp, fn, tn, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp + tn) / 20, 6) AS accuracy FROM h")
def confusion_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a table lacks, from its ratios."""
    d = detections(spark, sf_dir)
    is_o = F.col("detector") == "O"
    m = d.groupBy("image_id").agg(F.count_if(is_o).alias("predicted_px"), F.count_if(~is_o).alias("truth_px"), F.count_if(is_o & (F.col("label") == "crack")).alias("b"))
    over = lambda x: F.coalesce(F.col("b") / F.nullif(F.col(x), F.lit(0)), F.lit(0.0))
    none = {c: F.lit(None).cast(t) for c, t in (("fp", "long"), ("fn", "long"), ("tn", "long"), ("specificity", "double"), ("accuracy", "double"))}
    rows = m.withColumns({"precision": over("predicted_px"), "recall": F.least(over("truth_px"), F.lit(1.0)), "width": F.lit(5), "height": F.lit(4), "tp": F.when(F.col("image_id") % 3 == 0, F.col("b")), **none})
    return E.confusion_filled(rows).select("image_id", "tp", "fp", "fn", "tn", F.round("specificity", 6).alias("specificity"), F.round("accuracy", 6).alias("accuracy"))


@query("e4_threshold_sweep", f"{DET}, {_COUNTS}, {_METRICS}, {_SWEEP} SELECT t, round(dice, 6) AS dice, round(iou, 6) AS iou FROM s")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(spark, sf_dir).groupBy("t").agg(F.round(F.avg("dice"), 6).alias("dice"), F.round(F.avg("iou"), 6).alias("iou"))


@query("a8_best_threshold", f"{DET}, {_COUNTS}, {_METRICS}, {_SWEEP} SELECT t AS best, round(iou, 6) AS iou FROM s ORDER BY s.iou DESC, s.dice DESC, abs(t - 0.5), t LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = swept(spark, sf_dir).groupBy("t").agg(F.avg("dice").alias("dice"), F.avg("iou").alias("iou"))
    best = F.max(F.struct("iou", "dice", (-F.abs(F.col("t") - 0.5)).alias("near"), (-F.col("t")).alias("low"))).alias("b")
    return s.agg(best).select((-F.col("b.low")).alias("best"), F.round("b.iou", 6).alias("iou"))


@query("e5_f_beta", f"{DET}, {_COUNTS} SELECT image_id, t, round(CASE WHEN tp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 0.0 END, 6) AS f2 FROM c")
def f_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(spark, sf_dir).select("image_id", "t", F.round(E.f_beta(F.col("tp"), F.col("fp"), F.col("fn"), 2.0), 6).alias("f2"))


_PAIRED = f"{DET}, p AS (SELECT image_id, sum(round(score * 100)::INT) FILTER (detector = 'O') / count(*) FILTER (detector = 'O') AS a, sum(round(score * 100)::INT) FILTER (detector = 'F') / count(*) FILTER (detector = 'F') AS b FROM det GROUP BY image_id HAVING a IS NOT NULL AND b IS NOT NULL), d AS (SELECT floor((a - b) * 10 + 0.5) / 1000 AS d FROM p)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of whole hundredths, so that every order of summing gives the same."""
    of = lambda x: F.sum(F.when(F.col("detector") == x, F.round(F.col("score") * 100).cast("int"))) / F.count_if(F.col("detector") == x)
    p = detections(spark, sf_dir).groupBy("image_id").agg(of("O").alias("a"), of("F").alias("b"))
    return p.where("a is not null and b is not null").select("image_id", "a", "b", (F.floor((F.col("a") - F.col("b")) * 10 + 0.5) / 1000).alias("delta"))


@query(
    "e8_wilcoxon",
    f"""{_PAIRED}, s AS (SELECT abs(d) AS size, count(*) AS n, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY abs(d)), r AS (SELECT *, sum(n) OVER (ORDER BY size) - (n - 1) / 2 AS rank FROM s),
t AS (SELECT sum(n)::BIGINT AS n, sum(rank * up) AS plus, sum(rank * (n - up)) AS minus, sum(n * (n * n - 1)) AS ties FROM r)
SELECT n, least(plus, minus)::DOUBLE AS w, round(1 - 2 * least(plus, minus) / (n * (n + 1) / 2), 6) AS rank_biserial, round((least(plus, minus) - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 5) AS z FROM t""",
)
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.wilcoxon(paired(spark, sf_dir)).select("n", "w", F.round("rank_biserial", 6).alias("rank_biserial"), F.round("z", 5).alias("z"))


@query("e9_win_counts", f"{_PAIRED} SELECT count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties, round(median(d), 6) AS median_delta FROM d")
def win_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paired(spark, sf_dir).select(F.round("delta", 3).alias("d"))
    return d.agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"), F.round(F.median("d"), 6).alias("median_delta"))


@query("a6_group_stats", f"{DET} SELECT label, detector, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS deviation, round(median(score), 6) AS median FROM det GROUP BY label, detector")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("label", "detector").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("deviation"), F.round(F.median("score"), 6).alias("median"))


@query("a2_label_shares", f"{DET} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM det GROUP BY label")
def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("a15_mean_area", f"{DET}, i AS (SELECT image_id, sum((x2 - x1) * (y2 - y1)) / max(width * height) AS share FROM det GROUP BY image_id) SELECT count(*) AS images, round(avg(share), 6) AS mean_share, round(max(share), 6) AS most FROM i")
def mean_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = detections(spark, sf_dir).groupBy("image_id").agg((F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / F.max(F.col("width") * F.col("height"))).alias("share"))
    return i.agg(F.count("*").alias("images"), F.round(F.avg("share"), 6).alias("mean_share"), F.round(F.max("share"), 6).alias("most"))


@query("a23_terciles", f"{DET}, i AS (SELECT image_id, max(score) AS s, count(*) AS n FROM det GROUP BY image_id), q AS (SELECT quantile_cont(n, 1 / 3.0) AS lo, quantile_cont(n, 2 / 3.0) AS hi FROM i) SELECT CASE WHEN n <= lo THEN 'low' WHEN n <= hi THEN 'middle' ELSE 'high' END AS bucket, count(*) AS images, round(avg(s), 6) AS mean_score FROM i CROSS JOIN q GROUP BY ALL")
def terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = detections(spark, sf_dir).groupBy("image_id").agg(F.max("score").alias("s"), F.count("*").alias("n"))
    q = i.agg(F.percentile("n", 1 / 3).alias("lo"), F.percentile("n", 2 / 3).alias("hi"))  # one row
    bucket = F.when(F.col("n") <= F.col("lo"), "low").when(F.col("n") <= F.col("hi"), "middle").otherwise("high")
    return i.join(F.broadcast(q)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("images"), F.round(F.avg("s"), 6).alias("mean_score"))


@query("a24_pivot_delta", f"{DET} SELECT label, round(avg(score) FILTER (detector = 'O'), 6) AS o, round(avg(score) FILTER (detector = 'F'), 6) AS f, round(avg(score) FILTER (detector = 'O') - avg(score) FILTER (detector = 'F'), 6) AS delta FROM det GROUP BY label")
def pivot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = detections(spark, sf_dir).groupBy("label").pivot("detector", ["O", "F"]).agg(F.avg("score"))
    return p.select("label", F.round("O", 6).alias("o"), F.round("F", 6).alias("f"), F.round(F.col("O") - F.col("F"), 6).alias("delta"))


@query("a27_summary", f"{BOTH} SELECT count(d.det_id) AS findings, count(DISTINCT i.image_id) AS images, round(count(DISTINCT d.image_id) / count(DISTINCT i.image_id), 6) AS affected, round(coalesce(avg(d.score), 0), 6) AS mean_score, round(coalesce(max(least(100.0, 58 * d.score + 320 * (d.x2 - d.x1) * (d.y2 - d.y1) / (i.width * i.height))), 0), 6) AS severity FROM img i LEFT JOIN det d USING (image_id)")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    severity = F.least(F.lit(100.0), 58 * F.col("score") + 320 * (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("width") * F.col("height")))
    per = d.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.max(severity).alias("severity"))
    j = images(spark, sf_dir).select("image_id").join(per, "image_id", "left")
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.count("*").alias("images"), F.round(F.count("n") / F.count("*"), 6).alias("affected"), F.round(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)), 6).alias("mean_score"), F.round(F.coalesce(F.max("severity"), F.lit(0.0)), 6).alias("severity"))
