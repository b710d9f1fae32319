"""Queries of data sets: splits, clusters and their links, reviews, merges, audits, report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.functions.stored import stored
from boxwright.operators import mining as M
from boxwright.operators.backgrounds import free_boxes
from boxwright.operators.numbering import numbered
from boxwright.plans.core import query
from boxwright.plans.decision_queries import _SIG, signals
from boxwright.plans.io_queries import scratch
from boxwright.sources import sinks
from boxwright.sources.views import HEIGHT, SQL_DETECTIONS, SQL_IMAGES, WIDTH, detections, images, read

DET = f"WITH {SQL_DETECTIONS}"
BOTH = f"{DET}, {SQL_IMAGES}"


# Splits

_PLACE = "((('0x' || substr(md5('split-' || unit), 1, 7))::BIGINT * (((trial * 40503 + 12345) % 134217728) * 2 + 1)) % 268435456) * 1000 >> 28"


def _balanced_sql(units: str, counts: dict[str, float], trials: int) -> str:
    wanted = {"train": 0.7, "val": 0.2, "test": 1 - (0.7 + 0.2)}
    cost = " + ".join(f"{w} * (coalesce(sum(CASE WHEN split = '{s}' THEN {c} ELSE 0 END) / nullif(sum({c}), 0), 0) - {share}) ** 2" for c, w in counts.items() for s, share in wanted.items())
    return f"""{BOTH}, u AS ({units}), t AS (SELECT *, {_PLACE} AS p FROM u, range({trials}) r(trial)), s AS (SELECT *, CASE WHEN p < 700 THEN 'train' WHEN p < 900 THEN 'val' ELSE 'test' END AS split FROM t),
b AS (SELECT trial, round({cost}, 9) AS cost FROM s GROUP BY trial ORDER BY cost, trial LIMIT 1) SELECT unit, split FROM s JOIN b USING (trial)"""


_LABELS = ["crack", "mold", "spall"]
_COUNT_SQL = ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in _LABELS)


@query("l2_balanced_images", _balanced_sql(f"SELECT image_id AS unit, 1 AS images, count(*) AS boxes, {_COUNT_SQL} FROM det GROUP BY image_id", {"images": 20, "boxes": 10, "crack": 2, "mold": 2, "spall": 2}, 1200))
def balanced_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most even of 1200 splits by image, by images, boxes and labels."""
    d = detections(spark, sf_dir)
    units = d.groupBy(F.col("image_id").alias("unit")).agg(F.lit(1).alias("images"), F.count("*").alias("boxes"), *[F.count_if(F.col("label") == x).alias(x) for x in _LABELS])
    return M.balanced_split(units, {"images": 20, "boxes": 10, "crack": 2, "mold": 2, "spall": 2}, 1200)


@query("l3_balanced_sources", _balanced_sql(f"SELECT source_id AS unit, 1 AS sources, count(DISTINCT image_id) AS images, count(*) AS boxes, {_COUNT_SQL} FROM det JOIN img USING (image_id) GROUP BY source_id", {"images": 8, "boxes": 8, "sources": 1.5, "crack": 2, "mold": 2, "spall": 2}, 5000))
def balanced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most even of 5000 splits by source."""
    d = detections(spark, sf_dir).join(images(spark, sf_dir).select("image_id", "source_id"), "image_id")
    return M.source_split(d.select(F.col("image_id").alias("image"), F.col("source_id").alias("source"), "label"), _LABELS)


def _hashed(seed: str, key: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), key).cast("binary"))


@query("m9_share_split", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('m9-' || o_orderkey), o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN k < floor(0.7::DOUBLE * n) THEN 'train' WHEN k < floor((0.7::DOUBLE + 0.2::DOUBLE) * n) THEN 'val' ELSE 'test' END AS split FROM o")
def share_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact shares of a shuffled table: numbers in the order of a hash, whole boundaries, the last part takes the rest."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", _hashed("m9", "o_orderkey").alias("h"))
    n = o.count()
    placed = numbered(o, [F.col("h"), F.col("o_orderkey")], "k")
    return placed.select("o_orderkey", F.when(F.col("k") <= int(0.7 * n), "train").when(F.col("k") <= int((0.7 + 0.2) * n), "val").otherwise("test").alias("split"))


_SIDE = lambda name, key: f"CASE WHEN ('0x' || substr(md5('{name}-' || {key}), 1, 7))::BIGINT % 10 < 7 THEN 'train' ELSE 'test' END"


@query("l10_interaction_split", f"SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN {_SIDE('e', 'l_partkey')} = {_SIDE('f', 'l_suppkey')} THEN {_SIDE('e', 'l_partkey')} ELSE 'not selected' END AS split FROM lineitem")
def interaction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interaction belongs to a split only if both of its ends do."""
    side = lambda name, key: F.when(F.conv(F.substring(_hashed(name, key), 1, 7), 16, 10).cast("long") % 10 < 7, "train").otherwise("test")
    pairs = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    e, f = side("e", "l_partkey"), side("f", "l_suppkey")
    return pairs.select("l_partkey", "l_suppkey", F.when(e == f, e).otherwise("not selected").alias("split"))


# Clusters and their links


@query("a18_symmetric_matrix", "WITH p AS (SELECT c_nationkey % 5 AS q, c_custkey % 5 AS t, c_acctbal::DOUBLE AS v FROM customer WHERE c_nationkey % 5 <> 4), b AS (SELECT q, t, v FROM p UNION ALL SELECT t, q, v FROM p), m AS (SELECT q, t, avg(v) AS v FROM b GROUP BY ALL) SELECT q, round(coalesce(max(v) FILTER (t = 0), 0), 4) AS c0, round(coalesce(max(v) FILTER (t = 1), 0), 4) AS c1, round(coalesce(max(v) FILTER (t = 2), 0), 4) AS c2, round(coalesce(max(v) FILTER (t = 3), 0), 4) AS c3, round(coalesce(max(v) FILTER (t = 4), 0), 4) AS c4 FROM m GROUP BY q")
def symmetric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a pair in both directions as a matrix, absent pairs zero."""
    c = read(spark, sf_dir, "customer").where("c_nationkey % 5 <> 4")
    p = c.select((F.col("c_nationkey") % 5).alias("q"), (F.col("c_custkey") % 5).alias("t"), F.col("c_acctbal").cast("double").alias("v"))
    both = p.unionByName(p.select(F.col("t").alias("q"), F.col("q").alias("t"), "v"))
    m = both.groupBy("q").pivot("t", list(range(5))).agg(F.avg("v")).na.fill(0)
    return m.select("q", *[F.round(F.col(str(k)), 4).alias(f"c{k}") for k in range(5)])


@query("a19_cluster_weights", "SELECT p_size % 7 AS cluster, count(*) AS members, round(sum(p_retailprice)::DOUBLE, 2) AS weight, [sum(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT, sum(CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END)::BIGINT, sum(CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END)::BIGINT]::VARCHAR AS strata FROM part GROUP BY cluster")
def cluster_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and strata (a vector) summed over a cluster's members."""
    p = read(spark, sf_dir, "part")
    strata = F.array(*[F.sum(F.when(F.col("p_partkey") % 3 == k, 1).otherwise(0)) for k in range(3)])
    g = p.groupBy((F.col("p_size") % 7).alias("cluster")).agg(F.count("*").alias("members"), F.round(F.sum("p_retailprice").cast("double"), 2).alias("weight"), strata.alias("s"))
    return g.select("cluster", "members", "weight", F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]")).alias("strata"))


@query("a20_cluster_linkage", "SELECT l_partkey % 10 AS ca, l_suppkey % 10 AS cb, round(avg(l_discount::DOUBLE), 6) AS mean, min(l_discount::DOUBLE) AS least, max(l_discount::DOUBLE) AS most FROM lineitem GROUP BY ALL")
def cluster_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average, single and complete linkage over member pairs."""
    d = F.col("l_discount").cast("double")
    return read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 10).alias("ca"), (F.col("l_suppkey") % 10).alias("cb")).agg(F.round(F.avg(d), 6).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"))


@query("a21_cluster_interactions", "SELECT p_size % 7 AS ce, s_nationkey AS cf, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def cluster_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions counted by entity pair first, so the joins see each pair once."""
    pairs = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    e = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 7).alias("ce"))
    f = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("cf"))
    return pairs.join(e, "l_partkey").join(f, "l_suppkey").groupBy("ce", "cf").agg(F.sum("n").alias("n"))


# Report tables


@query("a25_radar", f"{DET}, m AS (SELECT label, avg(score) AS s, 1 / greatest(avg((x2 - x1) * (y2 - y1)) / 1e4, 0.01) AS a FROM det GROUP BY label) SELECT label, round(s / max(s) OVER (), 6) AS score, round(a / max(a) OVER (), 6) AS smallness FROM m")
def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each axis over its largest value; axes where less is better are inverted first."""
    m = detections(spark, sf_dir).groupBy("label").agg(F.avg("score").alias("s"), (1 / F.greatest(F.avg(F.expr("(x2 - x1) * (y2 - y1)")) / 1e4, F.lit(0.01))).alias("a"))
    top = m.agg(F.max("s").alias("ts"), F.max("a").alias("ta"))
    return m.crossJoin(F.broadcast(top)).select("label", F.round(F.col("s") / F.col("ts"), 6).alias("score"), F.round(F.col("a") / F.col("ta"), 6).alias("smallness"))  # one row


@query("a26_version_deltas", f"{DET}, m AS (SELECT label, detector, avg(score) AS mean, max(x2) AS most FROM det GROUP BY ALL), u AS (SELECT label, detector, metric, v FROM m UNPIVOT (v FOR metric IN (mean, most))) SELECT a.label, a.metric, round(b.v - a.v, 6) AS delta, round(100 * (b.v - a.v) / nullif(a.v, 0), 4) AS percent FROM u a JOIN u b ON a.label = b.label AND a.metric = b.metric AND a.detector = 'O' AND b.detector = 'F'")
def version_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = detections(spark, sf_dir).groupBy("label", "detector").agg(F.avg("score").alias("mean"), F.max("x2").alias("most"))
    u = m.unpivot(["label", "detector"], ["mean", "most"], "metric", "v")
    p = u.groupBy("label", "metric").pivot("detector", ["O", "F"]).agg(F.first("v"))
    return p.select("label", "metric", F.round(F.col("F") - F.col("O"), 6).alias("delta"), F.round(100 * (F.col("F") - F.col("O")) / F.nullif(F.col("O"), F.lit(0.0)), 4).alias("percent"))


@query("a28_class_scores", f"{DET}, e AS (SELECT image_id, label, prompt_key, max(score) AS s FROM det GROUP BY ALL), p AS (SELECT *, exp(s * 10) / sum(exp(s * 10)) OVER (PARTITION BY image_id) AS p FROM e), c AS (SELECT image_id, label, round(sum(p), 6) AS score FROM p GROUP BY ALL) SELECT image_id, label, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label) AS place FROM c")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over an image's prompts, summed by class and ranked."""
    e = detections(spark, sf_dir).groupBy("image_id", "label", "prompt_key").agg(F.exp(F.max("score") * 10).alias("e"))
    whole = Window.partitionBy("image_id")
    c = e.withColumn("p", F.col("e") / F.sum("e").over(whole)).groupBy("image_id", "label").agg(F.round(F.sum("p"), 6).alias("score"))
    return c.withColumn("place", F.row_number().over(whole.orderBy(F.desc("score"), "label")).cast("long"))


# Reviews, merges, audits


def review_rows(edits: DataFrame, *more: str) -> DataFrame:
    """place, result_id, action, label, decision (and more of the edits' columns) of the valid edits: manual_reject gives reject, others need a label. edits: place, result_id (text), action, new_label."""
    number = F.col("result_id").try_cast("long")
    action = F.trim("action")
    label = F.when(action == "manual_reject", "reject").otherwise(F.lower(F.trim("new_label")))
    rows = edits.select("place", number.alias("result_id"), action.alias("action"), label.alias("label"), *more)
    decision = F.when(F.col("action") == "manual_reject", "reject").otherwise("manual_accept")
    return rows.where("result_id is not null and label <> ''").where(F.col("action").isin("manual_accept", "manual_relabel", "manual_reject")).withColumn("decision", decision)


def reviewed(cleaned: DataFrame, edits: DataFrame) -> DataFrame:
    """The cleaned labels with the last valid edit of each result applied; edits of other results change nothing."""
    last = review_rows(edits).groupBy("result_id").agg(F.max_by(F.struct("label", "decision"), "place").alias("l")).select("result_id", "l.label", "l.decision")
    return sinks.updated(cleaned, last, ["result_id"])


def review_session(edits: DataFrame, session_id: str, run_id: str, reviewer: str, at: str, notes: str = "") -> tuple[DataFrame, DataFrame]:
    """The rows of a committed session and of its decisions (stored); both are empty if no edit is valid. edits: as for review_rows(), and previous_label, note."""
    valid = review_rows(edits.where("place is not null").dropDuplicates(["place"]), "previous_label", "note")
    id_text = F.col("result_id").cast("string")
    text = lambda c: F.coalesce(c, F.lit(""))
    decisions = valid.select(F.lit(session_id).alias("review_session_id"), "place", F.lit("result").alias("target_type"), id_text.alias("target_id"), "result_id", "action", text("previous_label").alias("previous_label"), F.col("label").alias("new_label"), F.col("decision").alias("new_decision_type"), F.lit('["human_correction"]').alias("reason_codes_json"), F.concat(F.lit("["), id_text, F.lit("]")).alias("affected_result_ids_json"), text("note").alias("note"), F.lit(at).alias("created_at_utc"), F.lit(run_id).alias("run_id"))
    decisions = stored(decisions, "decisions")
    sessions = decisions.limit(1).select("review_session_id", "run_id", F.lit(reviewer).alias("reviewer"), F.lit("committed").alias("status"), F.lit(at).alias("created_at_utc"), F.lit(at).alias("committed_at_utc"), F.lit(notes).alias("notes"))
    return sessions, decisions


def commit_review(store: sinks.RunStore, cleaned: DataFrame, edits: DataFrame, session_id: str, run_id: str, reviewer: str, at: str, notes: str = "") -> bool:
    """Writes the changed labels, the session and its decisions as one change of the store, beside the run's other sessions; a session written again takes its own place.

    False, and nothing written, if no edit is valid. cleaned: run_id, result_id, label, decision of that run.
    """
    sessions, decisions = review_session(edits, session_id, run_id, reviewer, at, notes)
    if sessions.isEmpty():
        return False
    known = store.manifest(edits.sparkSession)

    def beside(name: str, new: DataFrame) -> DataFrame:
        if name not in known:
            return new
        old = store.read(edits.sparkSession, name).where((F.col("run_id") == run_id) & (F.col("review_session_id") != session_id))
        return old.unionByName(new)

    store.replace({"cleaned_labels": reviewed(cleaned, edits), "review_sessions": beside("review_sessions", sessions), "review_decisions": beside("review_decisions", decisions)})
    return True


_EDITS = """e AS (SELECT result_id AS place, CASE WHEN result_id % 10 = 7 THEN 'x' ELSE result_id::VARCHAR END AS id, CASE result_id % 4 WHEN 0 THEN 'manual_reject' WHEN 1 THEN 'manual_relabel' WHEN 2 THEN 'other' ELSE ' manual_accept ' END AS action, CASE result_id % 5 WHEN 0 THEN '' ELSE ' MOLD' END AS new_label, label AS previous FROM sig WHERE result_id % 3 = 0),
v AS (SELECT TRY_CAST(id AS BIGINT) AS result_id, trim(action) AS action, CASE WHEN trim(action) = 'manual_reject' THEN 'reject' ELSE lower(trim(new_label)) END AS new_label, previous FROM e)"""


@query("d15_review_session", f"""{_SIG}, {_EDITS}, w AS (SELECT * FROM v WHERE result_id IS NOT NULL AND new_label <> '' AND action <> 'other')
SELECT 'r1-review' AS review_session_id, 'committed' AS status, result_id, action, previous AS previous_label, new_label, CASE WHEN action = 'manual_reject' THEN 'reject' ELSE 'manual_accept' END AS new_decision_type, '[' || result_id || ']' AS affected_result_ids_json FROM w""")
def review_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session, its decisions and the changed labels, written as one change and read back. All are made of one table of results and labels."""
    s = stored(signals(spark, sf_dir).select("result_id", "label"), "labels")
    k = F.col("result_id")
    action = F.when(k % 4 == 0, "manual_reject").when(k % 4 == 1, "manual_relabel").when(k % 4 == 2, "other").otherwise(" manual_accept ")
    edits = s.where("result_id % 3 = 0").select(k.alias("place"), F.when(k % 10 == 7, "x").otherwise(k.cast("string")).alias("result_id"), action.alias("action"), F.when(k % 5 == 0, "").otherwise(" MOLD").alias("new_label"), F.col("label").alias("previous_label"), F.lit(None).cast("string").alias("note"))
    store = sinks.RunStore(scratch(spark, "reviews"))
    cleaned = s.select(F.lit("r1").alias("run_id"), "result_id", "label", F.lit("auto_accept").alias("decision"))
    commit_review(store, cleaned, edits, "r1-review", "r1", "me", "2026-01-01T00:00:00Z")
    d = store.read(spark, "review_decisions").join(store.read(spark, "review_sessions").select("review_session_id", "status"), "review_session_id")
    return d.select("review_session_id", "status", "result_id", "action", "previous_label", "new_label", "new_decision_type", "affected_result_ids_json")


@query("d15_review_apply", f"""{_SIG}, e AS (SELECT result_id AS place, CASE WHEN result_id % 10 = 7 THEN 'x' ELSE result_id::VARCHAR END AS id, CASE result_id % 4 WHEN 0 THEN 'manual_reject' WHEN 1 THEN 'manual_relabel' WHEN 2 THEN 'other' ELSE ' manual_accept ' END AS action, CASE result_id % 5 WHEN 0 THEN '' ELSE ' MOLD' END AS new_label FROM sig WHERE result_id % 3 = 0 UNION ALL SELECT result_id + 1000000000, result_id::VARCHAR, 'manual_relabel', 'crack' FROM sig WHERE result_id % 6 = 0 UNION ALL SELECT 5, '-1', 'manual_reject', ''),
v AS (SELECT place, TRY_CAST(id AS BIGINT) AS result_id, trim(action) AS action, CASE WHEN trim(action) = 'manual_reject' THEN 'reject' ELSE lower(trim(new_label)) END AS label FROM e),
l AS (SELECT * FROM v WHERE result_id IS NOT NULL AND label <> '' AND action <> 'other' QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY place DESC) = 1)
SELECT s.result_id, coalesce(l.label, s.label) AS label, CASE WHEN l.result_id IS NULL THEN 'auto_accept' WHEN l.action = 'manual_reject' THEN 'reject' ELSE 'manual_accept' END AS decision FROM sig s LEFT JOIN l USING (result_id)""")
def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).select("result_id", "label")
    k = F.col("result_id")
    text = F.when(k % 10 == 7, "x").otherwise(k.cast("string"))
    action = F.when(k % 4 == 0, "manual_reject").when(k % 4 == 1, "manual_relabel").when(k % 4 == 2, "other").otherwise(" manual_accept ")
    first = s.where("result_id % 3 = 0").select(k.alias("place"), text.alias("result_id"), action.alias("action"), F.when(k % 5 == 0, "").otherwise(" MOLD").alias("new_label"))
    second = s.where("result_id % 6 = 0").select((k + 1000000000).alias("place"), k.cast("string").alias("result_id"), F.lit("manual_relabel").alias("action"), F.lit("crack").alias("new_label"))
    unknown = spark.createDataFrame([(5, "-1", "manual_reject", "")], "place long, result_id string, action string, new_label string")
    return reviewed(s.withColumn("decision", F.lit("auto_accept")), first.unionByName(second).unionByName(unknown))


@query("m8_merge_promotes", f"{_SIG}, o AS (SELECT result_id, label, 'auto_accept' AS decision, '' AS reasons FROM sig WHERE result_id % 3 = 0), p AS (SELECT result_id, clip_label AS label, 'probe_relabel' AS decision, printf('probe_relabel,probe_prob_%.2f', clip_score) AS reasons FROM sig WHERE clip_score >= 0.9) SELECT * FROM o UNION ALL SELECT * FROM p WHERE result_id NOT IN (SELECT result_id FROM o)")
def merge_promotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original rows verbatim; promoted ones only for new ids."""
    s = signals(spark, sf_dir)
    o = s.where("result_id % 3 = 0").select("result_id", "label", F.lit("auto_accept").alias("decision"), F.lit("").alias("reasons"))
    p = s.where("clip_score >= 0.9").select("result_id", F.col("clip_label").alias("label"), F.lit("probe_relabel").alias("decision"), F.format_string("probe_relabel,probe_prob_%.2f", "clip_score").alias("reasons"))
    return sinks.upserted(o, p, ["result_id"], ignore=True)


@query("m2_nested_children", f"{BOTH} SELECT i.image_id, count(*) AS children, string_agg(d.det_id, ',' ORDER BY d.det_id) AS boxes FROM img i JOIN det d USING (image_id) WHERE d.score >= 0.5 GROUP BY i.image_id")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children as a sorted array under their parent; parents without one go."""
    kids = detections(spark, sf_dir).where("score >= 0.5").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("det_id", "label", "score"))).alias("boxes"))
    j = images(spark, sf_dir).select("image_id").join(kids, "image_id")
    return j.select("image_id", F.size("boxes").cast("long").alias("children"), F.array_join(F.transform("boxes", lambda b: b["det_id"].cast("string")), ",").alias("boxes"))


@query("m3_two_counts", f"{BOTH} SELECT i.image_id, (SELECT count(*) FROM det d WHERE d.image_id = i.image_id AND d.score >= 0.8) AS strong, (SELECT count(*) FROM det d WHERE d.image_id = i.image_id AND d.score < 0.1) AS weak FROM img i")
def two_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    of = lambda where, name: d.where(where).groupBy("image_id").agg(F.count("*").alias(name))
    return images(spark, sf_dir).select("image_id").join(of("score >= 0.8", "strong"), "image_id", "left").join(of("score < 0.1", "weak"), "image_id", "left").na.fill(0)


@query("m10_subset_pairs", f"{BOTH}, m AS (SELECT replace(rel_path, 'scan_', 'mask_') AS mask FROM img WHERE image_id % 4 <> 0) SELECT i.rel_path AS image, m.mask FROM img i JOIN m ON m.mask = replace(i.rel_path, 'scan_', 'mask_') WHERE contains(i.rel_path, '_3/')")
def subset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose name holds a token, with their masks."""
    i = images(spark, sf_dir).select("image_id", F.col("rel_path").alias("image"), F.replace("rel_path", F.lit("scan_"), F.lit("mask_")).alias("mask"))
    masks = i.where("image_id % 4 <> 0").select("mask")
    return i.where(F.col("image").contains("_3/")).join(masks, "mask").select("image", "mask")


@query("m11_roi_table", f"{DET}, r AS (SELECT det_id, image_id, x1, x2 FROM det WHERE det_id % 3 <> 2) SELECT image_id, count(*) AS rois, sum(CASE WHEN det_id % 3 = 1 THEN x1 + 1 ELSE x1 END) AS left_sum FROM r GROUP BY image_id")
def roi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions inserted, some updated, some deleted; then listed by image."""
    d = detections(spark, sf_dir).select("det_id", "image_id", "x1", "x2")
    t = sinks.upserted(d.where("det_id % 3 = 0"), d.where("det_id % 3 <> 0"), ["det_id"])
    t = sinks.updated(t, d.where("det_id % 3 = 1").select("det_id", (F.col("x1") + 1).alias("x1")), ["det_id"])
    t = t.join(d.where("det_id % 3 = 2").select("det_id"), "det_id", "left_anti")
    return t.groupBy("image_id").agg(F.count("*").alias("rois"), F.sum("x1").alias("left_sum"))


def audit(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """name, there, missing (columns), rows of each required table: one aggregation for each."""
    spark = next(iter(tables.values())).sparkSession
    out = []
    for name, columns in sorted(required.items()):
        if name not in tables:
            out.append(spark.createDataFrame([(name, False, ",".join(columns), None)], "name string, there boolean, missing string, rows long"))
        else:
            missing = ",".join(c for c in columns if c not in tables[name].columns)
            out.append(tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(True).alias("there"), F.lit(missing).alias("missing"), "rows"))
    return reduce(DataFrame.unionByName, out)


@query("q1_schema_audit", "SELECT 'customer' AS name, true AS there, 'c_colour' AS missing, count(*) AS rows FROM customer UNION ALL SELECT 'nation', true, '', count(*) FROM nation UNION ALL SELECT 'runs', false, 'run_id', NULL")
def schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit({t: read(spark, sf_dir, t) for t in ("customer", "nation")}, {"customer": ["c_custkey", "c_colour"], "nation": ["n_name"], "runs": ["run_id"]})


@query("q2_step_status", f"{BOTH}, c AS (SELECT 1 AS step, 'detect' AS name, count(*) AS n, NULL AS depends_on FROM det UNION ALL SELECT 2, 'filter', count(*) FILTER (score >= 0.5), 'detect' FROM det UNION ALL SELECT 3, 'review', count(*) FILTER (status = 'X'), 'filter' FROM img) SELECT c.name, c.n, CASE WHEN c.n > 0 THEN 'done' WHEN p.n > 0 OR c.depends_on IS NULL THEN 'ready' ELSE 'blocked' END AS state FROM c LEFT JOIN c p ON p.name = c.depends_on")
def step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each step left; a step without rows is ready if the one it depends on has some."""
    d, i = detections(spark, sf_dir), images(spark, sf_dir)
    step = lambda df, name, n, after: df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n", F.lit(after).cast("string").alias("depends_on"))
    c = step(d, "detect", F.count("*"), None).unionByName(step(d, "filter", F.count_if(F.col("score") >= 0.5), "detect")).unionByName(step(i, "review", F.count_if(F.col("status") == "X"), "filter"))
    p = c.select(F.col("name").alias("depends_on"), F.col("n").alias("before"))
    return c.join(p, "depends_on", "left").select("name", "n", F.when(F.col("n") > 0, "done").when((F.col("before") > 0) | F.col("depends_on").isNull(), "ready").otherwise("blocked").alias("state"))


@query("r7_epoch_metrics", "WITH e AS (SELECT user_id % 5 AS run, (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS epoch, avg(value) AS loss FROM events GROUP BY ALL) SELECT run, epoch, round(loss, 6) AS loss, round(min(loss) OVER (PARTITION BY run ORDER BY epoch), 6) AS best FROM e")
def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics appended by epoch, with the best so far of each run."""
    e = read(spark, sf_dir, "events")
    seconds = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    m = e.groupBy((F.col("user_id") % 5).alias("run"), F.floor(seconds / 3600).alias("epoch")).agg(F.avg("value").alias("loss"))
    return m.select("run", "epoch", F.round("loss", 6).alias("loss"), F.round(F.min("loss").over(Window.partitionBy("run").orderBy("epoch")), 6).alias("best"))


@query("m4_background_boxes", f"""{BOTH}, c AS (SELECT image_id, s.w, s.h, x, y, x * 1000 + y + s.w AS k FROM img, (VALUES (64, 64), (48, 32)) s(w, h), range(0, 277, 24) a(x), range(0, 229, 24) b(y) WHERE x + s.w <= 340 AND y + s.h <= 260),
f AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.image_id = c.image_id AND greatest(0, least(c.x + c.w, d.x2) - greatest(c.x, d.x1)) * greatest(0, least(c.y + c.h, d.y2) - greatest(c.y, d.y1)) > 0.02 * c.w * c.h))
SELECT image_id, w, h, x, y FROM f QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5(image_id || '-' || k), k) = 1""")
def background_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a typical size that overlaps no detection by over 2 % of itself: candidates on a grid, the first in the order of a hash."""
    return free_boxes(images(spark, sf_dir), detections(spark, sf_dir), [(64, 64), (48, 32)], range(0, 277, 24), range(0, 229, 24), WIDTH, HEIGHT, 0.02, lambda w, h, x, y: x * 1000 + y + w)
