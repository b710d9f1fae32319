"""Queries of splitting, leakage, job states and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.plans.core import query
from boxwright.sources.views import SQL_DETECTIONS, SQL_IMAGES, detections, images, read
from boxwright.streaming import states
from boxwright.streaming.jobs import latest_status

BOTH = f"WITH {SQL_DETECTIONS}, {SQL_IMAGES}"
#: A split by hash of the source: shares of 70, 20 and 10 %.
_PLACE = "(('0x' || substr(md5(concat('split-1-', source_id)), 1, 7))::BIGINT % 100)"
_SPLIT = f"sp AS (SELECT *, CASE WHEN {_PLACE} < 70 THEN 'train' WHEN {_PLACE} < 90 THEN 'val' ELSE 'test' END AS split FROM img)"


def split_by_source(rows: DataFrame, seed: int = 1) -> DataFrame:
    """Column split; all images of a source fall into one, and no row need know another."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"split-{seed}-"), F.col("source_id")).cast("binary")), 1, 7), 16, 10).cast("long") % 100
    return rows.withColumn("split", F.when(place < 70, "train").when(place < 90, "val").otherwise("test"))


@query("l3_source_split", f"{BOTH}, {_SPLIT} SELECT image_id, split FROM sp")
def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_by_source(images(spark, sf_dir)).select("image_id", "split")


@query("a16_class_counts", f"{BOTH}, {_SPLIT} SELECT split, count(*) FILTER (label = 'crack') AS crack, count(*) FILTER (label = 'mold') AS mold, count(*) FILTER (label = 'spall') AS spall FROM det JOIN sp USING (image_id) GROUP BY split")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = detections(spark, sf_dir).select("image_id", "label").join(split_by_source(images(spark, sf_dir)).select("image_id", "split"), "image_id")
    return j.groupBy("split").pivot("label", ["crack", "mold", "spall"]).count().na.fill(0)


@query("a17_leaking_sources", f"{BOTH}, s AS (SELECT source_id, CASE WHEN image_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM img) SELECT source_id, count(DISTINCT split) AS splits, count(*) AS images FROM s GROUP BY source_id HAVING count(DISTINCT split) > 1")
def leaking_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a split by image, not by source, lets leak."""
    s = images(spark, sf_dir).select("source_id", F.when(F.col("image_id") % 10 < 7, "train").otherwise("test").alias("split"))
    return s.groupBy("source_id").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("images")).where("splits > 1")


@query(
    "l9_leakage",
    f"""WITH c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), n AS (SELECT label, count(*) AS w FROM embeddings GROUP BY label),
s AS (SELECT a.label AS p, b.label AS q, sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS sim FROM c a JOIN c b ON a.i = b.i GROUP BY ALL)
SELECT round(sum(CASE WHEN p % 3 <> q % 3 THEN x.w * y.w * (sim + 1) / 2 ELSE 0 END) / sum(x.w * y.w * (sim + 1) / 2), 6) AS leakage FROM s JOIN n x ON x.label = p JOIN n y ON y.label = q""",
)
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted similarity across splits over all of it; pairs are of clusters (labels), not of vectors."""
    e = read(spark, sf_dir, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    n = e.groupBy("label").agg(F.count("*").alias("w"))
    a, b = c.select(F.col("label").alias("p"), "i", F.col("m").alias("am")), c.select(F.col("label").alias("q"), "i", F.col("m").alias("bm"))
    s = a.join(b, "i").groupBy("p", "q").agg((F.sum(F.col("am") * F.col("bm")) / F.sqrt(F.sum(F.col("am") * F.col("am")) * F.sum(F.col("bm") * F.col("bm")))).alias("sim"))
    j = s.join(n.select(F.col("label").alias("p"), F.col("w").alias("pw")), "p").join(n.select(F.col("label").alias("q"), F.col("w").alias("qw")), "q")
    part = F.col("pw") * F.col("qw") * (F.col("sim") + 1) / 2
    return j.agg(F.round(F.sum(F.when(F.col("p") % 3 != F.col("q") % 3, part).otherwise(0.0)) / F.sum(part), 6).alias("leakage"))


@query("l11_duplicates", "SELECT p_type AS value, min(p_partkey) AS first_id, sum(p_size)::BIGINT AS weight FROM part GROUP BY p_type")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("value")).agg(F.min("p_partkey").alias("first_id"), F.sum("p_size").alias("weight"))


@query("a22_degrees", "SELECT l_partkey AS entity, count(*) AS degree, count(DISTINCT l_suppkey) AS partners FROM lineitem GROUP BY l_partkey")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.count("*").alias("degree"), F.count_distinct("l_suppkey").alias("partners"))


@query("r1_latest_status", "SELECT user_id AS job, event_type AS status, ts, count(*) OVER (PARTITION BY user_id) AS events FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_status(read(spark, sf_dir, "events"))


_JOBS = """e AS (SELECT job, event_id, ts, event, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM (SELECT user_id * 100 + day(ts) % 4 AS job, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE CASE WHEN event_id % 3 = 0 THEN 'cancelled' ELSE 'drained' END END AS event FROM events)),
w AS (SELECT job, n, event_id, ts, event, NULL::VARCHAR AS f, CASE WHEN event = 'queued' THEN 'queued' END AS s, event IN ('queued', 'drained') AS legal FROM e WHERE n = 1
  UNION ALL SELECT e.job, e.n, e.event_id, e.ts, e.event, w.s,
  CASE WHEN e.event = 'queued' AND w.s IS NULL THEN 'queued' WHEN e.event = 'started' AND w.s = 'queued' THEN 'running' WHEN e.event IN ('done', 'failed') AND w.s = 'running' THEN e.event WHEN e.event = 'cancelled' AND w.s IN ('queued', 'running') THEN 'cancelled' ELSE w.s END,
  e.event = 'drained' OR (e.event = 'queued' AND w.s IS NULL) OR coalesce((e.event = 'started' AND w.s = 'queued') OR (e.event IN ('done', 'failed') AND w.s = 'running') OR (e.event = 'cancelled' AND w.s IN ('queued', 'running')), false)
  FROM w JOIN e ON e.job = w.job AND e.n = w.n + 1)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind == "signup", "queued").when(kind == "view", "started").when(kind == "purchase", "done").when(kind == "error", "failed").when(F.col("event_id") % 3 == 0, "cancelled").otherwise("drained")
    return read(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.day("ts") % 4).alias("job"), "event_id", "ts", event.alias("event"))


@query("r1_job_transitions", f"WITH RECURSIVE {_JOBS} SELECT job, event_id, event, f AS from_status, s AS to_status, legal FROM w")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the statuses before and after it, illegal ones told: here by minima, in the SQL one after the other."""
    return states.transitions(job_events(spark, sf_dir)).drop("ts")


@query("r1_retained_jobs", f"""WITH RECURSIVE {_JOBS}, l AS (SELECT job, max_by(s, n) FILTER (legal AND event <> 'drained') AS status, max(n) FILTER (legal AND event <> 'drained') AS m, count(*) AS events, count(*) FILTER (NOT legal) AS illegal, coalesce(max(n) FILTER (event <> 'drained') > max(n) FILTER (event = 'drained'), max(n) FILTER (event <> 'drained') IS NOT NULL) AS undrained FROM w GROUP BY job),
o AS (SELECT l.*, w.ts, w.event_id, CASE WHEN status IN ('done', 'failed', 'cancelled') THEN row_number() OVER (PARTITION BY status IN ('done', 'failed', 'cancelled') ORDER BY w.ts, w.event_id, l.job) END AS place FROM l LEFT JOIN w ON w.job = l.job AND w.n = l.m)
SELECT job, status, events, illegal, undrained FROM o WHERE place IS NULL OR place <= 200 OR undrained""")
def retained_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.retained(states.statuses(states.transitions(job_events(spark, sf_dir)))).select("job", "status", "events", "illegal", "undrained")


@query("s17_latest_run", "SELECT o_custkey AS owner, o_orderkey AS run_id, o_orderdate AS created FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("o_orderdate", "o_orderkey"))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(last.alias("l")).select("owner", F.col("l.o_orderkey").alias("run_id"), F.col("l.o_orderdate").alias("created"))


@query("x_tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.streaming.jobs import hourly

    return hourly(read(spark, sf_dir, "events"))


@query(
    "x_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.session_window("ts", "6 hours")
    return read(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("w11_no_improvement", f"{BOTH}, d AS (SELECT date_trunc('day', created) AS day, max(width + image_id % 97) AS metric FROM img GROUP BY ALL), b AS (SELECT *, CASE WHEN metric > coalesce(max(metric) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS best FROM d), g AS (SELECT *, sum(best) OVER (ORDER BY day) AS k FROM b) SELECT day, row_number() OVER (PARTITION BY k ORDER BY day) - 1 AS waited FROM g")
def no_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since the best one so far; a row for each day."""
    d = images(spark, sf_dir).groupBy(F.date_trunc("day", "created").alias("day")).agg(F.max(F.col("width") + F.col("image_id") % 97).alias("metric"))
    w = Window.orderBy("day")
    b = d.withColumn("best", (F.col("metric") > F.coalesce(F.max("metric").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    return b.withColumn("k", F.sum("best").over(w)).select("day", (F.row_number().over(Window.partitionBy("k").orderBy("day")) - 1).cast("long").alias("waited"))
