"""Queries of the relational layer: joins, windows, pages, sets, and the exports' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.functions import labels as L
from boxwright.plans.core import query
from boxwright.sources.views import SQL_DETECTIONS, SQL_IMAGES, detections, images, read

BOTH = f"WITH {SQL_DETECTIONS}, {SQL_IMAGES}"


@query("j1_star_join", f"{BOTH} SELECT c.c_mktsegment AS segment, i.status, count(*) AS n, round(avg(d.score), 6) AS mean_score FROM det d JOIN img i USING (image_id) JOIN customer c ON c.c_custkey = i.source_id GROUP BY ALL")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark picks the joins: a small side is broadcast behind its own size threshold."""
    j = detections(spark, sf_dir).select("image_id", "score").join(images(spark, sf_dir), "image_id").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("source_id"))
    return j.groupBy(F.col("c_mktsegment").alias("segment"), "status").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("j4_computed_key", f"{BOTH}, k AS (SELECT concat(image_id, '_v1') AS key, count(*) AS boxes FROM det GROUP BY image_id) SELECT i.image_id, coalesce(k.boxes, 0) AS boxes FROM img i LEFT JOIN k ON k.key = concat(i.image_id, '_v1')")
def computed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = detections(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("boxes")).select(F.concat("image_id", F.lit("_v1")).alias("key"), "boxes")
    return images(spark, sf_dir).withColumn("key", F.concat("image_id", F.lit("_v1"))).join(k, "key", "left").select("image_id", F.coalesce("boxes", F.lit(0)).alias("boxes"))


@query("j6_restricted_left", f"{BOTH} SELECT d.det_id, i.status FROM det d LEFT JOIN img i ON i.image_id = d.image_id AND i.source_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def restricted_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right side is restricted by a semi join before the left join."""
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("source_id"))
    right = images(spark, sf_dir).join(rich, "source_id", "left_semi").select("image_id", "status")
    return detections(spark, sf_dir).select("image_id", "det_id").join(right, "image_id", "left").select("det_id", "status")


@query("j8_counts", f"{BOTH} SELECT i.image_id, (SELECT count(*) FROM det d WHERE d.image_id = i.image_id) AS boxes, (SELECT count(*) FROM det d WHERE d.image_id = i.image_id AND d.label = 'crack') AS cracks FROM img i")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated counts as one aggregation and a left join."""
    per = detections(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("boxes"), F.count_if(F.col("label") == "crack").alias("cracks"))
    return images(spark, sf_dir).select("image_id").join(per, "image_id", "left").na.fill(0)


@query("j10_semi", f"{BOTH} SELECT image_id, status FROM img WHERE image_id IN (SELECT image_id FROM det WHERE score >= 0.9)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("image_id", "status").join(detections(spark, sf_dir).where("score >= 0.9").select("image_id"), "image_id", "left_semi")


@query("j12_anti", f"{BOTH} SELECT image_id FROM img WHERE image_id NOT IN (SELECT image_id FROM det)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to process when a job resumes."""
    return images(spark, sf_dir).select("image_id").join(detections(spark, sf_dir).select("image_id"), "image_id", "left_anti")


@query("j19_fuzzy_names", "WITH s AS (SELECT s_suppkey, lower(s_name) AS stem FROM supplier), c AS (SELECT c_custkey, lower(replace(c_name, 'Customer', 'Supplier')) AS stem FROM customer), h AS (SELECT s.s_suppkey, c.c_custkey, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY c.c_custkey) AS n FROM s JOIN c ON c.stem IN (s.stem, 'mask_' || s.stem, s.stem || '_mask')) SELECT s_suppkey, c_custkey FROM h WHERE n = 1")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem, prefix + stem or stem + suffix: derived keys and an equi-join, the first match of each."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.lower("s_name").alias("stem"))
    keys = s.select("s_suppkey", F.explode(F.array("stem", F.concat(F.lit("mask_"), "stem"), F.concat("stem", F.lit("_mask")))).alias("stem"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.lower(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("stem"))
    return keys.join(c, "stem").groupBy("s_suppkey").agg(F.min("c_custkey").alias("c_custkey"))


@query("w1_top_per_group", f"{BOTH} SELECT det_id, label, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY label, image_id ORDER BY score DESC, det_id) AS n FROM det) WHERE n <= 2")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("label", "image_id").orderBy(F.desc("score"), "det_id"))
    return detections(spark, sf_dir).withColumn("n", n).where("n <= 2").select("det_id", "label", "n")


@query("w5_representative", f"{BOTH} SELECT image_id, arg_max(det_id, score * 1e12 - det_id % 1000) AS det_id, count(*) AS size FROM det GROUP BY image_id")
def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best box of each image, the first of equals: a combinable maximum instead of a window."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "det_id"))
    return detections(spark, sf_dir).groupBy("image_id").agg(best.alias("b"), F.count("*").alias("size")).select("image_id", F.col("b.det_id").alias("det_id"), "size")


@query("t2_page", f"{BOTH} SELECT det_id, score FROM det ORDER BY score DESC, det_id LIMIT 50 OFFSET 100")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("det_id", "score").orderBy(F.desc("score"), "det_id").offset(100).limit(50)


@query("t3_page_of_groups", f"{BOTH}, g AS (SELECT image_id, count(*) AS n FROM det GROUP BY image_id ORDER BY n DESC, image_id LIMIT 20) SELECT d.det_id, d.image_id FROM det d SEMI JOIN g USING (image_id)")
def page_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    g = d.groupBy("image_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "image_id").limit(20).select("image_id")
    return d.select("det_id", "image_id").join(g, "image_id", "left_semi").select("det_id", "image_id")


@query("u1_union_of_queues", f"{BOTH} SELECT det_id, 'damage' AS queue FROM det WHERE score >= 0.8 UNION ALL SELECT det_id, 'reject' FROM det WHERE score < 0.1")
def union_of_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    one = lambda where, queue: d.where(where).select("det_id", F.lit(queue).alias("queue"))
    return one("score >= 0.8", "damage").unionByName(one("score < 0.1", "reject"))


@query("u2_first_spelling", "SELECT lower(event_type) AS key, arg_min(event_type, event_id) AS first_spelling, min(event_id) AS place FROM events GROUP BY lower(event_type)")
def first_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.lower("event_type").alias("key")).agg(F.min_by("event_type", "event_id").alias("first_spelling"), F.min("event_id").alias("place"))


@query("f1_labels", r"SELECT p_partkey, trim(regexp_replace(lower(translate(p_type, '_-', '  ')), '\s+', ' ', 'g')) AS canonical, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", L.canonical(F.col("p_type")).alias("canonical"), L.slug(F.col("p_name")).alias("slug"))


# Exports: rows of the files; writing is df.write.

_INDEX = "CASE label WHEN 'crack' THEN 0 WHEN 'mold' THEN 1 ELSE 2 END"


@query("k8_yolo_labels", f"{BOTH} SELECT image_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', {_INDEX}, (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height), chr(10) ORDER BY det_id) AS content FROM det GROUP BY image_id")
def yolo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file's text for each image: class index and centre form, in order of id."""
    index = F.when(F.col("label") == "crack", 0).when(F.col("label") == "mold", 1).otherwise(2)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", index, F.expr("(x1 + x2) / 2 / width"), F.expr("(y1 + y2) / 2 / height"), F.expr("(x2 - x1) / width"), F.expr("(y2 - y1) / height"))
    lines = F.array_sort(F.collect_list(F.struct("det_id", line.alias("line"))))
    return detections(spark, sf_dir).groupBy("image_id").agg(lines.alias("l")).select("image_id", F.array_join("l.line", "\n").alias("content"))
