"""Queries of the sources and sinks: formats are written into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.functions.stored import application_dir, stored
from boxwright.operators.numbering import numbered, numbered_within, running_sums
from boxwright.plans.core import query
from boxwright.sources import formats, sinks
from boxwright.sources.views import SQL_DETECTIONS, SQL_IMAGES, detections, images, read
from boxwright.streaming.sinks import BufferedSink

DET = f"WITH {SQL_DETECTIONS}"
BOTH = f"{DET}, {SQL_IMAGES}"
LABELS = ["crack", "mold", "spall"]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _index(label: str = "label") -> Column:
    return F.coalesce(*[F.when(F.col(label) == n, k) for k, n in enumerate(LABELS)])


def _coco(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections as COCO documents, written and read back."""
    d = detections(spark, sf_dir)
    i = images(spark, sf_dir).select(F.col("image_id").alias("id"), F.col("rel_path").alias("file_name"), "width", "height", F.lit("train").alias("split"))
    a = d.select(F.col("det_id").alias("id"), "image_id", (_index() + 1).alias("category_id"), F.array(F.col("x1"), F.col("y1"), F.expr("x2 - x1"), F.expr("y2 - y1")).alias("bbox"), F.expr("(x2 - x1) * (y2 - y1)").alias("area"))
    orphan = spark.createDataFrame([(-5, -7, 1, [0.0, 0.0, 1.0, 1.0], 1.0)], "id long, image_id long, category_id int, bbox array<double>, area double")
    c = spark.createDataFrame([(k + 1, n) for k, n in enumerate(LABELS)], "id int, name string")
    path = scratch(spark, "coco")
    formats.coco_documents(i, a.unionByName(orphan), c).write.option("compression", "gzip").text(path)
    return formats.documents(spark, path)


@query("s9_coco_scan", f"{BOTH} SELECT i.rel_path AS file_name, d.det_id AS annotation_id, d.label AS category, d.x1, d.y1, d.x2, d.y2 FROM det d JOIN img i USING (image_id)")
def coco_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.coco_annotations(_coco(spark, sf_dir)).select("file_name", "annotation_id", "category", "x1", "y1", "x2", "y2")


_HOLD = lambda v, most: f"greatest(0.0, least({v}, {most}))"
_WIDE = "x1 - 20 AS x, y1 AS y, x2 - x1 + 60 AS w, y2 - y1 AS h"


@query("s10_detection_results", f"{DET}, r AS (SELECT image_id, CASE label WHEN 'crack' THEN 0 WHEN 'mold' THEN 1 ELSE 2 END AS class_id, score, {_HOLD('x1 - 20', '340')} AS x1, {_HOLD('y1', '260')} AS y1, {_HOLD('x2 + 40', '340')} AS x2, {_HOLD('y2', '260')} AS y2 FROM det WHERE score >= 0.3) SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, class_id, x1, y1, x2, y2) - 1 AS place, class_id, score, x1, y1, x2, y2 FROM r WHERE x2 > x1 AND y2 > y1")
def detection_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a detector, an array for each image, clamped to its size."""
    d = detections(spark, sf_dir)
    item = F.struct("image_id", (_index() + 1).alias("category_id"), F.array(F.expr("x1 - 20"), F.col("y1"), F.expr("x2 - x1 + 60"), F.expr("y2 - y1")).alias("bbox"), "score")
    path = scratch(spark, "results")
    d.groupBy("image_id").agg(F.to_json(F.collect_list(item)).alias("value")).select("value").write.text(path)
    found = formats.detection_results(formats.documents(spark, path), images(spark, sf_dir), 0.3)
    return found.withColumn("place", F.col("place").cast("long"))


@query("s11_yolo_scan", f"{DET} SELECT image_id::VARCHAR AS stem, CASE label WHEN 'crack' THEN 0 WHEN 'mold' THEN 1 ELSE 2 END AS class_id, round(x1, 2) AS x1, round(y1, 2) AS y1, round(x2, 2) AS x2, round(y2, 2) AS y2 FROM det")
def yolo_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines, a short one among them."""
    d = detections(spark, sf_dir)
    line = F.format_string("%d %.9f %.9f %.9f %.9f", _index(), F.expr("(x1 + x2) / 2 / width"), F.expr("(y1 + y2) / 2 / height"), F.expr("(x2 - x1) / width"), F.expr("(y2 - y1) / height"))
    path = scratch(spark, "yolo")
    rows = d.select(F.col("image_id").cast("string").alias("stem"), line.alias("value"))
    rows.unionByName(rows.limit(1).withColumn("value", F.lit("0 0.5 0.5"))).write.parquet(path)
    found = formats.yolo_boxes(spark.read.parquet(path), images(spark, sf_dir).select(F.col("image_id").cast("string").alias("stem"), "width", "height"))
    return found.select("stem", "class_id", *[F.round(c, 2).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("s12_box_lists", f"{DET} SELECT label, score, x1, y1, x2, y2 FROM det")
def box_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of boxes, bare and under a key, corners swapped in some."""
    d = detections(spark, sf_dir).withColumns({"x1": F.when(F.col("det_id") % 2 == 0, F.col("x2")).otherwise(F.col("x1")), "x2": F.when(F.col("det_id") % 2 == 0, F.col("x1")).otherwise(F.col("x2"))})
    docs = formats.box_list_documents(d, "image_id", "det_id")
    under = F.when(F.col("image_id") % 3 == 0, F.concat(F.lit('{"detections": '), "value", F.lit("}"))).otherwise(F.col("value"))
    path = scratch(spark, "boxes")
    docs.select(under.alias("value")).write.text(path)
    return formats.box_lists(formats.documents(spark, path)).drop("doc", "place")


@query("s4_csv_required", "SELECT p_partkey, trim(p_name) AS p_name, p_size FROM part")
def csv_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    read(spark, sf_dir, "part").select("p_size", F.concat(F.lit(" "), "p_name").alias("p_name"), "p_partkey", "p_type").write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return formats.csv_rows(spark, path, {"p_partkey": "long", "p_name": "string", "p_size": "int"})


@query("s5_pair_map", "SELECT n_nationkey::VARCHAR AS key, n_name AS value FROM nation")
def pair_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "pairs") + ".tsv"
    read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=True, sep="\t")
    return formats.pairs(spark, path)


@query("s6_header", "SELECT true AS with_header, false AS without_header")
def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for named in (True, False):
        path = scratch(spark, "header")
        read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").coalesce(1).write.csv(path, header=named)
        found.append(formats.has_header(spark, path))
    return spark.createDataFrame([tuple(found)], "with_header boolean, without_header boolean")


@query("s7_matrix", "SELECT a.n_name AS a, b.n_name AS b, (abs(a.n_nationkey - b.n_nationkey) + a.n_regionkey)::DOUBLE AS value FROM nation a CROSS JOIN nation b")
def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    other = n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("k"))
    cells = n.crossJoin(other).select("n_name", "b", (F.abs(F.col("n_nationkey") - F.col("k")) + F.col("n_regionkey")).alias("v"))  # 25 x 25
    path = scratch(spark, "matrix")
    cells.groupBy("n_name").pivot("b").agg(F.first("v")).write.csv(path, header=True, sep="\t")
    return formats.matrix(spark, path)


@query("s3_folder_scan", "SELECT DISTINCT o_orderstatus AS folder FROM orders")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that hold a file with the suffix, at any depth; names alone are read."""
    path = scratch(spark, "folder")
    images(spark, sf_dir).select("status", "rel_path").write.partitionBy("status").text(path)
    return formats.folder(spark, path, [".txt"]).select(F.regexp_extract("path", r"status=([^/]*)/", 1).alias("folder")).distinct()


@query("s14_requests", "SELECT CASE c_custkey % 3 WHEN 0 THEN 'prototype' WHEN 1 THEN 'review' END AS kind, concat('run_', c_custkey) AS run_id, CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 0 END AS n_decisions, 0 AS n_corrections FROM customer")
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    body = F.when(k % 3 == 0, F.format_string('{"type": " Prototype_Request", "run_id": "", "runId": "run_%d"}', k)).when(k % 3 == 1, F.format_string('{"kind": "review", "run_id": "run_%d", "decisions": [{"resultId": 1}, {"resultId": 2}]}', k)).otherwise(F.format_string('{"kind": "other", "run_id": "run_%d", "decisions": null}', k))
    path = scratch(spark, "requests")
    read(spark, sf_dir, "customer").select(body.alias("value")).write.text(path)
    return formats.requests(formats.documents(spark, path)).drop("doc")


@query("s15_run_catalog", "SELECT concat('run_', o_orderkey) AS run_id, 'scan' AS workflow, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END AS status, o_orderdate::DATE::VARCHAR AS created_at FROM orders WHERE o_orderkey % 5 <> 0")
def run_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document is cut off and left out."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(', "status": "'), "o_orderstatus", F.lit('"'))).otherwise("")
    text = F.concat(F.format_string('{"run_id": "run_%d", "workflow": "scan", "created_at": "%s"', "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd")), status, F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("}"))
    path = scratch(spark, "runs")
    o.select(text.alias("value")).write.text(path)
    return formats.runs(formats.documents(spark, path))


@query("s16_cached_vectors", "SELECT 'same' AS case, count(*) AS n FROM embeddings UNION ALL SELECT 'moved', 0 UNION ALL SELECT 'checkpoint', 0")
def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache holds for its checkpoint and its paths in their order alone."""
    e = read(spark, sf_dir, "embeddings")
    cache = e.select(F.concat(F.lit("img_"), "vec_id").alias("path"), F.col("vec_id").alias("place"), F.lit("c1").alias("checkpoint"), F.col("embedding").alias("vector"))
    wanted = cache.select("path", "place")
    moved = wanted.withColumn("place", F.when(F.col("place") == 0, 1).when(F.col("place") == 1, 0).otherwise(F.col("place")))
    of = lambda case, w, c: formats.cached(cache, w, c).agg(F.count("*").alias("n")).select(F.lit(case).alias("case"), "n")
    return of("same", wanted, "c1").unionByName(of("moved", moved, "c1")).unionByName(of("checkpoint", wanted, "c2"))


@query("s8_sequences", "SELECT 'fasta' AS format, p_name AS name, upper(replace(p_type, ' ', '')) || repeat('A', p_size::INT) AS content FROM part UNION ALL SELECT 'sdf', p_name, p_type || chr(10) || 'M  END' || chr(10) FROM part")
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written over several lines and read back."""
    p = read(spark, sf_dir, "part")
    fasta, sdf = scratch(spark, "fasta"), scratch(spark, "sdf")
    p.select(F.concat(F.lit(">"), "p_name", F.lit("\n"), F.upper(F.replace("p_type", F.lit(" "))), F.lit("\n"), F.expr("repeat('A', cast(p_size as int))")).alias("v")).write.text(fasta)
    p.select(F.concat("p_name", F.lit("\n"), "p_type", F.lit("\nM  END\n$$$$")).alias("v")).write.text(sdf)
    found = formats.fasta(spark, fasta).select(F.lit("fasta").alias("format"), "name", F.col("sequence").alias("content"))
    return found.unionByName(formats.sdf(spark, sdf).select(F.lit("sdf").alias("format"), "name", F.col("body").alias("content")))


# Sinks


@query("k1_write", "SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written with a partition column and read back: overwritten whole, not added to."""
    path = scratch(spark, "written")
    for _ in range(2):
        read(spark, sf_dir, "nation").write.mode("overwrite").partitionBy("n_regionkey").parquet(path)
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("first"))


@query("k2_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, 'added'")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("c_mktsegment")).unionByName(spark.createDataFrame([(-1, "added")], "c_custkey long, c_mktsegment string"))
    return sinks.upserted(old, new, ["c_custkey"])


@query("k3_replace_run", "SELECT o_orderstatus AS run_id, count(*) AS n, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0 GROUP BY o_orderstatus")
def replace_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run F is written anew, twice, with other rows; the others stay."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run_id"), "o_orderkey")
    path = scratch(spark, "runs")
    sinks.replace_run(o.withColumn("version", F.lit(1)), path)
    for _ in range(2):
        sinks.replace_run(o.where("run_id = 'F' and o_orderkey % 2 = 0").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"), F.max("version").alias("version")).select("run_id", "n", "version")


@query("k4_point_update", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN NULL WHEN c_custkey % 10 = 4 THEN 'X' ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer")
def point_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    changes = old.where("c_custkey % 10 in (3, 4)").select("c_custkey", F.when(F.col("c_custkey") % 10 == 4, "X").alias("c_mktsegment"))
    return sinks.updated(old, changes, ["c_custkey"])


@query("k5_fill_nulls", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('f', c_nationkey) ELSE c_name END AS c_name FROM customer")
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")).alias("c_name"))
    return sinks.filled(old, c.select("c_custkey", F.concat(F.lit("f"), "c_nationkey").alias("c_name")), ["c_custkey"])


@query("k6_backup", "SELECT count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier")
def backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.backup(read(spark, sf_dir, "supplier"), scratch(spark, "backup")).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))


@query("k7_json_exports", "SELECT 'rows' AS export, count(*) AS n, sum(r_regionkey)::BIGINT AS keys, max(r_name) AS last FROM region UNION ALL SELECT 'none', 0, NULL, NULL")
def json_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of objects, read back whole."""
    r, out = read(spark, sf_dir, "region").select("r_regionkey", "r_name"), None
    for name, df in (("rows", r), ("none", r.where("false"))):
        path = scratch(spark, "json")
        sinks.export_json(df, path, [F.col("r_name")])
        back = spark.read.schema("r_regionkey int, r_name string").json(path, multiLine=True)
        one = back.agg(F.count("*").alias("n"), F.sum("r_regionkey").alias("keys"), F.max("r_name").alias("last")).select(F.lit(name).alias("export"), "n", "keys", "last")
        out = one if out is None else out.unionByName(one)
    return out


@query("k3_replace_tables", "SELECT 'lines' AS part, l_returnflag AS run, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'orders', o_orderstatus, count(*) FROM orders GROUP BY ALL")
def replace_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of runs, written twice: the second time as the same change; readers see both of one version."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run_id"), "l_orderkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run_id"), "o_orderkey")
    store = sinks.RunStore(scratch(spark, "runs"))
    store.replace({"lines": lines.where("run_id <> 'A'"), "orders": orders})
    store.replace({"lines": lines.where("run_id in ('A', 'N')"), "orders": orders.where("run_id = 'O'")})
    count = lambda name: store.read(spark, name).groupBy(F.col("run_id").alias("run")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "run", "n")
    return count("lines").unionByName(count("orders"))


@query("k14_buffered_log", "SELECT event_type AS level, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL")
def buffered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven batches through the log sink, two of them twice, as after a restart: each row once."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("level"), "ts")
    rows = e.count()
    sink = BufferedSink(scratch(spark, "log"), flush_every=max(1, rows // 3))
    for k in (0, 1, 2, 2, 3, 1, 4, 5, 6):
        sink(e.where(F.col("event_id") % 7 == k), k)
    return sink.rows(spark).groupBy("level").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("k7_exports", "SELECT 'rows' AS export, 'r_regionkey,r_name' AS header, count(*) AS lines FROM region UNION ALL SELECT 'none', 'empty', 0")
def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1)
    out = None
    for name, df in (("rows", r), ("none", r.where("false"))):
        path = scratch(spark, "export")
        sinks.export_csv(df, path)
        is_header = F.col("value").isin("r_regionkey,r_name", "empty")
        one = spark.read.text(path).agg(F.max(F.when(is_header, F.col("value"))).alias("header"), F.count_if(~is_header).alias("lines")).select(F.lit(name).alias("export"), "header", "lines")
        out = one if out is None else out.unionByName(one)
    return out


@query("k8_yolo_dataset", f"""{BOTH}, s AS (SELECT image_id, CASE WHEN image_id % 10 < 7 THEN 'train' WHEN image_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM img),
l AS (SELECT image_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', CASE label WHEN 'crack' THEN 0 WHEN 'mold' THEN 1 ELSE 2 END, (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height), chr(10) ORDER BY det_id) AS t FROM det GROUP BY image_id)
SELECT 'labels/' || s.split || '/img_' || s.image_id || '.txt' AS path, length(l.t) + 1 AS size FROM l JOIN s USING (image_id)
UNION ALL SELECT 'classes.txt', 17 UNION ALL SELECT 'data.yaml', 93""")
def yolo_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and sizes of a data set's files; write_files() puts them in a folder."""
    split = F.when(F.col("image_id") % 10 < 7, "train").when(F.col("image_id") % 10 < 9, "val").otherwise("test")
    i = images(spark, sf_dir).select("image_id", F.concat(F.lit("img_"), "image_id", F.lit(".png")).alias("name"), split.alias("split"), "width", "height")
    d = detections(spark, sf_dir).select("image_id", "det_id", "label", "x1", "y1", "x2", "y2")
    return formats.yolo_dataset(d, i, LABELS).select("path", F.length("content").cast("long").alias("size"))


@query("k10_coco_to_yolo", f"{BOTH} SELECT i.rel_path AS file_name, d.det_id AS annotation_id, printf('%d %.8f %.8f %.8f %.8f', CASE label WHEN 'crack' THEN 0 ELSE 1 END, (x1 + (x2 - x1) / 2) / 340, (y1 + (y2 - y1) / 2) / 260, (x2 - x1) / 340, (y2 - y1) / 260) AS line FROM det d JOIN img i USING (image_id) WHERE label <> 'spall'")
def coco_to_yolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category that is not known is left out."""
    return formats.coco_to_yolo(formats.coco_annotations(_coco(spark, sf_dir)), {1: 0, 2: 1})


@query("k12_report", f"{DET}, m AS (SELECT label, avg(score) FILTER (detector = 'O') AS a, avg(score) FILTER (detector = 'F') AS b FROM det GROUP BY label) SELECT label, printf('%.4f', a) AS old, printf('%.4f', b) AS new, printf('%+.4f', b - a) AS delta FROM m")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed decimals and signed deltas."""
    m = detections(spark, sf_dir).groupBy("label").agg(F.avg(F.when(F.col("detector") == "O", F.col("score"))).alias("a"), F.avg(F.when(F.col("detector") == "F", F.col("score"))).alias("b"))
    return m.select("label", F.format_string("%.4f", "a").alias("old"), F.format_string("%.4f", "b").alias("new"), F.format_string("%+.4f", F.col("b") - F.col("a")).alias("delta"))


@query("k13_event_log", "SELECT user_id AS job, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, read back as one log."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("kind"), "event_id")
    path = scratch(spark, "events")
    for k in range(2):
        sinks.append_events(e.where(F.col("event_id") % 2 == k), path)
    return sinks.read_events(spark, path, "job long, kind string, event_id long").groupBy("job", "kind").agg(F.count("*").alias("n"))


@query("k9_coco_annotations", f"{BOTH}, a AS (SELECT row_number() OVER (ORDER BY image_id, det_id) AS id, dense_rank() OVER (ORDER BY image_id) AS image, CASE label WHEN 'crack' THEN 1 WHEN 'mold' THEN 2 ELSE 3 END AS category_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM det) SELECT id, image, category_id, x, y, w, h, w * h AS area FROM a")
def coco_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential ids: annotations are numbered in order of (image, id), whatever ids look like. Images are numbered, with the annotations before them; an annotation's place is within its image."""
    d = detections(spark, sf_dir).select("image_id", "det_id", "label", "x1", "y1", "x2", "y2")
    n = d.where("image_id is not null").groupBy("image_id").agg(F.count("*").alias("n"))
    i = running_sums(n, [F.col("image_id")], {"upto": F.col("n"), "image": F.lit(1).cast("long")}).select("image_id", "image", (F.col("upto") - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("det_id"))
    j = d.withColumn("place", place).join(i.hint("merge"), "image_id").withColumn("id", F.col("before") + F.col("place"))
    return j.select("id", "image", (_index() + 1).alias("category_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.expr("x2 - x1").alias("w"), F.expr("y2 - y1").alias("h"), F.expr("(x2 - x1) * (y2 - y1)").alias("area"))


@query("k15_unique_names", f"{BOTH}, n AS (SELECT image_id, rel_path, CASE WHEN image_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, image_id % 50 AS base, 'scan_' || (source_id % 7) AS dir FROM img), r AS (SELECT *, row_number() OVER (PARTITION BY split, base ORDER BY rel_path) AS k, row_number() OVER (PARTITION BY split, base, dir ORDER BY rel_path) AS j FROM n), f AS (SELECT split, base, arg_min(dir, k) AS first_dir FROM r GROUP BY ALL) SELECT image_id, split, CASE WHEN k = 1 THEN 'img_' || r.base ELSE dir || '__img_' || r.base || CASE WHEN j - CASE WHEN dir = first_dir THEN 1 ELSE 0 END > 1 THEN '_' || (j - CASE WHEN dir = first_dir THEN 1 ELSE 0 END) ELSE '' END END AS name FROM r JOIN f USING (split, base)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a split the first use of a base name keeps it; another is folder__name, then _2, _3. Ranks come from ranges, not from a window over a few names."""
    split = F.when(F.col("image_id") % 10 < 7, "train").otherwise("test")
    i = images(spark, sf_dir).select("image_id", "rel_path", split.alias("split"), (F.col("image_id") % 50).alias("base"), F.concat(F.lit("scan_"), F.col("source_id") % 7).alias("dir"))
    order = [F.col("rel_path")]
    first = i.groupBy("split", "base").agg(F.min("rel_path").alias("rel_path")).withColumn("plain", F.lit(True))
    marked = stored(i.join(first, ["split", "base", "rel_path"], "left"), "names")
    others = numbered_within(marked.where("plain is null"), ["split", "base", "dir"], order, "j")
    name = F.concat(F.lit("img_"), "base")
    again = F.concat("dir", F.lit("__"), name, F.when(F.col("j") > 1, F.concat(F.lit("_"), "j")).otherwise(""))
    return marked.where("plain").select("image_id", "split", name.alias("name")).unionByName(others.select("image_id", "split", again.alias("name")))


@query("w8_global_top", f"{DET} SELECT det_id, row_number() OVER (ORDER BY score DESC, det_id) AS rank FROM det ORDER BY rank LIMIT 500")
def global_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 of all by score: a top-k first, numbers after."""
    top = detections(spark, sf_dir).select("det_id", "score").orderBy(F.desc("score"), "det_id").limit(500)
    return numbered(top, [F.desc("score"), F.col("det_id")], "rank").select("det_id", "rank")
