"""Domain tables projected from the TPC-H-like tables, in Spark and as SQL text for the other engine.

images: image_id, source_id, rel_path, status, width, height, created. detections: image_id, det_id, label, detector,
prompt_key, score, x1..y2, width, height. (order, line) is no key there, so ids number the rows of an order by all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 340, 260


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.col("o_custkey").alias("source_id"),
        F.format_string("scan_%d/img_%d.png", F.col("o_custkey") % 7, F.col("o_orderkey")).alias("rel_path"),
        F.col("o_orderstatus").alias("status"),
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
        F.col("o_orderdate").alias("created"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    x1 = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 200
    y1 = (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 29) % 150
    return line.select(
        F.col("l_orderkey").alias("image_id"),
        (F.col("l_orderkey") * 1000 + number).alias("det_id"),
        F.when(F.col("l_returnflag") == "R", "crack").when(F.col("l_returnflag") == "A", "mold").otherwise("spall").alias("label"),
        F.col("l_linestatus").alias("detector"),
        F.concat(F.lit("p"), F.col("l_linenumber") % 3).alias("prompt_key"),
        ((1 + (F.col("l_partkey") * 17 + F.col("l_linenumber")) % 99) / 100.0).alias("score"),
        x1.cast("double").alias("x1"),
        y1.cast("double").alias("y1"),
        (x1 + 10 + (F.col("l_partkey") * 7) % 120).cast("double").alias("x2"),
        (y1 + 10 + (F.col("l_suppkey") * 13) % 100).cast("double").alias("y2"),
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
    )


SQL_IMAGES = f"""img AS (SELECT o_orderkey AS image_id, o_custkey AS source_id, 'scan_' || (o_custkey % 7) || '/img_' || o_orderkey || '.png' AS rel_path,
  o_orderstatus AS status, {WIDTH} AS width, {HEIGHT} AS height, o_orderdate AS created FROM orders)"""
SQL_DETECTIONS = f"""det AS (SELECT image_id, det_id, label, detector, prompt_key, score, x1, y1, x1 + bw AS x2, y1 + bh AS y2, {WIDTH} AS width, {HEIGHT} AS height FROM (
  SELECT l_orderkey AS image_id, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS det_id,
  CASE l_returnflag WHEN 'R' THEN 'crack' WHEN 'A' THEN 'mold' ELSE 'spall' END AS label, l_linestatus AS detector, 'p' || (l_linenumber % 3) AS prompt_key,
  (1 + (l_partkey * 17 + l_linenumber) % 99) / 100.0::DOUBLE AS score, ((l_partkey * 37 + l_linenumber * 11) % 200)::DOUBLE AS x1, ((l_suppkey * 53 + l_linenumber * 29) % 150)::DOUBLE AS y1,
  (10 + (l_partkey * 7) % 120)::DOUBLE AS bw, (10 + (l_suppkey * 13) % 100)::DOUBLE AS bh FROM lineitem))"""
