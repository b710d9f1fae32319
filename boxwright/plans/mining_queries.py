"""Queries of prototype candidates, groups, banks, core mining and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.functions.stored import stored
from boxwright.operators import diverse, probes
from boxwright.operators import mining as M
from boxwright.operators.numbering import numbered_within
from boxwright.plans.core import query
from boxwright.plans.decision_queries import _SIG, signals
from boxwright.sources.views import SQL_DETECTIONS, SQL_IMAGES, detections, images, read

DET = f"WITH {SQL_DETECTIONS}"
BOTH = f"{DET}, {SQL_IMAGES}"

#: Cluster members of the labelled detections, with an image for each: a fixture in words that both engines read alike.
_MEMBER = {"cluster_id": "concat(label, '_', det_id % 5)", "similarity": "((det_id * 37) % 200) / 2e2", "reliability": "((det_id * 13) % 100) / 1e2", "decision_type": "CASE det_id % 4 WHEN 0 THEN 'suspect' WHEN 1 THEN 'reject' ELSE 'auto_accept' END", "reasons": "CASE det_id % 6 WHEN 0 THEN '[\"geometry_conflict\"]' WHEN 1 THEN '[\"low_margin\"]' END"}
_BASE = f"{BOTH}, m AS (SELECT d.det_id AS result_id, d.label, i.rel_path, {', '.join(f'{e} AS {k}' for k, e in _MEMBER.items())} FROM det d JOIN img i USING (image_id))"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = detections(spark, sf_dir).join(images(spark, sf_dir).select("image_id", "rel_path"), "image_id")
    return j.select(F.col("det_id").alias("result_id"), "label", "rel_path", *[F.expr(e).alias(k) for k, e in _MEMBER.items()])


def prototype_candidates(rows: DataFrame, embedded: DataFrame, per_image: int = 2, reject_limit: int = 2000) -> DataFrame:
    """result_id, label, cluster_id, domain_index, cluster_size, similarity: up to per_image rows of an image in each cluster, and doubtful ones as reject candidates.

    rows: result_id, label, rel_path, cluster_id, similarity, reliability, decision_type, reasons. embedded: result_id. Domains
    are a label's clusters that occur, by size.
    """
    reasons = F.coalesce("reasons", F.lit(""))
    doubtful = F.col("decision_type").isin("suspect", "reject", "relabel_candidate") | (F.col("reliability") < 0.5) | reasons.contains("conflict") | reasons.contains("low_margin")
    narrow = rows.where(F.col("label").isin("crack", "mold", "spall")).select("result_id", "label", "cluster_id", "rel_path", "similarity", F.coalesce(doubtful, F.lit(False)).alias("doubtful"))
    # an image's rows are brought together once for both places
    base = narrow.join(embedded, "result_id", "left_semi").repartition("rel_path")
    best = Window.partitionBy("label", "cluster_id", "rel_path").orderBy(F.desc("similarity"), "result_id")
    first = Window.partitionBy("rel_path", "doubtful").orderBy("result_id")
    placed = base.withColumn("own", F.row_number().over(best) <= per_image).withColumn("reject", F.col("doubtful") & (F.row_number().over(first) <= per_image))
    kept = stored(placed.where("own or reject").select("result_id", "label", "cluster_id", "similarity", "own", "reject", F.when(F.col("reject"), F.col("rel_path")).alias("rel_path")), "candidates")
    damage = kept.where("own")
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    domains = damage.select("label", "cluster_id").distinct().join(sizes, "cluster_id")
    place = Window.partitionBy("label").orderBy(F.desc("cluster_size"), "cluster_id")
    domains = stored(domains.withColumn("domain_index", F.row_number().over(place) - 1), "domains")  # a row for each cluster; stored, its size tells Spark how to join it
    own = damage.join(domains, ["label", "cluster_id"]).select("result_id", "label", "cluster_id", "domain_index", "cluster_size", "similarity")
    reject = kept.where("reject").orderBy("rel_path", "result_id").limit(reject_limit)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster_id", "string"), ("domain_index", "int"))]
    return own.unionByName(reject.select("result_id", F.lit("reject").alias("label"), *none, F.lit(0).cast("long").alias("cluster_size"), F.lit(None).cast("double").alias("similarity")))


_CANDIDATES = f"""{_BASE}, b AS (SELECT * FROM m WHERE result_id % 9 <> 0),
d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY label, cluster_id, rel_path ORDER BY similarity DESC, result_id) <= 2),
z AS (SELECT cluster_id, count(*) AS cluster_size FROM m GROUP BY cluster_id), o AS (SELECT DISTINCT label, cluster_id, cluster_size FROM d JOIN z USING (cluster_id)),
x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cluster_size DESC, cluster_id) - 1 AS domain_index FROM o),
r AS (SELECT * FROM b WHERE decision_type IN ('suspect', 'reject', 'relabel_candidate') OR reliability < 0.5 OR coalesce(reasons, '') LIKE '%conflict%' OR coalesce(reasons, '') LIKE '%low_margin%'),
q AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY result_id) <= 2)"""


@query("j5_prototype_candidates", f"{_CANDIDATES} SELECT d.result_id, d.label, d.cluster_id, x.domain_index, x.cluster_size, d.similarity FROM d JOIN x USING (label, cluster_id) UNION ALL SELECT * FROM (SELECT result_id, 'reject', NULL, NULL, 0, NULL FROM q ORDER BY rel_path, result_id LIMIT 300)")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine in ten results have a vector; the reject limit is the review page's."""
    m = stored(members(spark, sf_dir), "members")
    return prototype_candidates(m, m.where("result_id % 9 <> 0").select("result_id"), reject_limit=300)


@query("w2_domain_ranks", f"{_BASE}, d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY label, cluster_id, rel_path ORDER BY similarity DESC, result_id) <= 2) SELECT result_id, row_number() OVER (PARTITION BY label, cluster_id ORDER BY similarity DESC, result_id) AS place FROM d")
def domain_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within a label's cluster of what the image limit left: a cluster may hold much of the table, so they come from ranges."""
    best = Window.partitionBy("label", "cluster_id", "rel_path").orderBy(F.desc("similarity"), "result_id")
    d = members(spark, sf_dir).withColumn("n", F.row_number().over(best)).where("n <= 2").drop("n")
    return numbered_within(d.select("label", "cluster_id", "similarity", "result_id"), ["label", "cluster_id"], [F.desc("similarity"), F.col("result_id")], "place").select("result_id", "place")


@query("j7_groups", f"{_BASE}, z AS (SELECT label, cluster_id, count(*) AS size, arg_min(result_id, (1 - similarity) * 1e9 + result_id % 1000) FILTER (result_id % 3 <> 0) AS whatever FROM m GROUP BY ALL), r AS (SELECT * FROM m WHERE result_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, result_id) = 1) SELECT z.cluster_id, z.label, z.size, row_number() OVER (PARTITION BY z.label ORDER BY z.size DESC, z.cluster_id) - 1 AS domain_index, r.result_id AS rep_id, r.similarity AS rep_similarity, r.rel_path AS rep_path FROM z LEFT JOIN r USING (cluster_id)")
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their size, place among the label's and best core member: one combinable aggregation."""
    core = F.when(F.col("result_id") % 3 != 0, F.struct((-F.col("similarity")).alias("s"), "result_id", "rel_path"))
    z = members(spark, sf_dir).groupBy("label", "cluster_id").agg(F.count("*").alias("size"), F.min(core).alias("r"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("size"), "cluster_id")) - 1
    return z.select("cluster_id", "label", "size", place.alias("domain_index"), F.col("r.result_id").alias("rep_id"), (-F.col("r.s")).alias("rep_similarity"), F.col("r.rel_path").alias("rep_path"))


@query("j2_decisions_and_views", f"{_SIG}, r AS (SELECT result_id, image_id % 7 AS run, geometry FROM sig WHERE result_id % 3 <> 0), v AS (SELECT result_id, image_id % 7 AS run, 'tight' AS view FROM sig WHERE result_id % 5 <> 0 UNION ALL SELECT result_id, image_id % 7, 'pad10' FROM sig) SELECT s.result_id, s.image_id % 7 AS run, r.geometry, v.view FROM sig s LEFT JOIN r ON r.result_id = s.result_id AND r.run = s.image_id % 7 JOIN v ON v.result_id = s.result_id AND v.run = s.image_id % 7 WHERE coalesce(r.geometry, 0.9) >= 0.2 AND v.view = 'tight'")
def decisions_and_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join and an inner one on (run, result), with a coalesced predicate."""
    s = signals(spark, sf_dir).select("result_id", (F.col("image_id") % 7).alias("run"), "geometry")
    r = s.where("result_id % 3 <> 0")
    v = s.where("result_id % 5 <> 0").select("result_id", "run", F.lit("tight").alias("view")).unionByName(s.select("result_id", "run", F.lit("pad10").alias("view")))
    key = ["result_id", "run"]
    return s.drop("geometry").join(r, key, "left").join(v.where("view = 'tight'"), key).where(F.coalesce("geometry", F.lit(0.9)) >= 0.2)


@query("j14_paired_runs", f"{BOTH}, a AS (SELECT '  IMG_' || image_id AS id, avg(score) AS s FROM det WHERE detector = 'O' GROUP BY image_id), b AS (SELECT 'img_' || image_id || ' ' AS id, avg(score) AS s FROM det WHERE detector = 'F' GROUP BY image_id) SELECT lower(trim(a.id)) AS id, round(a.s, 6) AS s_old, round(b.s, 6) AS s_new FROM a JOIN b ON lower(trim(a.id)) = lower(trim(b.id))")
def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' runs on the image id in lower case without white space."""
    d = detections(spark, sf_dir)
    side = lambda which, name, s: d.where(F.col("detector") == which).groupBy("image_id").agg(F.round(F.avg("score"), 6).alias(s)).select(F.lower(F.trim(name)).alias("id"), s)
    return side("O", F.concat(F.lit("  IMG_"), "image_id"), "s_old").join(side("F", F.concat(F.lit("img_"), "image_id", F.lit(" ")), "s_new"), "id")


@query("j18_parents", f"{DET}, c AS (SELECT *, CASE WHEN det_id % 1000 > 1 THEN det_id - 1 END AS parent_id FROM det) SELECT c.det_id, p.det_id AS parent_id, p.label AS parent_label, g.det_id AS grandparent_id FROM c LEFT JOIN c p ON p.det_id = c.parent_id LEFT JOIN c g ON g.det_id = p.parent_id")
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).select("det_id", "label", F.when(F.col("det_id") % 1000 > 1, F.col("det_id") - 1).alias("parent_id"))
    p = d.select(F.col("det_id").alias("parent_id"), F.col("label").alias("parent_label"), F.col("parent_id").alias("grandparent_id"))
    j = d.select("det_id", "parent_id").join(p, "parent_id", "left")
    g = d.select(F.col("det_id").alias("grandparent_id"))
    return j.join(g.withColumn("there", F.lit(True)), "grandparent_id", "left").select("det_id", "parent_id", "parent_label", F.when(F.col("there"), F.col("grandparent_id")).alias("grandparent_id"))


@query("j20_model_grid", f"{DET}, g AS (SELECT m.model, d.label, x.metric FROM (VALUES ('O'), ('F'), ('none')) m(model), (VALUES ('crack'), ('mold'), ('spall')) d(label), (VALUES ('mean'), ('max')) x(metric)), s AS (SELECT detector AS model, label, avg(score) AS mean, max(score) AS max FROM det GROUP BY ALL) SELECT g.model, g.label, g.metric, round(CASE metric WHEN 'mean' THEN s.mean ELSE s.max END, 6) AS value FROM g LEFT JOIN s USING (model, label)")
def model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models x labels x metrics, absent ones with a null: three small dimensions."""
    dim = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    g = dim("model", ["O", "F", "none"]).crossJoin(dim("label", ["crack", "mold", "spall"])).crossJoin(dim("metric", ["mean", "max"]))
    s = detections(spark, sf_dir).groupBy(F.col("detector").alias("model"), "label").agg(F.avg("score").alias("mean"), F.max("score").alias("max"))
    return g.join(s, ["model", "label"], "left").select("model", "label", "metric", F.round(F.when(F.col("metric") == "mean", F.col("mean")).otherwise(F.col("max")), 6).alias("value"))


def with_labels(rows: DataFrame, targets: list[str], column: str = "label") -> DataFrame:
    """Rows whose label, `_` and `-` as spaces, holds one of the targets; no targets keep all."""
    from boxwright.functions.labels import canonical

    text = canonical(F.col(column))
    plain = [t.lower().replace("_", " ").replace("-", " ") for t in targets]
    return rows if not plain else rows.where(F.exists(F.array(*map(F.lit, plain)), lambda t: text.contains(t)))


@query("p10_label_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'promo') OR contains(lower(p_type), 'small')")
def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_labels(read(spark, sf_dir, "part"), ["PROMO", "small"], "p_type").select("p_partkey")


@query("p11_confident_labels", f"{DET} SELECT det_id FROM det WHERE score >= 0.4 AND label IN ('crack', 'spall')")
def confident_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where((F.col("score") >= 0.4) & F.col("label").isin("crack", "spall")).select("det_id")


def latest(runs: DataFrame, owner: str, run: str, created: str, wanted: str = "latest") -> DataFrame:
    """owner, run: the latest run of each owner, or the wanted one (an error if it is not there), or none."""
    if wanted == "none":
        return runs.select(owner, run).limit(0)
    if wanted != "latest":
        found = runs.where(F.col(run).cast("string") == wanted).select(owner, run)
        if found.isEmpty():
            raise ValueError(f"no run {wanted}")
        return found
    return runs.groupBy(owner).agg(F.max(F.struct(created, run)).alias("l")).select(owner, F.col(f"l.{run}").alias(run))


@query("s17_named_run", "SELECT 'named' AS mode, o_custkey AS owner, o_orderkey AS run_id FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def named_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    some = o.agg(F.min("o_orderkey")).first()[0]
    named = latest(o, "o_custkey", "o_orderkey", "o_orderdate", str(some)).select(F.lit("named").alias("mode"), F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("run_id"))
    none = latest(o, "o_custkey", "o_orderkey", "o_orderdate", "none").select(F.lit("none").alias("mode"), F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("run_id"))
    return named.unionByName(none)


_BANK = f"""{_BASE}, manual AS (SELECT result_id, CASE WHEN result_id % 2 = 0 THEN 'reject' ELSE label END AS label FROM m WHERE result_id % 40 = 1), picked(cluster_id, label) AS (VALUES ('crack_0', 'crack'), ('mold_1', 'mold'), ('crack_2', 'spall')),
c AS (SELECT m.result_id, p.label FROM m JOIN picked p USING (cluster_id) WHERE m.result_id % 3 <> 0)
SELECT coalesce(c.result_id, manual.result_id) AS result_id, coalesce(c.label, manual.label) AS label, CASE WHEN c.result_id IS NULL THEN 'manual' ELSE 'core_cluster' END AS source FROM c FULL JOIN manual USING (result_id) WHERE coalesce(c.result_id, manual.result_id) % 11 <> 0"""


@query("d4_prototype_bank", _BANK)
def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    manual = m.where("result_id % 40 = 1").select("result_id", F.when(F.col("result_id") % 2 == 0, "reject").otherwise(F.col("label")).alias("label"), F.col("result_id").alias("place"))
    picked = spark.createDataFrame([("crack_0", "crack", 0), ("mold_1", "mold", 1), ("crack_2", "spall", 2)], "cluster string, label string, place int")
    rows = m.select("result_id", F.col("cluster_id").alias("cluster"), "similarity", (F.col("result_id") % 3 != 0).alias("is_core"))
    return M.prototype_bank(manual, rows, picked, m.where("result_id % 11 = 0").select("result_id"))


@query("d6_core_candidates", f"{_SIG}, d AS (SELECT 'r1' AS run_id, result_id, CASE WHEN result_id % 13 = 0 THEN 'shadow' ELSE label END AS final_label, score AS reliability, clip_score AS model_agreement FROM sig), a AS (SELECT 'r1' AS run_id, result_id, 0.8 AS agreement_ratio FROM sig WHERE result_id % 2 = 0), b AS (SELECT 'r1_box_graph_v1' AS graph_id, result_id, result_id % 5 AS keep FROM sig WHERE result_id % 3 = 0) SELECT d.result_id, d.final_label AS label, coalesce(a.agreement_ratio, d.model_agreement)::DOUBLE AS agreement FROM d LEFT JOIN a USING (run_id, result_id) LEFT JOIN b ON b.result_id = d.result_id AND b.graph_id = d.run_id || '_box_graph_v1' WHERE d.reliability >= 0.7 AND coalesce(a.agreement_ratio, d.model_agreement) >= 0.75 AND coalesce(b.keep, 1) = 1 AND d.final_label NOT IN ('reject', 'unknown', 'background', 'shadow', 'edge', 'object')")
def core_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).withColumn("run_id", F.lit("r1"))
    d = s.select("run_id", "result_id", F.when(F.col("result_id") % 13 == 0, "shadow").otherwise(F.col("label")).alias("final_label"), F.col("score").alias("reliability"), F.col("clip_score").alias("model_agreement"))
    a = s.where("result_id % 2 = 0").select("run_id", "result_id", F.lit(0.8).alias("agreement_ratio"))
    b = s.where("result_id % 3 = 0").select(F.lit("r1_box_graph_v1").alias("graph_id"), "result_id", (F.col("result_id") % 5).alias("keep"))
    return M.candidates(d, a, b)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("result_id"), F.concat(F.lit("l"), "label").alias("label"), (((F.col("vec_id") * 13) % 100) / 100).alias("reliability"), F.col("embedding").alias("v"))


def _rounds_sql(most: int, rounds: int = 20) -> str:
    """k-means in whole numbers over rows (label, result_id, q) and sized (label, k), unrolled: more rounds than it takes change nothing."""
    square = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = ["pool AS MATERIALIZED (SELECT label, k, q, p FROM (SELECT label, k, q, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || result_id), result_id) AS p FROM rows JOIN sized USING (label)) WHERE p <= 64)", "s0 AS (SELECT label, k, 0 AS cluster, q AS c FROM pool WHERE p = 1)", f"g0 AS MATERIALIZED (SELECT pool.*, {square('pool.q', 's0.c')} AS d FROM pool JOIN s0 USING (label))"]
    for j in range(1, most):
        steps.append(f"s{j} AS MATERIALIZED (SELECT label, k, {j} AS cluster, arg_max(q, d * 128 - p) AS c FROM g{j - 1} GROUP BY label, k)")
        steps.append(f"g{j} AS MATERIALIZED (SELECT g.label, g.k, g.q, g.p, least(g.d, {square('g.q', 's.c')}) AS d FROM g{j - 1} g JOIN s{j} s ON s.label = g.label)")
    steps.append(f"c0 AS MATERIALIZED (SELECT label, cluster, c FROM ({' UNION ALL '.join(f'SELECT * FROM s{j}' for j in range(most))}) WHERE cluster < k)")
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r.label, r.result_id, arg_min(c.cluster, {square('r.q', 'c.c')} * 64 + c.cluster) AS cluster FROM rows r JOIN c{i} c ON c.label = r.label GROUP BY ALL)")
        steps.append(f"""m{i} AS (SELECT label, cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT a.label, a.cluster, t.i, sum(r.q[t.i])::BIGINT AS s, count(*) AS n
  FROM a{i} a JOIN rows r USING (result_id), (SELECT unnest(range(1, 65)) AS i) t GROUP BY ALL) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.label, c.cluster, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.label = c.label AND m.cluster = c.cluster)""")
    return ", ".join(steps)


_MINING = f"""WITH base AS (SELECT vec_id AS result_id, 'l' || label AS label, 0.7 + vec_id % 3 / 10 AS agreement, embedding AS v, list_transform(embedding, lambda x: floor(x::DOUBLE * 1048576 + 0.5)::BIGINT) AS q FROM embeddings),
sized AS (SELECT label, count(*) AS n, greatest(1, least(8, count(*) // 10)) AS k FROM base GROUP BY label),
rows AS MATERIALIZED (SELECT base.* FROM base JOIN sized USING (label) WHERE n >= 10),
{_rounds_sql(8)},
mean AS (SELECT label, cluster, list(m ORDER BY i) AS m FROM (SELECT label, cluster, i, avg(x::DOUBLE) AS m FROM (SELECT a.label, a.cluster, unnest(r.v) AS x, generate_subscripts(r.v, 1) AS i FROM a19 a JOIN rows r USING (result_id)) GROUP BY ALL) GROUP BY ALL),
near AS (SELECT a.result_id, a.label, a.cluster, r.agreement, greatest(-1, least(1, list_dot_product(r.v::DOUBLE[], m) / greatest(sqrt(list_dot_product(m, m)), 1e-12))) AS similarity FROM a19 a JOIN rows r USING (result_id) JOIN mean ON mean.label = a.label AND mean.cluster = a.cluster),
about AS (SELECT label, cluster, count(*) AS size, avg(similarity) AS density, avg(agreement) AS ca FROM near GROUP BY ALL)
SELECT result_id, label, cluster::INTEGER AS cluster, size, round(density, 5) AS density, round(ca, 5) AS cluster_agreement, round(similarity, 5) AS similarity,
  CASE WHEN size >= 10 AND ca >= 0.75 THEN 'core' WHEN size >= 3 THEN 'rare_cluster' ELSE 'noise_cluster' END AS status FROM near JOIN about USING (label, cluster)
UNION ALL SELECT result_id, label, NULL, NULL, NULL, NULL, NULL, 'insufficient_class_samples' FROM base JOIN sized USING (label) WHERE n < 10"""


@query("d6_core_mining", _MINING)
def core_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("agreement", 0.7 + F.col("result_id") % 3 / 10)
    out = M.core_mining(rows)
    return out.withColumns({c: F.round(c, 5) for c in ("density", "cluster_agreement", "similarity")})


@query("t4_diverse_sample")
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential by nature: tested against a loop."""
    return diverse.diverse_sample(_vectors(spark, sf_dir), 0.05)


@query("t5_domains_by_size", f"{_BASE}, z AS (SELECT label, cluster_id, count(*) AS size, min(result_id) AS first FROM m GROUP BY ALL) SELECT cluster_id, row_number() OVER (ORDER BY size DESC, first) AS place FROM z")
def domains_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = members(spark, sf_dir).groupBy("label", "cluster_id").agg(F.count("*").alias("size"), F.min("result_id").alias("first"))
    return z.select("cluster_id", F.row_number().over(Window.orderBy(F.desc("size"), "first")).cast("long").alias("place"))  # a row for each cluster


_SOURCES = f"""WITH u AS (SELECT 's' || vec_id % 40 AS source, i, avg(x::DOUBLE) AS m FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
n AS (SELECT source, list(m ORDER BY i) AS m, sqrt(sum(m * m)) AS norm FROM u GROUP BY source),
rows AS MATERIALIZED (SELECT 'all' AS label, source AS result_id, list_transform(m, lambda x: floor(x / greatest(norm, 1e-12) * 1048576 + 0.5)::BIGINT) AS q FROM n), sized AS (SELECT 'all' AS label, least(count(*), 5) AS k FROM rows),
{_rounds_sql(5)} SELECT result_id AS source, cluster::INTEGER AS cluster FROM a19"""


@query("l5_source_clusters", _SOURCES)
def source_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sources_clustered(_vectors(spark, sf_dir).select(F.concat(F.lit("s"), F.col("result_id") % 40).alias("source"), "v"), 5)


@query("d16_linear_probe")
def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted candidates by threshold; a model has no SQL, its accuracy is tested."""
    v = _vectors(spark, sf_dir)
    probed = M.linear_probe(v.where("result_id % 4 <> 0").select("label", "v"), v.where("result_id % 4 = 0").select("result_id", "v"))
    return M.threshold_report(probed, [0.5, 0.7, 0.9])


@query("d16_cross_validation")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each of five folds; the models are tested against a fit of each fold by itself."""
    rows = _vectors(spark, sf_dir).select("result_id", "label", "v")
    return probes.accuracies(probes.cross_validated(rows)).withColumn("accuracy", F.round("accuracy", 4))


@query("d17_temperature", f"{DET}, r AS (SELECT (score - 0.5) * 6 AS logit, CASE WHEN det_id % 10 < score * 10 THEN 1 ELSE 0 END AS target FROM det), g(t) AS (VALUES (0.25), (0.5), (1.0), (2.0), (4.0), (8.0)) SELECT t::DOUBLE AS t, round(avg(greatest(logit / t, 0) - logit / t * target + ln(1 + exp(-abs(logit / t)))), 6) AS loss FROM r CROSS JOIN g GROUP BY t")
def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    rows = d.select(((F.col("score") - 0.5) * 6).alias("logit"), F.when(F.col("det_id") % 10 < F.col("score") * 10, 1).otherwise(0).alias("target"))
    return M.temperature_losses(rows, [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]).withColumn("loss", F.round("loss", 6))


@query("e7_bootstrap")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resamples have no SQL; the interval is tested against the normal one."""
    return M.bootstrap(detections(spark, sf_dir), "score")


@query("o7_dup_score", f"{DET}, p AS (SELECT a.det_id AS a_det_id, b.det_id AS b_det_id, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab FROM det a JOIN det b ON a.image_id = b.image_id AND a.det_id < b.det_id) SELECT a_det_id, b_det_id, round(0.6 * greatest(i / (aa + ab - i), i / least(aa, ab)) + 0.4 * (((a_det_id * b_det_id) % 200 - 100) / 1e2 + 1) / 2, 6) AS score FROM p WHERE i > 0")
def dup_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.functions import boxes as B
    from boxwright.operators.pairs import overlapping_pairs

    p = overlapping_pairs(detections(spark, sf_dir), [])
    cosine = F.expr("((a_det_id % 200) * (b_det_id % 200) % 200 - 100) / 1e2")  # of the remainders: the product of large ids is no long
    return p.select("a_det_id", "b_det_id", F.round(M.dup_score(B.iou(B.box("a_"), B.box("b_")), B.containment(B.box("a_"), B.box("b_")), cosine), 6).alias("score"))


@query("o11_keep_order", f"{DET} SELECT det_id, row_number() OVER (PARTITION BY image_id ORDER BY floor(score * 10) DESC, (x2 - x1) * (y2 - y1) DESC, det_id) AS place FROM det")
def keep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.functions import boxes as B

    order = M.keep_order(good=F.floor(F.col("score") * 10), area=B.area(B.box()), key=F.col("det_id"))
    return detections(spark, sf_dir).select("det_id", F.row_number().over(Window.partitionBy("image_id").orderBy(*order)).cast("long").alias("place"))
