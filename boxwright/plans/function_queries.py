"""Queries of scalar functions: names and paths, aliases, prompt groups, JSON, distances, touching boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import boxes as B
from boxwright.functions import labels as L
from boxwright.functions import vectors as V
from boxwright.plans.core import query
from boxwright.sources.views import SQL_DETECTIONS, detections, read

DET = f"WITH {SQL_DETECTIONS}"

#: Names of images in the forms that are met, by the customer's key.
_NAME = """CASE c_custkey % 11 WHEN 0 THEN concat('a/DSC', c_custkey, '__roi', c_nationkey, '.png') WHEN 1 THEN concat('DSC', c_custkey, '-ROI3.jpg') WHEN 2 THEN concat('x_', c_custkey, '_1_2_3.png') WHEN 3 THEN concat('x_', c_custkey, '_7.png') WHEN 4 THEN concat('img', c_custkey, '_dup2.png')
WHEN 5 THEN concat('ti_', c_custkey, '-1.jpg') WHEN 6 THEN concat('test_img/', c_custkey, '.jpg') WHEN 7 THEN concat('tr_', c_custkey, '.jpg') WHEN 8 THEN concat('deep/', c_custkey, '/images/b.jpg') WHEN 9 THEN concat('y_', c_custkey, '_5_roi4.png') ELSE concat('plain', c_custkey) END"""
_STEM = "regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', '')"
_NUM = lambda x: f"CASE WHEN regexp_matches({x}, '^(.*)_\\d+_\\d+_\\d+_\\d+$') THEN regexp_extract({x}, '^(.*)_\\d+_\\d+_\\d+_\\d+$', 1) WHEN regexp_matches({x}, '^(.*)_\\d+_\\d+$') THEN regexp_extract({x}, '^(.*)_\\d+_\\d+$', 1) ELSE {x} END"


@query(
    "f2_names",
    f"""WITH n AS (SELECT c_custkey, {_NAME} AS p FROM customer), s AS (SELECT *, {_STEM} AS st, regexp_replace({_STEM}, '_dup\\d+$', '') AS d, regexp_replace(regexp_replace({_STEM}, '(__roi|_roi)\\d+$', ''), '_dup\\d+$', '') AS r FROM n)
SELECT c_custkey, st AS stem, CASE WHEN regexp_matches(d, '(?i)^(.+?)__roi\\d+$') THEN regexp_extract(d, '(?i)^(.+?)__roi\\d+$', 1) WHEN regexp_matches(d, '(?i)^(.+?)[_-]roi\\d+$') THEN regexp_extract(d, '(?i)^(.+?)[_-]roi\\d+$', 1) ELSE {_NUM("d")} END AS source_id,
  {_NUM("d")} AS image_source, {_NUM("r")} AS roi_source, replace(replace(p, '/images/', '/masks/'), '.jpg', '.png') AS mask,
  CASE WHEN p LIKE 'test_img/%' OR p LIKE 'ti\\_%' ESCAPE '\\' THEN 'test_img__' WHEN p LIKE 'train_img/%' OR p LIKE 'tr\\_%' ESCAPE '\\' THEN 'train_img__' ELSE '' END || CASE WHEN p LIKE '%/%' THEN st ELSE regexp_replace(st, '^t[ir]_', '') END AS canonical FROM s""",
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_NAME).alias("p"))
    p = F.col("p")
    return n.select("c_custkey", L.stem(p).alias("stem"), L.source_id(p).alias("source_id"), L.image_source_id(L.stem(p)).alias("image_source"), L.roi_source_id(p).alias("roi_source"), L.mask_path(p).alias("mask"), L.canonical_image(p).alias("canonical"))


#: Detector labels and prompts, by the part's key.
_WORDS = "Crack,hairline Fissure,SPALLING wall,delamination,mould spot,moisture,dirty tile,moss,chipped edge,broken brick,stain,shadow,delaminated crack,none".split(",")
_SAID = "CASE p_partkey % 14 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WORDS)) + " END"


def _alias_sql(table: list[tuple[str, list[str]]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(t), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{label}'" for label, words in table) + f" ELSE {otherwise} END"


@query("f3_aliases", f"WITH w AS (SELECT p_partkey, {_SAID} AS t FROM part) SELECT p_partkey, {_alias_sql(L.ALIASES_SOURCE, 'lower(trim(t))')} AS source_label, {_alias_sql(L.ALIASES_ENSEMBLE, 'NULL')} AS ensemble_label, {_alias_sql(L.ALIASES_SEED, 'NULL')} AS seed_label, CASE WHEN lower(trim(t)) IN ('crack', 'mold', 'spall') THEN lower(trim(t)) ELSE 'reject' END AS plain FROM w")
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "part").select("p_partkey", F.expr(_SAID).alias("t"))
    t = F.col("t")
    return w.select("p_partkey", L.by_alias(t, L.ALIASES_SOURCE, F.lower(F.trim(t))).alias("source_label"), L.by_alias(t, L.ALIASES_ENSEMBLE).alias("ensemble_label"), L.by_alias(t, L.ALIASES_SEED).alias("seed_label"), L.normalise(t).alias("plain"))


GROUPS = [("crack", ["wall crack", "crack"]), ("mold", ["mould spot", "green mold"]), ("spall", ["spalling wall", "chipped edge"])]


@query("m1_prompt_groups", f"WITH w AS (SELECT p_partkey, {_SAID} AS t FROM part) SELECT p_partkey, CASE WHEN contains(lower(t), 'spalling wall') THEN 'spall' WHEN contains(lower(t), 'chipped edge') THEN 'spall' WHEN contains(lower(t), 'wall crack') THEN 'crack' WHEN contains(lower(t), 'mould spot') THEN 'mold' WHEN contains(lower(t), 'green mold') THEN 'mold' WHEN contains(lower(t), 'crack') THEN 'crack' WHEN contains(lower(t), 'fracture') OR contains(lower(t), 'fissure') OR contains(lower(t), 'hairline') THEN 'crack' WHEN regexp_matches(lower(t), 'mold|mould|mildew|moss|algae|fungal|fungus|lichen|biological') THEN 'mold' WHEN regexp_matches(lower(t), 'spall|flaked|chipped|delamination') THEN 'spall' END AS grp FROM w")
def prompt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", L.matched_group(F.expr(_SAID), GROUPS).alias("grp"))


@query("f7_group_texts", "WITH g AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN concat(n_name, ' = a, b ,') WHEN 1 THEN concat('::', n_name) ELSE concat('q1,', n_name) END AS t FROM nation) SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN trim(split_part(t, '=', 1)) ELSE printf('group_%02d', n_nationkey) END AS name, CASE n_nationkey % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN substr(t, 3) ELSE replace(t, ',', '|') END AS queries FROM g")
def group_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    t = F.when(k % 3 == 0, F.concat(name, F.lit(" = a, b ,"))).when(k % 3 == 1, F.concat(F.lit("::"), name)).otherwise(F.concat(F.lit("q1,"), name))
    g = L.prompt_group(t, k)
    return read(spark, sf_dir, "nation").select("n_nationkey", g["name"].alias("name"), F.array_join(g["queries"], "|").alias("queries"))


def tolerant(text: F.Column, schema: str, empty: F.Column) -> F.Column:
    """The parsed document; a malformed one, or one of another shape, is empty."""
    return F.coalesce(F.from_json(text, schema), empty)


@query("f4_json", """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '["b","a","b"]' WHEN 1 THEN '["conflict"' ELSE '{"x": 1}' END AS codes, CASE event_id % 4 WHEN 0 THEN '{"k": ' ELSE props END AS props FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '["a","b","new"]' ELSE '["new"]' END AS codes, CASE WHEN event_id % 4 <> 0 THEN (props ->> '$.k')::BIGINT END AS k, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS merged FROM e""")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason codes parsed, united with another, sorted and written; two maps merged, the later value winning."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    codes = tolerant(F.when(k % 3 == 0, '["b","a","b"]').when(k % 3 == 1, '["conflict"').otherwise('{"x": 1}'), "array<string>", F.array().cast("array<string>"))
    codes = F.filter(codes, lambda c: c.isNotNull() & ~c.startswith("{"))
    props = tolerant(F.when(k % 4 == 0, '{"k": ').otherwise(F.col("props")), "map<string, bigint>", F.create_map().cast("map<string, bigint>"))
    more = F.create_map(F.lit("score"), F.lit(1).cast("bigint"))
    merged = F.map_concat(F.map_filter(props, lambda key, _: ~F.map_contains_key(more, "score") | (key != "score")), more)
    return e.select("event_id", F.to_json(F.array_sort(F.array_union(codes, F.array(F.lit("new"))))).alias("codes"), F.try_element_at(props, F.lit("k")).alias("k"), F.size(merged).cast("long").alias("merged"))


_BITS = "WITH p AS (SELECT a.vec_id, a.embedding AS v, b.embedding AS w, list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1] > 0)::INT * 2 + (z[2] > 0)::INT) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), c AS (SELECT vec_id, v, w, len(list_filter(z, lambda x: x = 3))::DOUBLE AS n11, len(list_filter(z, lambda x: x = 2))::DOUBLE AS n10, len(list_filter(z, lambda x: x = 1))::DOUBLE AS n01, len(list_filter(z, lambda x: x = 0))::DOUBLE AS n00 FROM p), d AS (SELECT *, n11 + n10 AS a, n11 + n01 AS b, n11 + n10 + n01 + n00 AS n, n10 + n01 AS x FROM c)"


@query("f5_distances", f"""{_BITS} SELECT vec_id, round(x / n, 6) AS hamming, round(x / (n11 + x), 6) AS jaccard, round(x / n, 6) AS matching, round(2 * x / (n11 + n00 + 2 * x), 6) AS rogerstanimoto, round(2 * x / (n11 + n00 + 2 * x), 6) AS sokalmichener, round(n10 * n01 / (n11 * n00 + n10 * n01), 6) AS yule,
round(list_sum(list_transform(list_zip(v, w), lambda z: CASE WHEN abs(z[1]::DOUBLE) + abs(z[2]::DOUBLE) > 0 THEN abs(z[1]::DOUBLE - z[2]::DOUBLE) / (abs(z[1]::DOUBLE) + abs(z[2]::DOUBLE)) ELSE 0 END)) / len(v), 5) AS canberra, round(1 - list_sum(list_transform(list_zip(v, w), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(v, lambda t: t::DOUBLE * t::DOUBLE)) * list_sum(list_transform(w, lambda t: t::DOUBLE * t::DOUBLE))), 5) AS cosine FROM d""")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector and the next one; booleans are the signs."""
    p = _neighbours(spark, sf_dir)
    bits = lambda c: F.transform(c, lambda x: x > 0)
    found = V.distances(*(F.col(c) for c in ("n11", "n10", "n01", "n00")))
    counted = p.withColumns(dict(zip(("n11", "n10", "n01", "n00"), V.bit_counts(bits("v"), bits("w")), strict=True)))
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    return counted.select("vec_id", *[F.round(v, 6).alias(k) for k, v in found.items()], F.round(V.canberra(as_double("v"), as_double("w")), 5).alias("canberra"), F.round(1 - V.cosine(F.col("v"), F.col("w")), 5).alias("cosine"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("v")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w")), "vec_id")


@query("f6_similarities", f"{_BITS} SELECT vec_id, round((n11 + n00) / n, 6) AS allbit, round(n11 / least(a, b), 6) AS asymmetric, round(n11 / greatest(a, b), 6) AS braunblanquet, round(n11 / sqrt(a * b), 6) AS cosine, round(2 * n11 / (a + b), 6) AS dice, round(n11 * (a + b) / (2 * a * b), 6) AS kulczynski, round(n11 / (n11 + x), 6) AS onbit, round(n11 / (a + b) + n00 / (2 * n - a - b), 6) AS rogotgoldberg, round(n11 / n, 6) AS russel, round(n11 / (2 * a + 2 * b - 3 * n11), 6) AS sokal, round(n11 / (a + b - n11), 6) AS tanimoto FROM d")
def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = lambda c: F.transform(c, lambda x: x > 0)
    counted = _neighbours(spark, sf_dir).withColumns(dict(zip(("n11", "n10", "n01", "n00"), V.bit_counts(bits("v"), bits("w")), strict=True)))
    found = V.similarities(*(F.col(c) for c in ("n11", "n10", "n01", "n00")))
    return counted.select("vec_id", *[F.round(v, 6).alias(k) for k, v in found.items()])


@query("b15_touching", f"{DET} SELECT a.det_id AS a_det_id, b.det_id AS b_det_id FROM det a JOIN det b ON a.image_id = b.image_id AND a.det_id < b.det_id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2")
def touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda p: detections(spark, sf_dir).select("image_id", *[F.col(c).alias(f"{p}_{c}") for c in ("det_id", "x1", "y1", "x2", "y2")])
    return side("a").join(side("b"), "image_id").where((F.col("a_det_id") < F.col("b_det_id")) & B.touch(B.box("a_"), B.box("b_"))).select("a_det_id", "b_det_id")


@query("f8_missing_words", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'p' END, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN '' END, ''), c_mktsegment) AS label, round(greatest(0, least(100, (58 * 0.5 + 320 * c_acctbal / 1e5) * 1.2)), 6) AS severity, round(greatest(0.0, least(1.0, 1 - abs(c_acctbal / 1e4 - 0.5) / 0.5)), 6) AS uncertainty FROM customer")
def missing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty text counts as missing; severity and uncertainty are clipped."""
    k = F.col("c_custkey")
    empty = F.nullif(F.when(k % 3 == 0, "").otherwise("p"), F.lit(""))
    bal = F.col("c_acctbal").cast("double")
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(empty, F.nullif(F.when(k % 2 == 0, ""), F.lit("")), "c_mktsegment").alias("label"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (58 * 0.5 + 320 * bal / 1e5) * 1.2)), 6).alias("severity"), F.round(B.clip01(1 - F.abs(bal / 1e4 - 0.5) / 0.5), 6).alias("uncertainty"))
