"""Queries over boxes: algebra, spatial joins, suppression, box graph, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.functions import boxes as B
from boxwright.operators import pairs, suppress, tiles
from boxwright.plans.core import query
from boxwright.sources.views import SQL_DETECTIONS, detections

# SQL text of the box algebra; a and b are prefixes such as "a." or "k.".
area = lambda a: f"(greatest(0.0, {a}x2 - {a}x1) * greatest(0.0, {a}y2 - {a}y1))"
inter = lambda a, b: f"(greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"
union = lambda a, b: f"({area(a)} + {area(b)} - {inter(a, b)})"
iou = lambda a, b: f"(CASE WHEN {union(a, b)} > 0 THEN {inter(a, b)} / {union(a, b)} ELSE 0.0 END)"
contain = lambda a, b: f"(CASE WHEN least({area(a)}, {area(b)}) > 0 THEN {inter(a, b)} / least({area(a)}, {area(b)}) ELSE 0.0 END)"
aspect = lambda a: f"(greatest(0.0, {a}x2 - {a}x1) / greatest(greatest(0.0, {a}y2 - {a}y1), 1e-6))"
elong = lambda a: f"greatest({aspect(a)}, 1 / greatest({aspect(a)}, 1e-6))"
DET = f"WITH {SQL_DETECTIONS}"


@query(
    "b_box_algebra",
    f"""{DET}, d AS (SELECT *, x1 - 20 AS u1, y1 - 20 AS v1 FROM det)
SELECT det_id, {area("")} AS area, {aspect("")} AS aspect, {elong("")} AS elongation,
  CASE WHEN least(x2, 340.0) > greatest(u1, 0.0) AND least(y2, 260.0) > greatest(v1, 0.0) THEN greatest(u1, 0.0) END AS clip_x1,
  CASE WHEN least(x2, 340.0) > greatest(u1, 0.0) AND least(y2, 260.0) > greatest(v1, 0.0) THEN greatest(v1, 0.0) END AS clip_y1,
  greatest(x1 - (x2 - x1) * 0.1, 0.0) AS grow_x1, least(x2 + (x2 - x1) * 0.1, 340.0) AS grow_x2,
  greatest(trunc(x1 - 10)::INT, 0) AS pad_x1, least(trunc(x2 + 10.999999)::INT, 340) AS pad_x2,
  (x1 + x2) / 2 / 340 AS yolo_cx, (y2 - y1) / 260 AS yolo_h,
  greatest(0.8 * x1 - 0.6 * y1 + 5, 0.8 * x1 - 0.6 * y2 + 5, 0.8 * x2 - 0.6 * y1 + 5, 0.8 * x2 - 0.6 * y2 + 5) AS turned_x2 FROM d""",
)
def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    b, w, h = B.box(), F.col("width").cast("double"), F.col("height").cast("double")
    shifted = B.Box(b.x1 - 20, b.y1 - 20, b.x2, b.y2)
    clip, grow, pad, yolo = B.clip(shifted, w, h), B.expand(b, 0.2, w, h), B.padded(b, 10, F.col("width"), F.col("height")), B.yolo(b, w, h)
    turned = B.rotate_back(b, [F.lit(v) for v in (0.8, -0.6, 5.0, 0.6, 0.8, 0.0)])
    return d.select("det_id", B.area(b).alias("area"), B.aspect(b).alias("aspect"), B.elongation(b).alias("elongation"), clip.x1.alias("clip_x1"), clip.y1.alias("clip_y1"), grow.x1.alias("grow_x1"), grow.x2.alias("grow_x2"), pad.x1.alias("pad_x1"), pad.x2.alias("pad_x2"), yolo.x1.alias("yolo_cx"), yolo.y2.alias("yolo_h"), turned.x2.alias("turned_x2"))


@query("b9_merged_box", f"{DET} SELECT image_id, greatest(trunc(min(x1) - 50)::INT, 0) AS x1, greatest(trunc(min(y1) - 50)::INT, 0) AS y1, least(trunc(max(x2) + 50)::INT, 340) AS x2, least(trunc(max(y2) + 50)::INT, 260) AS y2 FROM det GROUP BY image_id")
def merged_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).groupBy("image_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    lo = lambda c: F.greatest((F.col(c) - 50).cast("int"), F.lit(0)).alias(c)
    hi = lambda c, most: F.least((F.col(c) + 50).cast("int"), F.lit(most)).alias(c)
    return d.select("image_id", lo("x1"), lo("y1"), hi("x2", 340), hi("y2", 260))


@query("p8_valid_detections", f"{DET} SELECT det_id, image_id FROM det WHERE x2 - x1 >= 15 AND y2 - y1 >= 15 AND {area('')} >= 400 AND {area('')} / greatest(1, width * height) <= 0.2 AND {area('')} <= 0.92 * width * height")
def valid_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, whole = B.box(), F.col("width") * F.col("height")
    return detections(spark, sf_dir).where((B.width(b) >= 15) & (B.height(b) >= 15) & (B.area(b) >= 400) & (B.area(b) / F.greatest(F.lit(1), whole) <= 0.2) & (B.area(b) <= 0.92 * whole)).select("det_id", "image_id")


@query(
    "p12_score_floor_topk",
    f"{DET}, r AS (SELECT *, max(score) OVER (PARTITION BY image_id) AS best, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS n FROM det) SELECT det_id, image_id, score FROM r WHERE best >= 0.6 AND score >= 0.3 AND n <= 3",
)
def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = detections(spark, sf_dir).select("image_id", "det_id", "score", F.max("score").over(Window.partitionBy("image_id")).alias("best"), F.row_number().over(pairs.score_order()).alias("n"))
    return ranked.where("best >= 0.6 and score >= 0.3 and n <= 3").select("det_id", "image_id", "score")


_PAIRS = f"p AS (SELECT a.image_id, a.det_id AS a_det_id, b.det_id AS b_det_id, {iou('a.', 'b.')} AS iou, {contain('a.', 'b.')} AS con, a.label = b.label AS same, {area('a.')} >= {area('b.')} AS a_first FROM det a JOIN det b ON a.image_id = b.image_id AND a.det_id < b.det_id AND {inter('a.', 'b.')} > 0)"


@query("j15_spatial_self_join", f"{DET}, {_PAIRS} SELECT image_id, a_det_id, b_det_id, iou, con FROM p WHERE con >= 0.5 OR iou >= 0.1")
def spatial_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = B.box("a_"), B.box("b_")
    p = pairs.overlapping_pairs(detections(spark, sf_dir), [])
    return p.select("image_id", "a_det_id", "b_det_id", B.iou(a, b).alias("iou"), B.containment(a, b).alias("con")).where("con >= 0.5 or iou >= 0.1")


@query("j15_spatial_grid_join", f"{DET}, big AS (SELECT det.*, det_id // 50000 AS scene FROM det) SELECT a.scene, a.det_id AS a_det_id, b.det_id AS b_det_id, {iou('a.', 'b.')} AS iou FROM big a JOIN big b ON a.scene = b.scene AND a.det_id < b.det_id AND {inter('a.', 'b.')} > 0 WHERE {iou('a.', 'b.')} >= 0.5")
def spatial_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of some hundred boxes."""
    d = detections(spark, sf_dir).withColumn("scene", F.expr("det_id div 50000"))
    value = B.iou(B.box("a_"), B.box("b_"))
    return pairs.overlapping_pairs_grid(d, [], key="scene").select("scene", "a_det_id", "b_det_id", value.alias("iou")).where("iou >= 0.5")


@query(
    "g_geometry_features",
    f"""{DET}, {_PAIRS}, s AS (SELECT a_det_id AS det_id, iou, con, same, a_first AS first FROM p UNION ALL SELECT b_det_id, iou, con, same, NOT a_first FROM p),
g AS (SELECT det_id, max(con) AS mc, max(CASE WHEN same THEN iou END) AS mi, count(*) FILTER (con >= 0.9 AND first) AS cc, count(*) FILTER (con >= 0.9 AND NOT first) AS cb FROM s GROUP BY det_id)
SELECT d.det_id, {area("d.")} / (d.width * d.height) AS area_ratio, {aspect("d.")} AS aspect, {elong("d.")} AS elongation, coalesce(mc, 0) AS max_containment, coalesce(mi, 0) AS max_iou_same_label, coalesce(cc, 0) AS contains_count, coalesce(cb, 0) AS contained_by_count FROM det d LEFT JOIN g USING (det_id)""",
)
def geometry_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.geometry_features(detections(spark, sf_dir))


_GRAPH = f"""e AS (SELECT a.image_id, CASE WHEN {area("a.")} >= {area("b.")} THEN a.det_id ELSE b.det_id END AS parent_id, CASE WHEN {area("a.")} >= {area("b.")} THEN b.det_id ELSE a.det_id END AS child_id,
  {inter("a.", "b.")} / greatest({union("a.", "b.")}, 1e-6) AS iou, {inter("a.", "b.")} AS inter, {inter("a.", "b.")} / greatest(least({area("a.")}, {area("b.")}), 1e-6) AS containment,
  {inter("a.", "b.")} / greatest({area("a.")}, {area("b.")}, 1e-6) AS child_coverage, least({area("a.")}, {area("b.")}) / greatest({area("a.")}, {area("b.")}, 1e-6) AS area_ratio,
  sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2) / sqrt(340.0 ** 2 + 260.0 ** 2) AS centre_distance,
  least({aspect("a.")}, {aspect("b.")}) / greatest({aspect("a.")}, {aspect("b.")}, 1e-6) AS aspect_similarity, a.label = b.label AS label_agreement
  FROM det a JOIN det b ON a.image_id = b.image_id AND a.det_id < b.det_id AND {inter("a.", "b.")} > 0),
edges AS (SELECT *, CASE WHEN containment >= 0.9 THEN 'containment' ELSE 'overlap' END AS edge_type FROM e WHERE containment >= 0.5 OR iou >= 0.1)"""


@query("g1_box_graph", f"{DET}, {_GRAPH} SELECT * FROM edges")
def box_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.box_graph(detections(spark, sf_dir))


_STATS = f"""j AS (SELECT e.parent_id, e.inter, c.label, (c.x1 + c.x2) / 2 AS cx, (c.y1 + c.y2) / 2 AS cy, {area("p.")} AS parent_area FROM edges e JOIN det c ON c.det_id = e.child_id JOIN det p ON p.det_id = e.parent_id WHERE e.containment >= 0.9),
m AS (SELECT parent_id, count(*) AS children, count(DISTINCT label) AS diversity, sum(inter) AS inter, max(parent_area) AS parent_area, var_pop(cx) AS vx, var_pop(cy) AS vy, covar_pop(cx, cy) AS vxy, avg(CASE WHEN label = 'crack' THEN 1.0 ELSE 0.0 END) AS crack_ratio FROM j GROUP BY parent_id),
l AS (SELECT *, (vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + vxy ** 2) AS l1, (vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + vxy ** 2) AS l2 FROM m),
stats AS (SELECT parent_id, children, diversity, least(1.0, inter / greatest(parent_area, 1e-6)) AS coverage, CASE WHEN children = 1 THEN 1.0 WHEN l1 <= 1e-6 THEN 0.0 ELSE 1 - greatest(l2, 0.0) / greatest(l1, 1e-6) END AS alignment, crack_ratio FROM l)"""


@query("g3_child_stats", f"{DET}, {_GRAPH}, {_STATS} SELECT parent_id, children, diversity, round(coverage, 6) AS coverage, round(alignment, 6) AS alignment, round(crack_ratio, 6) AS crack_ratio FROM stats")
def child_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pairs.child_stats(detections(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("coverage", "alignment", "crack_ratio")})


@query(
    "g4_box_quality",
    f"""{DET}, {_GRAPH}, {_STATS}, i AS (SELECT parent_id AS det_id FROM edges WHERE containment >= 0.9 UNION SELECT child_id FROM edges WHERE containment >= 0.9),
f AS (SELECT d.det_id, d.label, d.score, 0.9 * d.score AS sem, d.score * 0.12 AS margin, {elong("d.")} AS elong, {area("d.")} / 88400.0 AS ratio, s.*, coalesce(s.children, 0) AS n, i.det_id IS NOT NULL AS involved FROM det d LEFT JOIN stats s ON s.parent_id = d.det_id LEFT JOIN i ON i.det_id = d.det_id),
x AS (SELECT *, n >= 2 AND coalesce(diversity, 0) > 1 AS composite, ratio >= 0.25 AND coalesce(coverage, 0) <= 0.35 AND sem <= 0.65 AS broad, label = 'crack' AND elong >= 3 AND CASE WHEN n = 0 THEN sem >= 0.75 AND margin >= 0.05 ELSE crack_ratio >= 0.75 AND alignment >= 0.60 END AS long_crack FROM f),
y AS (SELECT *, CASE WHEN long_crack THEN 'keep_long_crack' WHEN composite THEN 'composite_parent' WHEN broad THEN 'broad_box' ELSE 'keep' END AS decision FROM x)
SELECT det_id, round(least(greatest(0.25 * score + 0.25 * sem + 0.15 * least(1.0, margin / 0.10) - 0.2 * broad::INT - 0.2 * composite::INT, 0.0), 1.0), 6) AS quality, decision, CASE WHEN decision <> 'keep' THEN decision WHEN involved THEN 'box_graph_checked' ELSE 'no_box_conflict' END AS reason FROM y""",
)
def box_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs.box_quality(detections(spark, sf_dir), 0.9 * F.col("score"), F.col("score") * 0.12)
    return out.withColumn("quality", F.round("quality", 6))


_TRUTH = f"{DET}, t AS (SELECT * FROM det WHERE detector = 'F'), q AS (SELECT * FROM det WHERE detector = 'O')"


@query(
    "j16_best_truth",
    f"""{_TRUTH}, j AS (SELECT q.det_id AS pred_id, t.det_id AS truth, coalesce({iou("q.", "t.")}, 0.0) AS iou FROM q LEFT JOIN t ON q.image_id = t.image_id AND q.label = t.label),
r AS (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY iou DESC, truth) AS n FROM j) SELECT pred_id, CASE WHEN truth IS NULL THEN 0.0 ELSE iou END AS best_iou, CASE WHEN iou > 0 THEN truth END AS truth_id FROM r WHERE n = 1""",
)
def best_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return pairs.best_truth(d.where("detector = 'O'"), d.where("detector = 'F'"))


@query(
    "b13_union_coverage",
    f"""{_TRUTH}, tc AS (SELECT DISTINCT image_id, px, unnest(range(y1::BIGINT, y2::BIGINT)) AS py FROM (SELECT image_id, unnest(range(x1::BIGINT, x2::BIGINT)) AS px, y1, y2 FROM t)),
qc AS (SELECT DISTINCT image_id, px, unnest(range(y1::BIGINT, y2::BIGINT)) AS py FROM (SELECT image_id, unnest(range(x1::BIGINT, x2::BIGINT)) AS px, y1, y2 FROM q))
SELECT image_id, count(qc.px) / count(*) AS covered FROM tc LEFT JOIN qc USING (image_id, px, py) GROUP BY image_id""",
)
def union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return pairs.coverage(d.where("detector = 'F'"), d.where("detector = 'O'"))


@query("b14_zero_overlap", f"{_TRUTH} SELECT det_id, image_id FROM q WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.image_id = q.image_id AND {inter('q.', 't.')} > 0)")
def zero_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return pairs.without_overlap(d.where("detector = 'O'"), d.where("detector = 'F'")).select("det_id", "image_id")


def _nms_sql(test: str, keys: str, most: str = "") -> str:
    """Greedy suppression as a reduction over lists of one box each. test: over k (kept) and b (next)."""
    inner = test.replace("b.", "b[1].")
    return f"""{DET}, lists AS (SELECT {keys}, list([{{'det_id': det_id, 'label': label, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY score DESC, det_id) AS l FROM det GROUP BY {keys}),
kept AS (SELECT unnest(list_reduce(l, lambda kept, b: CASE WHEN {most}len(list_filter(kept, lambda k: {inner})) > 0 THEN kept ELSE list_concat(kept, b) END)) AS k FROM lists)
SELECT k.det_id AS det_id FROM kept"""


def _ids(df: DataFrame) -> DataFrame:
    return df.select("det_id")


@query("n1_nms_agnostic", _nms_sql(f"{iou('k.', 'b.')} >= 0.3", "image_id", "len(kept) >= 5 OR "))
def nms_agnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(suppress.nms(detections(spark, sf_dir), 0.3, max_kept=5))


@query("n2_nms_per_label", _nms_sql(f"{iou('k.', 'b.')} > 0.28", "image_id, label"))
def nms_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(suppress.nms(detections(spark, sf_dir), 0.28, per_label=True, strict=True))


@query("n3_nms_strict", _nms_sql(f"{iou('k.', 'b.')} > 0.5", "image_id"))
def nms_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(suppress.nms(detections(spark, sf_dir), 0.5, strict=True))


@query(
    "n4_parent_filter",
    f"""{DET}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS pos FROM det)
SELECT a.det_id FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.image_id = a.image_id AND b.pos < a.pos AND {area("b.")} < {area("a.")} AND {area("b.")} > 0 AND {inter("a.", "b.")} / {area("b.")} >= 0.7)""",
)
def parent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(suppress.parent_filter(detections(spark, sf_dir)))


_T = f"""f AS (SELECT a.image_id, {iou("a.", "b.")} AS iou, {contain("a.", "b.")} AS con, least({area("a.")}, {area("b.")}) / greatest({area("a.")}, {area("b.")}) AS ratio FROM det a JOIN det b ON a.image_id = b.image_id AND a.det_id < b.det_id),
t AS (SELECT image_id, coalesce(least(greatest(quantile_cont(CASE WHEN iou > 0.02 THEN iou END, 0.72), 0.38), 0.62), 0.5) AS iou_t, coalesce(least(greatest(quantile_cont(CASE WHEN con > 0.5 THEN con END, 0.80), 0.82), 0.94), 0.88) AS contain_t,
  coalesce(least(greatest(quantile_cont(CASE WHEN con > 0.5 THEN ratio END, 0.35), 0.25), 0.55), 0.35) AS area_t FROM f GROUP BY image_id)"""


@query("n5_adaptive_thresholds", f"{DET}, {_T} SELECT image_id, round(iou_t, 6) AS iou_t, round(contain_t, 6) AS contain_t, round(area_t, 6) AS area_t FROM t")
def adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.adaptive_thresholds(detections(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("iou_t", "contain_t", "area_t")})


_QUALITY = f"0.68 * score + 0.14 * CASE WHEN label = 'crack' THEN least(greatest(ln({elong('')}) / ln(10.0), 0.0), 1.0) WHEN label IN ('mold', 'spall') THEN 1 - least(greatest(({elong('')} - 1) / 8, 0.0), 1.0) ELSE 0.5 END + 0.10 * (1 - least(greatest({area('')} / (width * height) / CASE WHEN label = 'crack' THEN 0.06 ELSE 0.20 END, 0.0), 1.0)) + 0.08 * CASE WHEN detector = 'F' THEN 1.0 ELSE 0.92 END"


@query(
    "n6_adaptive_filter",
    f"""{DET}, {_T}, q AS (SELECT det.*, {_QUALITY} AS quality, coalesce(t.iou_t, 0.5) AS iou_t FROM det LEFT JOIN t USING (image_id)),
lists AS (SELECT image_id, list([{{'det_id': det_id, 'label': label, 'prompt_key': prompt_key, 'quality': quality, 'iou_t': iou_t, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY round(quality, 9) DESC, det_id) AS l FROM q GROUP BY image_id),
kept AS (SELECT image_id, unnest(list_reduce(l, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k: {iou('k.', 'b.').replace('b.', 'b[1].')} >= CASE WHEN k.label = b[1].label THEN b[1].iou_t ELSE greatest(0.42, b[1].iou_t) END)) > 0 THEN kept ELSE list_concat(kept, b) END)) AS k FROM lists)
SELECT image_id, k.det_id AS det_id, k.prompt_key AS prompt_key, round(k.quality, 6) AS quality FROM kept""",
)
def adaptive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.adaptive_filter(detections(spark, sf_dir)).select("image_id", "det_id", "prompt_key", F.round("quality", 6).alias("quality"))


@query("n7_weighted_fusion")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suppress.weighted_fusion(detections(spark, sf_dir), 0.3)
    return out.withColumns({c: F.round(c, 4) for c in ("x1", "y1", "x2", "y2")})


_TURNED = "cos((k.det_id % 7) - (b[1].det_id % 7))"


@query(
    "n8_embedding_dedup",
    f"""{DET}, lists AS (SELECT image_id, list([{{'det_id': det_id, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY score DESC, det_id) AS l FROM det GROUP BY image_id),
kept AS (SELECT image_id, unnest(list_reduce(l, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k: {iou('k.', 'b.').replace('b.', 'b[1].')} >= 0.2 AND {_TURNED} >= 0.5)) > 0 THEN kept ELSE list_concat(kept, b) END)) AS k FROM lists),
m AS (SELECT d.image_id, d.det_id, k.det_id AS into_id FROM det d JOIN kept USING (image_id) WHERE {iou('d.', 'k.')} >= 0.2 AND cos((d.det_id % 7) - (k.det_id % 7)) >= 0.5 QUALIFY row_number() OVER (PARTITION BY d.image_id, d.det_id ORDER BY k.score DESC, k.det_id) = 1)
SELECT image_id, det_id, det_id = into_id AS kept, CASE WHEN det_id <> into_id THEN into_id END AS merged_into FROM m""",
)
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes merge only if their vectors are alike too: directions, by the id."""
    turn = F.col("det_id") % 7
    return suppress.embedding_dedup(detections(spark, sf_dir).withColumn("v", F.array(F.cos(turn), F.sin(turn))), 0.2, 0.5)


@query("n9_merge_touching")
def merge_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.merge_touching(detections(spark, sf_dir))


@query("n10_annotation_dedupe", _nms_sql(f"{iou('k.', 'b.')} >= 0.95", "image_id, label"))
def annotation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(suppress.nms(detections(spark, sf_dir), 0.95, per_label=True))


@query("n11_quantised_dedupe", f"{DET} SELECT min(det_id) AS det_id FROM det GROUP BY image_id, floor(x1 / 2), floor(y1 / 2), floor(x2 / 2), floor(y2 / 2)")
def quantised_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(suppress.quantised_dedupe(detections(spark, sf_dir)))


@query(
    "n12_nested_suppression",
    f"""{DET}, {_GRAPH}, x AS (SELECT e.*, p.label = 'crack' AND {elong("p.")} >= 3 AS long_crack, p.score AS parent_q, c.score AS child_q FROM edges e JOIN det p ON p.det_id = parent_id JOIN det c ON c.det_id = child_id WHERE containment >= 0.9 AND label_agreement)
SELECT DISTINCT CASE WHEN long_crack THEN child_id WHEN abs(parent_q - child_q) < 0.05 THEN parent_id WHEN parent_q < child_q THEN parent_id ELSE child_id END AS det_id FROM x""",
)
def nested_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.nested_drops(detections(spark, sf_dir))


@query(
    "n12_nested_kept",
    f"""{DET}, {_GRAPH}, x AS (SELECT e.*, p.label = 'crack' AND {elong("p.")} >= 3 AS long_crack, p.score AS parent_q, c.score AS child_q FROM edges e JOIN det p ON p.det_id = parent_id JOIN det c ON c.det_id = child_id WHERE containment >= 0.9 AND label_agreement)
SELECT det_id FROM det WHERE det_id NOT IN (SELECT CASE WHEN long_crack THEN child_id WHEN abs(parent_q - child_q) < 0.05 THEN parent_id WHEN parent_q < child_q THEN parent_id ELSE child_id END FROM x)""",
)
def nested_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the nested pairs leave."""
    return suppress.nested_kept(detections(spark, sf_dir))


@query("n13_global_cap", f"{DET} SELECT det_id FROM det QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) <= 2")
def global_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(suppress.cap(detections(spark, sf_dir), 2))


@query(
    "x1_tiles",
    """WITH img AS (SELECT o_orderkey AS image_id, 300 + o_orderkey % 700 AS w, 200 + o_custkey % 500 AS h FROM orders),
xs AS (SELECT image_id, w, h, unnest(list_distinct(list_concat(list_filter(range(0, w, 192), lambda x: x + 256 < w), [greatest(w - 256, 0)]))) AS x FROM img)
SELECT image_id, x AS x1, y AS y1, least(x + 256, w) AS x2, least(y + 256, h) AS y2 FROM (SELECT *, unnest(list_distinct(list_concat(list_filter(range(0, h, 192), lambda y: y + 256 < h), [greatest(h - 256, 0)]))) AS y FROM xs)""",
)
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    images = orders.select(F.col("o_orderkey").alias("image_id"), (300 + F.col("o_orderkey") % 700).alias("w"), (200 + F.col("o_custkey") % 500).alias("h"))
    return tiles.grid(images, 256, 64)


@query(
    "x2_tile_fusion",
    f"""{DET}, t AS (SELECT image_id, floor(x1 / 32)::INT AS cx, floor(y1 / 32)::INT AS cy, score, 0.05 + 0.5 - 0.5 * cos(2 * pi() * (det_id % 17) / 16) AS weight FROM det)
SELECT image_id, cx, cy, round(sum(score * weight) / sum(weight), 9) AS value FROM t GROUP BY image_id, cx, cy""",
)
def tile_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).select("image_id", F.floor(F.col("x1") / 32).cast("int").alias("cx"), F.floor(F.col("y1") / 32).cast("int").alias("cy"), F.col("score").alias("value"), (0.05 + tiles.hann(F.col("det_id") % 17, 17)).alias("weight"))
    return tiles.fuse(d, ["image_id", "cx", "cy"]).withColumn("value", F.round("value", 9))
