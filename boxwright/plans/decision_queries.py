"""Queries of the labelling layer: votes, decisions, reliability, policy, prototypes, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions.labels import ALIASES_ENSEMBLE, by_alias
from boxwright.operators import decide, prototypes, votes
from boxwright.plans.core import query
from boxwright.sources.views import SQL_DETECTIONS, detections, read

DET = f"WITH {SQL_DETECTIONS}"

#: Signals of other models on a detection: a fixture in words that both engines read alike.
SIGNALS = {
    "clip_label": "CASE det_id % 4 WHEN 0 THEN 'crack' WHEN 1 THEN 'mold' WHEN 2 THEN 'spall' ELSE label END",
    "clip_score": "((det_id * 13) % 100) / 1e2",
    "second_score": "((det_id * 7) % 50) / 1e2",
    "proto_label": "CASE det_id % 6 WHEN 0 THEN 'crack' WHEN 1 THEN 'mold' WHEN 2 THEN 'spall' WHEN 3 THEN 'reject' WHEN 4 THEN label END",
    "proto_sim": "CASE WHEN det_id % 6 < 5 THEN ((det_id * 29) % 200 - 60) / 1.4e2 END",
    "proto_margin": "CASE WHEN det_id % 6 < 5 THEN ((det_id * 31) % 20) / 1e2 END",
    "core_label": "CASE det_id % 5 WHEN 0 THEN 'crack' WHEN 1 THEN 'mold' WHEN 2 THEN label WHEN 3 THEN label END",
    "core_sim": "CASE WHEN det_id % 5 < 4 THEN ((det_id * 37) % 200 - 40) / 1.6e2 END",
    "density": "CASE WHEN det_id % 5 < 3 THEN ((det_id * 3) % 100) / 1e2 END",
    "geometry": "CASE WHEN det_id % 7 < 6 THEN ((det_id * 43) % 100) / 1e2 END",
    "box_type": "CASE det_id % 23 WHEN 0 THEN 'suspect_broad' WHEN 1 THEN 'drop_nested_duplicate' ELSE 'keep' END",
    "outlier_type": "CASE det_id % 29 WHEN 0 THEN 'rare_cluster' WHEN 1 THEN 'noise_cluster' END",
}
_SIG = f"{DET}, sig AS (SELECT det_id AS result_id, image_id, label, score, prompt_key, {', '.join(f'{e} AS {k}' for k, e in SIGNALS.items())} FROM det)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return d.select(F.col("det_id").alias("result_id"), "image_id", "label", "score", "prompt_key", *[F.expr(e).alias(k) for k, e in SIGNALS.items()])


def ballots(*leave_out: str) -> Column:
    named = {"detector": ("label", "score"), "clip": ("clip_label", "clip_score"), "prototype": ("proto_label", "proto_sim"), "core": ("core_label", "core_sim")}
    return votes.ballots(**{k: (F.col(a), F.col(b)) for k, (a, b) in named.items() if k not in leave_out})


_BALLOTS = f"""{_SIG}, v AS (SELECT result_id, 'detector' AS source, label, score FROM sig UNION ALL SELECT result_id, 'clip', clip_label, clip_score FROM sig UNION ALL SELECT result_id, 'prototype', proto_label, proto_sim FROM sig WHERE proto_label IS NOT NULL UNION ALL SELECT result_id, 'core', core_label, core_sim FROM sig WHERE core_label IS NOT NULL),
vc AS (SELECT result_id, label, count(*) AS n, count(*) FILTER (score >= 0.7) AS strong FROM v GROUP BY ALL),
vr AS (SELECT *, sum(n) OVER (PARTITION BY result_id) AS total, row_number() OVER (PARTITION BY result_id ORDER BY n DESC, label) AS place FROM vc),
agree AS (SELECT result_id, max(label) FILTER (place = 1) AS majority_label, max(n / total) FILTER (place = 1) AS agreement_ratio, max(strong) FILTER (place = 1) AS strong_agreement_count, coalesce(list(label ORDER BY label) FILTER (place > 1), []) AS conflict_labels, -sum(n / total * ln(n / total)) AS entropy FROM vr GROUP BY result_id)"""


@query("a9_majority_vote", f"{_BALLOTS} SELECT result_id, majority_label, agreement_ratio, strong_agreement_count, array_to_string(conflict_labels, ',') AS conflict_labels, round(entropy, 6) + 0.0 AS entropy FROM agree")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = votes.majority(signals(spark, sf_dir), ballots())
    return out.select("result_id", "majority_label", "agreement_ratio", "strong_agreement_count", F.array_join("conflict_labels", ",").alias("conflict_labels"), (F.round("entropy", 6) + 0.0).alias("entropy"))


#: Prompts of the detector, by their key.
_PROMPT = "CASE prompt_key WHEN 'p0' THEN 'Wall fissure' WHEN 'p1' THEN 'moss, mildew' ELSE 'other' END"


@query("d1_ensemble", f"{_SIG}, v AS (SELECT result_id, label, score FROM sig UNION ALL SELECT result_id, clip_label, clip_score FROM sig UNION ALL SELECT result_id, CASE prompt_key WHEN 'p0' THEN 'crack' ELSE 'mold' END, score FROM sig WHERE prompt_key <> 'p2'), c AS (SELECT result_id, label, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY n DESC, label) AS place, sum(n) OVER (PARTITION BY result_id) AS total FROM c) SELECT result_id, label AS majority_label, n / total AS agreement_ratio, total::INT AS votes FROM r WHERE place = 1")
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector, second model and, where its words tell a label, the detector's prompt."""
    s = signals(spark, sf_dir)
    prior = by_alias(F.expr(_PROMPT), ALIASES_ENSEMBLE)
    cast = votes.ballots(detector=(F.col("label"), F.col("score")), clip=(F.col("clip_label"), F.col("clip_score")), prompt=(prior, F.col("score")))
    return votes.majority(s.withColumn("cast", cast), F.col("cast")).select("result_id", "majority_label", "agreement_ratio", F.size("cast").alias("votes"))


_WIN = """top AS (SELECT *, max(n) OVER (PARTITION BY result_id) AS most FROM (SELECT result_id, label, count(*) AS n FROM v WHERE source <> 'clip' GROUP BY ALL)),
win AS (SELECT result_id, CASE WHEN count(*) = 1 AND max(n) >= 2 THEN max(label) END AS winner FROM top WHERE n = most GROUP BY result_id)"""


@query("a10_unique_winner", f"{_BALLOTS}, {_WIN} SELECT * FROM win")
def unique_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.unique_winner(signals(spark, sf_dir), ballots("clip")).select("result_id", "winner")


_SEED = """ini AS (SELECT s.result_id, s.label AS initial_label, CASE s.prompt_key WHEN 'p0' THEN s.label END AS seed_label, s.clip_label, s.clip_score,
  CASE WHEN s.prompt_key = 'p0' THEN s.score ELSE s.clip_score END AS top_score, s.second_score, coalesce(CASE s.prompt_key WHEN 'p0' THEN s.label END, s.clip_label) = s.label AS detector_agrees, a.majority_label, a.agreement_ratio, a.strong_agreement_count
  FROM sig s JOIN agree a USING (result_id)),
i1 AS (SELECT *, coalesce(seed_label, clip_label) AS top, greatest(0.0, top_score - second_score) AS margin, coalesce(seed_label, clip_label) = clip_label AS ca FROM ini),
i2 AS (SELECT *, least(greatest(0.25 * top_score + 0.15 * least(1.0, margin / 0.1) + 0.45 * detector_agrees::INT + 0.05 * ca::INT - 0.08 * (NOT detector_agrees)::INT + CASE WHEN agreement_ratio >= 0.75 AND strong_agreement_count >= 1 THEN 0.08 WHEN agreement_ratio <= 0.5 THEN -0.18 ELSE 0 END, 0.0), 1.0) AS reliability FROM i1),
i3 AS (SELECT *, majority_label <> top AND agreement_ratio >= 0.75 AS relabel, agreement_ratio <= 0.5 AS low, reliability >= 0.75 AND margin >= 0.03 AS accepted, reliability < 0.5 OR margin < 0.03 AS weak FROM i2)"""


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    seed = F.when(F.col("prompt_key") == "p0", F.col("label"))
    return votes.majority(s, ballots()).select("result_id", F.col("label").alias("initial_label"), seed.alias("seed_label"), "clip_label", "clip_score", F.when(seed.isNotNull(), F.col("score")).otherwise(F.col("clip_score")).alias("top_score"), "second_score", (F.coalesce(seed, "clip_label") == F.col("label")).alias("detector_agrees"), "majority_label", "agreement_ratio", "strong_agreement_count")


@query(
    "d2_initial_decision",
    f"""{_BALLOTS}, {_SEED} SELECT result_id, top AS suggested_label, CASE WHEN relabel THEN majority_label ELSE top END AS final_label, CASE WHEN relabel THEN 'relabel_candidate' WHEN low THEN 'suspect' WHEN accepted THEN 'auto_accept' ELSE 'suspect' END AS decision_type, round(reliability, 6) AS reliability,
  concat_ws(',', CASE WHEN seed_label IS NOT NULL THEN 'detector_seed_label' END, CASE WHEN NOT detector_agrees THEN 'detector_semantic_conflict' END, CASE WHEN top_score >= 0.75 AND margin >= 0.1 THEN 'high_consensus' END, CASE WHEN margin < 0.03 THEN 'low_margin' END, CASE WHEN NOT (relabel OR low OR accepted) AND weak AND margin >= 0.03 THEN 'low_semantic_reliability' END, CASE WHEN relabel THEN 'majority_relabels_openclip' END, CASE WHEN agreement_ratio >= 0.75 THEN 'model_agreement_high' END, CASE WHEN low THEN 'model_disagreement' END, CASE WHEN NOT (relabel OR low OR accepted OR weak) THEN 'needs_core_or_prototype_evidence' END, CASE WHEN NOT ca THEN 'openclip_seed_conflict' END, CASE WHEN top <> initial_label THEN 'top_score_differs_from_initial_label' END) AS some_reasons FROM i3""",
)
def initial_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide.initial(seeded(spark, sf_dir))
    # in the SQL's order
    order = ["detector_seed_label", "detector_semantic_conflict", "high_consensus", "low_margin", "low_semantic_reliability", "majority_relabels_openclip", "model_agreement_high", "model_disagreement", "needs_core_or_prototype_evidence", "openclip_seed_conflict", "top_score_differs_from_initial_label"]
    listed = F.concat_ws(",", *[F.when(F.array_contains("reasons", r), r) for r in order])
    return out.select("result_id", "suggested_label", "final_label", "decision_type", F.round("reliability", 6).alias("reliability"), listed.alias("some_reasons"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    rows = votes.majority(s, ballots()).select(
        "result_id",
        F.col("label").alias("initial_label"),
        F.col("label").alias("final_label"),
        F.col("clip_score").alias("semantic"),
        F.col("agreement_ratio").alias("agreement"),
        F.greatest(F.lit(0.0), F.col("score") - F.col("second_score")).alias("margin"),
        (F.col("clip_label") == F.col("label")).cast("double").alias("detector_agreement"),
        "proto_label",
        "proto_sim",
        "proto_margin",
        (F.col("proto_label") == "reject").alias("proto_reject"),
        "core_label",
        "core_sim",
        "density",
        F.lit(None).cast("double").alias("consistency"),
        "geometry",
        "outlier_type",
        F.col("box_type").startswith("suspect").alias("box_suspect"),
        F.array().cast("array<string>").alias("reasons"),
        "box_type",
    )
    return decide.reliability(rows)


_REL = f"""{_BALLOTS}, r0 AS (SELECT s.*, s.label AS final_label, a.agreement_ratio AS agreement, greatest(0.0, s.score - s.second_score) AS margin, (s.clip_label = s.label)::INT AS da, s.proto_label IS NOT NULL AS kp, s.core_label IS NOT NULL AS kc FROM sig s JOIN agree a USING (result_id)),
r1 AS (SELECT *, 0.08 * least(greatest(clip_score, 0.0), 1.0) + 0.08 * agreement + 0.05 * least(margin / 0.1, 1.0) + 0.12 * da
  + CASE WHEN kp THEN 0.28 * (0.75 * (proto_sim + 1) / 2 + 0.25 * least(greatest(proto_margin / 0.1, 0.0), 1.0)) * CASE WHEN proto_label <> label THEN 0.5 ELSE 1.0 END ELSE 0 END
  + CASE WHEN kc THEN 0.24 * (core_sim + 1) / 2 * CASE WHEN core_label <> label THEN 0.4 ELSE 1.0 END ELSE 0 END
  + CASE WHEN kc AND density IS NOT NULL THEN 0.04 * (density + 1) / 2 ELSE 0 END + CASE WHEN geometry IS NOT NULL THEN 0.08 * geometry ELSE 0 END AS v,
  0.33 + CASE WHEN kp THEN 0.28 ELSE 0 END + CASE WHEN kc THEN 0.24 ELSE 0 END + CASE WHEN kc AND density IS NOT NULL THEN 0.04 ELSE 0 END + CASE WHEN geometry IS NOT NULL THEN 0.08 ELSE 0 END AS w FROM r0),
r2 AS (SELECT *, least(greatest(v / w - CASE WHEN outlier_type IS NOT NULL THEN 0.25 ELSE 0 END, 0.0), 1.0) AS reliability, coalesce(proto_label = 'reject', false) AS near, geometry IS NOT NULL AND starts_with(box_type, 'suspect') AS gc, coalesce(core_label <> label, false) AS co, kp OR kc AS ev FROM r1),
r3 AS (SELECT *, reliability >= 0.75 AND ev AND NOT near AND NOT gc AS acc FROM r2),
r4 AS (SELECT *, NOT acc AND near AND coalesce(proto_sim >= 0.5, false) AS rej FROM r3),
r5 AS (SELECT *, NOT acc AND NOT rej AND (reliability < 0.5 OR co OR gc) AS weak FROM r4),
rel AS (SELECT *, CASE WHEN acc THEN 'auto_accept' WHEN rej THEN 'reject' ELSE 'suspect' END AS decision_type,
  list_sort(list_filter([CASE WHEN coalesce(proto_label <> label, false) THEN 'prototype_label_disagree' END, CASE WHEN near THEN 'near_reject_prototype' END, CASE WHEN NOT kp THEN 'missing_prototype_signal' END, CASE WHEN co THEN 'openclip_core_disagree' END,
  CASE WHEN coalesce(core_label = label AND core_sim < 0.4, false) THEN 'far_from_class_core' END, CASE WHEN NOT kc THEN 'missing_core_signal' END, CASE WHEN gc THEN 'geometry_conflict' END, CASE WHEN acc THEN 'high_consensus' END, CASE WHEN weak AND margin < 0.1 THEN 'low_margin' END,
  CASE WHEN NOT acc AND NOT rej AND NOT weak AND NOT ev THEN 'needs_core_or_prototype_evidence' END, outlier_type], lambda x: x IS NOT NULL)) AS reasons FROM r5)"""


@query("d8_reliability", f"{_REL} SELECT result_id, round(reliability, 6) AS reliability, decision_type, array_to_string(reasons, ',') AS reasons FROM rel")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("result_id", F.round("reliability", 6).alias("reliability"), "decision_type", F.array_join("reasons", ",").alias("reasons"))


CONFIG = decide.Policy(accept=0.75, suspect=0.5, min_similarity=0.6, low_priority=True, accept_by={"crack": 0.7}, suspect_by={"mold": 0.55}, similarity_by={"spall": 0.65})
_LEAST = lambda label: f"CASE WHEN {label} = 'spall' THEN 0.65 ELSE 0.6 END"
_POL = f"""{_REL}, p1 AS (SELECT *, list_has_any(reasons, [{", ".join(f"'{x}'" for x in decide.CONFLICTS)}]) AS conflict FROM rel),
p2 AS (SELECT *, CASE WHEN near AND (coalesce(proto_label, '') NOT IN ('crack', 'mold', 'spall') OR proto_sim IS NULL OR proto_sim < {_LEAST("label")}) AND (core_sim IS NULL OR core_sim < {_LEAST("label")}) THEN 'reject_near_reject_prototype_low_damage_similarity'
  WHEN reliability >= CASE WHEN label = 'crack' THEN 0.7 ELSE 0.75 END AND acc AND NOT conflict THEN 'auto_accept_high_consensus'
  WHEN kc AND core_label <> label AND core_label <> 'reject' AND core_sim >= {_LEAST("core_label")} AND CASE WHEN coalesce(proto_label = label, false) THEN core_sim - proto_sim >= 0.05 ELSE coalesce(proto_margin, 0) >= 0.05 OR core_sim >= {_LEAST("core_label")} + 0.05 END THEN 'relabel_candidate_core_margin'
  WHEN reliability < CASE WHEN label = 'mold' THEN 0.55 ELSE 0.5 END OR conflict THEN 'suspect_low_reliability_or_conflict' ELSE 'auto_accept_low_priority' END AS matched_rule FROM p1),
pol AS (SELECT *, CASE WHEN starts_with(matched_rule, 'reject') THEN 'reject' WHEN matched_rule = 'auto_accept_high_consensus' THEN 'auto_accept' WHEN starts_with(matched_rule, 'relabel') THEN 'relabel_candidate' WHEN matched_rule = 'auto_accept_low_priority' THEN 'auto_accept_low_priority' ELSE 'suspect' END AS final_type,
  CASE WHEN starts_with(matched_rule, 'reject') THEN 'reject' WHEN starts_with(matched_rule, 'relabel') THEN core_label ELSE label END AS new_label FROM p2)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.policy(scored(spark, sf_dir), CONFIG)


@query("d9_decision_policy", f"{_POL} SELECT result_id, new_label AS final_label, final_type AS decision_type, matched_rule, round(reliability, 6) AS reliability FROM pol")
def decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("result_id", "final_label", "decision_type", "matched_rule", F.round("reliability", 6).alias("reliability"))


@query("decision_policy", f"{_POL} SELECT new_label AS final_label, final_type AS decision_type, matched_rule, count(*) AS n, round(avg(reliability), 6) AS mean_reliability FROM pol GROUP BY ALL")
def decision_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: signals to votes, reliability, policy and an overview."""
    return decided(spark, sf_dir).groupBy("final_label", "decision_type", "matched_rule").agg(F.count("*").alias("n"), F.round(F.avg("reliability"), 6).alias("mean_reliability"))


_OUT = f"{_POL}, o AS (SELECT result_id, new_label, final_type, reliability, box_type, box_type = 'keep' AS keep, ((result_id * 43) % 100) / 1e2 AS box_score FROM pol)"


def _boxes(rows: DataFrame) -> DataFrame:
    return rows.select("result_id", (F.col("box_type") == "keep").alias("keep"), "box_type", F.expr("((result_id * 43) % 100) / 1e2").alias("box_score"))


@query("d3_cleaned_labels", f"{_OUT} SELECT result_id, new_label AS label FROM o WHERE final_type IN ('auto_accept', 'auto_accept_low_priority') AND keep")
def cleaned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.outputs(decided(spark, sf_dir).drop("box_type"), _boxes(signals(spark, sf_dir)))[0]


@query("d10_review_queue", f"{_OUT} SELECT result_id, CASE WHEN starts_with(box_type, 'suspect') THEN box_type ELSE final_type END AS queue_type, round(CASE WHEN starts_with(box_type, 'suspect') THEN least(reliability, box_score) ELSE reliability END, 6) AS score FROM o WHERE (final_type IN ('suspect', 'reject', 'relabel_candidate') AND NOT starts_with(box_type, 'drop')) OR starts_with(box_type, 'suspect')")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.outputs(decided(spark, sf_dir).drop("box_type"), _boxes(signals(spark, sf_dir)))[1].select("result_id", "queue_type", F.round("score", 6).alias("score"))


@query("d10_policy_audit", f"{_POL} SELECT result_id, label AS previous_label, new_label, final_type AS decision_type, matched_rule, array_to_string(list_sort(list_distinct(list_concat(reasons, CASE WHEN starts_with(matched_rule, 'relabel') THEN ['core_relabel_candidate'] WHEN matched_rule = 'auto_accept_low_priority' THEN ['low_priority_accept'] ELSE [] END))), ',') AS reasons FROM pol")
def policy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each decision: what it was, what it became, by which rule and for which reasons."""
    return decided(spark, sf_dir).select("result_id", F.col("initial_label").alias("previous_label"), F.col("final_label").alias("new_label"), "decision_type", "matched_rule", F.array_join("reasons", ",").alias("reasons"))


@query(
    "d11_seed_relabel",
    f"{_BALLOTS}, {_WIN} SELECT s.result_id, s.label AS from_label, CASE WHEN coalesce(s.proto_label = 'reject' AND s.proto_sim >= 0.5, false) THEN 'reject' ELSE coalesce(w.winner, s.label) END AS to_label FROM sig s JOIN win w USING (result_id) WHERE CASE WHEN coalesce(s.proto_label = 'reject' AND s.proto_sim >= 0.5, false) THEN 'reject' ELSE coalesce(w.winner, s.label) END <> s.label",
)
def seed_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows that change."""
    s = signals(spark, sf_dir)
    j = votes.unique_winner(s, ballots("clip"))
    rejected = F.coalesce((F.col("proto_label") == "reject") & (F.col("proto_sim") >= 0.5), F.lit(False))
    to = F.when(rejected, "reject").otherwise(F.coalesce("winner", "label"))
    return j.select("result_id", F.col("label").alias("from_label"), to.alias("to_label")).where("from_label <> to_label")


@query("a13_label_flows", f"{_POL} SELECT label AS from_label, new_label AS to_label, count(*) AS n FROM pol GROUP BY ALL ORDER BY n DESC, from_label, to_label LIMIT 15")
def label_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).groupBy(F.col("initial_label").alias("from_label"), F.col("final_label").alias("to_label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_label", "to_label").limit(15)


RULES = [("crack", "crack"), ("mo", "mold"), ("spalling", None)]


@query(
    "d12_rule_decision",
    f"""{_SIG}, rules(query, to_label) AS (VALUES ('crack', 'crack'), ('mo', 'mold'), ('spalling', NULL)), p AS (SELECT result_id, 1 AS place, clip_label AS label, clip_score AS confidence FROM sig UNION ALL SELECT result_id, 2, label, score FROM sig),
h AS (SELECT p.result_id, to_label, row_number() OVER (PARTITION BY p.result_id ORDER BY place, query) AS n FROM p JOIN rules ON contains(lower(p.label), query) OR contains(query, lower(p.label)))
SELECT s.result_id, CASE WHEN s.clip_score < 0.2 THEN 'keep' WHEN h.result_id IS NULL THEN 'keep' WHEN to_label IS NULL THEN 'reject' ELSE 'accept' END AS decision, CASE WHEN s.clip_score >= 0.2 THEN to_label END AS label FROM sig s LEFT JOIN h ON h.result_id = s.result_id AND h.n = 1""",
)
def rule_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    one = lambda place, label, score: s.select("result_id", F.lit(place).alias("place"), F.col(label).alias("label"), F.col(score).alias("confidence"))
    return decide.first_matching_rule(one(1, "clip_label", "clip_score").unionByName(one(2, "label", "score")), spark.createDataFrame(RULES, "query string, label string"), 0.2, strict=False)


@query("d13_prototype_decision", f"{_SIG} SELECT result_id, CASE WHEN proto_label IS NULL THEN 'keep' WHEN proto_label = 'reject' THEN 'reject' WHEN proto_sim < 0.5 THEN 'keep' ELSE 'accept' END AS decision FROM sig")
def prototype_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("result_id", F.when(F.col("proto_label").isNull(), "keep").when(F.col("proto_label") == "reject", "reject").when(F.col("proto_sim") < 0.5, "keep").otherwise("accept").alias("decision"))


@query("d14_semantic_validation", f"{_SIG}, d AS (SELECT label, CASE WHEN core_sim >= 0.6 AND core_label = label AND core_sim - coalesce(proto_sim, 0) >= 0.05 THEN 'accept' WHEN coalesce(core_sim, 0) < 0.2 THEN 'reject' ELSE 'review' END AS decision FROM sig) SELECT label, decision, count(*) AS n FROM d GROUP BY ALL")
def semantic_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    accept = (F.col("core_sim") >= 0.6) & (F.col("core_label") == F.col("label")) & (F.col("core_sim") - F.coalesce("proto_sim", F.lit(0.0)) >= 0.05)
    return s.select("label", F.when(accept, "accept").when(F.coalesce("core_sim", F.lit(0.0)) < 0.2, "reject").otherwise("review").alias("decision")).groupBy("label", "decision").agg(F.count("*").alias("n"))


# Vectors: prototypes are every tenth vector, label 9 is the reject class.

_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_PROTO = f"""WITH p AS (SELECT vec_id AS proto_id, label, label = 9 AS is_reject, embedding AS v FROM embeddings WHERE vec_id % 10 = 0),
s AS (SELECT e.vec_id, p.proto_id, p.label, p.is_reject, round({_DOT("e.embedding", "p.v")}, 6) AS sim FROM embeddings e CROSS JOIN p),
l AS (SELECT vec_id, label, sim, proto_id, is_reject, row_number() OVER (PARTITION BY vec_id, label ORDER BY sim DESC, proto_id) AS n FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS place FROM l WHERE n = 1)"""


@query(
    "d5_prototype_scores",
    f"""{_PROTO} SELECT vec_id, max(label) FILTER (place = 1) AS top_label, max(sim) FILTER (place = 1) AS top_sim, max(proto_id) FILTER (place = 1) AS top_id, max(label) FILTER (place = 2) AS second_label, max(sim) FILTER (place = 2) AS second_sim,
  round(max(sim) FILTER (place = 1) - coalesce(max(sim) FILTER (place = 2), 0), 6) AS margin, bool_or(is_reject) FILTER (place = 1) AS is_reject_match, coalesce(max(sim) FILTER (place = 1) - max(sim) FILTER (place = 2) < 0.03, false) AS low_margin FROM r GROUP BY vec_id""",
)
def prototype_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    bank = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("proto_id"), "label", (F.col("label") == 9).alias("is_reject"), F.col("embedding").alias("v"))
    return prototypes.scores(e.select("vec_id", "embedding"), bank)


@query("w7_top_prototypes", f"{_PROTO} SELECT vec_id, place::INT AS place, proto_id, sim FROM (SELECT vec_id, proto_id, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, proto_id) AS place FROM s) WHERE place <= 3")
def top_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    bank = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("proto_id"), "label", (F.col("label") == 9).alias("is_reject"), F.col("embedding").alias("v"))
    return prototypes.top(e.select("vec_id", "embedding"), bank, 3)


_CENTRE = """c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
n AS (SELECT label, list(m ORDER BY i) AS m, sqrt(sum(m * m)) AS norm FROM c GROUP BY label),
cen AS (SELECT label, list_transform(m, lambda x: x / greatest(norm, 1e-12)) AS v FROM n)"""


@query("a12_centroids", f"WITH {_CENTRE} SELECT e.label, count(*) AS n, round(avg({_DOT('e.embedding', 'cen.v')}), 5) AS density, round(min({_DOT('e.embedding', 'cen.v')}), 5) AS least FROM embeddings e JOIN cen USING (label) GROUP BY e.label")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return prototypes.density(e, prototypes.centroids(e))


@query("d7_nearest_core", f"WITH {_CENTRE}, s AS (SELECT e.vec_id, cen.label, round({_DOT('e.embedding', 'cen.v')}, 6) AS sim FROM embeddings e CROSS JOIN cen) SELECT vec_id, label AS core_label, sim AS core_sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1")
def nearest_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return prototypes.nearest(e.select("vec_id", "embedding"), prototypes.centroids(e))


@query("o27_autoflag", f"WITH c AS (SELECT vec_id AS c_id, embedding AS v FROM embeddings WHERE vec_id % 25 = 0) SELECT e.vec_id FROM embeddings e CROSS JOIN c WHERE e.vec_id % 25 <> 0 GROUP BY e.vec_id HAVING max({_DOT('e.embedding', 'c.v')}) >= 0.3")
def autoflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return prototypes.flagged(e.where("vec_id % 25 <> 0"), e.where("vec_id % 25 = 0"), 0.3)


@query("o12_p_good", f"{_SIG} SELECT result_id, round(0.5 * least(greatest(coalesce(clip_score, 0.0), 0.0), 1.0) + 0.3 * score + 0.2 * least(greatest(coalesce(geometry, 0.0), 0.0), 1.0), 6) AS p_good FROM sig")
def p_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("result_id", F.round(prototypes.p_good(F.col("clip_score"), F.col("score"), F.col("geometry")), 6).alias("p_good"))


@query("o19_negative_anchor", f"{_SIG}, a AS (SELECT result_id, label, clip_score * (1 - 0.5 * least(greatest(coalesce(proto_sim, 0.0), 0.0), 1.0)) AS adjusted FROM sig) SELECT result_id, round(CASE WHEN sum(adjusted) OVER (PARTITION BY label) > 0 THEN adjusted / sum(adjusted) OVER (PARTITION BY label) ELSE 0.0 END, 9) AS share FROM a")
def negative_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes.anchored(signals(spark, sf_dir), "label", 0.5).select("result_id", F.round("share", 9).alias("share"))


@query("o23_calibration", "WITH r AS (SELECT source AS label, count(*) AS reviewed, count(*) FILTER (quality = 0 OR toxic = 1) AS wrong FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT label, reviewed, wrong / reviewed AS error_rate, round(least(0.15, 0.3 * wrong / reviewed), 6) AS threshold_delta FROM r")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed documents by source; sources without a review are left out."""
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    rate = F.count_if((F.col("quality") == 0) | (F.col("toxic") == 1)) / F.count("*")
    return j.groupBy(F.col("source").alias("label")).agg(F.count("*").alias("reviewed"), rate.alias("error_rate")).withColumn("threshold_delta", F.round(F.least(F.lit(0.15), 0.3 * F.col("error_rate")), 6))


@query("o25_upweighting", "SELECT doc_id, unnest(range(1, 1 + CASE WHEN toxic = 1 THEN 3 ELSE 1 END)) AS copy FROM labels WHERE quality IS NOT NULL")
def upweighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes.replicated(read(spark, sf_dir, "labels").where("quality is not null"), F.when(F.col("toxic") == 1, 3).otherwise(1)).select("doc_id", F.col("copy").cast("long").alias("copy"))
