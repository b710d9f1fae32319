"""Decisions on rows: initial decision, reliability, policy, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.boxes import clip01
from boxwright.functions.labels import DAMAGE, REJECT
from boxwright.functions.stored import stored
from boxwright.functions.vectors import unit
from boxwright.operators.products import block_product, parts

#: Weights of the reliability's parts, and codes that are a conflict.
WEIGHTS = {"semantic": 0.08, "agreement": 0.08, "margin": 0.05, "detector": 0.12, "prototype": 0.28, "core": 0.24, "density": 0.04, "consistency": 0.06, "geometry": 0.08}
OUTLIER_PENALTY = 0.25
CONFLICTS = ["openclip_core_disagree", "prototype_label_disagree", "near_reject_prototype", "geometry_conflict", "multi_crop_inconsistent", "rare_cluster", "noise_cluster", "insufficient_class_samples"]


@dataclass(frozen=True)
class Policy:
    accept: float = 0.75
    suspect: float = 0.50
    min_similarity: float = 0.70
    relabel_margin: float = 0.05
    low_priority: bool = False
    accept_by: dict[str, float] = field(default_factory=dict)
    suspect_by: dict[str, float] = field(default_factory=dict)
    similarity_by: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def of(by: dict[str, float], default: float, label: Column) -> Column:
        return F.coalesce(*[F.when(label == k, v) for k, v in by.items()], F.lit(default))


def codes(**when: Column) -> Column:
    """Names of the conditions that hold, sorted."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in sorted(when.items())]))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator: filters above are not written into the long CASE chains below, whose text would multiply."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def initial(rows: DataFrame, accept: float = 0.75, suspect: float = 0.5, low_margin: float = 0.03, strong_margin: float = 0.10, penalty: float = 0.08) -> DataFrame:
    """result_id, suggested_label, final_label, decision_type, reliability, reasons.

    rows: result_id, initial_label, seed_label (may be null), clip_label, clip_score, top_score, second_score, detector_agrees,
    majority_label, agreement_ratio, strong_agreement_count.
    """
    c = F.col
    r = rows.withColumn("top", F.coalesce("seed_label", "clip_label")).withColumn("margin", F.greatest(F.lit(0.0), c("top_score") - c("second_score")))
    agrees, clip_agrees = c("detector_agrees"), c("top") == c("clip_label")
    base = 0.25 * c("top_score") + 0.15 * F.least(F.lit(1.0), c("margin") / strong_margin) + 0.45 * agrees.cast("double") + 0.05 * clip_agrees.cast("double") - penalty * (~agrees).cast("double")
    high, low = c("agreement_ratio") >= 0.75, c("agreement_ratio") <= 0.50
    rel = clip01(base + F.when(high & (c("strong_agreement_count") >= 1), 0.08).when(low, -0.18).otherwise(0.0))
    r = r.withColumn("reliability", rel)
    is_reject, relabel = c("top").isin(REJECT), (c("majority_label") != c("top")) & high
    accepted = (c("reliability") >= accept) & (c("margin") >= low_margin)
    weak = (c("reliability") < suspect) | (c("margin") < low_margin)
    decision = F.when(is_reject, "reject").when(relabel, "relabel_candidate").when(low, "suspect").when(accepted, "auto_accept").otherwise("suspect")
    decided = is_reject | relabel | low | accepted
    reasons = codes(
        high_consensus=(c("top_score") >= accept) & (c("margin") >= strong_margin),
        low_margin=c("margin") < low_margin,
        detector_semantic_conflict=~agrees,
        detector_seed_label=c("seed_label").isNotNull(),
        openclip_seed_conflict=~clip_agrees,
        model_agreement_high=high,
        model_disagreement=low,
        near_reject_prototype=is_reject,
        majority_relabels_openclip=~is_reject & relabel,
        low_semantic_reliability=~decided & weak & ~(c("margin") < low_margin),
        needs_core_or_prototype_evidence=~decided & ~weak,
        top_score_differs_from_initial_label=c("top") != c("initial_label"),
    )
    final = F.when(is_reject, "reject").when(relabel, c("majority_label")).otherwise(c("top"))
    return r.select("result_id", c("top").alias("suggested_label"), final.alias("final_label"), decision.alias("decision_type"), "reliability", reasons.alias("reasons"))


def reliability(rows: DataFrame, accept: float = 0.75, suspect: float = 0.5, strong_margin: float = 0.10, reject_similarity: float = 0.5) -> DataFrame:
    """The rows with reliability, decision_type and reasons (earlier codes kept): a weighted mean over the parts that are there.

    rows: final_label, semantic, agreement, margin, detector_agreement, proto_label, proto_sim, proto_margin, proto_reject, core_label,
    core_sim, density, consistency, geometry, outlier_type, box_suspect, reasons.
    """
    c = F.col
    known = c("proto_label").isNotNull()
    proto = (0.75 * unit(c("proto_sim")) + 0.25 * clip01(c("proto_margin") / 0.10)) * F.when(c("proto_label") != c("final_label"), 0.5).otherwise(1.0)
    core = unit(c("core_sim")) * F.when(c("core_label") != c("final_label"), 0.4).otherwise(1.0)
    parts = {
        "semantic": clip01(c("semantic")),
        "agreement": clip01(F.coalesce("agreement", F.lit(0.0))),
        "margin": clip01(c("margin") / strong_margin),
        "detector": clip01(c("detector_agreement")),
        "prototype": F.when(known, proto),
        "core": F.when(c("core_label").isNotNull(), core),
        "density": F.when(c("core_label").isNotNull(), unit(c("density"))),
        "consistency": clip01(c("consistency")),
        "geometry": clip01(c("geometry")),
    }
    # greatest() and least() pass over nulls, so a part is looked up by its source
    there = {"consistency": c("consistency").isNotNull(), "geometry": c("geometry").isNotNull(), "prototype": known, "core": c("core_label").isNotNull(), "density": c("core_label").isNotNull() & c("density").isNotNull()}
    total = reduce(Column.__add__, (F.when(there.get(k, F.lit(True)), WEIGHTS[k]).otherwise(0.0) for k in parts))
    value = reduce(Column.__add__, (F.when(there.get(k, F.lit(True)), WEIGHTS[k] * v).otherwise(0.0) for k, v in parts.items()))
    outlier = c("outlier_type").isNotNull()
    rel = clip01(value / total - OUTLIER_PENALTY * outlier.cast("double"))
    near, geometry = F.coalesce(c("proto_reject"), F.lit(False)), there["geometry"] & c("box_suspect")
    core_off = F.coalesce(c("core_label") != c("final_label"), F.lit(False))
    evidence = known | c("core_label").isNotNull()
    r = rows.withColumn("reliability", rel)
    near = near | F.array_contains("reasons", "near_reject_prototype")
    accepted = (c("reliability") >= accept) & evidence & ~near & ~geometry
    rejected = ~accepted & near & F.coalesce(c("proto_sim") >= reject_similarity, F.lit(False))
    weak = ~accepted & ~rejected & ((c("reliability") < suspect) | core_off | geometry)
    added = codes(
        prototype_label_disagree=F.coalesce(c("proto_label") != c("final_label"), F.lit(False)),
        near_reject_prototype=near,
        missing_prototype_signal=~known,
        openclip_core_disagree=core_off,
        far_from_class_core=F.coalesce((c("core_label") == c("final_label")) & (c("core_sim") < 0.40), F.lit(False)),
        missing_core_signal=c("core_label").isNull(),
        multi_crop_inconsistent=F.coalesce(c("consistency") < 0.60, F.lit(False)),
        geometry_conflict=geometry,
        high_consensus=accepted,
        low_margin=weak & (c("margin") < strong_margin),
        needs_core_or_prototype_evidence=~accepted & ~rejected & ~weak & ~evidence,
    )
    every = F.array_sort(F.array_distinct(F.concat("reasons", added, F.array_compact(F.array("outlier_type")))))
    decision = F.when(accepted, "auto_accept").when(rejected, "reject").otherwise("suspect")
    return settled(r.withColumns({"decision_type": decision, "reasons": every}))


def policy(rows: DataFrame, config: Policy = Policy()) -> DataFrame:
    """The rows with decision_type, final_label, matched_rule and reasons of the first rule that fits.

    rows: result_id, initial_label, final_label, reliability, reasons, proto_label, proto_sim, proto_margin, core_label, core_sim.
    """
    c = F.col
    least = lambda label: Policy.of(config.similarity_by, config.min_similarity, label)
    conflict = F.arrays_overlap("reasons", F.array(*map(F.lit, CONFLICTS)))
    proto_low = ~F.coalesce(c("proto_label").isin(DAMAGE), F.lit(False)) | c("proto_sim").isNull() | (c("proto_sim") < least(c("final_label")))
    core_low = c("core_sim").isNull() | (c("core_sim") < least(c("final_label")))
    rejects = F.array_contains("reasons", "near_reject_prototype") & proto_low & core_low
    accepts = (c("reliability") >= Policy.of(config.accept_by, config.accept, c("final_label"))) & F.array_contains("reasons", "high_consensus") & ~conflict
    usable = c("core_label").isNotNull() & c("core_sim").isNotNull() & (c("core_label") != "") & (c("core_label") != c("initial_label")) & (c("core_label") != "reject") & (c("core_sim") >= least(c("core_label")))
    by_initial = (c("proto_label") == c("initial_label")) & c("proto_sim").isNotNull()
    leads = F.when(F.coalesce(by_initial, F.lit(False)), c("core_sim") - c("proto_sim") >= config.relabel_margin).otherwise((F.coalesce("proto_margin", F.lit(0.0)) >= config.relabel_margin) | (c("core_sim") >= least(c("core_label")) + config.relabel_margin))
    relabels = F.coalesce(usable & leads, F.lit(False))
    doubtful = (c("reliability") < Policy.of(config.suspect_by, config.suspect, c("final_label"))) | conflict
    low = "auto_accept_low_priority" if config.low_priority else "suspect_low_priority_disabled"
    rule = F.when(rejects, "reject_near_reject_prototype_low_damage_similarity").when(accepts, "auto_accept_high_consensus").when(relabels, "relabel_candidate_core_margin").when(doubtful, "suspect_low_reliability_or_conflict").otherwise(low)
    out = rows.withColumn("matched_rule", rule)
    m = c("matched_rule")
    decision = F.when(m.startswith("reject"), "reject").when(m == "auto_accept_high_consensus", "auto_accept").when(m.startswith("relabel"), "relabel_candidate").when(m == "auto_accept_low_priority", "auto_accept_low_priority").otherwise("suspect")
    added = F.when(m.startswith("relabel"), F.array(F.lit("core_relabel_candidate"))).when(m == "auto_accept_low_priority", F.array(F.lit("low_priority_accept"))).otherwise(F.array().cast("array<string>"))
    final = F.when(m.startswith("reject"), "reject").when(m.startswith("relabel"), c("core_label")).otherwise(c("final_label"))
    return settled(out.withColumns({"decision_type": decision, "final_label": final, "reasons": F.array_sort(F.array_distinct(F.concat("reasons", added)))}))


def outputs(decided: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cleaned (result_id, label) and review (result_id, queue_type, score, reasons). boxes: result_id, keep, box_type, box_score.

    Accepted rows whose box is kept are clean; rows in doubt whose box is not dropped are reviewed; a box under review
    overrides the row's queue, with the lower score.
    """
    j = decided.join(boxes, "result_id", "left").withColumns({"keep": F.coalesce("keep", F.lit(True)), "box_type": F.coalesce("box_type", F.lit("keep"))})
    clean = j.where(F.col("decision_type").isin("auto_accept", "auto_accept_low_priority") & F.col("keep")).select("result_id", F.col("final_label").alias("label"))
    in_review = F.col("box_type").startswith("suspect")
    doubt = F.col("decision_type").isin("suspect", "reject", "relabel_candidate") & ~F.col("box_type").startswith("drop")
    review = j.where(doubt | in_review).select(
        "result_id",
        F.when(in_review, F.col("box_type")).otherwise(F.col("decision_type")).alias("queue_type"),
        F.when(in_review, F.least("reliability", "box_score")).otherwise(F.col("reliability")).alias("score"),
        F.when(in_review, F.array_sort(F.array_union("reasons", F.array("box_type")))).otherwise(F.col("reasons")).alias("reasons"),
    )
    return clean, review


#: Bytes of the rules, and of the labels, that a task holds at a time.
RULE_BYTES, LABEL_BYTES = 8 << 20, 8 << 20
#: Parts that the rows of a text are dealt into where texts are too many to be sent to all.
DEALT = 32


def _first_rules(labels: pa.Table, rules: pa.Table) -> pa.Table:
    """low, query, to: for each label text the first rule (by query, then label) that holds it or is held by it.

    Two automata of Aho and Corasick: one of the rules reads each label once, one of the labels reads each rule once.
    """
    import ahocorasick

    ordered = sorted(set(zip(rules.column("query").to_pylist(), rules.column("to").to_pylist(), strict=True)), key=lambda r: (r[0], r[1] is not None, r[1]))
    texts = sorted(set(labels.column("low").to_pylist()))
    best: dict[str, int] = {}
    of_rules, of_labels = ahocorasick.Automaton(), ahocorasick.Automaton()
    for rank, (query, _) in enumerate(ordered):
        if query and query not in of_rules:
            of_rules.add_word(query, rank)
    for text in texts:
        if text:
            of_labels.add_word(text, text)
    empty_rule = 0 if ordered[0][0] == "" else None  # an empty text is within every other
    if len(of_rules):
        of_rules.make_automaton()
        for text in texts:
            if (found := min((rank for _, rank in of_rules.iter(text)), default=None)) is not None:
                best[text] = found
    if len(of_labels):
        of_labels.make_automaton()
        for rank, (query, _) in enumerate(ordered):
            for _, text in of_labels.iter(query):
                if rank < best.get(text, len(ordered)):
                    best[text] = rank
    for text in texts:
        if text == "" or empty_rule is not None:
            best[text] = 0
    at = list(best.items())
    columns = [[t for t, _ in at], [ordered[r][0] for _, r in at], [ordered[r][1] for _, r in at]]
    return pa.table([pa.array(c, pa.string()) for c in columns], names=["low", "query", "to"])


def first_matching_rule(predictions: DataFrame, rules: DataFrame, least: float, strict: bool) -> DataFrame:
    """result_id, decision, label: a row's first prediction (by place) that meets a rule. rules: query, label (null: reject).

    predictions: result_id, place, label, confidence. Low confidence is decided first: rejected if strict, else kept. A
    prediction meets a rule if one of the two texts holds the other, without regard to case. Each distinct text meets the
    rules once, tile by block, so rules may be many; a null text or query meets nothing, without rules nothing meets one.
    """
    p = predictions.withColumn("low", F.lower("label"))
    texts = p.select("low").where("low is not null").distinct()
    r = rules.select(F.lower("query").alias("query"), F.col("label").alias("to")).where("query is not null")
    size = lambda df, c: df.agg(F.sum(F.length(c) + 32)).first()[0]
    met = block_product(texts, r, parts(size(texts, "low"), LABEL_BYTES), parts(size(r, "query"), RULE_BYTES), _first_rules, "low string, query string, to string")
    one = stored(met.groupBy("low").agg(F.min(F.struct("query", "to")).alias("rule")), "rules")
    hit = F.when(F.col("rule").isNotNull(), F.struct("place", "rule.query", "rule.to"))
    few = (size(one, "low") or 0) <= LABEL_BYTES
    # a text may be that of a third of the rows: they stay where they are, or are dealt by their ids too
    salt = F.pmod(F.xxhash64("result_id"), F.lit(DEALT)).cast("int")
    told = p.join(F.broadcast(one), "low", "left") if few else p.withColumn("_salt", salt).join(one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).hint("merge"), ["low", "_salt"], "left")
    j = told.select("result_id", hit.alias("hit"), F.when(F.col("place") == 1, F.col("confidence")).alias("confidence"))
    g = j.groupBy("result_id").agg(F.min("hit").alias("hit"), F.max("confidence").alias("confidence"))
    other = F.lit("reject" if strict else "keep")
    decision = F.when(F.col("confidence") < least, other).when(F.col("hit").isNull(), other).when(F.col("hit.to").isNull(), "reject").otherwise("accept")
    return g.select("result_id", decision.alias("decision"), F.when(decision == "accept", F.col("hit.to")).alias("label"))
