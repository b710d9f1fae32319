"""Operators without SQL against loops, invariants and round trips."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.operators import diverse
from boxwright.operators import evaluate as E
from boxwright.operators import mining as M
from boxwright.operators import numbering, rasters, suppress
from boxwright.sources import formats, sinks

BOXES = "image_id long, det_id long, label string, score double, x1 double, y1 double, x2 double, y2 double"


def some_boxes(seed, n, images=4, span=30):
    r = random.Random(seed)
    at = lambda: float(r.randint(0, span))
    return [(i % images, i, r.choice(["crack", "mold"]), r.randint(1, 9) / 10, x, y, x + 12.0, y + 9.0) for i in range(n) for x, y in [(at(), at())]]


def iou(a, b):
    inter = max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))
    return inter / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - inter)


@pytest.mark.parametrize("most", [None, 2])
def test_weighted_fusion_meets_a_loop(spark, most):
    rows = some_boxes(1, 60)
    want = []
    for image in range(4):
        left = sorted((b for b in rows if b[0] == image), key=lambda b: (-b[3], b[1]))
        clusters = []
        while left:
            seed = left[0]
            own = [b for b in left if b[2] == seed[2] and (b is seed or iou(seed, b) >= 0.3)]
            left = [b for b in left if b not in own]
            total = sum(max(1e-6, b[3]) for b in own)
            clusters.append((seed[1], *(round(sum(b[3] * b[k] for b in own) / total, 9) for k in (4, 5, 6, 7)), seed[3], len(own)))
        want += clusters[:most]
    out = suppress.weighted_fusion(spark.createDataFrame(rows, BOXES).withColumn("prompt_key", F.col("label")), 0.3, most)
    got = [(r["seed_id"], *(round(r[c], 9) for c in ("x1", "y1", "x2", "y2")), r["score"], r["fused_count"]) for r in out.collect()]
    assert sorted(got) == sorted(want)


def test_caps_of_a_label(spark):
    rows = spark.createDataFrame(some_boxes(2, 40, span=200), BOXES).selectExpr("*", "'p' as prompt_key", "'F' as detector", "300 as width", "300 as height")
    got = suppress.adaptive_filter(rows, per_label=2).groupBy("image_id", "label").count().collect()
    assert got and max(r["count"] for r in got) == 2


def test_average_precision_is_exact(spark):
    r = random.Random(3)
    flagged = [(k, r.random() if r.random() < 0.7 else round(r.random(), 1), r.random() < 0.5) for k in ("a", "b") for _ in range(150)]
    truths = [("a", 120), ("b", 60), ("none", 5)]
    got = {x["k"]: x["ap"] for x in E.average_precision(spark.createDataFrame(flagged, "k string, score double, hit boolean").repartition(5), spark.createDataFrame(truths, "k string, truths long"), ["k"]).collect()}
    for key, n in truths:
        own = [(s, h) for k, s, h in flagged if k == key]
        tp = fp = 0
        curve = []
        for s in sorted({s for s, _ in own}, reverse=True):
            tp += sum(h for t, h in own if t == s)
            fp += sum(not h for t, h in own if t == s)
            curve.append((tp / n, tp / (tp + fp)))
        ap = sum((rec - (curve[i - 1][0] if i else 0)) * max(p for _, p in curve[i:]) for i, (rec, _) in enumerate(curve))
        assert got[key] == pytest.approx(ap, abs=1e-12)


def test_average_precision_of_a_small_curve_and_of_nothing(spark):
    flagged = spark.createDataFrame([("x", 0.9, True), ("x", 0.8, False), ("x", 0.7, True)], "k string, score double, hit boolean")
    truths = spark.createDataFrame([("x", 2)], "k string, truths long")
    assert E.average_precision(flagged, truths, ["k"]).first()["ap"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert E.average_precision(flagged.limit(0), truths, ["k"]).first()["ap"] == 0


def test_rank_sum_p_is_that_of_all_signs():
    for n, w in ((10, 5), (12, 20), (11, 33)):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        assert E.signed_rank_p(n, w, None, 0) == pytest.approx(min(1, 2 * sum(x <= w for x in sums) / 2**n))
    assert E.signed_rank_p(100, 0, -1.96, 0) == pytest.approx(0.05, abs=1e-3)


def test_wilcoxon_keeps_close_differences_apart(spark):
    deltas = [0.0001 * k for k in range(1, 12)] + [-0.00005]
    r = E.wilcoxon(spark.createDataFrame([(d,) for d in deltas], "delta double")).first()
    assert (r["n"], r["w"], r["note"]) == (12, 1.0, None) and r["p"] == pytest.approx(4 / 2**12)
    few = E.wilcoxon(spark.createDataFrame([(0.1,), (float("nan"),), (None,)], "delta double")).first()
    assert few["w"] is None and few["note"] == "too few pairs"


def test_numbers_of_a_hot_group_come_from_ranges(spark):
    rows = [("hot" if i % 5 else f"g{i % 3}", i * 37 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    got = {(r["g"], r["v"]): r["n"] for r in numbering.numbered_within(df, ["g"], [F.col("v")], "n").collect()}
    for g in {g for g, _ in rows}:
        assert [got[g, v] for v in sorted(v for k, v in rows if k == g)] == list(range(1, 1 + sum(k == g for k, _ in rows)))
    top = numbering.running_max(df, [F.col("v")], "m", F.col("v") % 100).orderBy("v").collect()
    assert [r["m"] for r in top] == np.maximum.accumulate([r["v"] % 100 for r in top]).tolist()


def test_farthest_points_meet_a_loop(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((40, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, "a" if i % 2 else "b", (i * 7 % 10) / 10, None if i % 9 == 0 else v[i].tolist()) for i in range(40)]
    got = {(r["label"], r["result_id"]) for r in diverse.diverse_sample(spark.createDataFrame(rows, "result_id long, label string, reliability double, v array<double>"), 0.3).collect()}
    want = set()
    for label in "ab":
        own = [r for r in rows if r[1] == label]
        taken = [min(own, key=lambda r: (r[2], r[0]))]
        while len(taken) < 6:
            far = lambda r: min((1 - float(np.dot(r[3], t[3])) if r[3] and t[3] else math.inf) for t in taken)  # noqa: B023, E731
            left = [r for r in own if r not in taken]
            taken.append(max(left, key=lambda r: (far(r), -r[0])))
        want |= {(label, r[0]) for r in taken}
    assert got == want


@pytest.mark.parametrize(("bucket", "together"), [(10, 10), (64, 5), (7, 1), (8192, 512)])
def test_samples_of_large_labels_are_those_of_a_loop(spark, bucket, together):
    rng = np.random.default_rng(6)
    v = rng.integers(-2, 3, (260, 3)) / 4.0  # many ties
    rows = [(i * 13 % 1000, ("x", "y", None)[0 if i < 180 else 1 + i % 2], None if i % 11 == 0 else (i * 7 % 10) / 10, None if i % 17 == 0 else v[i].tolist()) for i in range(260)]
    df = spark.createDataFrame(rows, "result_id long, label string, reliability double, v array<double>").repartition(5)
    got = {(r["label"], r["result_id"]) for r in diverse.diverse_sample(df, 0.12, bucket, together).collect()}
    want = set()
    for label in ("x", "y", None):
        own = [r for r in rows if r[1] == label]
        at = diverse.farthest_first(np.array([r[2] or 0 for r in own]), np.array([r[0] for r in own]), [r[3] for r in own], max(1, round(0.12 * len(own))))
        want |= {(label, own[i][0]) for i in at}
    assert got == want
    assert diverse.diverse_sample(df.limit(0), 0.5).count() == 0


def test_core_mining_invariants(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(4)
    rows = [(i, "few" if i < 5 else "many", 0.6 if i % 40 == 39 else 0.9, (centres[i % 4] + 0.05 * rng.standard_normal(4)).tolist()) for i in range(85)]
    df = spark.createDataFrame(rows, "result_id long, label string, agreement double, v array<double>")
    got = M.core_mining(df).collect()
    assert sorted(r["result_id"] for r in got) == list(range(85))
    assert all((r["status"] == "insufficient_class_samples") == (r["label"] == "few") for r in got)
    by = {}
    for r in got:
        if r["cluster"] is not None:
            by.setdefault(r["cluster"], []).append(r)
    assert len(by) <= 8
    v = {i: np.array(x) for i, _, _, x in rows}
    for members in by.values():
        c = np.mean([v[r["result_id"]] for r in members], axis=0)
        c /= np.linalg.norm(c)
        sims = [float(np.clip(v[r["result_id"]] @ c, -1, 1)) for r in members]
        agreement = np.mean([rows[r["result_id"]][2] for r in members])
        for r, s in zip(members, sims, strict=True):
            assert (r["size"], r["similarity"], r["density"]) == (len(members), pytest.approx(s), pytest.approx(np.mean(sims)))
            assert r["status"] == ("core" if len(members) >= 10 and agreement >= 0.75 else "rare_cluster" if len(members) >= 3 else "noise_cluster")
    assert M.core_mining(df.limit(0)).count() == 0


def test_an_empty_bank_is_an_error(spark):
    none = lambda s: spark.createDataFrame([], s)
    with pytest.raises(ValueError, match="empty"):
        M.prototype_bank(none("result_id long, label string, place int"), none("cluster string, result_id long, similarity double, is_core boolean"), none("cluster string, label string, place int"), none("result_id long"))


def test_probe_tells_classes_apart(spark):
    rng = np.random.default_rng(6)
    make = lambda i: (i, "ab"[i % 2], (np.array([i % 2, 1 - i % 2]) + 0.2 * rng.standard_normal(2)).tolist())
    schema = "result_id long, label string, v array<double>"
    train, rest = spark.createDataFrame([make(i) for i in range(200) if i % 2 or i % 8 == 0], schema), spark.createDataFrame([make(i) for i in range(300, 360)], schema)
    got = M.linear_probe(train, rest).collect()
    assert sum("ab"[r["result_id"] % 2] == r["probe_label"] for r in got) >= 57 and all(0.5 <= r["probability"] <= 1 for r in got)
    report = [r["promoted"] for r in M.threshold_report(M.linear_probe(train, rest), [0.5, 0.9, 0.99]).collect()]
    assert report == [sum(r["probability"] >= t for r in got) for t in (0.5, 0.9, 0.99)]


def test_temperature_is_that_of_least_loss(spark):
    rng = np.random.default_rng(7)
    z = rng.standard_normal(3000) * 6
    y = (rng.random(3000) < 1 / (1 + np.exp(-z / 3))).astype(int)
    t = M.fit_temperature(spark.createDataFrame([(float(a), int(b)) for a, b in zip(z, y, strict=True)] + [(None, 1), (float("nan"), 0)], "logit double, target int"))
    loss = lambda t: np.mean(np.maximum(z / t, 0) - z / t * y + np.log1p(np.exp(-np.abs(z / t))))
    assert loss(t) <= min(loss(x) for x in np.linspace(0.5, 10, 400)) + 1e-6
    assert M.fit_temperature(spark.createDataFrame([], "logit double, target int")) == 1.0


def test_bootstrap_meets_the_normal_interval(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(5, 2, 2000)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(9999, float("nan")), (9998, None)], "id long, x double")
    r = M.bootstrap(rows.repartition(4), "x", resamples=800).first()
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert r["mean"] == pytest.approx(x.mean()) and r["low"] == pytest.approx(x.mean() - half, abs=0.25 * half) and r["high"] == pytest.approx(x.mean() + half, abs=0.25 * half)
    assert M.bootstrap(rows.repartition(2), "x", resamples=800).first()["low"] == pytest.approx(r["low"])


def test_sources_in_as_many_clusters_as_asked(spark):
    rows = [(f"s{k}", [float(np.cos(k % 3 * 2 + 0.01 * j)), float(np.sin(k % 3 * 2 + 0.01 * j))]) for k in range(12) for j in range(5)]
    got = {r["source"]: r["cluster"] for r in M.sources_clustered(spark.createDataFrame(rows, "source string, v array<double>"), 3).collect()}
    assert len(got) == 12 and all(got[f"s{k}"] == got[f"s{k % 3}"] for k in range(12)) and len(set(got.values())) == 3
    assert M.sources_clustered(spark.createDataFrame(rows[:5], "source string, v array<double>"), 3).first()["cluster"] == 0


def flood(cells):
    left, out = set(cells), []
    while left:
        group, stack = set(), [left.pop()]
        while stack:
            x, y = stack.pop()
            group.add((x, y))
            near = {(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)} & left
            left -= near
            stack += near
        out.append(group)
    return out


def test_components_of_masks_meet_a_flood(spark):
    r = random.Random(9)
    masks = {i: {(x, y) for x in range(12) for y in range(12) if r.random() < 0.35} for i in range(3)}
    cells = spark.createDataFrame([(i, x, y) for i, m in masks.items() for x, y in m], "image_id long, x long, y long")
    box = lambda g: (min(x for x, _ in g), min(y for _, y in g), max(x for x, _ in g) + 1, max(y for _, y in g) + 1, len(g))
    got = sorted((q["image_id"], q["x1"], q["y1"], q["x2"], q["y2"], q["cells"]) for q in rasters.component_boxes(cells).collect())
    assert got == sorted((i, *box(g)) for i, m in masks.items() for g in flood(m))
    pieces = []
    for i, m in masks.items():
        for g in flood(m):
            x1, y1, x2, y2, _ = box(g)
            along = (lambda p: p[0] - x1) if x2 - x1 >= y2 - y1 else (lambda p: p[1] - y1)  # noqa: B023, E731
            parts = {}
            for p in g:
                parts.setdefault(along(p) // 4, set()).add(p)
            pieces += [(i, *box(q)) for q in parts.values() if len(q) >= 2]
    cut = rasters.component_boxes(cells, least=2, longest=4)
    assert sorted((q["image_id"], q["x1"], q["y1"], q["x2"], q["y2"], q["cells"]) for q in cut.collect()) == sorted(pieces)
    error = {q["image_id"]: q["error"] for q in rasters.betti_error(cells, cells.where("x < 6")).collect()}
    assert error == {i: abs(len(flood(m)) - len(flood({p for p in m if p[0] < 6}))) for i, m in masks.items()}


def test_regions_are_of_one_size_and_overlap_little(spark):
    r = random.Random(10)
    values = spark.createDataFrame([(i, x, y, round(r.random(), 2)) for i in range(3) for x in range(10) for y in range(8)], "image_id long, x long, y long, value double")
    got = rasters.refine_regions(values, 10, 8, 0.5, size=3, most=4).collect()
    by = {}
    for q in got:
        assert (q["x2"] - q["x1"], q["y2"] - q["y1"]) == (3, 3) and 0 <= q["x1"] <= 7 and 0 <= q["y1"] <= 5 and q["score"] <= 1
        by.setdefault(q["image_id"], []).append((0, 0, 0, 0, q["x1"], q["y1"], q["x2"], q["y2"]))
    assert set(by) == {0, 1, 2} and all(len(b) <= 4 and all(iou(p, q) <= 0.3 for p, q in itertools.combinations(b, 2)) for b in by.values())


def test_files_are_written_below_a_root(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 1, "mold", 10.0, 10.0, 30.0, 20.0), (1, 2, "crack", 0.0, 0.0, 100.0, 50.0), (2, 3, "crack", 0.0, 0.0, 1.0, 1.0), (3, 4, "other", 0.0, 0.0, 1.0, 1.0)], "image_id long, det_id long, label string, x1 double, y1 double, x2 double, y2 double")
    images = spark.createDataFrame([(1, "a.png", "train", 100, 50), (2, "b.png", "val", None, None), (3, "c.png", "val", 10, 10)], "image_id long, name string, split string, width int, height int")
    formats.write_files(formats.yolo_dataset(boxes, images, ["crack", "mold"]), f"file://{tmp_path}/set")
    assert (tmp_path / "set/labels/train/a.txt").read_text() == "1 0.200000 0.300000 0.200000 0.200000\n0 0.500000 0.500000 1.000000 1.000000\n"
    assert (tmp_path / "set/classes.txt").read_text() == "crack\nmold\n" and not (tmp_path / "set/labels/val").exists()


def test_missing_columns_are_named_and_backups_stay(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.csv(f"{tmp_path}/t", header=True)
    with pytest.raises(ValueError, match="c"):
        formats.csv_rows(spark, f"{tmp_path}/t", {"a": "int", "c": "string"})
    sinks.backup(spark.range(3), f"{tmp_path}/b")
    with pytest.raises(Exception, match="exist"):
        sinks.backup(spark.range(1), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 3


def test_unreadable_documents_are_left_out(spark):
    docs = spark.createDataFrame([("a", '{"images": [{"id": 1, "file_name": "f"}], "annotations": [{"id": 1, "image_id": 1, "bbox": [0, 0, 2, 3], "category_id": 9}, {"id": 2, "image_id": 5, "bbox": [0, 0, 1, 1]}], "categories": []}'), ("b", "{"), ("c", None)], "doc string, text string")
    assert [(r["annotation_id"], r["x2"], r["category"]) for r in formats.coco_annotations(docs).collect()] == [(1, 2.0, None)]
    assert formats.runs(docs.where("doc <> 'a'")).count() == 0 and formats.box_lists(docs).count() == 0


def test_queries_stand_without_the_llm_folder(monkeypatch):
    import importlib.util
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "boxwright.llm", None)  # what an absent or broken subpackage does
    assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries()) and len(entry.queries()) > 100
    assert set(entry.oracle_sql()) < set(entry.queries())
