"""Probes, rules, matching at many thresholds, splits, stores and data sources against plain versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.operators import decide, evaluate, mining, pairs, probes
from boxwright.plans.dataset_queries import commit_review
from boxwright.sources import datasources, formats, sinks

ROWS = "result_id long, label string, v array<double>"


def blobs(n=300, dim=6, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((3, dim))
    labels = r.choice(3, n, p=[0.6, 0.3, 0.1])
    v = centres[labels] + 0.9 * r.standard_normal((n, dim))
    return [(i, "abc"[k], x.tolist()) for i, (k, x) in enumerate(zip(labels, v, strict=True))]


def descended(x, y, classes, strength=1.0, steps=6000):
    """A fold's model by plain gradient descent on all its rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    counts = np.bincount(y, minlength=classes)
    w = (len(y) / (classes * counts))[y]
    m, one = np.zeros((classes, x.shape[1])), np.eye(classes)[y]
    rate = 1 / (0.5 * strength * (w[:, None] * x**2).sum() / 2 + 1)
    velocity = m.copy()
    for t in range(steps):
        ahead = m + t / (t + 3) * velocity
        z = np.exp(x @ ahead.T - (x @ ahead.T).max(axis=1, keepdims=True))
        g = strength * ((z / z.sum(axis=1, keepdims=True) - one) * w[:, None]).T @ x
        g[:, :-1] += ahead[:, :-1]
        new = ahead - rate * g
        velocity, m = new - m, new
    return m


def test_folds_fitted_together_are_folds_fitted_alone(spark):
    rows = blobs()
    found = probes.cross_validated(spark.createDataFrame(rows, ROWS).repartition(4), folds=5, strength=1.0).collect()
    assert sorted(r["result_id"] for r in found) == list(range(300))
    sizes = {}
    for r in found:
        sizes.setdefault(r["label"], []).append(r["fold"])
    assert all(max(np.bincount(f)) - min(np.bincount(f, minlength=5)) <= 1 for f in sizes.values())
    v = {i: np.array(x) / np.linalg.norm(x) for i, _, x in rows}
    agree = right = 0
    for fold in range(5):
        train = [r for r in found if r["fold"] != fold]
        m = descended(np.stack([v[r["result_id"]] for r in train]), np.array(["abc".index(r["label"]) for r in train]), 3)
        for r in found:
            if r["fold"] == fold:
                own = "abc"[int(np.argmax(np.append(v[r["result_id"]], 1) @ m.T))]
                agree += own == r["predicted"]
                right += own == r["label"]
    assert agree >= 299
    accuracy = np.average([r["accuracy"] for r in probes.accuracies(spark.createDataFrame(found)).collect()], weights=[60] * 5)
    assert abs(accuracy - right / 300) < 0.01


def test_class_reports_and_empty_probes(spark):
    told = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "label string, predicted string")
    got = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in probes.class_report(told).collect()}
    assert got == {"a": (0.5, 0.5, 2), "b": (pytest.approx(2 / 3), 1.0, 2), "c": (0.0, 0.0, 1)}
    none = spark.createDataFrame([(1, None, [1.0]), (2, "a", None)], ROWS)
    assert probes.cross_validated(none).count() == 0
    assert mining.linear_probe(none.select("label", "v"), none.select("result_id", "v")).count() == 0


@pytest.mark.parametrize(("rule_bytes", "label_bytes"), [(8 << 20, 8 << 20), (400, 300)])
def test_rules_meet_texts_both_ways(spark, monkeypatch, rule_bytes, label_bytes):
    monkeypatch.setattr(decide, "RULE_BYTES", rule_bytes)
    monkeypatch.setattr(decide, "LABEL_BYTES", label_bytes)
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcÉ ") for _ in range(n))
    rules = [(word(r.randint(2, 7)), r.choice(["x", "y", None])) for _ in range(60)] + [("AB", None), (None, "x")]
    rows = [(i, p, None if i % 13 == 0 else word(r.randint(0, 9)), 0.1 if i % 7 == 0 else 0.9) for i in range(80) for p in (1, 2)]
    df = spark.createDataFrame(rows, "result_id long, place int, label string, confidence double").repartition(3)
    got = {q["result_id"]: (q["decision"], q["label"]) for q in decide.first_matching_rule(df, spark.createDataFrame(rules, "query string, label string"), 0.5, strict=False).collect()}
    low = sorted({(q.lower(), t) for q, t in rules if q is not None}, key=lambda x: (x[0], x[1] is not None, x[1]))
    for i in range(80):
        own = [x for x in rows if x[0] == i]
        hit = min(((p, q, t) for _, p, text, _ in own if text is not None for q, t in low if q in text.lower() or text.lower() in q), key=lambda h: (h[0], h[1], h[2] is not None, h[2]), default=None)
        if own[0][3] < 0.5 or hit is None:
            want = ("keep", None)
        else:
            want = ("reject", None) if hit[2] is None else ("accept", hit[2])
        assert got[i] == want
    assert decide.first_matching_rule(df, spark.createDataFrame([], "query string, label string"), 0.5, strict=True).where("decision <> 'reject'").count() == 0


def boxes(spark, seed, n, images=4, high=200):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = r.randint(0, 150), r.randint(0, high)
        rows.append((r.randrange(images), i, r.choice(["crack", "mold"]), r.randint(0, 9) / 10, float(x), float(y), float(x + r.randint(5, 60)), float(y + r.randint(5, 60))))
    return spark.createDataFrame(rows, "image_id long, det_id long, label string, score double, x1 double, y1 double, x2 double, y2 double"), rows


def test_one_matching_for_all_thresholds(spark):
    p, _ = boxes(spark, 1, 120)
    t, _ = boxes(spark, 2, 90)
    thresholds = [0.1, 0.3, 0.5]
    found = evaluate.matches_at(p, t, thresholds).collect()
    for at in thresholds:
        own = {(r["pred_id"], r["truth_id"]) for r in found if r["threshold"] == at}
        assert own == {(r["pred_id"], r["truth_id"]) for r in evaluate.greedy_matches(p, t, at).collect()}
    got = {r["label"]: r["map"] for r in evaluate.mean_average_precision(p, t, thresholds).collect()}
    truths = t.groupBy("label").agg(F.count("*").alias("truths"))
    each = []
    for at in thresholds:
        hit = evaluate.greedy_matches(p, t, at).select(F.col("pred_id").alias("det_id"), F.lit(True).alias("hit"))
        flagged = p.join(hit, "det_id", "left").select("label", "score", F.coalesce("hit", F.lit(False)).alias("hit"))
        each.append({r["label"]: r["ap"] for r in evaluate.average_precision(flagged, truths, ["label"]).collect()})
    assert got == {k: pytest.approx(np.mean([e[k] for e in each])) for k in got}


@pytest.mark.parametrize("tile", [512, 64, 7])
def test_coverage_of_cut_boxes_counts_pixels(spark, tile):
    p, of_p = boxes(spark, 3, 60)
    t, of_t = boxes(spark, 4, 50, images=5)
    shifted = lambda df: df.withColumns({c: F.col(c) - 77.5 for c in ("x1", "y1", "x2", "y2")})
    cells = lambda rows: {(r[0], x, y) for r in rows for x in range(int(np.floor(r[4] - 77.5)), int(np.ceil(r[6] - 77.5))) for y in range(int(np.floor(r[5] - 77.5)), int(np.ceil(r[7] - 77.5)))}
    a, b = cells(of_t), cells(of_p)
    want = {i: sum(c in b for c in a if c[0] == i) / sum(c[0] == i for c in a) for i in {c[0] for c in a}}
    assert {r["image_id"]: r["covered"] for r in pairs.coverage(shifted(t), shifted(p), tile).collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_coverage_of_very_many_boxes_of_an_image(spark):
    some = spark.range(10_000).selectExpr("1L as image_id", "double(id * 7919 % 3000) as x1", "double(id * 104729 % 2000) as y1").selectExpr("*", "x1 + 40 as x2", "y1 + 30 as y2")
    grid = np.zeros((2040, 3050), bool)
    for k in range(10_000):
        x, y = k * 7919 % 3000, k * 104729 % 2000
        grid[y : y + 30, x : x + 40] = True
    half = spark.createDataFrame([(1, 0.0, 0.0, 1500.0, 3000.0)], "image_id long, x1 double, y1 double, x2 double, y2 double")
    assert pairs.coverage(some, half).first()["covered"] == pytest.approx(grid[:, :1500].sum() / grid.sum())


def test_counts_are_filled_from_ratios(spark):
    none = [f"cast(null as {t}) as {c}" for c, t in (("fp", "long"), ("fn", "long"), ("tn", "long"), ("specificity", "double"), ("accuracy", "double"))]
    rows = spark.createDataFrame([(0.5, 0.8, 10, 6, None), (0.5, 0.0, 10, 0, None), (0.0, 0.5, 0, 5, None), (0.0, 0.0, 0, 0, None), (0.5, 0.8, 10, 6, 3)], "precision double, recall double, predicted_px long, truth_px long, tp long").selectExpr("*", "5 as width", "4 as height", *none)
    got = [(r["tp"], r["fp"], r["fn"], r["tn"], r["accuracy"]) for r in evaluate.confusion_filled(rows).collect()]
    assert got == [(5, 5, 1, 9, 0.7), (5, 5, 0, 10, 0.75), (3, 0, 2, 15, 0.9), (0, 0, 0, 20, 1.0), (3, 7, 3, 7, 0.5)]


def test_under_three_sources_images_are_split(spark):
    rows = spark.range(120).selectExpr("id div 2 as image", "id % 2 as source", "'crack' as label")
    split = mining.source_split(rows, ["crack"], image_trials=50).groupBy("split").count().collect()
    assert {r["split"] for r in split} == {"train", "val", "test"} and abs({r["split"]: r["count"] for r in split}["train"] - 42) <= 4
    by_source = mining.source_split(rows.withColumn("source", F.col("image") % 20), ["crack"], trials=300)
    assert by_source.count() == 20
    assert mining.source_split(rows.limit(0), ["crack"]).count() == 0


def test_tables_of_a_run_change_together(spark, tmp_path):
    store = sinks.RunStore(f"file://{tmp_path}/store")
    table = lambda *rows: spark.createDataFrame(list(rows), "run_id string, v int")
    of = lambda name, version=None: sorted((r["run_id"], r["v"]) for r in store.read(spark, name, version).collect())
    store.replace({"a": table(("01", 1), ("2", 2)), "b": table(("01", 3))})
    store.replace({"a": table(("01", 9)), "b": table(("3", 4))})
    assert of("a") == [("01", 9), ("2", 2)] and of("b") == [("3", 4)]
    assert of("a", 0) == [("01", 1), ("2", 2)]

    def broken(batches):
        raise OSError("lost")
        yield

    with pytest.raises(Exception, match="lost"):  # the second table fails: readers keep the first version
        store.replace({"a": table(("2", 7)), "b": table(("2", 7)).mapInArrow(broken, "run_id string, v int")})
    assert of("a") == [("01", 9), ("2", 2)]
    store.replace({"a": table(("2", 5))}, runs=["3"])
    assert of("a") == [("01", 9), ("2", 5)]
    with pytest.raises(ValueError, match="no run"):
        store.read(spark, "b")


def test_reviews_are_written_with_their_change(spark, tmp_path):
    store = sinks.RunStore(f"file://{tmp_path}/store")
    cleaned = spark.createDataFrame([("r", 1, "crack", "auto"), ("r", 2, "mold", "auto")], "run_id string, result_id long, label string, decision string")
    edits = spark.createDataFrame([(1, "1", "manual_reject", "", "crack", "n"), (2, "x", "manual_reject", "", None, None), (3, "2", "manual_relabel", "", "mold", None)], "place long, result_id string, action string, new_label string, previous_label string, note string")
    assert not commit_review(store, cleaned, edits.where("place > 1"), "s0", "r", "me", "t") and store.versions(spark) == []
    assert commit_review(store, cleaned, edits, "s1", "r", "me", "t")
    assert sorted((r["result_id"], r["label"], r["decision"]) for r in store.read(spark, "cleaned_labels").collect()) == [(1, "reject", "reject"), (2, "mold", "auto")]
    d = store.read(spark, "review_decisions").first()
    assert (d["review_session_id"], d["target_id"], d["new_label"], d["affected_result_ids_json"], d["note"]) == ("s1", "1", "reject", "[1]", "n")
    assert store.read(spark, "review_sessions").count() == 1
    for _ in range(2):  # another session, and the same again
        assert commit_review(store, cleaned, edits.withColumn("result_id", F.lit("2")), "s2", "r", "me", "t")
    assert sorted(r["review_session_id"] for r in store.read(spark, "review_sessions").collect()) == ["s1", "s2"]
    assert sorted((r["review_session_id"], r["result_id"]) for r in store.read(spark, "review_decisions").collect()) == [("s1", 1), ("s2", 2), ("s2", 2)]


def test_json_exports_are_whole_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\"b"), (2, None), (3, "é\n")], "n int, s string").repartition(2)
    sinks.export_json(df, f"{tmp_path}/out", [F.col("n")])
    found = [r for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size for r in json.loads(p.read_text())]
    assert found == [{"n": 1, "s": 'a"b'}, {"n": 2, "s": None}, {"n": 3, "s": "é\n"}]
    sinks.export_json(df.limit(0), f"{tmp_path}/none")
    assert [json.loads(p.read_text()) for p in (tmp_path / "none").glob("part-*")] == [[]]


def test_formats_are_data_sources(spark, tmp_path):
    datasources.register(spark)
    docs = [{"images": [{"id": k, "file_name": f"{k}.png", "width": 10, "height": 8}], "categories": [{"id": 1, "name": "crack"}], "annotations": [{"id": 10 * k, "image_id": k, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 10 * k + 1, "image_id": -1, "category_id": 1, "bbox": [0, 0, 1, 1]}, {"id": 10 * k + 2, "image_id": k, "category_id": 7, "bbox": [0, 0, 1.5, 1]}]} for k in range(1, 6)]
    folder = tmp_path / "coco"
    folder.mkdir()
    for k, d in enumerate(docs):
        (folder / f"{k}.json").write_text(json.dumps(d))
    (folder / "bad.json").write_text("{")
    found = spark.read.format("coco_annotations").load(f"file://{folder}")
    columns = ["image_id", "file_name", "annotation_id", "category_id", "category", "x1", "y1", "x2", "y2"]
    other = formats.coco_annotations(formats.documents(spark, str(folder)))
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, other.select(*columns).collect())) != []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = spark.read.format("coco_annotations").option("push", "true").load(f"file://{folder}").where(F.col("doc").endswith("3.json"))
        assert {r["image_id"] for r in one.collect()} == {4}
        assert one.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "labels.txt").write_text("0 0.5 0.5 0.1 0.2\n1 0.5 0.5\nx y z a b\n2 .1 .2 .3 .4 0.9\n")
    assert [(r["class_id"], r["w"]) for r in spark.read.format("yolo_labels").load(f"file://{tmp_path}/labels.txt").collect()] == [(0, 0.1), (2, 0.3)]
    (tmp_path / "runs.json").write_text('{"run_id": "a"}\n{\n{"run_id": "b", "status": "done"}\n')
    assert [(r["run_id"], r["status"]) for r in spark.read.format("run_catalog").load(f"file://{tmp_path}/runs.json").collect()] == [("a", "unknown"), ("b", "done")]
    (tmp_path / "empty").mkdir()
    assert spark.read.format("run_catalog").load(f"file://{tmp_path}/empty").count() == 0
