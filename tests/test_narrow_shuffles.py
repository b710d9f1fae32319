"""Steps that shuffle few columns once: the same rows, by plans that do not join wide tables again."""

import random

from pyspark.sql import functions as F

from boxwright.operators import suppress
from boxwright.operators.numbering import running_sums
from boxwright.plans import io_queries
from boxwright.plans.dataset_queries import review_session
from boxwright.plans.mining_queries import prototype_candidates
from boxwright.sources import formats
from boxwright.streaming import states


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_transitions_join_no_table_of_jobs(spark):
    rows = [(1, 5, 2, "done"), (1, 1, 1, "queued"), (1, 2, 1, "started"), (1, 2, 1, "started"), (1, 6, 3, "cancelled"), (2, 1, 1, "started"), (2, 2, 2, "queued"), (2, 3, 3, "cancelled"), (2, 4, 4, "started"), (2, 5, 5, "drained"), (None, 1, 1, "queued")]
    df = spark.createDataFrame(rows, "job long, event_id long, s long, event string").select("job", "event_id", F.timestamp_seconds("s").alias("ts"), "event")
    moved = states.transitions(df)
    assert "Join" not in plan_of(moved)
    got = sorted((r["job"], r["event_id"], r["from_status"], r["to_status"], r["legal"]) for r in moved.collect())
    assert got == [(1, 1, None, "queued", True), (1, 2, "queued", "running", True), (1, 5, "running", "done", True), (1, 6, "done", "done", False), (2, 1, None, None, False), (2, 2, None, "queued", True), (2, 3, "queued", "cancelled", True), (2, 4, "cancelled", "cancelled", False), (2, 5, "cancelled", "cancelled", True)]


def test_a_session_is_made_of_its_stored_decisions(spark):
    """Of edits with one place one counts, with its own label and note."""
    edits = spark.createDataFrame([(1, "7", "manual_reject", "", "mold", "a"), (2, "8", "manual_accept", "Crack", "spall", None), (2, "8", "manual_accept", "Crack", "spall", None), (3, "9", "other", "x", "mold", "b")], "place long, result_id string, action string, new_label string, previous_label string, note string")
    sessions, decisions = review_session(edits, "s", "r", "me", "t")
    assert "Join" not in plan_of(sessions) and "Exchange hash" not in plan_of(decisions)
    assert sorted((d["place"], d["target_id"], d["previous_label"], d["new_label"], d["note"]) for d in decisions.collect()) == [(1, "7", "mold", "reject", "a"), (2, "8", "spall", "crack", "")]
    assert sessions.count() == 1


def test_nested_boxes_meet_in_their_image_alone(spark):
    r = random.Random(3)
    boxes = []
    for k in range(150):
        x, y = r.randrange(40), r.randrange(40)
        boxes.append((k % 4, k, r.choice(["crack", "mold"]), r.randint(1, 99) / 100, float(x), float(y), float(x + r.randint(5, 60)), float(y + r.randint(5, 40))))
    df = spark.createDataFrame(boxes, "image_id long, det_id long, label string, score double, x1 double, y1 double, x2 double, y2 double")
    area = lambda b: (b[6] - b[4]) * (b[7] - b[5])
    gone = set()
    for a in boxes:
        for b in boxes:
            if a[1] < b[1] and a[0] == b[0] and a[2] == b[2]:
                shared = max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))
                p, c = (a, b) if area(a) >= area(b) else (b, a)
                if shared / max(area(c), 1e-6) >= 0.9:
                    sides = p[6] - p[4], p[7] - p[5]
                    long = p[2] == "crack" and max(sides) / min(sides) >= 3
                    gone.add((c if long else p if abs(p[3] - c[3]) < 0.05 or p[3] < c[3] else c)[1])
    kept = suppress.nested_kept(df)
    assert len(gone) > 5 and {q["det_id"] for q in suppress.nested_drops(df).collect()} == gone
    assert sorted(q["det_id"] for q in kept.collect()) == sorted({b[1] for b in boxes} - gone)
    assert plan_of(suppress.nested_kept(df)).count("Join") == 1


def test_annotations_meet_their_images_where_a_document_is_read(spark):
    one = '{"images": [{"id": 1, "file_name": "a", "width": 9}, {"id": 2, "file_name": "b"}, {"id": 1, "file_name": "c"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}, {"id": 6, "image_id": 2, "category_id": null, "bbox": [0, 0, 1]}, {"id": 7, "image_id": 4}, {"id": 8, "image_id": null}], "categories": [{"id": 3, "name": "mold"}]}'
    two = '{"images": [{"id": 1, "file_name": "z"}], "annotations": [{"id": 9007199254740993, "image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 1]}]}'
    docs = spark.createDataFrame([("p", one), ("q", two), ("r", None), ("s", "no document"), ("t", "{}")], "doc string, text string").coalesce(1)
    found = formats.coco_annotations(docs)
    assert "Exchange" not in plan_of(found)
    got = sorted((r["doc"], r["annotation_id"], r["file_name"], r["category"], r["x2"], r["y2"]) for r in found.collect())
    assert got == [("p", 5, "a", "mold", 4.0, 6.0), ("p", 5, "c", "mold", 4.0, 6.0), ("p", 6, "b", None, 1.0, None), ("q", 9007199254740993, "z", None, 1.0, 1.0)]


def test_candidates_are_stored_once_and_meet_a_small_table(spark):
    rows = spark.createDataFrame([(k, "mold", f"p{k % 3}", f"c{k % 2}", k / 100, 0.9, "reject" if k % 4 == 0 else "auto_accept", None) for k in range(40)], "result_id long, label string, rel_path string, cluster_id string, similarity double, reliability double, decision_type string, reasons string")
    found = prototype_candidates(rows, rows.where("result_id <> 39").select("result_id"), reject_limit=4)
    assert plan_of(found).count("Join") == 1
    got = sorted((r["label"], r["result_id"], r["domain_index"]) for r in found.collect())
    assert got == sorted([("mold", k, k % 2) for k in (27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38)] + [("reject", k, None) for k in (0, 12, 4, 16)])


def test_annotations_are_numbered_by_their_images(spark, monkeypatch):
    """Images, not whole annotations, are dealt into ranges."""
    dealt = []
    monkeypatch.setattr(io_queries, "running_sums", lambda df, *a: dealt.append(df.columns) or running_sums(df, *a))
    ids = [r["id"] for r in io_queries.coco_export(spark, "/root/testdata/sf0.001").collect()]
    assert dealt == [["image_id", "n"]] and sorted(ids) == list(range(1, len(ids) + 1))
