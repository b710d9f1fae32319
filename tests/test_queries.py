import math

import duckdb
import pytest

from boxwright.operators import evaluate as E
from boxwright.operators import prototypes, suppress
from boxwright.plans.registry import ORACLES, QUERIES
from boxwright.streaming.jobs import hourly, latest_status, resumed

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.5f}"
    except (TypeError, ValueError):
        return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_meets_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    own = rows(df.columns, df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    other = rows(names, cursor.fetchall())
    assert len(own) == len(other)
    assert own == other


def boxes(spark, some):
    return spark.createDataFrame(some, "image_id long, det_id long, label string, score double, x1 double, y1 double, x2 double, y2 double")


def iou(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    inter = max(0, w) * max(0, h)
    return inter / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - inter)


def test_greedy_matches_meet_a_loop(spark):
    import random

    r = random.Random(5)
    make = lambda base: [(i % 6, base + i, "crack" if i % 3 else "mold", r.randint(1, 9) / 10, *(lambda x, y: (x, y, x + 10.0, y + 10.0))(float(r.randint(0, 12)), float(r.randint(0, 12)))) for i in range(90)]
    p, t = make(0), make(1000)
    expected, taken = set(), set()
    for a in sorted(p, key=lambda a: (-a[3], a[1])):
        near = sorted((-iou(a, b), b[1]) for b in t if b[0] == a[0] and b[2] == a[2] and b[1] not in taken and iou(a, b) >= 0.3)
        if near:
            taken.add(near[0][1])
            expected.add((a[1], near[0][1]))
    m = E.greedy_matches(boxes(spark, p), boxes(spark, t), 0.3)
    assert {(x["pred_id"], x["truth_id"]) for x in m.collect()} == expected and expected
    c = {x["image_id"]: x for x in E.image_counts(boxes(spark, p), boxes(spark, t), m, ["image_id"]).collect()}
    assert sum(x["tp"] for x in c.values()) == len(expected)
    assert all(x["tp"] + x["fp"] == 15 and x["tp"] + x["fn"] == 15 for x in c.values())


def test_wilcoxon_needs_ten_pairs(spark):
    few = spark.createDataFrame([(0.1 * i,) for i in range(1, 6)], "delta double")
    assert E.wilcoxon(few).first()["w"] is None
    many = E.wilcoxon(spark.createDataFrame([(0.1 * i,) for i in range(1, 13)], "delta double")).first()
    assert many["w"] == 0 and many["rank_biserial"] == 1


def test_stream_gives_what_batch_gives(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, fn in (("status", latest_status), ("hours", lambda d: hourly(d, "1 day"))):
        q = fn(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        q.stop()
        both = [sorted(map(tuple, d.collect())) for d in (spark.table(name), (latest_status if name == "status" else hourly)(events))]
        assert both[0] == both[1] and both[0]


def test_resumed_leaves_out_what_is_done(spark):
    batch = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    assert sorted(r["k"] for r in resumed(batch, spark.createDataFrame([(1,)], "k int"), "k").collect()) == [2, 3]


def touching(some, width):
    """Boxes of an image by brute force: (x1, y1, x2, y2, score, members)."""
    grown = [(b[4] - max(8, (b[6] - b[4]) * 0.15), b[5] - max(8, (b[7] - b[5]) * 0.15), b[6] + max(8, (b[6] - b[4]) * 0.15), b[7] + max(8, (b[7] - b[5]) * 0.15)) for b in some]
    root = list(range(len(some)))
    for _ in some:
        root = [min(root[j] for j, q in enumerate(grown) if some[i][2] == some[j][2] and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]) for i, p in enumerate(grown)]
    out = []
    for r in set(root):
        own = [b for b, k in zip(some, root, strict=True) if k == r]
        box = lambda g: (min(b[4] for b in g), min(b[5] for b in g), max(b[6] for b in g), max(b[7] for b in g), max(b[3] for b in g), len(g))
        whole = box(own)
        out += [box([b]) for b in own] if whole[2] - whole[0] > 0.45 * width or whole[3] - whole[1] > 0.45 * width else [whole]
    return sorted(out)


@pytest.mark.parametrize("name", ["d5_prototype_scores", "w7_top_prototypes", "o27_autoflag", "d7_nearest_core"])
def test_banks_of_several_blocks_give_what_one_block_gives(spark, name, monkeypatch):
    of = lambda: sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    whole = of()
    monkeypatch.setattr(prototypes, "BLOCK_BYTES", 4000)
    assert whole and of() == whole


def test_shares_of_a_group_need_no_window(spark):
    rows = spark.createDataFrame([(1, "a", 3.0, None), (2, "a", 1.0, 0.0), (3, None, 2.0, None), (4, "b", 0.0, None)], "id int, label string, clip_score double, proto_sim double")
    found = prototypes.anchored(rows, "label", 0.5)
    assert {r["id"]: r["share"] for r in found.collect()} == {1: 0.75, 2: 0.25, 3: 1.0, 4: 0.0}
    assert "Window" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("width", [500, 5000])
def test_a_chain_of_touching_boxes_is_one_component(spark, width):
    chain = [(1, k, "crack", k / 100, 20.0 * k, 0.0, 20.0 * k + 4, 10.0) for k in range(30)]
    some = [*chain, (1, 40, "mold", 0.5, 0.0, 0.0, 4.0, 10.0), (1, 41, "crack", 0.5, 0.0, 200.0, 4.0, 210.0)]
    found = suppress.merge_touching(boxes(spark, some).selectExpr("*", f"{width} as width", f"{width} as height"))
    assert sorted((r["x1"], r["y1"], r["x2"], r["y2"], r["score"], r["members"]) for r in found.collect()) == touching(some, width)


def test_fusion_of_two_boxes_and_one_apart(spark):
    some = boxes(spark, [(1, 1, "crack", 0.75, 0.0, 0.0, 10.0, 10.0), (1, 2, "crack", 0.25, 2.0, 0.0, 12.0, 10.0), (1, 3, "crack", 0.5, 50.0, 50.0, 60.0, 60.0)]).selectExpr("*", "'p' as prompt_key")
    found = {r["seed_id"]: r for r in suppress.weighted_fusion(some, 0.5).collect()}
    assert set(found) == {1, 3}
    assert (found[1]["x1"], found[1]["x2"], found[1]["fused_count"], found[1]["score"]) == (0.5, 10.5, 2, 0.75)
    assert (found[3]["x1"], found[3]["fused_count"]) == (50.0, 1)
