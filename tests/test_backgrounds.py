"""Background boxes: no candidate is a row, and the same boxes as by SQL and by hashlib."""

import datetime
import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from __spark_entry__ import oracle_sql, queries
from boxwright.operators import backgrounds
from boxwright.operators.backgrounds import free_boxes

GRID = [(64, 64), (48, 32)], range(0, 277, 24), range(0, 229, 24), 340, 260, 0.02, lambda w, h, x, y: x * 1000 + y + w
NAME = "m4_background_boxes"


def test_candidates_are_no_rows(spark):
    """And the boxes of an image, which may be many, are on the side that is not held."""
    plan = queries()[NAME](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "SortAggregate" not in plan and "LeftOuter, BuildLeft" in plan


def test_odd_rows_meet_the_sql(spark, tmp_path):
    """No id, ids of many lengths, an id twice, rows without a part, a supplier or a line, an image whose rows go over many batches, one that is full."""
    r = random.Random(4)
    ids = [None, None, 0, 7, -12, 12, 12, 300, 4096, 99999, 123456, 1234567, 12345678, 10**12, 2**62, -(2**62), 55, 56]
    day = datetime.datetime(1995, 1, 1)
    line = lambda i, part, supp, n: (i, part, supp, n, 1.0, 1.0, 0.0, 0.0, "R", "F", day)
    lines = [line(i, r.randrange(20000), r.randrange(1000), k) for i in ids for k in range(r.randrange(5))]
    lines += [line(7, 5, None, 1), line(300, None, 9, 1), line(4096, None, None, 2), line(99999, 5, 9, None), line(None, 3, 3, 3), line(8, 1, 1, 1)]
    lines += [line(55, 11, 13, k % 7) for k in range(12000)] + [line(56, r.randrange(20000), r.randrange(1000), k % 7) for k in range(12000)]
    orders = [(i, 1, "O", 1.0, day, "x") for i in ids]
    make = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    make(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", "orders")
    make(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp", "lineitem")
    duck = duckdb.connect()
    for t in ("orders", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.execute(oracle_sql()[NAME]).fetchall()
    got = [tuple(q) for q in queries()[NAME](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert (None, 48, 32, 0, 0) in got and not {56, 4096} & {q[0] for q in got} and 55 in {q[0] for q in got}


def brute(image, some):
    best = []
    sizes, xs, ys, width, height, share, number = GRID
    for w, h in sizes:
        for x in xs:
            for y in ys:
                over = lambda b: max(0, min(x + w, b[2]) - max(x, b[0])) * max(0, min(y + h, b[3]) - max(y, b[1])) > share * w * h  # noqa: B023, E731
                if x + w <= width and y + h <= height and not any(map(over, some)):
                    k = number(w, h, x, y)
                    best.append((hashlib.md5(f"{image}-{k}".encode()).hexdigest(), k, w, h, x, y))
    return min(best)[2:] if best else None


def test_boxes_meet_a_loop_over_slices(spark, monkeypatch):
    """Text ids, some too long for one block of the hash; images cut by slices."""
    monkeypatch.setattr(backgrounds, "ROWS", 3)
    r = random.Random(6)
    corners = lambda: (x := r.random() * 250, y := r.random() * 180, x + r.random() * 130, y + r.random() * 110)
    boxes = {("é" * k + str(k)): [corners() for _ in range(r.randrange(9))] for k in range(40)}
    rows = [(i, *b) for i, some in boxes.items() for b in some]
    df = spark.createDataFrame(rows, "image_id string, x1 double, y1 double, x2 double, y2 double")
    found = free_boxes(spark.createDataFrame([(i,) for i in boxes], "image_id string"), df, *GRID).collect()
    want = {i: brute(i, some) for i, some in boxes.items()}
    assert {q[0]: tuple(q[1:]) for q in found} == {i: b for i, b in want.items() if b} and len(found) > 30


def test_no_room_gives_no_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0)], "image_id long, x1 double, y1 double, x2 double, y2 double")
    some = df.select("image_id")
    assert not free_boxes(some, df, [(50, 50)], range(0, 9), range(0, 9), 40, 40, 0.1, lambda w, h, x, y: x * 9 + y).collect()
    assert not free_boxes(some.where("image_id > 1"), df, *GRID).collect()


def test_heads_of_hashes_are_those_of_hashlib():
    r = random.Random(1)
    texts = [bytes(r.randrange(256) for _ in range(k)) for k in range(backgrounds.BLOCK + 1) for _ in range(40)]
    raw = np.zeros((len(texts), 64), np.uint8)
    for row, text in zip(raw, texts, strict=True):
        row[: len(text)], row[len(text)] = np.frombuffer(text, np.uint8), 0x80
        row[56:58] = len(text) * 8 % 256, len(text) * 8 // 256
    words = list(np.ascontiguousarray(raw.view("<u4").T))
    words[15] = None
    assert backgrounds.md5_heads(words).tolist() == [int(hashlib.md5(t).hexdigest()[:8], 16) for t in texts]


@pytest.mark.parametrize("tied", [False, True])
def test_first_by_the_whole_hash(monkeypatch, tied):
    """Also where the first bytes of the hashes are equal, for boxes that are no number or leave a side open, and over the blocks of messages and boxes."""
    monkeypatch.setattr(backgrounds, "MESSAGES", 1000)
    monkeypatch.setattr(backgrounds, "BOXES", 7)
    if tied:
        monkeypatch.setattr(backgrounds, "md5_heads", lambda words: np.zeros(len(words[14]), np.uint32))
    r = np.random.default_rng(2)
    low, size = r.integers(0, 200, (2, 60)).astype(float), r.integers(10, 130, (2, 60))
    high = low + size
    low[0, 0], low[1, 1], high[0, 2], high[1, 3], low[0, 4] = -math.inf, -math.inf, math.inf, math.nan, math.nan
    all_ = backgrounds._Candidates(*GRID)
    ids = r.integers(-(10**9), 10**9, 60) // 10 ** r.integers(0, 10, 60)
    found = all_.first(pa.array(ids), all_.taken(*low, *high)).to_pylist()
    high[1, 3] = math.inf
    want = [brute(i, [(*a, *b)]) for i, a, b in zip(ids, low.T, high.T, strict=True)]
    want[4] = None  # no number is the largest one, so it takes all
    assert [tuple(q[0].values()) if q else None for q in found] == want and sum(q is not None for q in want) > 50
