"""Queries on tables with keys of larger copies, and what they shuffle."""

import pytest

from __spark_entry__ import queries

TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def shifted(spark, tmp_path):
    """lineitem and orders with keys beyond those of 60 copies."""
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        t = spark.read.parquet(f"{TABLES}/{name}.parquet")
        t.withColumn(key, t[key] + 6_000_000_000).write.parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


def test_dup_score_of_large_ids(spark, shifted):
    """The shift is a multiple of 200 in every id, so scores stay."""
    rows = lambda d: sorted((r["a_det_id"] % 10**9, r["b_det_id"] % 10**9, r["score"]) for r in queries()["o7_dup_score"](spark, d).collect())
    want = rows(TABLES)
    assert want and rows(shifted) == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_box_means_join_no_cells(spark):
    """The map of scores is not joined."""
    _, plan = _plan(queries()["x3_box_means"](spark, TABLES))
    assert "Join" not in plan


def test_background_candidates_are_made_after_the_join(spark):
    _, plan = _plan(queries()["m4_background_boxes"](spark, TABLES))
    assert plan.rindex("Generate") < plan.index("Join")  # the plan is written from its end


def test_votes_are_counted_twice_at_most(spark):
    """Once where rows are left out and once where they are told, however often the ranks are looked at."""
    plan, _ = _plan(queries()["d11_seed_relabel"](spark, TABLES))
    assert plan.count("array_sort(") <= 2


def test_rows_of_one_text_are_not_dealt_by_it(spark):
    _, plan = _plan(queries()["d12_rule_decision"](spark, TABLES))
    assert "BroadcastHashJoin" in plan and "hashpartitioning(low" not in plan


def test_components_within_groups_cut_by_batches(spark):
    """A chain over many batches, small groups, and one id in several groups."""
    from boxwright.operators.components import components_within

    edges = [("a", i, i + 1) for i in range(0, 25000)] + [(f"g{i % 7}", 10 * i, 10 * i + 3) for i in range(50)] + [("h", 5, 7), ("h", 7, 9)]
    df = spark.createDataFrame(edges, "name string, u long, v long").repartition(3)
    got = {(r["name"], r["node"]): r["root"] for r in components_within(df, ["name"]).collect() if r["node"] != r["root"]}
    want = {("a", i): 0 for i in range(1, 25001)} | {(f"g{i % 7}", 10 * i + 3): 10 * i for i in range(50)} | {("h", 7): 5, ("h", 9): 5}
    assert got == want
