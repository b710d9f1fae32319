"""Row numbers and running sums over a whole table, without a window that sees all of it.

The rows are dealt into ranges of the order and stored; a range is a task's, and what lies before it is a sum over one row
for each range. Equal rows of the order get neighbouring numbers, so the order should end with a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions.stored import stored

_RANGE = "_range"


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, stored, with a column of the range that each row lies in."""
    return stored(df.repartitionByRange(*order).withColumn(_RANGE, F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sums over each row and all before it."""
    return _running(in_ranges(df, order), order, sums).drop(_RANGE)


def _running(ranged: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    totals = ranged.groupBy(_RANGE).agg(*[F.sum(v).alias(f"_b_{k}") for k, v in sums.items()])
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = totals.select(_RANGE, *[F.coalesce(F.sum(f"_b_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    own = Window.partitionBy(_RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({f"_o_{k}": F.sum(v).over(own) for k, v in sums.items()}).join(base, _RANGE)
    return rows.withColumns({k: F.col(f"_b_{k}") + F.col(f"_o_{k}") for k in sums}).drop(*[f"{p}_{k}" for k in sums for p in ("_b", "_o")])


def running_max(df: DataFrame, order: list[Column], name: str, value: Column) -> DataFrame:
    """df with the largest value of each row and all before it."""
    ranged = in_ranges(df, order)
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = ranged.groupBy(_RANGE).agg(F.max(value).alias("_m")).select(_RANGE, F.max("_m").over(before).alias("_b"))
    own = Window.partitionBy(_RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("_o", F.max(value).over(own)).join(base, _RANGE).withColumn(name, F.greatest("_b", "_o")).drop(_RANGE, "_b", "_o")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the rows' numbers from 1 on."""
    return running_sums(df, order, {name: F.lit(1).cast("long")})


def numbered_within(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df with the rows' numbers from 1 on within each group, however large a group is."""
    rows = stored(numbered(df, [F.col(g) for g in group] + order, "_all"), "numbered")
    first = rows.groupBy(*group).agg(F.min("_all").alias("_first"))
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    joined = rows.alias("r").join(first.alias("f"), same)
    return joined.select("r.*", (F.col("r._all") - F.col("f._first") + 1).alias(name)).drop("_all")
