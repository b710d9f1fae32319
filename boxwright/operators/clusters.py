"""k-means of many keys at once: one round moves the centres of all of them.

Vectors are taken in fixed point, so sums, centres and distances are whole numbers: nothing depends on the order in which
tasks finish, and equal distances go to the lower cluster. A key's first centres are far from each other among its rows of
the smallest hashes.

A row keeps its cluster, an upper bound of the distance to it and a lower bound of the distance to any other (Hamerly's
bounds, rounded outwards); where the upper one is below the lower one nothing is compared. Sums change by the rows that
changed clusters alone. Each round is a table in the shared folder. Centres are a small table that Spark joins by its size;
a key that holds a third of the rows is split by the join, and its sums are added up before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions.stored import own_tables, stored

#: Fixed point: so many parts of one.
PARTS = 1 << 20
#: Rows of a key among which its first centres are chosen.
POOL = 64
SLACK = 1e-12


def fixed(v: str | Column) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: F.floor(x.cast("double") * PARTS + 0.5).cast("long"))


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def _centres(changes: DataFrame, before: DataFrame) -> DataFrame:
    """label, cluster, n, s (number and sum of its rows), c (their floored mean; a cluster without rows stays), moved, touched. changes: label, cluster, i, s; i = 0 counts rows."""
    added = changes.groupBy("label", "cluster", "i").agg(F.sum("s").alias("s"))
    whole = added.groupBy("label", "cluster").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("d"))  # a row for each component
    same = F.col("b.label").eqNullSafe(F.col("w.label")) & (F.col("b.cluster") == F.col("w.cluster"))
    j = before.alias("b").join(whole.alias("w"), same, "left").select("b.label", "b.cluster", "b.n", "b.s", "b.c", "w.d")
    parts = F.transform(F.slice("d", 2, F.size("d") - 1), lambda p: p["s"])
    there = F.col("d").isNotNull()
    summed = j.select("label", "cluster", F.when(there, F.col("n") + F.element_at("d", 1)["s"]).otherwise(F.col("n")).alias("n"), F.when(there, F.zip_with("s", parts, lambda x, y: x + y)).otherwise(F.col("s")).alias("s"), F.col("c").alias("old"), there.alias("touched"))
    mean = F.expr("if(n > 0, transform(s, x -> (x - pmod(x, n)) div n), old)")
    return summed.withColumn("c", mean).select("label", "cluster", "n", "s", "c", (F.sqrt(_square(F.col("c"), F.col("old")).cast("double")) * (1 + SLACK)).alias("moved"), "touched")


def _seeds(pool: pd.DataFrame) -> pd.DataFrame:
    """A label's first centres: of its pool the first row, then always the one farthest from those taken (of equal ones the first)."""
    pool = pool.sort_values("place", ignore_index=True)
    q = np.stack(pool["q"].tolist()).astype(np.int64)
    taken, least = [0], None
    while len(taken) < min(int(pool["k"].iloc[0]), len(q)):
        square = ((q - q[taken[-1]]) ** 2).sum(axis=1)
        least = square if least is None else np.minimum(least, square)
        taken.append(int(np.argmax(least)))
    return pd.DataFrame({"label": [pool["label"].iloc[0]] * len(taken), "cluster": range(len(taken)), "c": [q[i].tolist() for i in taken]})


def _by_label(centres: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("cluster", "c", "moved")))  # a row for each cluster
    return centres.groupBy("label").agg(ordered.alias("a")).select(F.col("label").alias("_label"), F.transform("a", lambda x: x["c"]).alias("cs"), F.transform("a", lambda x: x["moved"]).alias("moved"))


def _assigned(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows (label, key columns, q, cluster, up, low) with new clusters and bounds, was (the cluster before) and scanned."""
    j = rows.join(_by_label(centres), F.col("label").eqNullSafe(F.col("_label")))
    own = F.get("moved", F.col("cluster"))
    others = F.array_max(F.transform("moved", lambda m, i: F.when(i != F.col("cluster"), m)))
    j = j.withColumns({"up": (F.col("up") + own) * (1 + SLACK), "low": F.col("low") * (1 - SLACK) - F.coalesce(others, F.lit(0.0)) * (1 + SLACK)})
    mine = F.sqrt(_square(F.col("q"), F.get("cs", F.col("cluster"))).cast("double")) * (1 + SLACK)
    near = F.when(F.col("cluster").isNull(), F.lit(float("inf"))).when(F.col("up") < F.col("low"), F.col("up")).otherwise(mine)
    j = j.withColumn("up", near).withColumn("scanned", F.col("cluster").isNull() | ~(F.col("up") < F.col("low")))
    ranked = F.array_sort(F.transform("cs", lambda c, i: F.struct(_square(F.col("q"), c).alias("d"), i.cast("int").alias("i"))))
    j = j.withColumn("r", F.when(F.col("scanned"), F.slice(ranked, 1, 2)))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    root = lambda d, way: F.sqrt(d.cast("double")) * (1 + way * SLACK)
    return j.select(
        *[c for c in rows.columns if c not in ("cluster", "up", "low")],
        F.col("cluster").alias("was"),
        F.when(F.col("scanned"), first["i"]).otherwise(F.col("cluster")).alias("cluster"),
        F.when(F.col("scanned"), root(first["d"], 1)).otherwise(F.col("up")).alias("up"),
        F.when(F.col("scanned"), F.coalesce(root(second["d"], -1), F.lit(float("inf")))).otherwise(F.col("low")).alias("low"),
        "scanned",
    )


def keyed_kmeans(rows: DataFrame, k: DataFrame, most: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """rows (label, result_id, v: finite, of one length in a label; result_id a key) with cluster (from 0), of the labels in k (label, k up to most). Null labels are one label."""
    with own_tables() as own:
        same = F.col("r.label").eqNullSafe(F.col("k.label"))
        h = F.md5(F.concat(F.lit(f"{seed}-"), F.col("result_id").cast("string")).cast("binary"))
        state = stored(rows.alias("r").join(k.alias("k"), same).select("r.*", "k.k").select("label", "result_id", fixed("v").alias("q"), "k", h.alias("h")), "kmeans")
        place = F.row_number().over(Window.partitionBy("label").orderBy("h", "result_id"))
        pool = state.withColumn("place", place).where(F.col("place") <= max(POOL, most))  # so many rows of a label, cut before the shuffle
        kind = rows.schema["label"].dataType.simpleString()
        seeds = pool.select("label", "place", "q", "k").groupBy("label").applyInPandas(_seeds, f"label {kind}, cluster int, c array<bigint>")
        zeros = F.transform("c", lambda x: F.lit(0).cast("long"))
        centres = stored(seeds.select("label", "cluster", F.lit(0).cast("long").alias("n"), zeros.alias("s"), "c", F.lit(0.0).alias("moved"), F.lit(True).alias("touched")), "centres")
        none = F.lit(None)
        now = state.select("label", "result_id", "q", none.cast("int").alias("cluster"), none.cast("double").alias("up"), none.cast("double").alias("low"))
        for _ in range(rounds):
            done = stored(_assigned(now, centres), "kmeans")
            changed = done.where("was is null or was <> cluster")
            part = lambda c, sign: changed.where(F.col(c).isNotNull()).select("label", F.col(c).alias("cluster"), F.posexplode(F.transform(F.concat(F.array(F.lit(1).cast("long")), "q"), lambda x: x * sign)).alias("i", "s"))  # noqa: B023, E731
            centres = stored(_centres(part("cluster", 1).unionByName(part("was", -1)), centres), "centres")
            own.discard_all_but(done, centres)
            if centres.where("touched").isEmpty():
                break
            now = done.drop("was", "scanned")
        own.discard_all_but(done)
    return rows.join(done.select("result_id", "cluster"), "result_id")
