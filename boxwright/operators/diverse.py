"""Farthest-point samples of labels of any size, the same picks as one after the other.

A row's distance to the picks so far only shrinks. So of a label's rows the few farthest are looked at together: while the
best of them is farther than all others were, it is the next pick, whatever the others' distances are by now. A round
finds those few by a tree of partial top lists, picks from them in one task, and then brings every row's distance up to
date against the new picks, bucket by bucket. A label of no more rows than that is done in its first round.

No task holds more than a bucket, a top list, or the picks of a round; each round is a table in the shared folder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions.stored import discard, own_tables, stored

#: Rows of a bucket, rows of a label that are looked at together, top lists that are merged at a time.
BUCKET, TOGETHER, MERGED = 8192, 512, 16


def cosines(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row in one order of summation, so that a row's cosine does not depend on the rows beside it."""
    return (matrix * v).sum(axis=1)


def farthest_first(reliability: np.ndarray, ids: np.ndarray, vectors: list, k: int) -> np.ndarray:
    """Places of k rows, all in one place: first the least (reliability, id), then always the one farthest (cosine) from those taken, the least id of equal ones; a missing vector is infinitely far."""
    matrix, there = padded(vectors, max((len(v) for v in vectors if v is not None), default=0))
    first = np.lexsort((ids, reliability))[:1]
    least = np.full(len(ids), np.inf)
    taken, by_id = [], np.argsort(ids, kind="stable")
    while len(taken) < min(k, len(ids)):
        at = int(first[0]) if not taken else int(by_id[np.argmax(least[by_id])])
        taken.append(at)
        if there[at]:
            least[there] = np.minimum(least[there], 1 - cosines(matrix[there], matrix[at]))
        least[taken] = -np.inf
    return np.array(taken, int)


def padded(vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of a matrix, and which are there at all."""
    matrix, there = np.zeros((len(vectors), size)), np.array([v is not None for v in vectors], bool)
    for i, v in enumerate(vectors):
        if v is not None:
            matrix[i, : len(v)] = v
    return matrix, there


def _picks(size: int, together: int, first: bool):
    """The next picks of a label: top is its farthest rows, and one more that only bounds the rest (where there are more). In the first round nothing bounds them beyond the first pick."""

    def pick(top: pd.DataFrame) -> pd.DataFrame:
        top = top.sort_values(["d", "reliability", "result_id"], ascending=[False, True, True], ignore_index=True)
        need, bounded = int(top["need"].iloc[0]), len(top) > together
        bound = (top["d"].iloc[-1], top["result_id"].iloc[-1]) if bounded else None
        own = top.iloc[: len(top) - bounded]
        matrix, there = padded(list(own["v"]), size)
        d, ids, taken = own["d"].to_numpy(float).copy(), own["result_id"].to_numpy(), []
        while len(taken) < min(need, len(own)):
            best = d.max()
            at = int(np.flatnonzero(d == best)[0]) if not taken else int(min(np.flatnonzero(d == best), key=lambda i: ids[i]))
            if taken and bound and (first or (best, -ids[at]) <= (bound[0], -bound[1])):
                break
            taken.append(at)
            if there[at]:
                free = there & (d > -np.inf)
                d[free] = np.minimum(d[free], 1 - cosines(matrix[free], matrix[at]))
            d[at] = -np.inf
        return own.iloc[taken][["label", "result_id", "v"]].assign(place=np.arange(len(taken), dtype=np.int32))

    return pick


def _nearer(size: int, together: int):
    """A bucket's rows against the new picks: those left, their distances, and which are among the bucket's farthest."""

    def update(rows: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
        rows = rows[~rows["result_id"].isin(picks["result_id"])]
        matrix, there = padded(list(rows["v"]), size)
        chosen, known = padded(list(picks.sort_values("place")["v"]), size)
        d = rows["d"].to_numpy(float).copy()
        for v in chosen[known]:
            d[there] = np.minimum(d[there], 1 - cosines(matrix[there], v))
        far = np.zeros(len(rows), bool)
        far[np.lexsort((rows["result_id"], -d))[: together + 1]] = True
        return rows.assign(d=d, reliability=0.0, far=far)

    return update


def diverse_sample(rows: DataFrame, ratio: float, bucket: int = BUCKET, together: int = TOGETHER) -> DataFrame:
    """label, result_id of a share of each label, at least one row: farthest-point samples. rows: result_id (a key), label, reliability, v.

    A missing reliability is 0; a row without a vector (or with a null or NaN in it) is infinitely far from all. Null labels are
    one label. Equal distances go to the smaller id. Rows of one id are one row. An empty table gives no rows.
    """
    with own_tables() as own:
        picks = _rounds(rows, ratio, bucket, together)
        own.discard_all_but(*picks)
    return reduce(DataFrame.unionByName, [p.select("label", "result_id") for p in picks])


def _rounds(rows: DataFrame, ratio: float, bucket: int, together: int) -> list[DataFrame]:
    """The picks of each round, stored."""
    key = [F.col("label"), F.col("result_id")]
    known = F.coalesce(F.nanvl(F.col("reliability").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("reliability")
    wide = F.col("v").cast("array<double>")
    sound = F.when(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x)), wide)
    rows = rows.where("result_id is not null").select(*key, known, sound.alias("v")).dropDuplicates(["result_id"])
    same = lambda a, b: F.col(f"{a}.label").eqNullSafe(F.col(f"{b}.label"))
    sizes = stored(rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("need", F.greatest(F.lit(1), F.bround(F.col("n") * ratio).cast("long"))), "sizes")
    dealt = rows.alias("r").join(sizes.alias("s"), same("r", "s")).select("r.*", F.pmod(F.xxhash64("result_id"), F.ceil(F.col("n") / bucket)).alias("bucket"))
    first = Window.partitionBy("label", "bucket").orderBy("reliability", "result_id")
    state = stored(dealt.withColumns({"d": F.lit(float("inf")), "far": F.row_number().over(first) <= together + 1}), "distances")
    about = state.agg(F.max(F.size("v")).alias("size"), F.max("bucket").alias("buckets")).first()
    if about["buckets"] is None:
        return [state]
    size, need, done = max(about["size"], 0), sizes.select("label", "need"), []
    picked = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name in ("label", "result_id", "v"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    while True:
        top, groups = state.where("far"), int(about["buckets"]) + 1
        while groups > 1:  # lists of a few buckets at a time
            groups = -(-groups // MERGED)
            w = Window.partitionBy("label", F.pmod(F.col("bucket"), F.lit(groups))).orderBy(F.desc("d"), "reliability", "result_id")
            top = top.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= together + 1).drop("_rank")
        asked = top.alias("t").join(need.alias("n"), same("t", "n")).select("t.*", "n.need")
        picks = stored(asked.groupBy("label").applyInPandas(_picks(size, together, not done), f"{picked}, place int"), "picks")
        done.append(picks)
        taken = picks.groupBy("label").agg(F.count("*").alias("taken"))
        left = stored(need.alias("n").join(taken.alias("t"), same("n", "t"), "left").select("n.label", (F.col("n.need") - F.coalesce("t.taken", F.lit(0))).alias("need")).where("need > 0"), "need")
        if left.isEmpty():
            break
        need = left
        going = state.alias("s").join(need.alias("n"), same("s", "n"), "left_semi")
        chosen = picks.alias("p").join(need.alias("n"), same("p", "n"), "left_semi")
        each = chosen.alias("p").join(going.select("label", "bucket").distinct().alias("s"), same("p", "s")).select("p.*", F.col("s.bucket").alias("bucket"))  # a round's picks for every bucket
        nearer = stored(going.groupBy("label", "bucket").cogroup(each.groupBy("label", "bucket")).applyInPandas(_nearer(size, together), schema), "distances")
        discard(state)
        state = nearer
    return done
