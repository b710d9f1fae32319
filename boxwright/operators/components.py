"""Connected components of a large edge list, by alternating large-star and small-star rounds.

Every round is a few joins and combinable minima over the edges alone; their number is logarithmic in practice. Each
round's edges are a table in the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions.stored import discard, stored
from boxwright.operators.blocks import least_roots


def _minima(pairs: DataFrame) -> DataFrame:
    """Stored apart from the join that reads it: both sides of the join are then plain exchanges, which Spark splits where a node is hot."""
    return stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m")), "minima")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    minima = _minima(both)
    joined = both.join(minima, F.col("u") == F.col("node")).where("v > u")
    out = stored(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
    discard(minima)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    minima = _minima(down)
    moved = down.join(minima, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stored(moved.union(minima.select(F.col("node").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "small")
    discard(minima)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of an edge (u, v) reaches; roots are not listed under themselves. Edges with a null end, and from a node to itself, say nothing; repeated ones are one."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        large = _large_star(now)
        discard(now)
        now = _small_star(large)
        discard(large)
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if mark == found:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = found


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """keys, u, v in order of the keys to keys, node, root (within the batch) and open: whether the group may go on in another batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        *keys, u, v = batch.columns
        codes = [k.dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
        no = np.cumsum(np.r_[0, np.any([c[1:] != c[:-1] for c in codes], axis=0)])
        ids, number = np.unique(np.concatenate([u.to_numpy(), v.to_numpy()]), return_inverse=True)
        nodes, at = np.unique(np.concatenate([no, no]) * len(ids) + number, return_inverse=True)
        root = least_roots(len(nodes), at[: len(no)], at[len(no) :])
        own = nodes // len(ids)
        row = pa.array(np.r_[0, np.flatnonzero(np.diff(no)) + 1][own])
        columns = [*(k.take(row) for k in keys), pa.array(ids[nodes % len(ids)]), pa.array(ids[nodes[root] % len(ids)]), pa.array((own == 0) | (own == no[-1]))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: len(keys)], "node", "root", "open"])


def components_within(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, root: components() of edges (keys, whole numbers u, v) that link nodes of one group.

    Edges lie in order of their group, so most groups are whole within a batch of rows and are done there. Of the few that a
    batch may cut, however large, it leaves each node's link to its root, for the rounds of components().
    """
    rows = edges.where("u is not null and v is not null and u <> v").select(*keys, F.col("u").cast("long"), F.col("v").cast("long"))
    schema = ", ".join([*(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys), "node bigint, root bigint, open boolean"])
    linked = stored(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked, schema), "linked")
    end = lambda c: F.struct(*keys, F.col(c).alias("node"))
    rest = components(linked.where("open").select(end("node").alias("u"), end("root").alias("v")))
    return linked.where("not open").select(*keys, "node", "root").unionByName(rest.select(*[f"node.{k}" for k in keys], "node.node", F.col("root.node").alias("root")))
