"""Exact top-k inner products: tiled matrix products of query blocks and shards, partial selection, tree merging.

Vectors are quantised to floor(scale * x). A query is compared with every other row whose vector has the same length.
Queries within a block's bytes are sent to all tasks; more of them are dealt into blocks and the rows into tiles, which meet
in one shuffle (operators/products.py). A task multiplies its block with its rows, tile by tile, and keeps the best k + 1 of
each query. The lists of all tasks meet in a tree: first those of a sixth of the bits of the task's (or tile's) number, then
those of a query; then the query itself leaves.

Null vectors, null ids and vectors holding null, NaN or infinite components take no part. A query is a distinct id and
vector: rows that repeat both are one query, rows with the same id and another vector are queries of their own, and each
of them but one copy of the query itself is a candidate. Equal scores go to the smaller id. Scores are exact; one beyond
a 64-bit integer is set to the nearest. With fewer than k candidates all are returned; an empty table gives no rows.
Vectors may have any length (very long ones make smaller blocks); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.operators.products import BLOCK_BYTES, TILE_BYTES, block_product, parts

from .util import stored, table

#: Rows of a tile of a shard, queries of a tile.
TILE_ROWS, TILE_QUERIES = 4096, 512
#: Lists of that many groups of tasks are merged before those of a query.
FAN_IN = 64
EXACT = 2.0**53


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, q (doubles holding integers), of the vectors that take part."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & whole)
    floored = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.floor(x * float(scale)).cast("double"))
    return valid.select(F.col(id_col).cast("long").alias("id"), floored.alias("q"))


class Block:
    """Some queries: for each length of vectors the first one's place and the matrix; of all of them numbers, ids and own scores."""

    def __init__(self, rows: list[dict]):
        by: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["id"], r["number"])):
            by.setdefault(len(r["q"]), []).append(r)
        ordered = [r for some in by.values() for r in some]
        self.ids, self.numbers = (np.array([r[c] for r in ordered], np.int64) for c in ("id", "number"))
        self.of, at, own = {}, 0, []
        for d, some in by.items():
            matrix = np.array([r["q"] for r in some], np.float64).reshape(len(some), d)
            self.of[d] = at, matrix
            own += [_products(matrix[i : i + 1], matrix[i : i + 1]).astype(np.int64).ravel() for i in range(len(some))]
            at += len(some)
        self.own = np.concatenate(own) if own else np.zeros(0, np.int64)


def _products(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as float64 where that holds them and else as clipped Python integers."""
    if not q.shape[1] or np.abs(q).max(initial=0) * np.abs(t).max(initial=0) * q.shape[1] < EXACT / TILE_ROWS:
        return q @ t.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(t).T, -(2**63), 2**63 - 1)


def _best(scores: np.ndarray, first: int, t_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partial selection within a tile: (query's number from first on, score, id) of the k best, ties to the smaller id."""
    n = scores.shape[1]
    if scores.dtype == object:
        rank = np.array([np.lexsort((t_ids, [-x for x in row])) for row in scores.tolist()]).argsort(axis=1)
        keys = (n - rank).astype(np.float64)
    else:
        keys = scores * n - np.arange(n)  # exact: products stay under 2**53 / TILE_ROWS
    take = min(k, n)
    at = np.argpartition(-keys, take - 1, axis=1)[:, :take] if n > take else np.tile(np.arange(n), (len(keys), 1))
    rows = np.repeat(np.arange(len(keys)), at.shape[1])
    at = at.ravel()
    return rows + first, scores[rows, at].astype(np.int64), t_ids[at]


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    query, score, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, ~score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = rank < k
    return query[keep], score[keep], ids[keep]


def _lists(queries: Block, batches: Iterable[pa.RecordBatch], k: int, part: int) -> pa.RecordBatch | None:
    """The k + 1 best of the rows (id, q) for each query, the query's own row among them if it is that good."""
    best = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(batch.column(1).offsets.to_numpy())
        ids_all, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
        starts = np.r_[0, np.cumsum(lengths)]
        for d in np.unique(lengths).tolist():
            if d not in queries.of:
                continue
            at = np.flatnonzero(lengths == d)
            at = at[np.argsort(ids_all[at], kind="stable")]
            first, q = queries.of[d]
            for a in range(0, len(at), TILE_ROWS):
                rows = at[a : a + TILE_ROWS]
                tile = flat[starts[rows][:, None] + np.arange(d)] if d else np.zeros((len(rows), 0))
                for b in range(0, len(q), TILE_QUERIES):
                    found = _best(_products(q[b : b + TILE_QUERIES], tile), first + b, ids_all[rows], k + 1)
                    best = found if best is None else tuple(np.concatenate(x) for x in zip(best, found, strict=True))
                if len(best[0]) > 8 * (k + 1) * len(queries.ids):
                    best = _merge([best], k + 1)
    if best is None:
        return None
    query, score, ids = _merge([best], k + 1)
    own = (ids == queries.ids[query]) & (score == queries.own[query])
    columns = [queries.numbers[query], queries.ids[query], score, ids, own, np.full(len(ids), part, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["number", "query_id", "score", "vec_id", "own", "part"])


_LISTS = "number long, query_id long, score long, vec_id long, own boolean, part int"


def exact_topk(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, block_bytes: int = BLOCK_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a predicate on id_col."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col, scale)
    size = F.sum(F.size("q") * 8 + 32)
    queries = stored(quantised(vectors.where(is_query), id_col, vec_col, scale).distinct().withColumn("number", F.monotonically_increasing_id()), "queries")
    blocks = parts(queries.select(size).first()[0], block_bytes)
    if blocks == 1:
        block = spark.sparkContext.broadcast(Block([r.asDict() for r in queries.collect()]))  # within block_bytes

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if (found := _lists(block.value, batches, k, TaskContext.get().partitionId())) is not None:
                yield found

        lists = rows.mapInArrow(scan, _LISTS)
    else:

        def meet(tile: pa.Table, block: pa.Table) -> pa.Table:
            whole = tile.select(["id", "q"]).combine_chunks().to_batches()
            found = _lists(Block(block.select(["id", "q", "number"]).to_pylist()), whole, k, tile.column("_tile")[0].as_py())
            return empty_lists if found is None else pa.Table.from_batches([found])

        empty_lists = pa.table({n: pa.array([], t) for n, t in (("number", pa.int64()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("own", pa.bool_()), ("part", pa.int32()))})
        lists = block_product(rows, queries, parts(rows.select(size).first()[0], tile_bytes), blocks, meet, _LISTS)
    lists = stored(lists, "lists")
    order = [F.desc("score"), F.asc("vec_id")]
    ranked = lambda df, *group: df.withColumn("rank", F.row_number().over(Window.partitionBy("number", *group).orderBy(*order))).where(F.col("rank") <= k + 1)
    top = ranked(ranked(lists.withColumn("part", F.col("part") % FAN_IN), "part").drop("rank"))
    # one row of equal score and id is the query itself: what is behind it moves up
    itself = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("number"))
    moved = top.withColumn("itself", F.coalesce(itself, F.lit(k + 1))).where(F.col("rank") != F.col("itself"))
    return moved.select("query_id", (F.col("rank") - (F.col("rank") > F.col("itself")).cast("int")).alias("rank"), "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""
