"""Vectors against prototypes and class centres: matrix products of batches of rows and blocks of a bank.

A bank within BLOCK_BYTES is broadcast; a larger one is dealt into blocks and the rows into tiles, which meet in one shuffle
(products.py), and a row's best of each block are merged. vec_id is a key. Vectors that are shorter than others are taken as ending in zeros; null vectors take no part.
Similarities are rounded to six places; equal ones go to the smaller prototype.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.boxes import clip01
from boxwright.functions.vectors import dot
from boxwright.operators.products import BLOCK_BYTES, TILE_BYTES, block_product, parts

#: Rows that are multiplied at a time.
ROWS = 512


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        own = np.array([0.0 if x is None else x for x in v[:width]], np.float64)
        out[i, : len(own)] = own
    return out


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest whole numbers of each row, ties to the first column."""
    n = sims.shape[1]
    keys = sims * n - np.arange(n)
    take = min(k, n)
    at = np.argpartition(-keys, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(sims), 1))
    return np.repeat(np.arange(len(sims)), take), at.ravel()


class Bank:
    """Prototypes as a matrix, in order of (label and) id, and where each label's begin."""

    def __init__(self, held: pa.Table, width: int, by_label: bool):
        rows = sorted(held.select(["proto_id", "label", "is_reject", "v"]).to_pylist(), key=lambda r: (r["label"] if by_label else 0, r["proto_id"]))
        change = [i for i in range(1, len(rows)) if rows[i]["label"] != rows[i - 1]["label"]]
        self.bounds, self.matrix = [0, *change, len(rows)], _matrix([r["v"] for r in rows], width)
        key, label = held.schema.field("proto_id").type, held.schema.field("label").type
        self.neg = pa.array([-r["proto_id"] for r in rows], key)
        self.label, self.is_reject = pa.array([r["label"] for r in rows], label), pa.array([r["is_reject"] for r in rows], pa.bool_())

    def found(self, ids: pa.Array, vectors: pa.Array, k: int, by_label: bool) -> pa.RecordBatch:
        """vec_id and its k best, or the best of each label."""
        sims = np.rint(_matrix(vectors.to_pylist(), self.matrix.shape[1]) @ self.matrix.T * 1e6).astype(np.int64)
        if by_label:
            row = np.repeat(np.arange(len(sims)), len(self.bounds) - 1)
            column = np.stack([a + np.argmax(sims[:, a:b], axis=1) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)], axis=1).ravel()
        else:
            row, column = _best(sims, k)
        columns = [pa.array(sims[row, column] / 1e6), *(c.take(pa.array(column)) for c in (self.neg, self.label, self.is_reject))]
        offsets = np.searchsorted(row, np.arange(len(sims) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=["sim", "neg", "label", "is_reject"]))
        return pa.RecordBatch.from_arrays([ids, lists], names=["vec_id", "found"])


def of_blocks(rows: DataFrame, bank: DataFrame, k: int = 1, by_label: bool = False) -> DataFrame:
    """vec_id, found: the k best (sim, neg, label, is_reject; neg: -proto_id) of each row (vec_id, embedding), or the best of each label. bank: proto_id, label, is_reject, v."""
    spark = rows.sparkSession
    kind = bank.schema["label"].dataType.simpleString()
    key = bank.schema["proto_id"].dataType.simpleString()
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, found array<struct<sim: double, neg: {key}, label: {kind}, is_reject: boolean>>"
    held = bank.where("v is not null").select("proto_id", "label", "is_reject", "v")
    good = rows.select("vec_id", "embedding").where("embedding is not null")
    total, width = held.agg(F.sum(F.size("v") * 8 + 64), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], schema)
    blocks = parts(total, BLOCK_BYTES)
    if blocks == 1:
        block = spark.sparkContext.broadcast(Bank(held.toArrow(), width, by_label))  # within BLOCK_BYTES

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    yield block.value.found(part.column(0), part.column(1), k, by_label)

        return good.mapInArrow(scan, schema)

    def meet(tile: pa.Table, block: pa.Table) -> pa.Table:
        own = Bank(block, width, by_label)
        return pa.Table.from_batches([own.found(part.column(0), part.column(1), k, by_label) for part in tile.combine_chunks().to_batches(max_chunksize=ROWS)])

    tiles = parts(good.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0], TILE_BYTES)
    out = block_product(good, held, tiles, blocks, meet, schema)
    if by_label:  # the best of each label over the blocks
        best = out.select("vec_id", F.explode("found").alias("f")).groupBy("vec_id", "f.label").agg(F.max("f").alias("f"))
        return best.groupBy("vec_id").agg(F.collect_list("f").alias("found"))
    return out.groupBy("vec_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found")), asc=False), 1, k).alias("found"))


def scores(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Best and second label of each row by its best prototype, the lead, whether the best is a reject class."""
    one = lambda f: F.struct((-f["sim"]).alias("neg_sim"), f["label"].alias("label"), f["sim"].alias("sim"), (-f["neg"]).alias("proto_id"), f["is_reject"].alias("is_reject"))
    ranked = of_blocks(rows, bank, by_label=True).select("vec_id", F.array_sort(F.transform("found", one)).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    lead = first["sim"] - F.coalesce(second["sim"], F.lit(0.0))
    return ranked.select("vec_id", first["label"].alias("top_label"), first["sim"].alias("top_sim"), first["proto_id"].alias("top_id"), second["label"].alias("second_label"), second["sim"].alias("second_sim"), F.round(lead, 6).alias("margin"), first["is_reject"].alias("is_reject_match"), F.coalesce(first["sim"] - second["sim"] < 0.03, F.lit(False)).alias("low_margin"))


def top(rows: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """The k closest prototypes of each row, place 1 first."""
    best = of_blocks(rows, bank, k).select("vec_id", F.posexplode(F.sort_array("found", asc=False)).alias("at", "p"))
    return best.select("vec_id", (F.col("at") + 1).alias("place"), (-F.col("p.neg")).alias("proto_id"), "p.sim")


def centroids(rows: DataFrame) -> DataFrame:
    """label, v: the mean vector of each label, of unit length."""
    m = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = m.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    return v.select("label", F.transform("v", lambda p: p["m"] / F.greatest(F.col("norm"), F.lit(1e-12))).alias("v"))


def density(rows: DataFrame, centres: DataFrame) -> DataFrame:
    sim = dot(F.col("embedding"), F.col("v"))
    return rows.join(centres, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(sim), 5).alias("density"), F.round(F.min(sim), 5).alias("least"))


def nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """vec_id, core_label, core_sim: the class centre (label, v) that is closest to each row."""
    bank = centres.select(F.col("label").alias("proto_id"), "label", F.lit(False).alias("is_reject"), "v")
    found = of_blocks(rows, bank).select("vec_id", F.get("found", F.lit(0)).alias("b"))
    return found.select("vec_id", (-F.col("b.neg")).alias("core_label"), F.col("b.sim").alias("core_sim"))


def flagged(rows: DataFrame, corrections: DataFrame, least: float) -> DataFrame:
    """vec_id of the rows as close to a stored correction."""
    bank = corrections.select(F.col("vec_id").alias("proto_id"), "label", F.lit(False).alias("is_reject"), F.col("embedding").alias("v"))
    return of_blocks(rows, bank).where(F.get("found", F.lit(0))["sim"] >= least).select("vec_id")


def p_good(semantic: Column, detector: Column, geometry: Column) -> Column:
    """.5, .3 and .2 of the parts, each within 0 and 1; a null or NaN is 0."""
    sane = lambda v: clip01(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    return 0.5 * sane(semantic) + 0.3 * sane(detector) + 0.2 * sane(geometry)


def anchored(rows: DataFrame, group: str, alpha: float) -> DataFrame:
    """Scores lowered by alpha times the likeness to a negative anchor (proto_sim), then shared out to 1 within a group."""
    lowered = F.col("clip_score") * (1 - alpha * clip01(F.coalesce("proto_sim", F.lit(0.0))))
    adjusted = rows.withColumn("adjusted", lowered)
    totals = adjusted.groupBy(F.col(group).alias("_group")).agg(F.sum("adjusted").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("adjusted") / F.col("_total")).otherwise(0.0)
    return adjusted.join(totals, F.col(group).eqNullSafe(F.col("_group"))).withColumn("share", share).drop("_group", "_total")


def replicated(rows: DataFrame, times: Column) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
