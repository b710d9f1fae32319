"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to cells: ordered values (sources, languages, ids) by how many rows come before their value, so
that a frequent value takes many cells and a cell many rare ones; sizes by the logarithm. A row's cell of all dimensions
has a place on the curve; rows are sorted by that place, within a cell by their text's hash (equal texts are neighbours)
and their id, and the order is cut into runs. Neighbours on the curve differ by one cell in one dimension, so a run
covers a compact block of all dimensions at once: a reader that filters by any of them skips most files by their minima
and maxima (`bounds`). `write_shards` writes the runs as files.

Two laws: `rows` cuts after equal numbers of rows (counts differ by one at most), `bytes` after equal sizes, each row going
where the middle of its bytes lies (a shard is off by the size of one row at most). Values are counted before they are
shuffled; the order is dealt into ranges, whose totals make the numbers, so no task sees all rows and a value that holds
a third of all rows is split like any other. Only keys, sizes and hashes are sorted, no texts.

A null text has no bytes, a null value (also an id) comes before all others of its dimension. Repeated rows are rows of
their own. With fewer rows than shards some are empty; an empty table gives no rows. Other columns are ignored by
`sharded` and kept by `write_shards`, where rows of equal ids and texts share the first of their slots.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators.numbering import running_sums

from .util import crc32_sql, fresh, stored, table, utf8

#: Bits of a cell's number in each dimension.
BITS = 8
SHARDS = 16


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places on the curve of cells[row, dimension], by Skilling's transposition: exchange and invert low bits from the top down, then undo the Gray code."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            low, inverted = q - 1, (x[i] & q) > 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | ((x[i] ^ flip) >> b & 1)
    return place


def _place(bits: int, n: int):
    @F.pandas_udf("long")
    def place(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([c.to_numpy() for c in cells], axis=1), bits)) if len(cells[0]) else pd.Series([], dtype="int64")

    if n * bits > 63:
        raise ValueError("cells of all dimensions together have 63 bits at most")
    return place


def _by_rank(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """rows with _cell_name: the share of rows with smaller values (nulls first), in cells. Distinct values are numbered, not rows."""
    counts = stored(rows.groupBy(name).agg(F.count("*").alias("_n")), "values")
    total = counts.agg(F.sum("_n")).first()[0] or 1
    before = running_sums(counts, [F.col(name).asc_nulls_first()], {"_upto": F.col("_n")})
    cell = F.floor((F.col("_upto") - F.col("_n")) * F.lit(1 << bits) / F.lit(total)).cast("int")
    cells = stored(before.select(F.col(name).alias("_value"), cell.alias(f"_cell_{name}")), "cells")
    return rows.join(cells, F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value")


def sharded(docs: DataFrame, shards: int = SHARDS, law: str = "rows", ranked: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """id_col, the ranked columns, size, text_crc32, curve, shard, slot. The dimensions are the ranked columns, the id's and the size's cells."""
    if law not in ("rows", "bytes") or shards < 1:
        raise ValueError("law is rows or bytes; one shard at least")
    data = utf8(text_col)
    names = {f"_d{i}": c for i, c in enumerate(ranked)}
    keys = docs.select(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`").alias(d) for d, c in names.items()], (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = keys = stored(keys, "keys")
    for d in names:
        rows = _by_rank(rows, d, bits)
    ends = keys.agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    of_id = F.coalesce(F.floor((F.col("_id") - F.lit(low)).cast("double") * F.lit(1 << bits) / F.lit(float(high - low + 1))).cast("int"), F.lit(0))
    of_size = F.least(F.floor(F.log2("size") * F.lit(1 << bits) / 32).cast("int"), F.lit((1 << bits) - 1))  # to 4 GB
    dimensions = [*[F.col(f"_cell_{d}") for d in names], of_id, of_size]
    placed = rows.withColumn("curve", _place(bits, len(dimensions))(*dimensions)).drop(*[f"_cell_{d}" for d in names])
    order = [F.col("curve"), F.col("text_crc32"), F.col("_id").asc_nulls_first(), F.col("size")]
    total = int((ends["n"] if law == "rows" else ends["bytes"]) or 1)
    numbers = running_sums(placed, order, {"_rank": F.lit(1).cast("long"), "_upto": F.col("size")})
    at = F.col("_rank") - 1
    if law == "rows":
        numbers = numbers.withColumn("shard", F.expr(f"(_rank - 1) * {shards}L div {total}L").cast("int"))
        slot = at - F.ceil(F.col("shard").cast("long") * F.lit(total) / F.lit(shards))
    else:
        numbers = stored(numbers.withColumn("shard", F.expr(f"least((2 * _upto - size) * {shards}L div {2 * total}L, {shards - 1}L)").cast("int")), "numbers")
        first = numbers.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row for each shard
        numbers = numbers.join(F.broadcast(first), "shard")
        slot = F.col("_rank") - F.col("_first")
    return numbers.select(F.col("_id").alias(id_col), *[F.col(d).alias(c) for d, c in names.items()], "size", "text_crc32", "curve", "shard", slot.cast("long").alias("slot"))


def bounds(shards: DataFrame, dimensions: tuple[str, ...] = ("source", "lang", "doc_id", "size")) -> DataFrame:
    """For each shard its rows, bytes and every dimension's least and greatest value: what tells a reader which files to skip."""
    return shards.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)])


def write_shards(docs: DataFrame, path: str, files: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """The documents in shard=N folders under path; a shard has as many files as the ranges of the order that meet it, each a run of the curve."""
    own = [fresh(docs, n) for n in ("shard", "_slot", "_crc", "_size")]
    keys = sharded(docs, id_col=id_col, text_col=text_col, **options).groupBy(id_col, "text_crc32", "size").agg(F.min(F.struct("shard", "slot")).alias("at"))
    keys = keys.select(F.col(id_col).alias("_key"), F.col("text_crc32").alias(own[2]), F.col("size").alias(own[3]), F.col("at.shard").alias(own[0]), F.col("at.slot").alias(own[1]))
    data = utf8(text_col)
    met = docs.join(keys, F.col(f"`{id_col}`").eqNullSafe(F.col("_key")) & (F.crc32(data) == F.col(own[2])) & (F.length(data) + 1 == F.col(own[3])))
    met.drop("_key", *own[2:]).repartitionByRange(files, *own[:2]).sortWithinPartitions(*own[:2]).drop(own[1]).write.partitionBy(own[0]).parquet(path)


def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "lang", "curve")


def _sql(bits: int = BITS) -> str:
    """The same cells; the curve one exchange after the other, as nested selects."""
    n, now = 4, "cells"
    step = lambda sets, where: f"(SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in sets.items())}) FROM {where})"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            swap = f"(xor(x0, x{i}) & {q - 1})"
            first = f"CASE WHEN x{i} & {q} > 0 THEN xor(x0, {q - 1}) ELSE xor(x0, {swap}) END"
            now = step({"x0": first} | ({f"x{i}": f"CASE WHEN x{i} & {q} > 0 THEN x{i} ELSE xor(x{i}, {swap}) END"} if i else {}), now)
    for i in range(1, n):
        now = step({f"x{i}": f"xor(x{i}, x{i - 1})"}, now)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        now = step({"flip": f"CASE WHEN x{n - 1} & {q} > 0 THEN xor(flip, {q - 1}) ELSE flip END"}, now)
    places = " + ".join(f"(((xor(x{i}, flip) >> {b}) & 1) << {b * n + n - 1 - i})" for b in range(bits) for i in range(n))
    rank = lambda c: f"(sum(n) OVER (ORDER BY {c} NULLS FIRST ROWS UNBOUNDED PRECEDING) - n) * {1 << bits} // sum(n) OVER ()"
    return f"""
WITH bytes AS (SELECT doc_id, lang, source, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
doc AS MATERIALIZED (SELECT doc_id, lang, source, len(b) + 1 AS size, {crc32_sql("b")} AS crc FROM bytes),
src AS (SELECT source, ({rank("source")})::BIGINT AS c FROM (SELECT source, count(*) AS n FROM doc GROUP BY source)),
lng AS (SELECT lang, ({rank("lang")})::BIGINT AS c FROM (SELECT lang, count(*) AS n FROM doc GROUP BY lang)),
cells AS (SELECT doc.*, src.c AS x0, lng.c AS x1, coalesce((doc_id - min(doc_id) OVER ()) * {1 << bits} // (max(doc_id) OVER () - min(doc_id) OVER () + 1), 0)::BIGINT AS x2,
  least(floor(log2(size) * {1 << bits} / 32), {(1 << bits) - 1})::BIGINT AS x3, 0::BIGINT AS flip FROM doc JOIN src ON src.source IS NOT DISTINCT FROM doc.source JOIN lng ON lng.lang IS NOT DISTINCT FROM doc.lang),
placed AS (SELECT *, ({places})::BIGINT AS curve FROM {now}),
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, crc, doc_id NULLS FIRST, size) - 1 AS r, count(*) OVER () AS n FROM placed),
cut AS (SELECT *, r * {SHARDS} // n AS shard FROM ranked)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY r) - 1)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, source, lang, curve FROM cut
"""


SQL = _sql()
