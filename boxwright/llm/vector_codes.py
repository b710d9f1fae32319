"""Vector code compression: product codes of integer vectors, by Lloyd rounds with Hamerly's bounds.

Components become floor(scale * x); a vector is cut into equal parts, each with a codebook of few entries that starts as
that part of the vectors with the smallest ids. A round assigns every part to the nearest entry and moves each entry to
the floored mean of its parts. A row keeps, for each part, its entry, an upper bound of the distance to it and a lower
bound of the distance to any other. When entries move the bounds move with them; only where the upper bound is not
strictly below the lower one (or below half the way to the next entry), also after the distance itself is known, are all
entries scanned, in integers. Bounds are rounded outwards, so codes, codebooks and errors are those of plain Lloyd rounds.

A round is one pass without a shuffle: each task writes its rows and one row of what it adds to the sums of the entries,
the change since the last round. The rows are a table in the shared folder, so a lost executor costs one round at most.
The driver holds the codebooks (as many vectors as an entry list is long) and their sums, whatever the number of rows.

Vectors that are null or hold null or non-finite components (also after scaling) are dropped. Vectors of another length
than the commonest that the parts divide (of equally common ones the shorter) keep their row, with null code and error;
if there is no such length, so do all. Fewer vectors than entries make shorter codebooks. Null ids come last and repeated
ids in the order of their vectors; repeated rows are rows of their own. Equal distances go to the lower entry, an entry
without parts stays. Components of any finite size are exact; an error beyond a 64-bit integer is set to the largest. An
empty table gives no rows. Other columns are carried by name, if asked for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import discard, sliced, stored, table

#: Rounding of a bound takes it outwards by this share; doubles are off by far less.
SLACK = 2.0**-46
#: Sums leave a task in digits of so many bits, which Spark adds up as long integers.
DIGIT = 40
EXACT, LONGEST = 2.0**53, 2**63 - 1
FARTHEST = math.sqrt(np.finfo(np.float64).max) / 4
_STATE = [T.StructField(name, T.ArrayType(kind)) for name, kind in (("_q", T.DoubleType()), ("_code", T.IntegerType()), ("_up", T.DoubleType()), ("_low", T.DoubleType()))]
_SUMS = T.StructField("_sums", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("digit", T.IntegerType()), T.StructField("part", T.LongType())])))


@dataclass
class Codebooks:
    """entries[part][entry]: integers (as objects, so of any size); moved: how far each entry came in the last round, rounded up."""

    entries: np.ndarray
    moved: np.ndarray | None = None
    #: For each round, parts whose entries were all scanned.
    scans: list[int] = field(default_factory=list)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from their squares, rounded down and up."""
    if squares.dtype == object and max(squares.ravel().tolist(), default=0) < EXACT:
        squares = squares.astype(np.float64)
    if squares.dtype == object:
        roots = np.array([float(math.isqrt(s)) if s < FARTHEST**2 else np.inf for s in squares.ravel().tolist()]).reshape(squares.shape)
        return np.where(np.isinf(roots), FARTHEST, roots) * (1 - SLACK), (roots + 1) * (1 + SLACK)
    roots = np.sqrt(squares)
    return roots * (1 - SLACK), roots * (1 + SLACK)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    away = x - y
    return (away * away).sum(axis=-1)


class Round:
    """What a task needs of the codebooks: entries as doubles where those are exact, how far the bounds move, the ways between entries."""

    def __init__(self, books: Codebooks):
        self.exact, self.moved = books.entries, books.moved
        self.largest = float(min(max((abs(x) for x in books.entries.ravel().tolist()), default=0), 10**300))
        parts, k, _ = books.entries.shape
        others = np.full((parts, k), np.inf)
        for e in range(k):
            for f in range(k):
                if e != f:
                    others[:, e] = np.minimum(others[:, e], _roots(_squares(books.entries[:, e], books.entries[:, f]))[0] / 2)
        self.half = others
        if self.moved is not None:  # the farthest move of any other entry
            rest = np.where(np.eye(k, dtype=bool), 0.0, self.moved[:, None, :])
            self.others_moved = rest.max(axis=2)

    def _in(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and entries in a type that holds every squared distance."""
        widest = max(self.largest, np.abs(q).max(initial=0.0)) * 2
        if widest < FARTHEST and widest * widest * max(q.shape[2], 1) < EXACT:
            return q, self.exact.astype(np.float64)
        return np.array([int(x) for x in q.ravel().tolist()], object).reshape(q.shape), self.exact

    def assign(self, q: np.ndarray, code: np.ndarray | None, up: np.ndarray | None, low: np.ndarray | None):
        """q[row, part, component] with its last entries and bounds: entries, bounds, squared distances, number of scans."""
        n, parts, _ = q.shape
        q, entries = self._in(q)
        every = np.arange(parts)
        if code is None:
            code, up, low = np.zeros((n, parts), np.int32), np.full((n, parts), np.inf), np.zeros((n, parts))
        else:
            code = code.copy()
            up = (up + self.moved[every, code]) * (1 + SLACK)
            low = np.maximum(low * (1 - SLACK) - self.others_moved[every, code] * (1 + SLACK), 0)
        squares = _squares(q, entries[every, code])
        fails = ~(up < np.maximum(low, self.half[every, code]))
        up = np.where(fails, _roots(squares)[1], up)
        fails &= ~(up < np.maximum(low, self.half[every, code]))
        for p in range(parts):
            at = np.flatnonzero(fails[:, p])
            if len(at):
                all_squares = _squares(q[at, p][:, None, :], entries[p][None])
                best = all_squares.argmin(axis=1)  # the first of equal ones
                row = np.arange(len(at))
                code[at, p], squares[at, p] = best, all_squares[row, best]
                below, above = _roots(all_squares)
                up[at, p] = above[row, best]
                below[row, best] = np.inf
                low[at, p] = below.min(axis=1)
        return code, up, low, squares, int(fails.sum())


def _digits(sums: np.ndarray) -> list[dict]:
    out = []
    for at, x in enumerate(sums.ravel().tolist()):
        sign, x, digit = (-1, -x, 0) if x < 0 else (1, x, 0)
        while x:
            out.append({"at": at, "digit": digit, "part": sign * (x & ((1 << DIGIT) - 1))})
            x, digit = x >> DIGIT, digit + 1
    return out


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def _pass(books: Round, length: int, carried: int, last: bool) -> Callable:
    """One round: rows with new entries and bounds, then a row of the changes of the sums; the last one gives codes and errors."""
    parts, k, dim = books.exact.shape
    kind = pa.list_(pa.struct([("at", pa.int32()), ("digit", pa.int32()), ("part", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scans, names = np.zeros((parts, k, dim + 1), object), 0, None
        for batch in sliced(batches):
            if not batch.num_rows:
                continue
            own, columns = batch.columns[:carried], batch.columns[carried:]
            q = _matrix(columns[0], length, np.float64).reshape(batch.num_rows, parts, dim)
            old = None if len(columns) == 1 else _matrix(columns[1], parts, np.int32)
            bounds = (None, None) if old is None else tuple(_matrix(c, parts, np.float64) for c in columns[2:4])
            code, up, low, squares, scanned = books.assign(q, old, *bounds)
            if last:
                error = pa.array([min(sum(int(x) for x in row), LONGEST) for row in squares.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*own, pa.array([bytes(row).hex() for row in code.tolist()]), error], names=[*batch.schema.names[:carried], "code", "error"])
                continue
            scans += scanned
            exact, _ = books._in(q)
            for p in range(parts):
                for sign, entry in ((1, code), (-1, old)):
                    at = np.arange(len(q)) if old is None else np.flatnonzero(code[:, p] != old[:, p])
                    if entry is not None and len(at):
                        change = np.zeros((k, dim + 1), exact.dtype)
                        np.add.at(change, (entry[at, p], slice(dim)), exact[at, p])
                        np.add.at(change, (entry[at, p], dim), 1)
                        sums[p] += sign * np.array([int(x) for x in change.ravel().tolist()], object).reshape(change.shape)
            state = [columns[0], _lists(code, pa.int32()), _lists(up, pa.float64()), _lists(low, pa.float64())]
            names = batch.schema.names[:carried] + [f.name for f in (*_STATE, _SUMS)]
            yield pa.RecordBatch.from_arrays([*own, *state, pa.nulls(batch.num_rows, kind)], names=names)
            kinds = [c.type for c in (*own, *state)]
        if names:
            told = [*_digits(sums), {"at": -1, "digit": 0, "part": scans}]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds), pa.array([told], kind)], names=names)

    return run


def _moved_entries(entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
    out = entries.copy()
    for p, e in np.argwhere(sums[:, :, -1] > 0):
        out[p, e] = [x // sums[p, e, -1] for x in sums[p, e, :-1]]
    return out


def _rounds(rows: DataFrame, carried: int, length: int, books: Codebooks, rounds: int) -> DataFrame:
    """The rows (carried columns, then _q) with their bounds after the rounds; books are moved along."""
    schema = T.StructType([*rows.schema.fields[:carried], *_STATE, _SUMS])
    sums, now, last = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), object), rows, None
    for _ in range(rounds):
        done = stored(now.mapInArrow(_pass(Round(books), length, carried, last=False), schema), "codes")
        if last is not None:
            discard(last)
        told = done.where("_sums is not null").select(F.explode("_sums").alias("s")).groupBy("s.at", "s.digit").agg(F.sum("s.part").alias("part"))
        scans = 0
        for r in told.collect():  # an entry's components, whatever the number of rows
            if r["at"] < 0:
                scans = r["part"]
            else:
                sums.ravel()[r["at"]] += r["part"] * (1 << (DIGIT * r["digit"]))
        entries = _moved_entries(books.entries, sums)
        books.moved, books.entries = _roots(_squares(entries, books.entries))[1], entries
        books.scans.append(scans)
        last, now = done, done.where("_sums is null").drop("_sums")
    return now


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", carry: tuple[str, ...] = (), parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """id_col, the carried columns, code (two hex digits a part), error (squared distances summed over the parts); and the codebooks. entries is 256 at most."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries, 1 part at least")
    names = [id_col, *carry]
    scaled = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x * float(scale))
    sound = F.forall("_s", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], scaled.alias("_s")).where(F.col("_s").isNotNull() & sound)
    fits = F.size("_s") % parts == 0
    common = kept.where(fits & (F.size("_s") > 0)).groupBy(F.size("_s").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = common["n"] if common else 0
    own = [f"_c{i}" for i in range(len(names))]
    restored = lambda df: df.select(*[F.col(o).alias(c) for o, c in zip(own, names, strict=True)], "code", "error")
    if not length:
        return restored(kept.select(*own, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))), Codebooks(np.zeros((parts, 0, 0), object))
    fitting = kept.where(F.size("_s") == length)
    first = fitting.orderBy(F.col("_c0").asc_nulls_last(), "_s").limit(entries).select("_s").collect()  # as many rows as entries
    seeds = np.array([[math.floor(x) for x in r["_s"]] for r in first], object).reshape(len(first), parts, length // parts)
    books = Codebooks(seeds.swapaxes(0, 1).copy())
    # floor of a double as a double: integers of any size
    floored = F.transform("_s", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    state = _rounds(fitting.select(*own, floored.alias("_q")), len(own), length, books, rounds)
    schema = T.StructType([*state.schema.fields[: len(own)], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = state.mapInArrow(_pass(Round(books), length, len(own), last=True), schema)
    odd = kept.where(F.size("_s") != length).select(*own, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return restored(coded.unionByName(odd)), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code. label_error: the label's rows are summed before they meet, and a label that holds a third of them is split by the join."""
    coded, books = product_codes(table(spark, sf_dir, "embeddings"), carry=("label",))
    coded = stored(coded, "coded")
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.least(wide, F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql(rounds: int = 6) -> str:
    """Plain Lloyd rounds, unrolled."""
    square = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT x.vec_id, x.p, min({square} * 256 + c.e) AS k FROM part x JOIN c{i} c ON c.p = x.p GROUP BY x.vec_id, x.p)")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT a.p, a.k % 256 AS e, t.i, floor(sum(x.v[t.i]) / count(*))::BIGINT AS m
  FROM a{i} a JOIN part x ON x.vec_id = a.vec_id AND x.p = a.p, (SELECT unnest(range(1, (SELECT max(len(v)) FROM part) + 1)) AS i) t GROUP BY ALL) GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.e = c.e)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS v FROM kept, (SELECT unnest(range(8)) AS p)),
c0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM part) WHERE e < 16),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c{rounds})),
coded AS (SELECT vec_id, string_agg(printf('%02x', k % 256), '' ORDER BY p) AS code, sum(k // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT coded.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded JOIN kept ON kept.vec_id = coded.vec_id, books
"""


SQL = _sql()
