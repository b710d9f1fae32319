"""Shared helpers: reading tables, tables in the shared folder, Arrow mapping."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions.stored import discard, shared_dir, stored  # noqa: F401

#: Rows that a task takes as Python objects at a time; Spark bounds an Arrow batch by its bytes.
BATCH_ROWS = 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns the memory that a worker holds free to the system, where its C library can: a worker outlives its task and is used for later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: str | F.Column) -> F.Column:
    """The text's bytes; null is empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


def crc32_sql(listing: str) -> str:
    """SQL of the CRC-32 of a list of bytes, byte by byte from its polynomial's table."""
    step = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (3988292384 if c & 1 else 0)
        step[i] = c
    return f"xor(4294967295, list_reduce({listing}, lambda a, x: xor(a >> 8, {step}[xor(a & 255, x) + 1]), 4294967295))"


def map_batches(df: DataFrame, fn: Callable[..., dict[str, list] | None], schema: str) -> DataFrame:
    """fn gets some rows' columns as lists, in order, and returns the columns of the result (or None)."""
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC2701
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if (columns := fn(*(c.to_pylist() for c in batch.columns))) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
