"""All rows of one table against all of another, tile by block: a shuffle in which a task meets one tile and one block.

Rows are dealt in turn, whatever they hold, so that equal rows and hot keys are spread evenly. The plan is one exchange of
each side, however many tiles and blocks there are; nothing passes the driver. What a task gives is to be small for each
row of its tile (its best few of the block), to be merged by the caller.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string  # noqa: PLC2701

#: Bytes of a tile and of a block, as counted by the caller.
TILE_BYTES, BLOCK_BYTES = 64 << 20, 16 << 20


def _in_turn(n: int) -> Column:
    return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")


def parts(total: int | None, bytes_each: int) -> int:
    return max(1, -(-int(total or 0) // bytes_each))


def block_product(left: DataFrame, right: DataFrame, tiles: int, blocks: int, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn gets a tile of left and a block of right (with _tile and _block), each pair of them once. A pair where either is empty is not called."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    l = left.withColumn("_tile", _in_turn(tiles)).withColumn("_block", every(blocks))  # noqa: E741
    r = right.withColumn("_block", _in_turn(blocks)).withColumn("_tile", every(tiles))

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()

    def whole(a: pa.Table, b: pa.Table) -> pa.Table:
        return fn(a, b) if a.num_rows and b.num_rows else empty

    return l.groupBy("_tile", "_block").cogroup(r.groupBy("_tile", "_block")).applyInArrow(whole, schema)
