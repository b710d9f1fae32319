"""Tables that change: upserts, run replacement, point updates, backups, exports and event logs.

A table is a folder of Parquet files. Rows are immutable, so a change is a new snapshot: what stays (an anti join by key)
and what is new. replace_run() overwrites only the partitions of the runs that come in.

Keys compare null with null as equal. Where the changes name a key more than once, each of their rows counts: upserted() has
all of them, updated() and filled() a row for each; callers pick one first. Empty changes leave a table as it is; an
empty table takes them all.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _keys(keys: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], ignore: bool = False) -> DataFrame:
    """The table after an upsert by key; ignore: rows that are there stay as they are. new has one row for each key."""
    if ignore:
        return old.unionByName(new.alias("n").join(old.select(*keys).alias("o"), _keys(keys), "left_anti"))
    return old.alias("o").join(new.select(*keys).alias("n"), _keys(keys), "left_anti").unionByName(new)


def replace_run(new: DataFrame, path: str, key: str = "run_id") -> None:
    """Overwrites the partitions (key=...) of the runs in new; other runs stay. Run again, it gives the same table."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def updated(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """old with the columns that changes has too taken from it where a row of equal key is there (also nulls)."""
    shared = [c for c in changes.columns if c not in keys]
    n = changes.withColumn("_there", F.lit(True)).alias("n")
    j = old.alias("o").join(n, _keys(keys), "left")
    return j.select(*[F.when(F.col("n._there"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in shared else F.col(f"o.{c}") for c in old.columns])


def filled(old: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """old with nulls alone taken from values."""
    shared = [c for c in values.columns if c not in keys]
    j = old.alias("o").join(values.alias("n"), _keys(keys), "left")
    return j.select(*[F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in shared else F.col(f"o.{c}") for c in old.columns])


def backup(table: DataFrame, path: str) -> DataFrame:
    """A snapshot folder; one that is there already is an error, so a backup is never overwritten."""
    table.write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty result has the single header 'empty'."""
    if df.isEmpty():
        df = df.sparkSession.createDataFrame([("empty",)], "v string")
        df.coalesce(1).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """JSON arrays of objects with all columns, nulls written: a file for each task's rows, in order; an empty result is one empty array.

    A reader takes the folder with multiLine. Each file is a whole document, so no task holds more than its own rows.
    """
    spark = df.sparkSession
    if df.isEmpty():
        spark.createDataFrame([("[]",)], "v string").coalesce(1).write.mode("overwrite").text(path)
        return
    rows = df.sort(*order) if order else df
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})

    def framed(batches):
        import pyarrow as pa

        sep = "["
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([sep + texts[0], *("," + t for t in texts[1:])])], names=["v"])
                sep = ","
        if sep == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["v"])

    rows.select(line.alias("v")).mapInArrow(framed, "v string").write.mode("overwrite").text(path)


class RunStore:
    """Tables of runs that change together: a version is a folder for each table and a manifest that names them all.

    replace() writes the new parts aside and then one manifest, under the next number; readers take the newest manifest, so they
    see all tables of a change or none. A change that is cut off leaves folders that no manifest names. Two writers at once
    cannot both make a number: the second fails.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _fs(self, spark: SparkSession, place: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def versions(self, spark: SparkSession) -> list[int]:
        fs, root = self._fs(spark, f"{self.path}/manifests")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(root)) if fs.exists(root) else []

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict[str, dict[str, str]]:
        """table: {run: folder} of a version, the newest by default."""
        known = self.versions(spark)
        if not known:
            return {}
        text = spark.read.text(f"{self.path}/manifests/{(known[-1] if version is None else version):020d}", wholetext=True).first()[0]
        return json.loads(text)

    def replace(self, tables: dict[str, DataFrame], key: str = "run_id", runs: list[str] | None = None) -> int:
        """All rows of the runs (by default those in any of the tables) are replaced in all tables of the store; a table without rows of a run loses it. The key is not null."""
        spark = next(iter(tables.values())).sparkSession
        known = self.versions(spark)
        now, number, made = self.manifest(spark), (known[-1] + 1 if known else 0), uuid.uuid4().hex
        placed: dict[str, dict[str, str]] = {}
        for name, df in tables.items():
            place = f"{self.path}/data/{name}-{number}-{made}"
            df.withColumn("_run", F.concat(F.lit("run-"), F.col(key).cast("string"))).write.partitionBy("_run").parquet(place)
            written = spark.read.schema(StructType([*df.schema.fields, StructField("_run", StringType())])).parquet(place)  # a table without rows has no files
            own = [r["_run"] for r in written.select("_run").distinct().collect()]  # a row for each run
            placed[name] = dict.fromkeys(own, place)
        gone = {f"run-{r}" for r in runs or []} | {r for own in placed.values() for r in own}
        new = {name: {r: p for r, p in now.get(name, {}).items() if r not in gone} | placed.get(name, {}) for name in now.keys() | placed.keys()}
        fs, path = self._fs(spark, f"{self.path}/manifests/{number:020d}")
        out = fs.create(path, False)  # fails if it is there
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        return number

    def read(self, spark: SparkSession, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version."""
        by_place: dict[str, list[str]] = {}
        for run, place in self.manifest(spark, version).get(name, {}).items():
            by_place.setdefault(place, []).append(run)
        if not by_place:
            raise ValueError(f"the store has no run of {name}")
        parts = [spark.read.parquet(place).where(F.col("_run").isin(runs)).drop("_run") for place, runs in sorted(by_place.items())]
        return reduce(DataFrame.unionByName, parts)


def append_events(events: DataFrame, path: str) -> None:
    """Lines of JSON, appended; null values are written."""
    events.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
