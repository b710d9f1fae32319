"""Tables in the shared folder: each application has a folder of its own there, each run a list of what it wrote."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions without a shared one, by application.
_LOCAL: dict[str, str] = {}


class Tables:
    """The tables of one run. Another run, in this thread or another, has a list of its own."""

    def __init__(self):
        self.paths: list[str] = []

    def discard_all_but(self, *kept: DataFrame) -> None:
        """Deletes the run's tables but these: they are written, so what they were made from is done."""
        places = {t._stored_at for t in kept}
        for place in [p for p in self.paths if p not in places]:
            _delete(kept[0].sparkSession, place)
            self.paths.remove(place)


_RUN: ContextVar[Tables | None] = ContextVar("run", default=None)


@contextmanager
def own_tables() -> Iterator[Tables]:
    """Within it, what stored() writes belongs to this run. What is left at its end belongs to the run around it, if any."""
    own, around = Tables(), _RUN.get()
    token = _RUN.set(own)
    try:
        yield own
    finally:
        _RUN.reset(token)
        if around is not None:
            around.paths += own.paths


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints. Where none is set a local session (a test) gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='boxwright-')}")
    return found.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/boxwright/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: lineage ends there, and a lost executor costs nothing that is done."""
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if (run := _RUN.get()) is not None:
        run.paths.append(path)
    return out


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Deletes a table that stored() wrote, when nothing that is still to run reads it."""
    _delete(table.sparkSession, table._stored_at)
    if (run := _RUN.get()) is not None and table._stored_at in run.paths:
        run.paths.remove(table._stored_at)


def discard_all(spark: SparkSession) -> None:
    """Deletes every table that this application stored, when none of its results is to be read again: a result is lazy, so only the caller knows."""
    _delete(spark, application_dir(spark))
