"""A log sink for foreachBatch: rows are collected, and flushed to a table a good number at a time, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DONE = "_SUCCESS"


class BufferedSink:
    """Appends the batches of a stream to a table under path: pending/<batch> until there are flush_every rows, then flushed/<batch>.

    A batch has the folder of its number, and counts when the folder is written whole. So a batch that is run again after a
    restart replaces what it left, or is passed over if it was flushed; a flush that did not end is passed over by readers
    and replaced by the next. What is flushed counts for all batches up to its number, also while their folders still lie
    in pending. Empty batches leave an empty folder, which the next flush takes along.
    """

    def __init__(self, path: str, flush_every: int = 20):
        self.path, self.flush_every = path.rstrip("/"), max(1, flush_every)

    def _batches(self, spark: SparkSession, kind: str) -> list[int]:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        whole = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), _DONE))
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(root) if s.isDirectory() and whole(s))

    def _place(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/{batch:020d}"

    def _delete(self, spark: SparkSession, place: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def _state(self, spark: SparkSession) -> tuple[list[int], list[int]]:
        flushed = self._batches(spark, "flushed")
        through = flushed[-1] if flushed else -1
        return flushed, [b for b in self._batches(spark, "pending") if b > through]

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        flushed = self._batches(spark, "flushed")
        if flushed:
            for stale in self._batches(spark, "pending"):
                if stale <= flushed[-1]:  # a flush that was stopped before it deleted them
                    self._delete(spark, self._place("pending", stale))
            if batch <= flushed[-1]:
                return
        rows.write.mode("overwrite").parquet(self._place("pending", batch))
        _, pending = self._state(spark)
        waiting = spark.read.parquet(*[self._place("pending", b) for b in pending])
        if waiting.count() >= self.flush_every:  # from the files' footers
            self.flush(spark)

    def flush(self, spark: SparkSession) -> None:
        """Writes what is pending as one part of the table, then deletes it."""
        _, pending = self._state(spark)
        if not pending:
            return
        places = [self._place("pending", b) for b in pending]
        spark.read.parquet(*places).write.mode("overwrite").parquet(self._place("flushed", pending[-1]))
        for place in places:
            self._delete(spark, place)

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """All rows so far, each once; None before the first batch."""
        flushed, pending = self._state(spark)
        places = [self._place("flushed", b) for b in flushed] + [self._place("pending", b) for b in pending]
        return spark.read.parquet(*places) if places else None


