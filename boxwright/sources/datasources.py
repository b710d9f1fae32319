"""Annotation formats as Spark data sources: spark.read.format("coco_annotations"), ("yolo_labels") or ("run_catalog").

Register them with register(spark). A partition is some files of about PART_BYTES; files are found and read through Arrow's file
systems where the task runs (file, hdfs, s3, gs URIs). With option push=true (and the session's
spark.sql.python.filterPushdown.enabled) filters on the file's name are pushed: files that they leave out are not opened. Documents that cannot be read, orphan annotations and short lines
are left out, as in formats.py; that module's functions take any path that Spark reads and stay inside the JVM, so they are
the faster way where a format name is not needed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

#: Bytes of the files of a partition; a larger file is a partition of its own.
PART_BYTES = 64 << 20
ROWS = 4096


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Reader(DataSourceReader):
    """Rows of the files below a path, as Arrow batches. What a file holds is told by rows()."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, schema: pa.Schema, options: dict[str, str]):
        self.schema, self.options, self.tests = schema, options, []
        if "path" not in options:
            raise ValueError("load() needs a path")

    def _passes(self, name: str) -> bool:
        def test(f: Filter) -> bool:
            if isinstance(f, EqualTo):
                return name == f.value
            if isinstance(f, In):
                return name in f.value
            return name.startswith(f.value) if isinstance(f, StringStartsWith) else name.endswith(f.value)

        return all(map(test, self.tests))

    def _system(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.options["path"])

    def partitions(self) -> list[Files]:
        from pyarrow.fs import FileSelector, FileType

        system, top = self._system()
        info = system.get_file_info(top)
        found = [info] if info.type == FileType.File else system.get_file_info(FileSelector(top, recursive=True))
        out, size = [[]], 0
        for f in sorted(found, key=lambda f: f.path):
            if f.type == FileType.File and f.path.endswith(self.suffixes) and not f.base_name.startswith(("_", ".")) and self._passes(f.path):
                if out[-1] and size + f.size > PART_BYTES:
                    out.append([])
                    size = 0
                out[-1].append(f.path)
                size += f.size
        return [Files(paths) for paths in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        held: list[tuple] = []
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            for row in self.rows(text):
                held.append((path, *row))
                if len(held) == ROWS:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)

    def rows(self, text: str) -> Iterator[tuple]:
        raise NotImplementedError


def _documents(text: str) -> Iterator[Any]:
    """A file is one document, or a document a line."""
    try:
        yield json.loads(text)
        return
    except ValueError:
        pass
    for line in text.splitlines():
        try:
            yield json.loads(line)
        except ValueError:
            continue


class CocoReader(Reader):
    suffixes = (".json", ".txt", ".jsonl")

    def rows(self, text: str) -> Iterator[tuple]:
        for d in _documents(text):
            if not isinstance(d, dict):
                continue
            images = {i["id"]: i for i in d.get("images") or []}
            names = {c["id"]: c.get("name") for c in d.get("categories") or []}
            for a in d.get("annotations") or []:
                image, box = images.get(a.get("image_id")), a.get("bbox")
                if image is not None and box and len(box) == 4:
                    x, y, w, h = map(float, box)
                    yield image["id"], image.get("file_name"), image.get("width"), image.get("height"), a.get("id"), a.get("category_id"), names.get(a.get("category_id")), x, y, x + w, y + h


class YoloReader(Reader):
    suffixes = (".txt",)

    def rows(self, text: str) -> Iterator[tuple]:
        for line in text.splitlines():
            try:
                numbers = [float(v) for v in line.split()[:5]]
            except ValueError:
                continue
            if len(numbers) == 5 and all(map(math.isfinite, numbers)):
                yield int(numbers[0]), *numbers[1:]


class RunReader(Reader):
    suffixes = (".json",)

    def rows(self, text: str) -> Iterator[tuple]:
        for d in _documents(text):
            if isinstance(d, dict):
                yield tuple(str(d.get(k, default)) for k, default in (("run_id", ""), ("workflow", ""), ("status", "unknown"), ("created_at", "")))


class Pushing:
    """Takes the filters on doc that its tests know; the rest stay with Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            known = isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute == ("doc",)
            if known:
                self.tests.append(f)
            else:
                yield f


def _source(name: str, columns: str, reader: type[Reader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> Reader:
            from pyspark.sql.pandas.types import to_arrow_schema

            kind = type(f"Pushing{reader.__name__}", (Pushing, reader), {}) if self.options.get("push") == "true" else reader
            return kind(to_arrow_schema(schema), dict(self.options))

    return Source


CocoAnnotations = _source("coco_annotations", "doc string, image_id bigint, file_name string, width int, height int, annotation_id bigint, category_id int, category string, x1 double, y1 double, x2 double, y2 double", CocoReader)
YoloLabels = _source("yolo_labels", "doc string, class_id int, xc double, yc double, w double, h double", YoloReader)
RunCatalog = _source("run_catalog", "doc string, run_id string, workflow string, status string, created_at string", RunReader)


def register(spark: SparkSession) -> None:
    for source in (CocoAnnotations, YoloLabels, RunCatalog):
        spark.dataSource.register(source)
