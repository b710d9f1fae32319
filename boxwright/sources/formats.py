"""Readers and writers of annotation formats: DataFrames in, DataFrames out.

A document (COCO, box list, request, run) may be one file or a line of a file; many files are read at once. Writers make
as many files as Spark has tasks, each a whole document of its own images.

Null texts, and texts that are no document of the format, give no rows; a missing field is null. Repeated documents and lines
are read as often as they occur. Lists keep their order; where rows are ranked, equal scores are in order of the other
fields. A very long document is read whole by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = "struct<images: array<struct<id: bigint, file_name: string, width: int, height: int, split: string>>, annotations: array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>, area: double, iscrowd: int>>, categories: array<struct<id: int, name: string>>>"
FOUND = ["doc", "category_id", "image_id", "file_name", "width", "height", "annotation_id", "x1", "y1", "x2", "y2", "category"]
RESULTS = "array<struct<image_id: bigint, category_id: int, bbox: array<double>, score: double>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc, text: a document for each file, or for each line of a file of JSON lines. An unreadable one is a null further on."""
    return spark.read.text(path).select(F.concat_ws("#", F.input_file_name(), F.monotonically_increasing_id()).alias("doc"), F.col("value").alias("text"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """doc, text of files that are one document over many lines."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc, images, notes, names) to their annotations, each with its image and its category's name."""
    for batch in batches:
        tables = []
        for lists in batch.columns[1:]:
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            flat = lists.flatten()
            tables.append(pa.Table.from_arrays([pa.array(row), *flat.flatten()], names=["row", *(f.name for f in flat.type)]))
        images, notes, names = tables
        found = notes.join(images, ["row", "image_id"], join_type="inner", use_threads=False).join(names, ["row", "category_id"], join_type="left outer", use_threads=False)
        found = found.append_column("doc", pa.chunked_array([batch.column(0)]).take(found["row"]))
        yield from found.select(FOUND).combine_chunks().to_batches()


def coco_annotations(docs: DataFrame) -> DataFrame:
    """doc, image_id, file_name, width, height, annotation_id, category_id, category, x1..y2: annotations of images that are there (orphans go).

    A document's annotations, images and categories are joined where it is read, so none is shuffled.
    """
    parsed = docs.select("doc", F.from_json("text", COCO).alias("c"))
    image = lambda i: F.struct(i["id"].alias("image_id"), i["file_name"].alias("file_name"), i["width"].alias("width"), i["height"].alias("height"))
    name = lambda n: F.struct(n["id"].alias("category_id"), n["name"].alias("category"))

    def note(a: Column) -> Column:
        at = lambda k: F.get(a["bbox"], F.lit(k))
        return F.struct(a["id"].alias("annotation_id"), a["image_id"].alias("image_id"), a["category_id"].alias("category_id"), at(0).alias("x1"), at(1).alias("y1"), (at(0) + at(2)).alias("x2"), (at(1) + at(3)).alias("y2"))

    lists = parsed.select("doc", F.transform("c.images", image).alias("images"), F.transform("c.annotations", note).alias("notes"), F.transform("c.categories", name).alias("names"))
    return lists.mapInArrow(_met, "doc string, category_id int, image_id bigint, file_name string, width int, height int, annotation_id bigint, x1 double, y1 double, x2 double, y2 double, category string")


def coco_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, per_document: int = 4096) -> DataFrame:
    """document (JSON) for each range of per_document image ids. images: id, file_name, width, height, split; annotations: id, image_id, category_id, bbox, area."""
    part = lambda c: F.floor((F.col(c) - 1) / per_document).alias("part")
    image = F.struct("id", "file_name", "width", "height", "split")
    note = F.struct("id", "image_id", "category_id", "bbox", "area", F.lit(0).alias("iscrowd"))
    i = images.groupBy(part("id")).agg(F.array_sort(F.collect_list(image)).alias("images"))
    a = annotations.groupBy(part("image_id")).agg(F.array_sort(F.collect_list(note)).alias("annotations"))
    c = categories.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("categories"))
    whole = i.join(a, "part", "left").crossJoin(F.broadcast(c))  # one row: the categories
    return whole.select(F.to_json(F.struct("images", F.coalesce("annotations", F.array()).alias("annotations"), "categories")).alias("value"))


def clamped(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> dict[str, Column]:
    hold = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    return {"x1": hold(x1, w), "y1": hold(y1, h), "x2": hold(x2, w), "y2": hold(y2, h)}


def detection_results(docs: DataFrame, images: DataFrame, least: float) -> DataFrame:
    """image_id, class_id (category - 1), score, x1..y2 clamped, place: results of known images, by score. images: image_id, width, height."""
    rows = docs.select(F.inline(F.from_json("text", RESULTS)))
    j = rows.where(F.coalesce("score", F.lit(0.0)) >= least).join(images.select("image_id", "width", "height"), "image_id")
    b = F.col("bbox")
    boxes = j.withColumns(clamped(b[0], b[1], b[0] + b[2], b[1] + b[3], F.col("width"), F.col("height"))).where("x2 > x1 and y2 > y1")
    own = boxes.select("image_id", (F.coalesce("category_id", F.lit(1)) - 1).alias("class_id"), "score", "x1", "y1", "x2", "y2")
    # ranks by position in the sorted list of an image's results
    listed = own.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "class_id", "score", "x1", "y1", "x2", "y2"))).alias("l"))
    return listed.select("image_id", F.posexplode("l").alias("place", "b")).select("image_id", "place", "b.class_id", "b.score", "b.x1", "b.y1", "b.x2", "b.y2")


def yolo_boxes(lines: DataFrame, images: DataFrame) -> DataFrame:
    """stem, class_id, x1..y2 in pixels, clamped; lines of under five fields and empty boxes go. lines: stem, value; images: stem, width, height."""
    f = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.try_element_at("f", F.lit(k)).try_cast("double")
    rows = lines.select("stem", f.alias("f")).where(F.size("f") >= 5).select("stem", number(1).cast("int").alias("class_id"), number(2).alias("xc"), number(3).alias("yc"), number(4).alias("bw"), number(5).alias("bh"))
    j = rows.join(images.select("stem", "width", "height"), "stem")
    w, h = F.col("width"), F.col("height")
    edge = lambda c, s, size, sign: (F.col(c) + sign * F.col(s) / 2) * size
    boxes = j.withColumns(clamped(edge("xc", "bw", w, -1), edge("yc", "bh", h, -1), edge("xc", "bw", w, 1), edge("yc", "bh", h, 1), w, h))
    return boxes.where("x2 > x1 and y2 > y1").select("stem", "class_id", "x1", "y1", "x2", "y2")


def coco_to_yolo(annotations: DataFrame, index: dict[int, int]) -> DataFrame:
    """file_name, annotation_id, line: clamped boxes in centre form with eight places; unknown categories and empty boxes go."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    known = F.coalesce(*[F.when(F.col("category_id") == k, v) for k, v in index.items()])
    a = annotations.where("x2 > x1 and y2 > y1 and width > 0 and height > 0").withColumns(clamped(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), w, h)).withColumn("k", known)
    a = a.where("k is not null and x2 > x1 and y2 > y1")
    line = F.format_string("%d %.8f %.8f %.8f %.8f", "k", (F.col("x1") + (F.col("x2") - F.col("x1")) / 2) / w, (F.col("y1") + (F.col("y2") - F.col("y1")) / 2) / h, (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h)
    return a.select("file_name", "annotation_id", line.alias("line"))


def yolo_dataset(boxes: DataFrame, images: DataFrame, names: list[str]) -> DataFrame:
    """path, content of a data set's files: a label file for each image with a size, classes.txt, data.yaml.

    boxes: image_id, det_id, label, x1..y2; images: image_id, name, split, width, height. names: export labels, sorted.
    """
    index = F.coalesce(*[F.when(F.col("label") == n, k) for k, n in enumerate(names)])
    j = boxes.withColumn("k", index).where("k is not null").join(images.where("width is not null and height is not null"), "image_id")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "k", F.expr("(x1 + x2) / 2 / width"), F.expr("(y1 + y2) / 2 / height"), F.expr("(x2 - x1) / width"), F.expr("(y2 - y1) / height"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    files = j.groupBy(F.concat_ws("/", F.lit("labels"), "split", F.concat(stem, F.lit(".txt"))).alias("path")).agg(F.array_sort(F.collect_list(F.struct("det_id", line.alias("line")))).alias("l"))
    files = files.select("path", F.concat(F.array_join("l.line", "\n"), F.lit("\n")).alias("content"))
    yaml = "train: images/train\nval: images/val\ntest: images/test\nnames:\n" + "".join(f"  {k}: {n}\n" for k, n in enumerate(names))
    fixed = boxes.sparkSession.createDataFrame([("classes.txt", "\n".join(names) + "\n"), ("data.yaml", yaml)], "path string, content string")
    return files.unionByName(fixed)


def write_files(files: DataFrame, root: str) -> None:
    """Files of the given relative paths and contents below root (a URI): each task writes its own, through Arrow's file systems."""

    def write(batches):
        import os.path

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        system, top = FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system.create_dir(os.path.dirname(f"{top}/{path}"), recursive=True)
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write(content.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    files.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def box_lists(docs: DataFrame) -> DataFrame:
    """doc, place, label, score, x1..y2 of lists of {box, label, score}, bare or under boxes, detections or rows; items without four numbers go, corners are put in order."""
    item = "array<struct<box: array<double>, label: string, score: double>>"
    under = [F.from_json(F.get_json_object("text", f"$.{k}"), item) for k in ("boxes", "detections", "rows")]
    listed = F.when(F.ltrim("text").startswith("["), F.from_json("text", item)).otherwise(F.coalesce(*under))
    rows = docs.select("doc", F.posexplode(listed).alias("place", "i")).where(F.size("i.box") == 4).where(~F.exists("i.box", lambda v: v.isNull()))
    b = F.col("i.box")
    corners = {"x1": F.least(b[0], b[2]), "y1": F.least(b[1], b[3]), "x2": F.greatest(b[0], b[2]), "y2": F.greatest(b[1], b[3])}
    return rows.select("doc", "place", F.coalesce("i.label", F.lit("")).alias("label"), F.coalesce("i.score", F.lit(1.0)).alias("score"), *[v.alias(k) for k, v in corners.items()])


def box_list_documents(boxes: DataFrame, key: str, order: str) -> DataFrame:
    """key, value (JSON): coordinates to two places, scores to four."""
    item = F.struct(F.array(*[F.round(c, 2) for c in ("x1", "y1", "x2", "y2")]).alias("box"), "label", F.round("score", 4).alias("score"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i"))))
    return boxes.groupBy(key).agg(F.to_json(F.transform(listed, lambda x: x["i"])).alias("value"))


def csv_rows(spark: SparkSession, path: str, required: dict[str, str], sep: str = ",") -> DataFrame:
    """A CSV with a header; a missing required column (name: type) is an error that names it."""
    raw = spark.read.csv(path, header=True, sep=sep, escape='"')
    if missing := sorted(set(required) - set(raw.columns)):
        raise ValueError(f"missing required columns: {missing}")
    return raw.select(*[F.trim(c).cast(t).alias(c) for c, t in required.items()])


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """key, value: the first two columns of a table with a header, separated by tabs if its name ends so, else by commas."""
    raw = spark.read.csv(path, header=True, sep="\t" if path.rstrip("/").endswith("tsv") else ",")
    return raw.select(F.col(raw.columns[0]).alias("key"), F.col(raw.columns[1]).alias("value"))


def has_header(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether a column of the first five lines holds numbers alone only if the first line is left out."""
    rows = [r[0].split(sep) for r in spark.read.text(path).limit(5).collect()]
    kinds = lambda some: [all(re.fullmatch(r"\s*[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?\s*", v, re.I) for v in c) for c in zip(*some, strict=False)]
    return kinds(rows) != kinds(rows[1:])


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """a, b, value of a square table with a header of names and a name before each row; columns are in the order of the rows' names."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    names = raw.columns[1:]  # a matrix is as wide as a header line
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("b"), F.col(f"`{n}`").cast("double").alias("value")) for n in names]))
    return raw.select(F.col(f"`{raw.columns[0]}`").alias("a"), cells.alias("c")).select("a", "c.b", "c.value")


def folder(spark: SparkSession, root: str, suffixes: list[str], recursive: bool = True) -> DataFrame:
    """path of the files with a suffix; contents are not read."""
    glob = "*{" + ",".join(suffixes) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root).select("path")


def requests(docs: DataFrame) -> DataFrame:
    """doc, kind (prototype, review or null), run_id, n_decisions, n_corrections of hand-over requests; keys in snake or camel case."""
    g = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.get_json_object("text", f"$.{k}")), F.lit("")) for k in keys])
    said = F.lower(g("type", "kind"))
    kind = F.when(said.isin("prototype", "prototype_request"), "prototype").when(said.isin("review", "review_request", "correction", "correction_request"), "review")
    size = lambda k: F.coalesce(F.json_array_length(F.get_json_object("text", f"$.{k}")), F.lit(0))
    return docs.select("doc", kind.alias("kind"), g("run_id", "runId").alias("run_id"), size("decisions").alias("n_decisions"), size("corrections").alias("n_corrections"))


def runs(docs: DataFrame) -> DataFrame:
    """run_id, workflow, status, created_at of the run documents that can be read."""
    g = lambda k, default: F.coalesce(F.get_json_object("text", f"$.{k}"), F.lit(default)).alias(k)
    readable = docs.where(F.try_parse_json("text").isNotNull())
    return readable.select(g("run_id", "").alias("run_id"), g("workflow", ""), g("status", "unknown"), g("created_at", ""))


def cached(cache: DataFrame, wanted: DataFrame, checkpoint: str) -> DataFrame:
    """The cached vectors (path, place, checkpoint, vector) if they are of that checkpoint and the wanted paths (path, place), in that order; else no row."""
    ours = cache.where(F.col("checkpoint") == checkpoint)
    both = ours.select("path", "place").withColumn("side", F.lit(1)).unionByName(wanted.select("path", "place").withColumn("side", F.lit(2)))
    wrong = both.groupBy("path", "place").agg(F.sum("side").alias("s")).where("s <> 3").limit(1)
    return ours.join(wrong.select(F.lit(True).alias("w")), F.lit(True), "left_anti")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence of the records of FASTA files; lines of a sequence are joined."""
    record = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    return record.select(F.trim(lines[0]).alias("name"), F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "").alias("sequence"))


def sdf(spark: SparkSession, path: str) -> DataFrame:
    """name, body of the records of SDF files: the first line and the rest."""
    record = spark.read.text(path, lineSep="$$$$\n").where("trim(value) <> ''")
    return record.select(F.trim(F.substring_index("value", "\n", 1)).alias("name"), F.substring("value", F.length(F.substring_index("value", "\n", 1)) + 2, F.length("value")).alias("body"))
