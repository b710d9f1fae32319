"""Linear probes over vectors: cross-validated and held-out reports, all folds fitted together.

A probe is a multinomial logistic regression with balanced classes. Each row is left out of its own fold's model and counts
for all others and for the model of all rows. A pass over the rows gives the loss and gradient of all models at once, a row
for each component whatever the number of rows; the driver holds the models alone (folds x classes x components) and moves
each by L-BFGS. So a report of five folds takes as many passes as one fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions.stored import stored
from boxwright.functions.vectors import normalised
from boxwright.operators.numbering import numbered_within

#: Labels that a probe tells apart: the models are held by the driver. More are an error.
MOST_LABELS = 1000
MEMORY = 8


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def _inputs(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.hstack([x, np.ones((len(x), 1))])


def _losses(rows: DataFrame, models: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted losses and gradients of the models[fold, class, component] over rows (y, fold, x); the last model is that of all rows."""
    k, classes, width = models.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k + models.size)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, fold, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _inputs(batch.column(2))
            p = _softmax((x @ models.reshape(-1, width).T).reshape(-1, k, classes))
            w = weights[:, y].T * (fold[:, None] != np.arange(k))
            row = np.arange(len(y))
            sums[:k] -= (w * np.log(np.maximum(p[row, :, y], 1e-300))).sum(axis=0)
            p[row, :, y] -= 1
            sums[k:] += ((p * w[:, :, None]).reshape(len(y), -1).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["at", "v"])

    total = np.zeros(k + models.size)
    for r in rows.select("y", "fold", "x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # a row for each component
        total[r["at"]] = r["v"]
    return total[:k], total[k:].reshape(models.shape)


def _direction(g: np.ndarray, steps: list, changes: list) -> np.ndarray:
    """L-BFGS: the gradient times the inverse curvature that the last steps showed."""
    q, held = g.copy(), []
    for s, c in zip(reversed(steps), reversed(changes), strict=True):
        a = (s @ q) / (s @ c)
        held.append(a)
        q -= a * c
    if steps:
        q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, c, a in zip(steps, changes, reversed(held), strict=True):
        q += s * (a - (c @ q) / (s @ c))
    return -q


def fit(rows: DataFrame, weights: np.ndarray, width: int, strength: float = 1.0, passes: int = 60, close: float = 1e-4) -> np.ndarray:
    """models[fold, class, component]: the least of strength x weighted loss + half the squared weights (not of the constant)."""
    k, classes = weights.shape
    shape = (k, classes, width)
    penalised = np.ones((classes, width))
    penalised[:, -1] = 0
    scale = 1 / np.maximum(weights.sum(axis=1), 1e-300)

    def at(models: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, grad = _losses(rows, models, weights)
        own = models * penalised
        loss = (strength * loss + 0.5 * (own**2).sum(axis=(1, 2))) * scale
        return loss, ((strength * grad + own) * scale[:, None, None]).reshape(k, -1)

    now = np.zeros(shape)
    loss, grad = at(now)
    steps, changes = [[] for _ in range(k)], [[] for _ in range(k)]
    way = np.stack([_direction(g, [], []) for g in grad])
    size = np.array([min(1.0, 1 / max(np.abs(g).sum(), 1e-12)) for g in grad])
    first = np.abs(grad).max(axis=1)
    for _ in range(passes):
        going = np.abs(grad).max(axis=1) > close * first
        if not going.any():
            break
        tried = now + (size * going)[:, None, None] * way.reshape(shape)
        new_loss, new_grad = at(tried)
        for i in np.flatnonzero(going):
            step = size[i] * way[i]
            if new_loss[i] > loss[i] + 1e-4 * (grad[i] @ step):  # too far
                size[i] /= 4
                continue
            change = new_grad[i] - grad[i]
            if step @ change > 1e-12:
                steps[i], changes[i] = [*steps[i], step][-MEMORY:], [*changes[i], change][-MEMORY:]
            now[i], loss[i], grad[i] = tried[i], new_loss[i], new_grad[i]
            way[i], size[i] = _direction(grad[i], steps[i], changes[i]), 1.0
    return now


def _prepared(rows: DataFrame, folds: int, normalise: bool) -> tuple[DataFrame, list, np.ndarray, int] | None:
    """Rows (id, y, fold, x) dealt into folds: within a label in turn, in the order of a hash; labels; counts[fold, label]; components."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    good = rows.where("label is not null and v is not null").withColumn("v", F.col("v").cast("array<double>")).where(sound)
    labels = sorted(r["label"] for r in good.select("label").distinct().limit(MOST_LABELS + 1).collect())
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not labels:
        return None
    named = rows.sparkSession.createDataFrame(list(enumerate(labels)), f"y int, label {rows.schema['label'].dataType.simpleString()}")
    x = normalised(F.col("v")) if normalise else F.col("v")
    keyed = good.join(F.broadcast(named), "label").select(F.col("result_id").alias("id"), "y", x.alias("x"), F.md5(F.col("result_id").cast("string").cast("binary")).alias("h"))  # MOST_LABELS rows
    dealt = numbered_within(keyed, ["y"], [F.col("h"), F.col("id")], "place")
    out = stored(dealt.select("id", "y", F.pmod(F.col("place") - 1, F.lit(folds)).cast("int").alias("fold"), "x"), "probe")
    counts = np.zeros((folds, len(labels)))
    for r in out.groupBy("fold", "y").count().collect():  # folds x labels
        counts[r["fold"], r["y"]] = r["count"]
    width = out.agg(F.max(F.size("x"))).first()[0] + 1
    return out, labels, counts, width


def _balanced(counts: np.ndarray) -> np.ndarray:
    """weights[model, label] of the models that leave a fold out each, and of that of all rows: rows over labels and the label's rows."""
    trained = np.vstack([counts.sum(axis=0) - counts, counts.sum(axis=0)])
    present = (trained > 0).sum(axis=1, keepdims=True)
    return np.where(trained > 0, trained.sum(axis=1, keepdims=True) / np.maximum(present * trained, 1), 0.0)


def cross_validated(rows: DataFrame, folds: int = 5, strength: float = 1.0, normalise: bool = True) -> DataFrame:
    """result_id, fold, label, predicted, probability of every row, by the model that was fitted without its fold. rows: result_id, label, v.

    Folds are stratified: a label's rows are dealt in turn. Rows without a label, or with a missing vector or component, are
    left out; vectors have one length. Equal probabilities go to the first label. Without a labelled row there are none.
    """
    kind = rows.schema["label"].dataType.simpleString()
    key = rows.schema["result_id"].dataType.simpleString()
    schema = f"result_id {key}, fold int, label {kind}, predicted {kind}, probability double"
    if (got := _prepared(rows, folds, normalise)) is None:
        return rows.sparkSession.createDataFrame([], schema)
    data, labels, counts, width = got
    models = fit(data, _balanced(counts), width, strength)
    names = np.array(labels, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, fold, x = batch.column(1).to_numpy(), batch.column(2).to_numpy(), _inputs(batch.column(3))
                p = _softmax(np.einsum("nd,ncd->nc", x, models[fold]))
                best = p.argmax(axis=1)
                columns = [batch.column(0), batch.column(2), pa.array(names[y].tolist()), pa.array(names[best].tolist()), pa.array(p.max(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["result_id", "fold", "label", "predicted", "probability"])

    return data.mapInArrow(run, schema)


def accuracies(predicted: DataFrame) -> DataFrame:
    """fold, n, accuracy."""
    right = F.avg((F.col("label") == F.col("predicted")).cast("double"))
    return predicted.groupBy("fold").agg(F.count("*").alias("n"), right.alias("accuracy"))


def class_report(predicted: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support; 0 where a denominator is."""
    both = predicted.groupBy("label", "predicted").agg(F.count("*").alias("n"))  # the confusion matrix
    sides = both.select(F.inline(F.array(F.struct("label", F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("right")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("right")))))
    g = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("right").alias("right"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = over(F.col("right"), F.col("said")), over(F.col("right"), F.col("support"))
    return g.select("label", p.alias("precision"), r.alias("recall"), over(2 * p * r, p + r).alias("f1"), "support")
