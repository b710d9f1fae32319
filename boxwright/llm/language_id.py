"""Language identification by hierarchical discrimination.

Features are byte trigrams of the lower-cased text, hashed into DIMENSIONS counts, square-rooted and scaled to unit
length. Linear support vector machines, one for each pair of families, vote for the language family; one for each pair
of languages of that family votes for the language. FAMILIES maps language codes to families; a code it lacks is a
family of its own.

The machines are fitted on a bounded sample: about PER_LANGUAGE labelled rows of each language (rows whose hash falls
below PER_LANGUAGE / rows of that language), whole texts, held-out rows left out, of the MOST_LANGUAGES most frequent
labels (equal ones in order of name). Prediction reads the text alone.

A text that is null or has no letter is "und" with score 0; so is every text if no row is labelled. Rows with a null
label are predicted but not learned from; rows with a null id are never held out nor learned from. Repeated rows are
predicted alike, an empty table gives no rows, very long texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import map_batches, sliced, table

FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic"}
PER_LANGUAGE = 400
#: Labels that are learned: the most frequent ones (a dirty column of labels must not grow the model).
MOST_LANGUAGES = 64
DIMENSIONS = 4096
NONE = "und"

_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def counts(text: bytes) -> np.ndarray:
    """Hashed trigram counts."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(DIMENSIONS)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(20), minlength=DIMENSIONS).astype(np.float64)


def features(text: bytes) -> np.ndarray:
    x = np.sqrt(counts(text))
    return x / max(np.sqrt(x @ x), 1e-12)


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM with squared hinge loss, by accelerated gradient descent. y: -1, 1, weighed to balance."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * strength
    w = z = np.zeros(x.shape[1])
    step, t = 1 / (1 + 2 * 2 * strength), 1.0  # rows have a length of at most sqrt(2)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (z - 2 * x.T @ (weight * y * slack))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, z = new, new + (before - 1) / t * (new - w)
    return w


class Votes:
    """One-versus-one machines over some names."""

    def __init__(self, names: list[str], x: np.ndarray, labels: np.ndarray):
        self.names = sorted(names)
        self.pairs = list(combinations(range(len(self.names)), 2))
        self.weights = []
        for a, b in self.pairs:
            own = np.isin(labels, [self.names[a], self.names[b]])
            self.weights.append(fit_svm(x[own], np.where(labels[own] == self.names[a], 1.0, -1.0)))

    def best(self, x: np.ndarray) -> tuple[str, float]:
        """The name with most votes (then the largest sum of margins, then the first), and how sure the closest machine is."""
        votes, sums, least = np.zeros(len(self.names)), np.zeros(len(self.names)), {}
        for (a, b), w in zip(self.pairs, self.weights, strict=True):
            m = float(x @ w[:-1] + w[-1])
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            for k, v in ((a, m), (b, -m)):
                least[k] = min(least.get(k, np.inf), v)
        i = int(np.lexsort((np.arange(len(votes)), -sums, -votes))[0])
        return self.names[i], 1 / (1 + np.exp(-4 * least[i])) if least else 1.0


class Hierarchy:
    def __init__(self, x: np.ndarray, labels: np.ndarray):
        family = np.array([FAMILIES.get(v, v) for v in labels], object)
        self.top = Votes(sorted(set(family)), x, family)
        self.within = {f: Votes(sorted(set(labels[family == f])), x[family == f], labels[family == f]) for f in set(family)}

    @property
    def languages(self) -> frozenset[str]:
        return frozenset(name for votes in self.within.values() for name in votes.names)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        family, sure = self.top.best(x)
        name, own = self.within[family].best(x)
        return name, float(sure * own)


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Hierarchy | None:
    """documents: id, text (bytes), lang of the rows to learn from."""
    labelled = documents.where("id is not null and text is not null and lang is not null")
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    totals = {r["lang"]: r["n"] for r in counted.collect()}
    if not totals:
        return None
    shares = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, per_language / n)) for k, n in totals.items()])
    sample = labelled.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < shares * (1 << 30)).select("text", "lang")

    def run(texts: list[bytes], langs: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "at": [], "x": []}
        for text, lang in zip(texts, langs, strict=True):
            if has_letter(text):
                x = features(text)
                at = np.flatnonzero(x)
                out["lang"].append(lang)
                out["at"].append(at.astype("<u2").tobytes())
                out["x"].append(x[at].astype("<f4").tobytes())
        return out

    rows = map_batches(sample, run, "lang string, at binary, x binary").orderBy("lang", "at", "x").collect()  # about per_language rows of each language
    if not rows:
        return None
    x = np.zeros((len(rows), DIMENSIONS))
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], "<f4")
    return Hierarchy(x, np.array([r["lang"] for r in rows], object))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _prepared(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, Hierarchy | None]:
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("held_out"))
    return rows, fit(rows.where(~F.col("held_out")))


def predict(model: Hierarchy | None, text: bytes | None) -> tuple[str, float]:
    return (NONE, 0.0) if model is None or text is None or not has_letter(text) else model.predict(features(text))


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows, model = _prepared(documents, id_col, text_col, lang_col)

    def run(ids: list, held: list, texts: list) -> dict[str, list]:
        found = [predict(model, t) for t in texts]
        return {"doc_id": ids, "held_out": held, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_batches(rows.select("id", "held_out", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(documents: DataFrame, languages: frozenset[str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, all columns, whose predicted language is wanted: one of those given, by default any learned label, whatever codes the table uses.

    Null texts and texts without a letter have no language and go. Without a model no text can be told from another, and all
    with a letter stay. Repeated rows, and rows with a null id or label, are judged by their text like any other.
    """
    _, model = _prepared(documents, id_col, text_col, lang_col)
    wanted = languages if languages is not None or model is None else model.languages

    def kept(text: bytes) -> bool:
        return has_letter(text) if model is None else predict(model, text)[0] in wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([t is not None and kept(t.encode()) for t in texts], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
