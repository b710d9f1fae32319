"""Benchmark decontamination by latent semantic retrieval.

1. Words are those of the license scan, hashed to 64 bits; their low bits are DIMENSIONS buckets. Document frequencies
   of the buckets are counted over the whole corpus, a row for each bucket and task before the exchange.
2. The benchmark's passages, all of them, are TF-IDF rows, in order of length and dealt into parts of PART passages.
   A randomised SVD finds the leading right singular vectors of each part, a task for each: a sketch with a random matrix,
   two power iterations. A part keeps as many directions as every one of its passages needs for LEAST_KEPT of its length,
   so a verbatim copy keeps its cosine however many passages there are.
   (The columns are the part's words, so other words of the corpus never pass for one of them.)
3. Each document is cut into windows, every STEP words, as long as the passages they are compared with. A window's cosine
   with a passage is its inner product with the passage's latent direction over the window's TF-IDF length; the inner
   product is the sum of what its words add, which is kept for each word and the passages where it is not zero. Passages to
   which the whole document adds too little cannot reach the least cosine and are left out.
4. Candidates with a cosine of LEAST_COSINE or more are checked: the longest common subsequence of the passage and the
   window (STEP words wider on both sides) must hold LEAST_SHARE of the passage's words; below SURE of them the window
   is a paraphrase and must also hold LEAST_ANSWER of the passage's answer words, the fifth of its words that are rarest
   in the corpus.

What is broadcast has a bound: a benchmark of over PASS_WORDS words is dealt into parts by a hash of the text, with a pass
over the documents for each. Documents never move.

Null and empty texts meet nothing; null or wordless items are no passages; items of under MIN_WORDS words must be met
word by word. Very long texts are read whole. Repeated rows give rows of their own; so do items of equal text. An empty
table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_scan import _SPACES
from .suffix_dedup import Hashes
from .util import LOWER, UPPER, map_batches, sliced, table, utf8

DIMENSIONS = 1 << 14
#: Passages of a part, which bounds its directions too.
PART, OVERSAMPLING = 64, 16
LEAST_KEPT = 0.9
STEP = 8
LEAST_COSINE, LEAST_SHARE, SURE, LEAST_ANSWER = 0.35, 0.6, 0.75, 0.3
MIN_WORDS = 5
#: Share of a passage's largest weight under which a word's weight is rounding.
NOISE = 1e-6
#: Sums of a document's blocks and some passages (PART at least) that are held at a time.
SUMS = 1 << 20
#: Words of the passages of a pass, about (or one longer item).
PASS_WORDS = 200_000


def word_hashes(text: bytes) -> np.ndarray:
    plain = text.lower().translate(_SPACES)
    inside = np.zeros(len(plain) + 2, bool)
    inside[1:-1] = np.frombuffer(plain, np.uint8) != 0x20
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return Hashes(plain).of(edge[::2], edge[1::2]) if len(plain) else np.zeros(0, np.uint64)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log((documents + 1) / (documents with the bucket + 1)) of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = np.zeros(DIMENSIONS + 1, bool)
                seen[buckets(word_hashes(text))] = True
                total += seen
                n += 1
        total[DIMENSIONS] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    total = np.zeros(DIMENSIONS + 1)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # DIMENSIONS + 1 rows at most
        total[r["bucket"]] = r["n"]
    return np.log((total[DIMENSIONS] + 1) / (total[:DIMENSIONS] + 1))


def _row(at: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, TF-IDF weights of unit length, the length before."""
    own, tf = np.unique(at, return_counts=True)
    x = tf * idf[own]
    norm = float(np.sqrt(x @ x))
    return own, x / max(norm, 1e-12), norm


def _places(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column of each word, and whether it has one."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return at, vocabulary[at] == hashes


def randomised_svd(texts: list[bytes], idf: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """A part's words (hashes, ascending) and, words x rank, the leading right singular vectors of its TF-IDF rows. idf: of each bucket."""
    hashes = [word_hashes(t) for t in texts]
    vocabulary = np.unique(np.concatenate(hashes))
    own_idf = idf[buckets(vocabulary)]
    rows = [(own, x) for h in hashes for own, x, norm in [_row(np.searchsorted(vocabulary, h), own_idf)] if norm]

    def product(q: np.ndarray) -> np.ndarray:
        """A' A q."""
        out = np.zeros_like(q)
        for own, x in rows:
            out[own] += np.outer(x, x @ q[own])
        return out

    q = np.random.default_rng(0).standard_normal((len(vocabulary), min(len(vocabulary), len(texts) + OVERSAMPLING)))
    for _ in range(rounds):
        q = np.linalg.qr(product(q))[0]
    values, vectors = np.linalg.eigh(q.T @ product(q))
    basis = q @ vectors[:, np.argsort(-values)]
    # squared length of the shortest row in the first 1, 2, 3 ... directions
    kept = np.min([np.cumsum((x @ basis[own]) ** 2) for own, x in rows], axis=0) if rows else np.ones(1)
    return vocabulary, basis[:, : 1 + np.searchsorted(kept, LEAST_KEPT**2)]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest one, with a's places as the bits of an integer."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for w in b:
        if p := places.get(w):
            both = state & p
            state = ((state + both) | (state - both)) & full
    return len(a) - state.bit_count()


def size_of(words: int) -> int:
    """Words of the windows that a passage is compared with."""
    return -(-(words + STEP) // STEP) * STEP


def word_weights(hashes: list[np.ndarray], vocabulary: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (word, passage) and weights: what a word adds to a window's inner product with the latent direction of a part's passage, without rounding's NOISE. hashes: of each passage's words."""
    own_idf = idf[buckets(vocabulary)]
    rows = [(x[:, None] * basis[own]).sum(axis=0) for own, x, _ in (_row(_places(vocabulary, h)[0], own_idf) for h in hashes)]
    vectors = np.array(rows, np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    weights = (own_idf[:, None] * basis).astype(np.float32) @ vectors.T
    word, passage = np.nonzero(np.abs(weights) > NOISE * np.abs(weights).max(axis=0, initial=0))
    return word, passage, weights[word, passage].astype(np.float64)


class Passages:
    """The benchmark's passages in latent space. items: (id, words' hashes) in order of size; spaces: words and basis of each part of them; idf: of each bucket."""

    def __init__(self, items: list[tuple[int, np.ndarray]], idf: np.ndarray, spaces: list[tuple[np.ndarray, np.ndarray]]):
        self.square = idf**2
        self.ids = [i for i, _ in items]
        self.words = [h.tolist() for _, h in items]
        self.size = [size_of(len(h)) for _, h in items]
        self.by_size = {s: np.flatnonzero(np.array(self.size) == s) for s in sorted(set(self.size))}
        #: Blocks of the windows of each size, in ascending order, and the place there of each passage's.
        self.steps = np.array(sorted(set(self.size)), np.int64) // STEP
        self.row = np.searchsorted(list(self.by_size), self.size)
        self.vocabulary = np.unique(np.concatenate([v for v, _ in spaces])) if spaces else np.zeros(0, np.uint64)
        found = []
        for k, (vocabulary, basis) in enumerate(spaces):
            word, passage, weight = word_weights([h for _, h in items[k * PART : (k + 1) * PART]], vocabulary, idf, basis)
            found.append((np.searchsorted(self.vocabulary, vocabulary)[word], k * PART + passage, weight))
        word, self.passage, self.weight = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(word, kind="stable")
        self.passage, self.weight = self.passage[order], self.weight[order]
        #: Of each word, where its passages and weights begin; then the end.
        self.begin = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))
        self.sets = [frozenset(h) for h in self.words]
        self.repeats = [len(h) - len(s) for h, s in zip(self.words, self.sets, strict=True)]
        rare = lambda h: [w for _, w in sorted((-idf[w & (DIMENSIONS - 1)], w) for w in set(h))][: max(1, len(set(h)) // 5)]
        self.answers = [set(rare(h)) for h in self.words]

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, window's first word, cosine) of the pairs with the least cosine. words: hashes of a document's words."""
        n = len(words)
        if not n or not len(self.ids):
            return []
        square = self.square[buckets(words)]
        # sums of blocks of STEP words; a window is a difference of sums up to its ends
        blocks = -(-n // STEP)
        starts = np.arange(0, n, STEP)

        def up(v: np.ndarray) -> np.ndarray:
            out = np.zeros(blocks + 1)
            np.cumsum(np.add.reduceat(v, starts), out=out[1:])
            return out

        place, known = _places(self.vocabulary, words)
        total, inside = up(square), up(square * known)
        # a row for each first block, a column for each size: the windows' ends, and their least inner products; infinite where nothing can reach it
        end = np.arange(blocks)[:, None] + np.minimum(self.steps, blocks)
        whole, end = end <= blocks, np.minimum(end, blocks)
        norm, held = total[end] - total[:-1, None], inside[end] - inside[:-1, None]
        seen = whole & (norm > 0) & (held > 0)
        if not seen.any():
            return []
        least = np.where(seen, LEAST_COSINE * np.sqrt(np.maximum(norm, 0)), np.inf)
        # a row for each passage that a word of the document adds to: block of the word, passage, weight
        at, place = np.flatnonzero(known) // STEP, place[known]
        first, count = self.begin[place], self.begin[place + 1] - self.begin[place]
        entry = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        passage, weight = self.passage[entry], self.weight[entry]
        # a window's inner product is at most the sum of all positive weights of the document (and a little, for rounding)
        most = np.bincount(passage, np.maximum(weight, 0), len(self.ids)) * (1 + 1e-9)
        near = np.flatnonzero(most >= least.min(axis=0)[self.row])
        column = np.full(len(self.ids), -1)
        column[near] = np.arange(len(near))
        column = column[passage]
        inner = np.flatnonzero(column >= 0)
        block, column, weight = np.repeat(at, count)[inner] + 1, column[inner], weight[inner]
        out = []
        width = max(PART, SUMS // (blocks + 1))
        for low in range(0, len(near), width):
            own = near[low : low + width]
            if len(own) < len(near):
                inner = (column >= low) & (column < low + len(own))
                cell, value = block[inner] * len(own) + column[inner] - low, weight[inner]
            else:
                cell, value = block * len(own) + column, weight
            sums = np.bincount(cell, value, (blocks + 1) * len(own)).reshape(blocks + 1, len(own))
            np.cumsum(sums, axis=0, out=sums)
            rows = self.row[own]
            product, lowest = sums[end[:, rows], np.arange(len(own))] - sums[:-1], least[:, rows]
            hit = np.flatnonzero(product >= lowest)
            if len(hit):
                window, of = np.divmod(hit, len(own))
                cosine = product.ravel()[hit] / (lowest.ravel()[hit] / LEAST_COSINE)
                out += zip(own[of].tolist(), (window * STEP).tolist(), cosine.tolist(), strict=True)
        return out

    def check(self, passage: int, window: list[int], held: set[int]) -> tuple[float, float] | None:
        """Shares of the passage and of its answer that a window (held: its words) holds, if it meets it."""
        own = self.words[passage]
        least = (LEAST_SHARE if len(own) >= MIN_WORDS else 1.0) * len(own)
        if len(self.sets[passage] & held) + self.repeats[passage] < least or sum(map(held.__contains__, own)) < least:  # no subsequence holds more words
            return None
        share = common_subsequence(own, window) / len(own)
        if share * len(own) < least:
            return None
        answer = len(self.answers[passage] & held) / len(self.answers[passage])
        return (share, answer) if share >= SURE or answer >= LEAST_ANSWER else None

    def met(self, text: bytes) -> list[tuple[int, int, float, float, float]]:
        """(item, window's first word, cosine, share, answer's share) of each passage that the text holds, at the best window."""
        hashes = word_hashes(text)
        found = self.candidates(hashes)
        if not found:
            return []
        words = hashes.tolist()
        windows: dict[tuple[int, int], tuple[list[int], set[int]]] = {}
        best: dict[int, tuple] = {}
        for passage, start, cosine in found:
            key = start, self.size[passage]
            if (window := windows.get(key)) is None:
                part = words[max(0, start - STEP) : start + key[1] + STEP]
                window = windows[key] = part, set(part)
            if (shares := self.check(passage, *window)) and (passage not in best or shares[0] > best[passage][3]):
                best[passage] = (self.ids[passage], start, cosine, *shares)
        return [best[p] for p in sorted(best)]


def prepared(items: DataFrame, idf: np.ndarray):
    """Passages (item_id, text as bytes) of a pass, broadcast."""
    spark = items.sparkSession
    held = [(r["item_id"], bytes(r["text"])) for r in items.select("item_id", "text").orderBy("item_id", "text").collect()]  # about PASS_WORDS words
    held = sorted(((i, h, t) for i, t in held if len(h := word_hashes(t))), key=lambda x: (size_of(len(x[1])), x[2]))
    spaces = []
    if held:
        texts = [(k, [t for _, _, t in held[at : at + PART]]) for k, at in enumerate(range(0, len(held), PART))]

        def run(numbers: list, texts: list) -> dict[str, list]:
            found = [randomised_svd(t, idf) for t in texts]
            return {"part": numbers, "words": [v.tobytes() for v, _ in found], "basis": [b.astype(np.float32).tobytes() for _, b in found]}

        dealt = spark.createDataFrame(texts, "part int, texts array<binary>").repartition(len(texts), "part")
        for r in map_batches(dealt, run, "part int, words binary, basis binary").orderBy("part").collect():  # at most PART + OVERSAMPLING numbers for each word
            words = np.frombuffer(r["words"], np.uint64)
            spaces.append((words, np.frombuffer(r["basis"], np.float32).reshape(len(words), -1)))
    return spark.sparkContext.broadcast(Passages([(i, h) for i, h, _ in held], idf, spaces))


def passes(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> Iterator:
    """The benchmark's passages, broadcast, a pass's at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), utf8(item_text).alias("text"), _n_words(F.col(item_text)).alias("words")).where("words > 0")
    total = items.agg(F.sum("words")).first()[0] or 0
    parts = max(1, -(-total // PASS_WORDS))
    idf = inverse_frequencies(documents.select(utf8(text_col).alias("text")))
    for p in range(parts):
        yield prepared(items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p) if parts > 1 else items, idf)


def _n_words(text: F.Column) -> F.Column:
    """Words by the same rule as word_hashes()."""
    return F.coalesce(F.size(F.regexp_extract_all(F.translate(text.cast("string"), UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))), F.lit(0)).cast("long")


MATCHES = "doc_id long, item_id long, first_word long, cosine double, share double, answer_share double"


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it holds: MATCHES."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))

    def found(passages) -> DataFrame:
        def run(ids: list, texts: list) -> dict[str, list] | None:
            met = [(i, *m) for i, text in zip(ids, texts, strict=True) for m in passages.value.met(text)]
            return dict(zip((x.split()[0] for x in MATCHES.split(", ")), zip(*met, strict=True), strict=True)) if met else None

        return map_batches(rows, run, MATCHES)

    return reduce(DataFrame.unionByName, map(found, passes(documents, benchmark, text_col)))


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that hold no benchmark item. Rows with a null or empty text, or a null id, stay; repeated rows are judged alike."""

    def without(docs: DataFrame, passages) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not passages.value.met((t or "").encode()) for t in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    return reduce(without, passes(documents, benchmark, text_col), documents)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
