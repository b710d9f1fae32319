"""Near copies: SimHash links, and texts that share most of their five-word shingles.

Texts are linked as op4 links them (simhash.py), and also if the Jaccard similarity of their sets of SHINGLE-word shingles
is SIMILAR or more: at that similarity two fingerprints of 64 bits differ in about ten bits, too many for op4's keys, so
candidates come from MinHash bands. Two texts meet in a band if ROWS minima of theirs are equal: at a similarity of 0.8 in
at least one of BANDS with a probability of 0.998. Likely pairs come first: a bucket's texts fall into PARTNERS parts by a
hash, each is compared with the first of every part, and of a pair of components the TRIES candidates with the closest
five-word fingerprints (MOST_BITS apart at most) are compared. That joins most of what belongs together, with candidates that
grow with the rows. Then come the rest: every pair that meets in a bucket, is in two components still and was not compared,
unless its sizes or bitmaps differ too much for the similarity. A bitmap holds, for each of its places, whether an odd number
of the set's hashes fall there, so two sets differ in at least as many shingles as their bitmaps in bits: what that leaves
out is not similar, and few pairs that are left are not either. Large buckets are dealt into chunks, each pair of chunks a
tile, where every bitmap meets every other: of a bucket that is open still, these are all pairs of two components. The
whole sets are compared, so every link is exact, and what can be lost is a pair that meets in no bucket.

A text without a word has no shingle and is linked by its fingerprint alone; one of fewer than SHINGLE words is one
shingle. Null texts are empty. Repeated texts are one. Null and repeated ids are told apart by the text. An empty table
gives no rows. Other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.operators.components import components

from .simhash import fingerprint, first_of_each, majority, roots_of, shingle_hashes, signed, tag_of
from .util import give_back, map_batches, sliced, stored, utf8

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 5
#: Bits in which the five-word fingerprints of a candidate may differ.
MOST_BITS = 20
#: Texts of a bucket that each of its texts is compared with, and pairs of texts that are compared for a pair of components: those with the closest fingerprints.
PARTNERS, TRIES = 8, 64
#: Texts of a bucket that a tile of the rest takes on each side.
CHUNK = 512
#: Bits of a bitmap: the power of two from BITS times the shingles on, within these bounds. Words of two sides' bitmaps that are compared at a time.
BITS, LEAST_BITS, MOST_BITMAP, WORDS = 4, 512, 1 << 15, 1 << 16
#: Shingles whose minima are taken at a time, and pairs whose sets are compared at a time.
AT_ONCE, PAIRS = 4096, 256

_RANDOM = np.random.default_rng(20)
_FLIPS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE).astype(np.uint64))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band; none without a shingle."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), AT_ONCE):
        mixed = (shingles[i : i + AT_ONCE, None] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, mixed.min(axis=0))
    return [signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def bitmap(shingles: np.ndarray) -> bytes:
    """For each place (a hash's low bits) whether an odd number of the hashes fall there."""
    n = min(MOST_BITMAP, max(LEAST_BITS, 1 << (BITS * len(shingles) - 1).bit_length())) if len(shingles) else LEAST_BITS
    odd = np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketches(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag (the text's hash), fp (op4's fingerprint), size (of the shingle set), coarse (fingerprint of five-word shingles), keys (of the bands), bits (the set's bitmap)."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), tag_of(text_col).alias("tag"), utf8(text_col).alias("text"))

    def sketched(ids: list, tags: list, texts: list) -> dict[str, list]:
        fps, sizes, coarse, keys, bits = [], [], [], [], []
        for text in texts:
            hashes = shingle_hashes(text, SHINGLE)
            shingles = np.unique(hashes.astype(np.uint64))
            fps.append(signed(fingerprint(text)))
            sizes.append(len(shingles))
            coarse.append(signed(majority(hashes)))
            keys.append(band_keys(shingles))
            bits.append(bitmap(shingles))
        return {"doc_id": ids, "tag": tags, "fp": fps, "size": sizes, "coarse": coarse, "keys": keys, "bits": bits}

    return map_batches(rows, sketched, "doc_id long, tag long, fp long, size int, coarse long, keys array<bigint>, bits binary")


def candidates(texts: DataFrame) -> DataFrame:
    """u, v (tags), root_u, root_v of the pairs to compare, of distinct texts (tag, root, size, coarse, keys)."""
    shared = texts.select("root", F.explode("keys").alias("key")).groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    met = stored(texts.select("tag", "root", "size", "coarse", F.explode("keys").alias("key")).join(stored(shared, "shared"), "key"), "met")
    row = F.struct(F.xxhash64("key", "tag").alias("order"), "tag", "root", "size", "coarse")
    firsts = met.groupBy("key", F.pmod(F.xxhash64("tag", "key"), F.lit(PARTNERS)).alias("part")).agg(F.min(row).alias("other")).drop("part")
    pairs = met.join(firsts, "key").where("root <> other.root")
    alike = pairs.where(F.least("size", "other.size") >= SIMILAR * F.greatest("size", "other.size")).withColumn("far", F.expr("bit_count(coarse ^ other.coarse)")).where(f"far <= {MOST_BITS}")
    mine, others = F.struct("root", "tag"), F.struct("other.root", "other.tag")
    ends = alike.select("far", F.least(mine, others).alias("a"), F.greatest(mine, others).alias("b"))
    closest = Window.partitionBy("a.root", "b.root").orderBy("far", "a.tag", "b.tag")
    tried = ends.distinct().withColumn("place", F.row_number().over(closest)).where(F.col("place") <= TRIES)
    return tried.select(F.col("a.tag").alias("u"), F.col("b.tag").alias("v"), F.col("a.root").alias("root_u"), F.col("b.root").alias("root_v"))


def near_pairs(size: np.ndarray, bits: list[bytes], group: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of two groups whose sizes and bitmaps don't rule out the similarity; where the rows have sides, those across."""
    length = np.array([len(b) for b in bits])
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(length).tolist():  # similar sets have bitmaps of one length, or the larger's is twice as long
        own, twice = np.flatnonzero(length == n), np.flatnonzero(length == 2 * n)
        at = np.r_[own, twice]
        words = np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(len(own), -1)
        longer = np.frombuffer(b"".join(bits[i] for i in twice), np.uint64).reshape(len(twice), 2, words.shape[1])
        words = np.concatenate([words, longer[:, 0] ^ longer[:, 1]])
        step = max(1, WORDS // (len(at) * words.shape[1]))
        for k in range(0, len(own), step):
            a = own[k : k + step]
            total, low = size[a][:, None] + size[at], np.minimum(size[a][:, None], size[at])
            good = (np.arange(k, k + len(a))[:, None] < np.arange(len(at))) & (group[a][:, None] != group[at]) & (low >= SIMILAR * (total - low))
            if side is not None:
                good &= side[a][:, None] != side[at]
            i, j = np.nonzero(good)
            for m in range(0, len(i), max(1, WORDS // words.shape[1])):
                x, y = i[m : m + max(1, WORDS // words.shape[1])], j[m : m + max(1, WORDS // words.shape[1])]
                differ = np.bitwise_count(words[k + x] ^ words[y]).sum(axis=1, dtype=np.int64)
                met = differ * (1 + SIMILAR) <= total[x, y] * (1 - SIMILAR) + 1e-6
                u.append(a[x[met]])
                v.append(at[y[met]])
    return np.concatenate(u), np.concatenate(v)


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v, root_u, root_v of the rows (key, low, high, side, tag, root, size, bits), in order of their tiles (key, low, high)."""
    names = ["key", "low", "high", "side", "tag", "root", "size"]

    def pairs(held: list[pa.RecordBatch], across: bool) -> pa.RecordBatch:
        side, tag, root, size = (np.concatenate([b.column(n).to_numpy() for b in held]) for n in names[3:])
        i, j = near_pairs(size, [x for b in held for x in b.column("bits").to_pylist()], root, side if across else None)
        i, j = np.where(tag[i] < tag[j], i, j), np.where(tag[i] < tag[j], j, i)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (tag[i], tag[j], root[i], root[j])], names=["u", "v", "root_u", "root_v"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in sliced(batches):
        columns = [batch.column(n).to_numpy() for n in names[:3]]
        cuts = np.r_[0, 1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)), batch.num_rows].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            tile = tuple(int(c[a]) for c in columns)
            if held and tile != last:
                yield pairs(held, last[1] < last[2])
                held = []
            held.append(batch.slice(a, b - a))
            last = tile
    if held:
        yield pairs(held, last[1] < last[2])
    give_back()


def rest(texts: DataFrame, tried: DataFrame) -> DataFrame:
    """u, v, root_u, root_v of all pairs of distinct texts (tag, root, size, keys, bits) that meet in a bucket, are of two roots, may be similar by their sizes and bitmaps and are not among those tried (u, v)."""
    rows = texts.select("tag", "root", "size", F.explode("keys").alias("key"))
    open_ = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("a < b").select("key", "chunks")
    met = stored(rows.join(stored(open_, "open"), "key").join(texts.select("tag", "bits").hint("merge"), "tag"), "met")
    dealt = met.withColumn("chunk", F.pmod(F.xxhash64("tag"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tile = [F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), (F.col("chunk") > F.col("other")).cast("int").alias("side")]
    tiles = dealt.select("key", *tile, "tag", "root", "size", "bits").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    ends = tiles.mapInArrow(_tile_pairs, "u long, v long, root_u long, root_v long").distinct()
    known = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return ends.join(known.hint("merge"), ["u", "v"], "left_anti")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """root_u, root_v of the pairs whose sets are similar."""
    for batch in sliced(batches, PAIRS):
        sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(name)] for name in ("set_u", "set_v")]
        keep = []
        for a, b in zip(*sets, strict=True):
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= SIMILAR * (len(a) + len(b) - both))
        rows = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([rows.column("root_u"), rows.column("root_v")], names=["u", "v"])


def similar_links(documents: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """u, v: components (root_u, root_v) that similar texts (u, v) link."""
    wanted = stored(pairs.select(F.explode(F.array("u", "v")).alias("tag")).distinct(), "wanted")
    texts = documents.select(tag_of(text_col).alias("tag"), utf8(text_col).alias("text")).join(wanted, "tag", "left_semi").dropDuplicates(["tag"])
    sets = stored(map_batches(texts, lambda tags, texts: {"tag": tags, "words": [shingle_set(t).tobytes() for t in texts]}, "tag long, words binary"), "sets")
    left = pairs.join(sets.select(F.col("tag").alias("u"), F.col("words").alias("set_u")), "u")
    both = left.join(sets.select(F.col("tag").alias("v"), F.col("words").alias("set_v")), "v").select("root_u", "root_v", "set_u", "set_v")
    return both.mapInArrow(_similar, "u long, v long").distinct()


def rooted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag, root: the component of each document."""
    sketched = stored(sketches(documents, id_col, text_col), "sketches")
    known = roots_of(sketched.select("doc_id", "fp")).select("fp", "root")
    one = sketched.groupBy("tag").agg(*(F.first(c).alias(c) for c in ("fp", "size", "coarse", "keys", "bits")))
    texts = stored(one.join(known, "fp").select("tag", "root", "size", "coarse", "keys", "bits"), "texts")
    pairs = stored(candidates(texts), "pairs")
    likely = _joined(known, similar_links(documents, pairs, text_col))
    moved = texts.join(likely, "root").select("tag", F.col("further").alias("root"), "size", "keys", "bits")
    others = stored(rest(stored(moved, "texts"), pairs), "pairs")
    roots = likely
    if not others.isEmpty():
        last = _joined(likely.select(F.col("further").alias("root")), similar_links(documents, others, text_col))
        roots = stored(likely.select("root", F.col("further").alias("between")).join(last.select(F.col("root").alias("between"), "further"), "between").select("root", "further"), "roots")
    named = known.join(roots, "root").select("fp", F.col("further").alias("root"))
    return sketched.select("doc_id", "tag", "fp").join(named, "fp").select("doc_id", "tag", "root")


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """root, further: the roots that are known, and the root of what links join."""
    found = components(links).select(F.col("node").alias("root"), F.col("root").alias("further"))
    return stored(known.select("root").distinct().join(found, "root", "left").select("root", F.coalesce("further", "root").alias("further")), "roots")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, but of each component only one: that with the smallest id (null first), then text hash."""
    return first_of_each(documents, rooted(documents, id_col, text_col), id_col, text_col)
