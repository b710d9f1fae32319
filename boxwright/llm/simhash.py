"""SimHash near-duplicates with pigeonring filtering.

A text's words are runs of non-white bytes after lower-casing A-Z; its features are the XXH64 values (seed 42) of all
4-word shingles. A fingerprint's bit is set if it is in over half of them. Fingerprints link at MOST or fewer differing
bits.

A fingerprint is a ring of SEGMENTS = MOST + 1 segments. If two fingerprints differ in at most MOST bits, then on the
ring some chain starts at which the differences of the first 1, 2, 3 ... segments never exceed their share MOST *
length / SEGMENTS: the strong pigeonhole principle. The first segment's share is below one bit and that of the first two
below two, so a chain's first two segments are equal but for one bit of the second. Each fingerprint is therefore a base
under the key of two neighbouring segments, for each segment, and a probe under the keys that one more set bit of the
second segment makes (of two segments that differ in a bit, one has it set): pairs meet under one key of 26 bits. There
the longer chains' budgets discard pairs one segment after another, and only what is left gets the full Hamming check.

Equal fingerprints are one node. Keys of over about CHUNK rows (by a sample of the fingerprints, which decides on the
dealing alone) are dealt into chunks, and each pair of chunks is a tile of its own, so that no task holds an unbounded
bucket. A tile keeps all links for connectivity but returns only a forest of them. Components are found on Spark
(components.py).

A null or empty text, or one of white space, has fingerprint zero, which links like any other. Texts with fewer than
four words are one shingle. Repeated rows are in one component; rows with a null id get one too (the smallest id that
is not null, or null). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators.components import components

from .util import fresh, map_batches, stored, table, utf8

SHINGLE, SEED, MOST = 4, 42, 4
SEGMENTS = MOST + 1
#: Rows of a key that one tile takes on each side, and the share of the fingerprints by which keys are counted.
CHUNK, SAMPLE = 512, 16
#: Rows, and links, that a task takes at a time.
ROWS, LINKS = 1 << 16, 1 << 20
#: Fingerprint bits of each segment: (lowest bit, bits).
BOUNDS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of all shingles of so many words, repeats included; fewer words are one shingle, none give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], ">u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes) -> int:
    return majority(shingle_hashes(text))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag (the text's hash), fp (as a signed 64-bit integer)."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), tag_of(text_col).alias("tag"), utf8(text_col).alias("text"))
    return map_batches(rows, lambda ids, tags, texts: {"doc_id": ids, "tag": tags, "fp": [signed(fingerprint(t)) for t in texts]}, "doc_id long, tag long, fp long")


_MASKS = [((1 << n) - 1) << lo for lo, n in BOUNDS]
#: For each first segment, the masks of the chains of 3 and of more segments, with the bits in which they may differ.
CHAINS = [(np.array([sum(_MASKS[(k + i) % SEGMENTS] for i in range(length)) for k in range(SEGMENTS)], np.uint64), length * MOST // SEGMENTS) for length in range(3, SEGMENTS + 1)]


def chain_links(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the pairs (a, b) that differ in at most MOST bits, of those whose first two segments (from first on) are within their share; longer chains are tested one after another, the whole ring last."""
    at = np.arange(len(a))
    x = a ^ b
    for masks, most in CHAINS:
        keep = np.bitwise_count(x & masks[first]) <= most
        at, x, first = at[keep], x[keep], first[keep]
    return at


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest node of its component, roots left out."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


#: Chunks of a key: their numbers have 16 bits. A key of more fingerprints has larger chunks.
MOST_CHUNKS = 1 << 16
#: A tile is key << 32 | low chunk << 16 | high chunk, and a key segment << 26 | its value << 13 | the next one's; flags: probe, of the high chunk.
PROBE, HIGH = 1, 2


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, fp, flags), sorted by tile: a forest of the links within the tiles."""

    def joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
        names, at = np.unique(np.r_[u, v], return_inverse=True)
        nodes, roots = forest(len(names), at[: len(u)], at[len(u) :])
        return names[nodes], names[roots]

    def links(rows: np.ndarray) -> pa.RecordBatch | None:
        tile, fp, flags = rows["tile"], rows["fp"].view(np.uint64), rows["flags"]
        change = np.flatnonzero(np.diff(tile)) + 1
        bounds = np.r_[0, change, len(tile)]
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(tile)) - 1  # rows of the tile after this one
        first = (tile >> 58).astype(np.int64)
        cross = (tile >> 16) & 0xFFFF != tile & 0xFFFF
        pairs, n, d = [], 0, 1
        at = np.flatnonzero(left >= d)
        while len(at):
            a, b = flags[at], flags[at + d]
            good = at[((a & b & PROBE) == 0) & (~cross[at] | ((a ^ b) & HIGH > 0))]
            met = good[chain_links(fp[good], fp[good + d], first[good])]
            if len(met):
                pairs.append((fp[met], fp[met + d]))
                n += len(met)
                if n > LINKS:
                    pairs = [joined(pairs)]
                    n = len(pairs[0][0])
            d += 1
            at = at[left[at] >= d]
        if not pairs:
            return None
        u, v = joined(pairs)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    kind = np.dtype([("tile", "i8"), ("fp", "i8"), ("flags", "i4")])
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.zeros(batch.num_rows, kind)
        for name in kind.names:
            rows[name] = batch.column(name).to_numpy()
        held.append(rows)
        if sum(map(len, held)) >= ROWS:
            rows = np.concatenate(held)
            cut = int(np.searchsorted(rows["tile"], rows["tile"][-1]))  # the last tile may go on
            held = [rows[cut:]]
            if (found := links(rows[:cut])) is not None:
                yield found
    if held and (found := links(np.concatenate(held))) is not None:
        yield found


def _keyed(fps: DataFrame) -> DataFrame:
    """key, probe, fp: under which keys a fingerprint is a base or a probe."""
    parts = []
    for k, (lo, n) in enumerate(BOUNDS):
        next_lo, next_n = BOUNDS[(k + 1) % SEGMENTS]
        second = f"cast(shiftrightunsigned(fp, {next_lo}) & {(1 << next_n) - 1} as int)"
        key = f"({k << 26} | shiftleft(cast(shiftrightunsigned(fp, {lo}) & {(1 << n) - 1} as int), 13) | {second})"
        parts.append(f"array(struct({key} as key, false as probe))")
        parts.append(f"transform(filter(sequence(0, {next_n - 1}), b -> getbit({second}, b) = 0), b -> struct({key} | shiftleft(1, b) as key, true as probe))")
    return fps.select("fp", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("k")).select("k.key", "k.probe", "fp")


def linked(fps: DataFrame) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that keep all connections."""
    sample = _keyed(fps.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(SAMPLE)) == 0))
    hot = stored(sample.groupBy("key").agg(F.least(F.ceil(F.count("*") * SAMPLE / CHUNK), F.lit(MOST_CHUNKS)).cast("int").alias("chunks")).where("chunks > 1"), "hot")
    dealt = _keyed(fps).join(hot, "key", "left")
    chunk = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.lit(0))
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiles = dealt.withColumn("chunk", chunk).withColumn("other", F.explode(others))
    tile = F.expr("shiftleft(cast(key as long), 32) | shiftleft(cast(least(chunk, other) as long), 16) | cast(greatest(chunk, other) as long)")
    flags = F.col("probe").cast("int") * PROBE + (F.col("chunk") > F.col("other")).cast("int") * HIGH
    return tiles.select(tile.alias("tile"), "fp", flags.alias("flags")).repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_links, "u long, v long")


def roots_of(fps: DataFrame) -> DataFrame:
    """fp, root, least (smallest doc_id with that fingerprint) of every distinct fingerprint."""
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(linked(nodes))
    return stored(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id."""
    fps = stored(fingerprints(documents, id_col, text_col), "fingerprints").select("doc_id", "fp")
    known = roots_of(fps)
    ids = stored(known.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = stored(known.join(ids, "root").select("fp", "component_id"), "named")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, but of each component only one: that with the smallest id (null first), then text hash."""
    fps = stored(fingerprints(documents, id_col, text_col), "fingerprints")
    known = roots_of(fps.select("doc_id", "fp")).select("fp", "root")
    return first_of_each(documents, fps.join(known, "fp"), id_col, text_col)


def first_of_each(documents: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the documents of each root (of doc_id, tag, root) the first."""
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("first"))
    kept_id, kept_tag, tag = (fresh(documents, name) for name in ("_kept_id", "_kept_tag", "_tag"))
    kept = stored(first.select(F.col("first.doc_id").alias(kept_id), F.col("first.tag").alias(kept_tag)), "kept")
    tagged = documents.withColumn(tag, tag_of(text_col))
    joined = tagged.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(tag) == F.col(kept_tag)), "left_semi")
    return joined.dropDuplicates([id_col, tag]).drop(tag)


def tag_of(text_col: str) -> F.Column:
    return F.xxhash64(utf8(text_col))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
