"""Removal of repeated strings by externally sorted suffixes.

A byte goes if it is covered by a LENGTH-byte string that also starts anywhere else, in the same document or another.

1. Anchors. Every window of LENGTH bytes has one: the leftmost of its K-grams with the smallest hash. Equal windows have
   equal anchors at equal offsets, so only windows at anchors whose hash occurs again can repeat. An anchor stands for a
   run of neighbouring windows; the bytes that these cover are its context. Counting anchors is a combinable
   aggregation, and only repeated ones (a few per cent of the positions / 70) go on. Hashes of anchors choose what meets;
   they never decide that two strings are equal.
2. Contexts. Equal contexts (by a 128-bit BLAKE2b digest) are one row with a count. If they occur twice all their windows
   repeat; if an anchor has one context alone, that is all there is to know about it.
3. Suffixes. Anchors with several contexts are exchanged by hash and sorted by it with Spark's external sort, so a shard
   may exceed memory by far: a task takes as many whole groups as BATCH allows. The suffixes that start at the anchors
   are sorted; then the suffixes one byte to the left are induced from them, in rounds: suffix tuples (group, preceding
   byte, rank) leave the queue in stable order, and their common-prefix values are one more than the least value between
   them in the round before. A window repeats if its suffix has LENGTH bytes in common with a neighbour. Tuples that can
   no longer reach LENGTH leave the queue early.
4. Recursion. A group of over GROUP different contexts is no task's. Its contexts are cut into pieces of PIECE windows,
   and pieces that share their core (what all windows of a piece share) are a group of the next level: equal pieces are
   counted as contexts are, others are sorted and induced in the same way. A group that is still too large is cut into
   single windows, where a group's members are equal strings and a count is all that is left.
5. Ranges of window starts go back to the occurrences, then to the documents.

A null text is empty. Texts shorter than LENGTH keep all bytes. Very long texts are read whole. Rows that repeat another
(id and text) are occurrences of their own; rows with the same id and different texts are told apart by the text's 64-bit
hash, rows with a null id by two of them. An empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import discard, fresh, give_back, map_batches, sliced, stored, table, utf8

LENGTH = 200
#: Length of the K-grams that anchors are chosen from.
K = 32
#: Contexts of a group that one task takes; contexts that it takes at a time, and those whose bytes it gathers at a time.
GROUP, BATCH, AT_ONCE = 256, 16384, 1024
#: Windows of a piece of a large group's context.
PIECE = 16

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_HALVES = struct.Struct("<qq")
_VALUES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)


class _Powers:
    """Powers of the hash's base, and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (_BASE, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of a text."""

    def __init__(self, text: bytes):
        self.up, down = _POWERS.upto(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_VALUES[np.frombuffer(text, np.uint8)] * down[: len(text)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.up[start])


def digest(data: bytes) -> tuple[int, int]:
    """128 bits, as two signed integers."""
    return _HALVES.unpack(hashlib.blake2b(data, digest_size=16).digest())


def anchors(text: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Hash and place of each anchor, and its run of windows as offsets (dmin, dmax) before it."""
    n = len(text)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    hashes = Hashes(text)
    grams = _mixed((hashes.sums[k:] - hashes.sums[:-k]) * hashes.up[: n - k + 1])
    low = np.uint64((1 << max(20, n.bit_length())) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # the place breaks ties to the left
    span, width = 1, length - k + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    at = (least & low).astype(np.int64)  # of the window that starts at each place
    change = np.flatnonzero(np.diff(at)) + 1
    first, last = np.r_[0, change], np.r_[change - 1, len(at) - 1]
    place = at[first]
    return grams[place], place, place - last, place - first


class InductionQueue:
    """Suffix tuples of whole groups, in suffix order, with the bytes they have in common with the tuple before (-1: another group)."""

    def __init__(self, group: np.ndarray, contexts: list[bytes], dmin: np.ndarray, dmax: np.ndarray, length: int = LENGTH):
        n, self.length, self.dmax = len(contexts), length, dmax
        sizes = np.array([len(c) for c in contexts])
        right = sizes - dmax
        joined = np.frombuffer(b"".join(contexts), np.uint8)
        starts = np.r_[0, np.cumsum(sizes)[:-1]] + dmax
        #: Bytes from the anchor on, and before it (column d: d + 1 places before).
        place, back = np.arange(length), np.arange(1, int(dmax.max(initial=0)) + 1)
        tail, self.before = np.zeros((n, len(place)), np.uint8), np.zeros((n, len(back)), np.uint8)
        for i in range(0, n, AT_ONCE):  # places take eight times the bytes
            at, own, far = starts[i : i + AT_ONCE, None], right[i : i + AT_ONCE, None], dmax[i : i + AT_ONCE, None]
            tail[i : i + AT_ONCE] = np.where(place < own, joined[np.minimum(at + place, len(joined) - 1)], 0)
            self.before[i : i + AT_ONCE] = np.where(back <= far, joined[np.maximum(at - back, 0)], 0)
        order = np.lexsort((right, np.ascontiguousarray(tail).view(f"S{length}").ravel(), group))
        same = np.ones(n, np.int64) * -1
        if n > 1:
            differ = tail[order[1:]] != tail[order[:-1]]
            common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
            common = np.minimum(common, np.minimum(right[order[1:]], right[order[:-1]]))
            same[1:] = np.where(group[order[1:]] == group[order[:-1]], common, -1)
        self.group, self.item, self.common, self.d = group, order, same, 0

    def neighbours(self) -> np.ndarray:
        return np.maximum(self.common, np.r_[self.common[1:], -1])

    def induce(self) -> bool:
        """From the suffixes at distance d before the anchors to those at d + 1; False if none are left."""
        reach = self.neighbours() + (self.dmax[self.item] - self.d)
        keep = np.flatnonzero((self.dmax[self.item] > self.d) & (reach >= self.length))
        if len(keep) < 2:
            return False
        common = np.minimum.reduceat(self.common, np.r_[0, keep[:-1] + 1]) if len(keep) < len(self.item) else self.common
        common = common[: len(keep)]
        if keep[-1] + 1 < len(self.item) and len(keep) < len(self.item):  # the last segment must end at the last kept tuple
            common[-1] = self.common[(keep[-2] + 1) : keep[-1] + 1].min()
        item = self.item[keep]
        key = self.group[item] * 256 + self.before[item, self.d]
        order = np.argsort(key, kind="stable")
        left, right = order[:-1], order[1:]
        alike = key[left] == key[right]
        new = np.full(len(order), -1, np.int64)
        pairs = np.stack([left[alike] + 1, right[alike] + 1], axis=1).ravel()
        if len(pairs):
            new[1:][alike] = 1 + np.minimum.reduceat(np.r_[common, np.iinfo(np.int64).max], pairs)[::2]
        new[1:][~alike & (self.group[item[left]] == self.group[item[right]])] = 0
        # a value of another group within the range would be -1: ranges lie within one group
        self.item, self.common, self.d = item[order], new, self.d + 1
        return True


def repeated_windows(group: np.ndarray, contexts: list[bytes], dmin: np.ndarray, dmax: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each context and distance d before its anchor, whether the window that starts there also starts in another context of its group."""
    found = np.zeros((len(contexts), int(dmax.max(initial=0)) + 1), bool)
    queue = InductionQueue(group, contexts, dmin, dmax, length)
    while True:
        hit = queue.item[queue.neighbours() >= length]
        found[hit, queue.d] = True
        if not queue.induce():
            return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of set flags."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


#: A context's key: its anchor's hash and its digest. Ranges: the first and last distance of repeated windows before an anchor.
_KEY = ["h", "c0", "c1"]
_RANGES = "h long, c0 long, c1 long, lo int, hi int"
#: Contexts of the groups g: windows at distances dmin to dmax before the anchor, the bytes that these cover.
_CONTEXTS = "g long, h long, c0 long, c1 long, dmin int, dmax int, context binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_CONTEXTS), sorted by g."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        g, h, c0, c1, dmin, dmax, contexts = zip(*rows, strict=True)
        g = np.array(g, np.int64)
        group = np.cumsum(np.r_[0, g[1:] != g[:-1]])
        row, lo, hi = _runs(repeated_windows(group, list(contexts), np.array(dmin, np.int64), np.array(dmax, np.int64)))
        columns = [pa.array(np.array(x, np.int64)[row]) for x in (h, c0, c1)] + [pa.array(x.astype(np.int32)) for x in (lo, hi)]
        return pa.RecordBatch.from_arrays(columns, names=[*_KEY, "lo", "hi"])

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        if len(held) >= BATCH:
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:  # the last group may go on
                cut -= 1
            if cut:
                yield solved(held[:cut])
                held = held[cut:]
    if held:
        yield solved(held)
    held.clear()
    give_back()


_PIECES = _CONTEXTS + ", p0 long, p1 long"


def _cut_into(width: int):
    """Contexts in pieces of the windows at width neighbouring distances: their group by what all these windows share, their own digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple] = []
            for _, h, c0, c1, dmin, dmax, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for number in range(dmin // width, dmax // width + 1):
                    low, high = number * width, number * width + width - 1
                    lo, hi = max(low, dmin), min(high, dmax)
                    bytes_ = context[dmax - hi : dmax - lo + LENGTH]
                    # windows at all distances of the piece begin at dmax - low at the latest and end at dmax - high + LENGTH at the earliest
                    core = context[dmax - low : dmax - high + LENGTH] if high <= dmax + LENGTH else b""
                    group = digest(b"%d %d %d " % (h, number, width) + core)[0]
                    out.append((group, h, c0, c1, lo, hi, bytes_, *digest(b"%d %d " % (lo, hi) + bytes_)))
            if out:
                yield _batch(_PIECES, out)

    return run


def _large_ranges(contexts: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Ranges of the groups that are too large for a task: cut into pieces, which are groups of the next level. Every table that a join reads is stored, so that Spark can split hot keys."""
    width, deeper = widths[0], widths[1:]
    pieces = stored(contexts.mapInArrow(_cut_into(width), _PIECES), "pieces")
    # equal pieces are one, with a count
    piece = ["g", "p0", "p1"]
    some = F.first(F.struct("h", "c0", "c1", "dmin", "dmax", "context")).alias("x")
    distinct = stored(pieces.groupBy(*piece).agg(F.count("*").alias("n"), some).select(*piece, "n", "x.*"), "distinct")
    again = stored(distinct.where("n > 1").select(*piece), "again")
    sure = pieces.join(again, piece, "left_semi").select(*_KEY, F.col("dmin").alias("lo"), F.col("dmax").alias("hi"))
    if not deeper:  # windows: the members of a group that are not equal share only its digest's half
        return sure
    sizes = stored(distinct.groupBy("g").agg(F.count("*").alias("size")).where("size > 1").select("g", (F.col("size") > GROUP).alias("large")), "sizes")
    open_ = stored(distinct.join(sizes, "g").select("g", *_KEY, "dmin", "dmax", "context", "large", *piece[1:]), "open")
    names = [x.split()[0] for x in _CONTEXTS.split(", ")]
    small = open_.where("not large").select(*names).repartition("g").sortWithinPartitions("g").mapInArrow(_sort_suffixes, _RANGES)
    large = _large_ranges(open_.where("large").select(*names), deeper)
    # what was found for one of equal pieces holds for that piece alone: the others of them repeat whole anyway
    return sure.unionByName(small).unionByName(large)


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """doc, tag, spans (array of first and last start) of the documents with repeated windows. rows: doc, tag, text (bytes)."""

    def run(docs: list, tags: list, texts: list) -> dict[str, list] | None:
        out = []
        for doc, tag, text in zip(docs, tags, texts, strict=True):
            h, place, dmin, dmax = anchors(text)
            if len(h):
                own = [digest(text[a:b]) for a, b in zip((place - dmax).tolist(), (place - dmin + LENGTH).tolist(), strict=True)]
                c0, c1 = np.array(own, np.int64).T
                out.append((h.view(np.int64), c0, c1, np.full(len(h), doc), np.full(len(h), tag), place, dmin, dmax))
        return dict(zip((*_KEY, "doc", "tag", "at", "dmin", "dmax"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)) if out else None

    found = stored(map_batches(rows, run, "h long, c0 long, c1 long, doc long, tag long, at int, dmin short, dmax short"), "found")
    again = stored(found.groupBy("h").agg(F.count("*").alias("n"), F.min("c0").alias("a"), F.max("c0").alias("b")).where("n > 1").select("h", (F.col("a") != F.col("b")).alias("several")), "anchors")
    occurrences = stored(found.join(again, "h"), "occurrences")
    discard(found)
    first = F.min(F.struct("doc", "tag", "at"))
    contexts = stored(occurrences.groupBy(*_KEY, "several").agg(F.count("*").alias("n"), first.alias("first"), F.min("dmin").cast("int").alias("dmin"), F.min("dmax").cast("int").alias("dmax")), "contexts")
    certain = contexts.where("n > 1").select(*_KEY, F.col("dmin").alias("lo"), F.col("dmax").alias("hi"))

    several = contexts.where("several")
    large = stored(several.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > GROUP).select("h", F.lit(True).alias("large")), "large")
    sought = several.join(large, "h", "left").select("first.*", F.struct(*_KEY, "dmin", "dmax", F.coalesce("large", F.lit(False)).alias("large"), F.col("first.at").alias("at")).alias("context"))
    by_doc = sought.groupBy("doc", "tag").agg(F.collect_list("context").alias("contexts"))  # no more than a document has anchors

    def cut(texts: list, lists: list) -> dict[str, list]:
        names = (*_KEY, "dmin", "dmax", "large")
        out: dict[str, list] = {k: [] for k in ("g", *names, "context")}
        for text, some in zip(texts, lists, strict=True):
            for c in some:
                out["g"].append(c["h"])
                for k in names:
                    out[k].append(c[k])
                out["context"].append(text[c["at"] - c["dmax"] : c["at"] - c["dmin"] + LENGTH])
        return out

    cutting = rows.join(by_doc, ["doc", "tag"]).select("text", "contexts")
    bytes_of = stored(map_batches(cutting, cut, "g long, h long, c0 long, c1 long, dmin int, dmax int, large boolean, context binary"), "bytes")
    columns = [x.split()[0] for x in _CONTEXTS.split(", ")]
    sorted_ = bytes_of.where("not large").select(*columns).repartition("g").sortWithinPartitions("g").mapInArrow(_sort_suffixes, _RANGES)

    deep = _large_ranges(bytes_of.where("large").select(*columns), (PIECE, 1))
    ranges = stored(certain.unionByName(sorted_).unionByName(deep), "ranges")
    discard(bytes_of)
    spans = occurrences.select(*_KEY, "doc", "tag", "at").join(ranges, _KEY).select("doc", "tag", F.struct((F.col("at") - F.col("hi")).alias("lo"), (F.col("at") - F.col("lo")).alias("hi")).alias("span"))
    return spans.groupBy("doc", "tag").agg(F.collect_set("span").alias("spans"))


def covered(size: int, spans: list | None, length: int = LENGTH) -> np.ndarray:
    """Removed bytes as (first, end) of maximal runs."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    pairs = np.array([(s["lo"], s["hi"] + length) for s in spans], np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(pairs[1:, 0] > end[:-1]) + 1
    return np.stack([pairs[np.r_[0, new], 0], end[np.r_[new - 1, len(pairs) - 1]]], axis=1)


def _with_spans(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with one more column, the last: first and last starts of repeated windows."""
    doc, tag, spans = (fresh(documents, name) for name in ("_doc", "_tag", "_spans"))
    keyed = documents.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"), F.lit(1))), tag: F.xxhash64(F.col(text_col).cast("string"))})
    found = repeated_ranges(keyed.select(F.col(doc).alias("doc"), F.col(tag).alias("tag"), utf8(text_col).alias("text")))
    found = found.select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("spans").alias(spans))
    return keyed.join(found, [doc, tag], "left").select(*[F.col(f"`{c}`") for c in documents.columns], spans)


def kept_bytes(text: bytes, runs: list[list[int]]) -> bytes:
    return b"".join(text[a:b] for (_, a), (b, _) in zip([(0, 0), *runs], [*runs, (len(text), 0)], strict=True))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(ids: list, texts: list, lists: list) -> dict[str, list]:
        runs = [covered(len(text), some).tolist() for text, some in zip(texts, lists, strict=True)]
        kept = [kept_bytes(text, r) for text, r in zip(texts, runs, strict=True)]
        return {"doc_id": ids, "n_bytes": [len(t) for t in texts], "n_removed": [len(t) - len(k) for t, k in zip(texts, kept, strict=True)], "n_spans": [len(r) for r in runs], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}

    joined = _with_spans(documents, id_col, text_col)
    joined = joined.select(F.col(id_col).cast("long"), utf8(text_col), joined.columns[-1])
    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without the repeated bytes; a character that is cut through goes whole."""
    joined = _with_spans(documents, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else kept_bytes(b := t.encode(), covered(len(b), some).tolist()).decode("utf-8", "ignore") for t, some in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, documents.schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
