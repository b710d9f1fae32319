"""Boxes of typical sizes on a grid of an image that its detections leave free: the first of them in the order of a hash."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes of a slice of a batch, boxes that are held to all candidates at once, messages whose hashes are made at once.
ROWS, BOXES, MESSAGES = 16384, 128, 32768
#: MD5 (RFC 1321): shifts and constants of its steps, its first state. One block holds 55 bytes of a message.
LEFT = [np.array(s, np.uint32) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
RIGHT = [np.array(32 - s, np.uint32) for s in LEFT]
SINES = [np.array(int(abs(math.sin(i + 1)) * 2**32), np.uint32) for i in range(64)]
STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
BLOCK = 55


def md5_heads(words: list[np.ndarray | None]) -> np.ndarray:
    """The first four bytes of the MD5 of messages of one block each, as numbers in the order of the digests. words: the 16 words of the blocks, None where all are 0.

    Spark's md5() of a row takes about five times as long (README). The last three of the 64 steps leave these bytes as they are.
    """
    n = len(words[14])
    a, b, c, d = (np.full(n, v, np.uint32) for v in STATE)
    f, low = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        a += f
        a += SINES[i]
        if words[at] is not None:
            a += words[at]
        np.right_shift(a, RIGHT[i], out=low)
        a <<= LEFT[i]
        a |= low
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(STATE[0])
    return b.byteswap()


class _Candidates:
    """The candidates of an image: sizes, then xs, then ys. Each has a number, by which it is hashed."""

    def __init__(self, sizes: Sequence[tuple[int, int]], xs: Sequence[int], ys: Sequence[int], width: int, height: int, share: float, number: Callable[[int, int, int, int], int]):
        self.share, self.grids, found = share, [], []
        for w, h in sizes:
            own, rows = [x for x in xs if x + w <= width], [y for y in ys if y + h <= height]
            self.grids.append((w, h, np.array(own, float), np.array(rows, float), slice(len(found), len(found) + len(own) * len(rows))))
            found += [(w, h, x, y) for x in own for y in rows]
        self.boxes = np.array(found, np.int32).reshape(-1, 4)
        self.numbers = [number(*c) for c in found]
        self.texts = [str(k).encode() for k in self.numbers]
        self.longest = max(map(len, self.texts), default=0)
        self.columns = (len(found) // 8 + 1) * 8
        self.tails: dict[int, np.ndarray] = {}

    def taken(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        """[box, word]: a byte for each candidate, 1 if the box covers more of it than the share (and in the last word's rest). As in Spark no number is the largest one."""
        side = lambda lo, hi, at, size: np.maximum(0.0, np.fmin(at + size, hi[:, None]) - np.maximum(at, lo[:, None]))
        out = np.ones((len(x1), self.columns), bool)
        for at in range(0, len(x1), BOXES):
            some = slice(at, at + BOXES)
            for w, h, xs, ys, own in self.grids:
                across, down = side(x1[some], x2[some], xs, w), side(y1[some], y2[some], ys, h)
                inside = across[:, :, None] * down[:, None, :] <= self.share * w * h
                np.logical_not(inside.reshape(len(inside), -1), out=out[some, own])
        return out.view(np.uint64)

    def _tail(self, start: int) -> np.ndarray:
        """[candidate, word] of a block: what follows a name of so many bytes, up to the block's end."""
        raw = np.zeros((len(self.texts), 64), np.uint8)
        for row, text in zip(raw, self.texts, strict=True):
            row[start : start + len(text)] = np.frombuffer(text, np.uint8)
            row[start + len(text)] = 0x80
            row[56:58] = divmod(8 * (start + len(text)), 256)[::-1]
        return raw.view("<u4")

    def _heads(self, names: list[bytes], image: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The hashes' first bytes of these candidates of these images, for names that leave room in a block."""
        size = np.array([len(n) for n in names])
        sizes, kind = np.unique(size, return_inverse=True)
        for n in sizes:
            if n not in self.tails:
                self.tails[n] = self._tail(n)
        heads = np.ascontiguousarray(np.array(names, "S64").view("<u4").reshape(len(names), 16).T)
        tails = np.concatenate([self.tails[n] for n in sizes]).T.copy()
        used = [*range((sizes[-1] + self.longest) // 4 + 1), 14]
        out = np.empty(len(image), np.uint32)
        for at in range(0, len(image), MESSAGES):
            i, c = image[at : at + MESSAGES], which[at : at + MESSAGES]
            k, words = c + kind[i] * len(self.texts), [None] * 16
            for j in used:
                words[j] = heads[j].take(i) if 4 * j + 4 <= sizes[0] else tails[j].take(k) if 4 * j >= sizes[-1] else heads[j].take(i) | tails[j].take(k)
            out[at : at + MESSAGES] = md5_heads(words)
        return out

    def first(self, ids: pa.Array, taken: np.ndarray) -> pa.ListArray:
        """For each image the first free candidate by the MD5 of id-number, then by the number; an empty list if none is free. Without an id the number alone counts."""
        names = [b"" if n is None else f"{n}-".encode() for n in pc.cast(ids, pa.string()).to_pylist()]
        whole = np.array([0 < len(n) <= BLOCK - self.longest for n in names])
        free = np.flatnonzero(~taken.view(bool))
        image = free // self.columns
        which = free - image * self.columns
        picked = np.full(len(names), -1)
        if len(image):
            heads = self._heads([n if ok else b"" for n, ok in zip(names, whole, strict=True)], image, which)
            starts = np.flatnonzero(np.r_[True, image[1:] != image[:-1]])
            ends = np.r_[starts[1:], len(image)]
            least = np.zeros(len(names), np.uint32)
            least[image[starts]] = np.minimum.reduceat(heads, starts)
            best = np.flatnonzero(heads == least.take(image))
            picked[image[best]] = which[best]
            alike = np.bincount(image[best], minlength=len(names)) > 1
            for g in np.flatnonzero((alike | ~whole)[image[starts]]):  # equal first bytes, no id, long ids
                name = names[image[starts[g]]]
                order = lambda c: (hashlib.md5(name + self.texts[c], usedforsecurity=False).hexdigest() if name else "", self.numbers[c])  # noqa: B023, E731
                picked[image[starts[g]]] = min(which[starts[g] : ends[g]], key=order)
        has = picked >= 0
        columns = [pa.array(c) for c in self.boxes[picked[has]].T]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has)].astype(np.int32)), pa.StructArray.from_arrays(columns, names=["w", "h", "x", "y"]))


def free_boxes(images: DataFrame, boxes: DataFrame, sizes: Sequence[tuple[int, int]], xs: Sequence[int], ys: Sequence[int], width: int, height: int, share: float, number: Callable[[int, int, int, int], int]) -> DataFrame:
    """image_id, w, h, x, y: of the candidates (each size at each x and y, within the image) that no box covers by more than a share of them, the first in the order of md5(image_id-number); an image without one gives no row.

    number: of w, h, x, y, another for each candidate. A corner of a box that is null leaves that side open. Boxes pass by
    the ids of images, are sorted, and what they take adds up in a byte for each candidate, however many they are: no
    candidate is a row, and an image's boxes are never held together. Little is shuffled for the work there is, so the
    number of tasks is fixed.
    """
    all_ = _Candidates(sizes, xs, ys, width, height, share, number)
    tasks = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    corner = lambda c, edge: F.coalesce(F.col(c).cast("double"), F.lit(edge)).alias(c)
    open_ = [corner(c, -math.inf if c in ("x1", "y1") else math.inf) for c in ("x1", "y1", "x2", "y2")]
    own = images.select("image_id").repartition(tasks, "image_id").distinct()
    theirs = boxes.select("image_id", *open_).repartition(tasks, "image_id")
    # an image without boxes gets one without extent, which takes nothing
    met = own.hint("shuffle_hash").join(theirs, "image_id", "left").select("image_id", *[corner(c, 0.0) for c in ("x1", "y1", "x2", "y2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda ids, taken: pa.RecordBatch.from_arrays([ids, all_.first(ids, taken)], names=["image_id", "free"])
        last, held = None, None  # the image that may go on
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                runs = pc.run_end_encode(some.column(0))
                ids, ends = runs.values, runs.run_ends.to_numpy()
                taken = np.bitwise_or.reduceat(all_.taken(*[c.to_numpy() for c in some.columns[1:]]), np.r_[0, ends[:-1]])
                if last is not None and last[0].as_py() == ids[0].as_py():
                    taken[0] |= held[0]
                elif last is not None:
                    ids, taken = pa.concat_arrays([last, ids]), np.concatenate([held, taken])
                if len(ids) > 1:
                    yield made(ids[:-1], taken[:-1])
                last, held = ids[-1:], taken[-1:]
        if last is not None:
            yield made(last, held)

    image = images.schema["image_id"].dataType.simpleString()
    return met.sortWithinPartitions("image_id").mapInArrow(run, f"image_id {image}, free array<struct<w: int, h: int, x: int, y: int>>").select("image_id", F.inline("free"))
