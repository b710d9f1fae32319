"""SentencePiece encoding and decoding as a weighted finite-state transducer.

compile_model() reads a model file and compiles N o P o M:

- N, the normaliser: the model's rewriting rules (longest match), the added first space, spaces as U+2581, and the removal
  of superfluous spaces if the model asks for it.
- P, the pieces: a trie of states over characters, with arcs in a hash table; a final state emits its piece's id. A character
  that is no piece has a fallback arc that emits the ids of its bytes (or the unknown id).
- M, the weights. In a unigram model an arc weighs its piece's negative score. In a byte-pair (BPE) model a state is the
  last piece, and an arc weighs zero if the two neighbours are what the model's merges make of their joined text, else
  infinity. Which merges could join two neighbours is known from the spines of their merge trees: a merge across the
  border takes place if its score beats those of the merges that would use up its two ends. So one path is finite.

Inputs are cut where no piece can lead across, and many cuts are composed at once: arcs are arrays (place, length, piece),
found by moving all places through the trie together; the tropical shortest path is relaxed in order of place, for all
cuts of a batch at each step. A task remembers the ids of cuts that it has met (REMEMBER, twice) and forgets them at its
end: its worker goes on to other stages.

Decoding joins the pieces, reads fallback bytes as UTF-8 and takes the first space off.

A null or empty text has no ids. Very long texts are encoded whole. Repeated rows are encoded alike; an empty table gives
no rows; null ids are passed through. Where normalising loses something (a U+2581 in the text decodes as a space), the text
does not come back byte for byte (column round_trip). Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import give_back, map_batches, sliced, table, utf8

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Cuts whose ids a task remembers (twice), and characters that are composed at a time (or one longer cut).
REMEMBER, AT_ONCE = 120_000, 1 << 16
#: Texts that are encoded at a time.
AT_A_TIME = 256
#: Pairs of pieces whose weight a task remembers.
REMEMBER_PAIRS = 500_000
#: What an unknown character weighs more than the least likely piece.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialised message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        elif tag & 7 == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Table:
    """A hash table from 64-bit keys (not negative) to 32-bit values, looked up and filled many at a time; absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.n = 0
        self._room(max(8, len(keys)))
        self.add(keys, values)

    def _room(self, n: int) -> None:
        size = 1 << (2 * n).bit_length()
        self.shift, self.mask = np.uint64(64 - (size.bit_length() - 1)), size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            there = self.keys >= 0
            keys, values = np.concatenate([self.keys[there], keys]), np.concatenate([self.values[there], values])
            self._room(2 * len(keys))
            self.n = 0
        self.n += len(keys)
        at = self._home(keys)
        left = np.arange(len(keys))
        while len(left):  # each free place takes one of those that ask for it
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            met = there == keys[left]
            out[left[met]] = self.values[at[left[met]]]
            left = left[~met & (there >= 0)]
        return out


class Normaliser:
    """N. rules: a model's compiled map (a double-array trie of UTF-8 sources, then their replacements)."""

    def __init__(self, rules: bytes, dummy_prefix: bool, squeeze: bool, escape: bool = True):
        self.dummy_prefix, self.squeeze, self.space = dummy_prefix, squeeze, SPACE if escape else " "
        size = struct.unpack_from("<I", rules)[0] if rules else 0
        self.units = np.frombuffer(rules, "<u4", size // 4, 4).tolist() if rules else []
        self.texts = rules[4 + size :] if rules else b""
        self.identity = not rules and not squeeze

    def _longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest source that starts at a place."""
        units, node, found = self.units, 0, None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node ^= offset(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    def _rewritten(self, text: str) -> str:
        if not self.units:
            return text
        data, out, at = text.encode(), [], 0
        while at < len(data):
            size, new = self._longest(data, at) or (1, data[at : at + 1])
            out.append(new)
            at += size
        return b"".join(out).decode("utf-8", "replace")

    def apply(self, text: str) -> str:
        out = self._rewritten(text)
        if self.squeeze:
            out = re.sub(" +", " ", out.strip(" "))
        if not out:
            return ""
        return (self.space if self.dummy_prefix else "") + out.replace(" ", self.space)


class Pieces:
    """P: states of the trie and their arcs (state << 21 | character), the piece of final states, and fallback ids."""

    def __init__(self, pieces: list[tuple[str, float, int]], fallback: bool):
        usable = [(p, i) for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER) and p]
        arcs: dict[tuple[int, int], int] = {}
        final = [-1]
        self.longest = max((len(p) for p, _ in usable), default=1)
        for p, i in usable:
            state = 0
            for c in p:
                state_next = arcs.setdefault((state, ord(c)), len(final))
                if state_next == len(final):
                    final.append(-1)
                state = state_next
            final[state] = i
        self.final = np.array(final, np.int32)
        self.arcs = Table(np.array([s << 21 | c for s, c in arcs], np.int64), np.array(list(arcs.values()), np.int32))
        joined = {(ord(p[k]) << 21) | ord(p[k + 1]) for p, _ in usable for k in range(len(p) - 1)}
        self.joined = Table(np.array(sorted(joined), np.int64), np.zeros(len(joined), np.int32))
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE} if fallback else {}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.fallbacks: dict[int, list[int]] = {}

    def compose(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs (place, length, piece; -1: fallback) over characters, sorted by place and length; none leads beyond the end of its cut (ends: of each place's cut)."""
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = []
        for length in range(1, self.longest + 1):
            inside = at + length <= ends[at]
            at, state = at[inside], state[inside]
            state = self.arcs.get(state << 21 | codes[at + length - 1]).astype(np.int64)
            keep = state >= 0
            at, state = at[keep], state[keep]
            if not len(at):
                break
            piece = self.final[state]
            full = piece >= 0
            found.append((at[full], np.full(int(full.sum()), length), piece[full]))
            if length == 1:
                single = np.zeros(len(codes), bool)
                single[at[full]] = True
        if not found:
            single = np.zeros(len(codes), bool)
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1, np.int32)))
        place, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place, kind="stable")  # runs of ascending places, one for each length
        return place[order], length[order], piece[order].astype(np.int64)

    def fallback(self, code: int) -> list[int]:
        found = self.fallbacks.get(code)
        if found is None:
            found = [self.byte[b] for b in chr(code).encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]
            self.fallbacks[code] = found
        return found


class MergeWeights:
    """M of a BPE model: whether a piece may follow another. A piece's spines are the parts of its merge tree at its ends, each with the score of the merge that uses it up."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.text = [p for p, _, _ in pieces]
        self.score = {p: s for p, s, t in pieces if t in (NORMAL, USER)}
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.n = len(pieces)
        self.forget()
        self.alone = np.full(self.n, -1, np.int8)  # whether merges make a piece of its own text; -1: not asked yet
        self.left: dict[int, list[tuple[str, float]]] = {}
        self.right: dict[int, list[tuple[str, float]]] = {}
        self.ordered = True  # no merge is made possible by a worse one

    def forget(self) -> None:
        self.known = Table(np.zeros(0, np.int64), np.zeros(0, np.int32))  # pairs of pieces: 1 if finite, else 0

    def merged(self, text: str) -> list[tuple[str, list[tuple[str, float]], list[tuple[str, float]]]]:
        """What merges make of a text, best score first, the left one of equals: parts with their left and right spines."""
        none = -float("inf")
        parts = [(c, [(c, none)], [(c, none)]) for c in text]
        last = float("inf")
        while len(parts) > 1:
            best, at = none, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k][0] + parts[k + 1][0])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                break
            if best > last:
                self.ordered = False
            last = best
            (a, left, _), (b, _, right) = parts[at], parts[at + 1]
            used = lambda spine: [*spine[:-1], (spine[-1][0], best)]  # noqa: B023, E731
            parts[at : at + 2] = [(a + b, [*used(left), (a + b, none)], [*used(right), (a + b, none)])]
        return parts

    def _spines(self, piece: int) -> None:
        parts = self.merged(self.text[piece])
        self.alone[piece] = len(parts) == 1
        self.left[piece], self.right[piece] = parts[0][1], parts[-1][2]

    def stands(self, pieces: np.ndarray) -> np.ndarray:
        for i in np.unique(pieces[(self.alone[pieces] < 0) & (pieces >= 0)]).tolist():
            self._spines(i)
        return (pieces < 0) | (self.alone[pieces] == 1)

    def _follows(self, a: int, b: int) -> bool:
        if not self.ordered:
            return [p[0] for p in self.merged(self.text[a] + self.text[b])] == [self.text[a], self.text[b]]
        score = self.score
        for u, u_used in self.right[a]:
            for v, v_used in self.left[b]:
                s = score.get(u + v)
                if s is not None and s > u_used and s >= v_used:
                    return False
        return True

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of standing pieces (-1: a fallback character, which never merges)."""
        out = (a < 0) | (b < 0)
        left = np.flatnonzero(~out)
        keys = a[left] * self.n + b[left]
        found = self.known.get(keys)
        if (new := found < 0).any():
            fresh = np.unique(keys[new])
            asked = np.fromiter((self._follows(*divmod(k, self.n)) for k in fresh.tolist()), np.int32, len(fresh))
            if self.known.n > REMEMBER_PAIRS:
                self.known = Table(fresh, asked)
            else:
                self.known.add(fresh, asked)
            found[new] = asked[np.searchsorted(fresh, keys[new])]
        out[left] = found == 1
        return out


class Transducer:
    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, normaliser: Normaliser, fallback: bool):
        self.pieces, self.kind, self.normaliser = pieces, kind, normaliser
        self.trie = Pieces(pieces, fallback)
        self.merges = MergeWeights(pieces) if kind == BPE else None
        scores = [s for _, s, t in pieces if t == NORMAL]
        least, most = min(scores, default=0.0), max(scores, default=0.0)
        weight = [-(len(p.encode()) * most - 0.1) if t == USER else -s for p, s, t in pieces]
        self.weight = np.array([*weight, UNKNOWN_PENALTY - least], np.float32)  # the last one is a fallback's; single precision, as models have it
        space = ord(SPACE)
        inner = (self.trie.joined.keys >= 0) & ((self.trie.joined.keys & 0x1FFFFF) == space) & ((self.trie.joined.keys >> 21) != space)
        # texts are cut before spaces if no piece, and no run of unknown characters, goes across
        self.spaces_split = not inner.any() and (bool(self.trie.byte) or any(p == SPACE for p, _, t in pieces if t in (NORMAL, USER)))
        self.plain = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.forget()

    def forget(self) -> None:
        """Drops what was remembered of texts; what is compiled stays."""
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.merges:
            self.merges.forget()

    def _bpe_paths(self, place: np.ndarray, length: np.ndarray, piece: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and piece of the arcs on the finite path of each cut (first, last: its bounds). A state is an arc just taken."""
        stands = self.merges.stands(piece)
        place, length, piece = place[stands], length[stands], piece[stands]
        n = int(last[-1]) if len(last) else 0
        begin = np.searchsorted(place, np.arange(n + 1))  # arcs by place
        cut = np.repeat(np.arange(len(first)), last - first)[place]
        end = place + length
        goes_on = np.flatnonzero(end < last[cut])
        count = begin[end[goes_on] + 1] - begin[end[goes_on]]
        source = np.repeat(goes_on, count)
        target = np.repeat(begin[end[goes_on]] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(source))
        fits = self.merges.follows(piece[source], piece[target])
        source, target = source[fits], target[fits]
        offset = (place[target] - first[cut[target]]).astype(np.int32)
        order = np.argsort(offset.astype(np.uint16) if len(offset) and offset.max() < 1 << 16 else offset, kind="stable")  # by radix, if short
        source, target, offset = source[order], target[order], offset[order]
        reached, back = place == first[cut], np.full(len(place), -1)
        bounds = np.searchsorted(offset, np.arange(1, int(offset[-1]) + 2)) if len(offset) else np.zeros(1, int)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, t = source[lo:hi], target[lo:hi]
            live = reached[s]
            reached[t[live]] = True
            back[t[live]] = s[live]
        done = np.flatnonzero(reached & (end == last[cut]))
        return self._walk(done, back, place, piece)

    def _unigram_paths(self, place: np.ndarray, length: np.ndarray, piece: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lightest path of each cut; of equal ones (in single precision) that which comes from further left."""
        cut = np.repeat(np.arange(len(first)), last - first)[place]
        end = place + length
        weight = self.weight[piece]
        # the end of a cut and the start of the next one are different states
        best = np.full((int(last[-1]) if len(last) else 0) + len(first) + 1, np.inf, np.float32)
        best[first + np.arange(len(first))] = 0.0
        through = np.full(len(best), -1)
        offset = end - first[cut]
        order = np.lexsort((place, offset))
        bounds = np.searchsorted(offset[order], np.arange(1, int(offset.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            arcs = order[lo:hi]
            total = best[place[arcs] + cut[arcs]] + weight[arcs]
            rank = np.lexsort((place[arcs], total, end[arcs] + cut[arcs]))
            states = (end[arcs] + cut[arcs])[rank]
            lead = np.r_[True, states[1:] != states[:-1]] if len(states) else np.zeros(0, bool)
            best[states[lead]], through[states[lead]] = total[rank[lead]], arcs[rank[lead]]
        back = through[place + cut]  # the arc taken before this one
        done = through[last + np.arange(len(first))]
        return self._walk(done[done >= 0], back, place, piece)

    @staticmethod
    def _walk(done: np.ndarray, back: np.ndarray, place: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and piece of the arcs on the paths that end in done, in order of place."""
        steps = []
        while len(done):
            steps.append(done)
            done = back[done]
            done = done[done >= 0]
        arcs = np.concatenate(steps) if steps else np.zeros(0, np.int64)
        arcs = arcs[np.argsort(place[arcs], kind="stable")]
        return place[arcs], piece[arcs]

    def _solve(self, words: list[str]) -> list[bytes]:
        """Ids of normalised words, packed; each word is composed by itself."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words])
        last = np.cumsum(sizes)
        # cut on where no piece leads across
        if len(codes) > 1:
            inner = self.trie.joined.get(codes[:-1] << 21 | codes[1:]) < 0
            cuts = np.union1d(np.flatnonzero(inner) + 1, last)
        else:
            cuts = last
        cuts = cuts[cuts > 0].astype(np.int64)
        first = np.r_[0, cuts[:-1]].astype(np.int64)
        place, length, piece = self.trie.compose(codes, np.repeat(cuts, cuts - first))
        paths = self._bpe_paths if self.kind == BPE else self._unigram_paths
        at, piece = paths(place, length, piece, first, cuts)
        lone = np.flatnonzero(piece < 0)
        if len(lone):
            if not self.trie.byte:  # neighbouring unknown characters are one unknown piece
                word = np.searchsorted(last, at, side="right")
                again = lone[1:][(piece[lone[1:] - 1] < 0) & (word[lone[1:] - 1] == word[lone[1:]])]
                keep = np.ones(len(piece), bool)
                keep[again] = False
                at, piece = at[keep], piece[keep]
                lone = np.flatnonzero(piece < 0)
            bytes_of = [self.trie.fallback(c) for c in codes[at[lone]].tolist()]
            count = np.ones(len(piece), np.int64)
            count[lone] = [len(x) for x in bytes_of]
            at = np.repeat(at, count)
            ids = np.repeat(piece, count)
            ids[np.repeat(piece < 0, count)] = [i for x in bytes_of for i in x]
        else:
            ids = piece
        packed = ids.astype("<u4").tobytes()
        bounds = (np.searchsorted(at, np.r_[0, last]) * 4).tolist()
        return [packed[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _words(self, text: str) -> list[str]:
        """A text in cuts; those that are one space and what follows are given without the space."""
        normal, dummy = self.normaliser, self.normaliser.dummy_prefix
        if normal.identity and dummy and self.spaces_split and SPACE not in text:
            parts = text.split(" ")
            if "" not in parts:
                return parts
        text = normal.apply(text)
        if not self.spaces_split:
            return [text] if text else []
        parts = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)
        return [p[1:] if p[0] == SPACE and len(p) > 1 and p[1] != SPACE else SPACE + p for p in parts]

    def _normal(self, word: str) -> str:
        return SPACE + word if self.spaces_split and not word.startswith(SPACE) else word[1:] if self.spaces_split else word

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self._words(t) if t else [] for t in texts]
        known = self.known
        new: list[str] = []
        for w in {w for p in parts for w in p}.difference(known):
            if (found := self.older.get(w)) is not None:
                known[w] = found
            else:
                new.append(w)
        at = 0
        while at < len(new):
            some, size = [], 0
            while at < len(new) and (not some or size < AT_ONCE):
                some.append(new[at])
                size += len(new[at]) + 1
                at += 1
            known.update(zip(some, self._solve([self._normal(w) for w in some]), strict=True))
        out = [b"".join([known[w] for w in p]) for p in parts]
        if len(known) > REMEMBER:  # what is in use comes back from the older half
            self.known, self.older = {}, known
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        plain = b"".join(map(self.plain.__getitem__, ids))
        return plain[1:] if self.normaliser.dummy_prefix and plain[:1] == b" " else plain


@lru_cache(maxsize=2)
def compile_model(path: str) -> Transducer:
    with open(path, "rb") as f:
        return compile_bytes(f.read())


def compile_bytes(data: bytes) -> Transducer:
    pieces, kind, fallback, rules, dummy, squeeze, escape = [], UNIGRAM, False, b"", True, True, True
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
        elif field == 2:
            own = dict(_fields(value))
            kind, fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif field == 3:
            own = dict(_fields(value))
            rules, dummy, squeeze, escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and byte-pair models are compiled")
    return Transducer(pieces, kind, Normaliser(rules, dummy, squeeze, escape), fallback)


def encode_documents(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_fallback (bytes written as fallback), ids_crc32 (of the ids as little-endian 32-bit integers), round_trip; with_ids: ids too."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, n_fallback long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compile_model(model)
        is_byte = np.zeros(len(machine.pieces), np.int64)
        is_byte[list(machine.trie.byte.values())] = 1
        for batch in sliced(batches, AT_A_TIME):
            texts = batch.column(1).to_pylist()
            packed = machine.encode_all([t.decode("utf-8", "surrogatepass") for t in texts])
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            bounds = np.r_[0, np.cumsum([len(p) // 4 for p in packed])]
            fallbacks = np.r_[0, np.cumsum(is_byte[ids])]
            numbers, cuts = ids.tolist(), bounds.tolist()
            same = [machine.decode(numbers[a:b]) == t for a, b, t in zip(cuts[:-1], cuts[1:], texts, strict=True)]
            columns = [batch.column(0), pa.array(np.diff(bounds)), pa.array(fallbacks[bounds[1:]] - fallbacks[bounds[:-1]]), pa.array([zlib.crc32(p) for p in packed], pa.int64()), pa.array(same, pa.bool_())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])
        machine.forget()
        give_back()

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids; null ids give a null text. Bytes that are no UTF-8 become replacement characters."""
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(doc_ids: list, lists: list) -> dict[str, list]:
        machine = compile_model(model)
        return {"doc_id": doc_ids, "text": [None if ids is None else machine.decode(ids).decode("utf-8", "replace") for ids in lists]}

    return map_batches(rows, run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_path(), with_ids=True)
