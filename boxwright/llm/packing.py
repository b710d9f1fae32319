"""Token ids as fixed-width bit packing.

Ids are stored in the fewest bits that hold the vocabulary. A shard is one file image:

    magic "BWP1", uint8 bits, uint64 documents, uint64 ids, uint32 ids a block, uint64 blocks   (little-endian)
    uint64 offset of each block's first byte, then of the end
    int64 doc_id of each document (with a bitmap of nulls before them), uint64 index of its first id, then of the end
    blocks: ids packed in big-endian bit order, each block padded to a whole byte

Block offsets allow random access: a range of ids needs the blocks that hold it alone. Documents lie in ascending order
of id over all shards (null ids first, equal ids by the text's hash), so a shard's place is its number. Shards are rows
(shard, n_ids, content) of a table in the shared folder, committed by Spark.

A null text is empty; every document has at least the end id. Very long texts are encoded whole. An empty table gives
no shards. Repeated rows are documents of their own. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import sliced, stored, table

HEAD = struct.Struct("<4sBQQIQ")
MAGIC = b"BWP1"
#: Ids of a block.
BLOCK = 4096
#: Ids after which a shard is closed (a shard is held in memory while it is written).
SHARD_IDS = 2 << 20
#: Pieces, and pre-tokens, whose ids a worker remembers, twice.
REMEMBER = 300_000
#: Marks that are a pre-token of their own after a word (an apostrophe is not).
MARKS = tuple(".,;:!?|")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel()).tobytes()


def unpack(data, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    return planes.astype(np.uint64) @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs over {bits} bits")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    nulls = np.packbits([x is None for x in doc_ids]).tobytes()
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    starts = np.cumsum([0, *lengths]).astype("<u8").tobytes()
    return b"".join([HEAD.pack(MAGIC, bits, len(doc_ids), len(ids), block, len(blocks)), offsets.tobytes(), nulls, docs, starts, *blocks])


class Shard:
    """Reads a shard's image; ids(a, b) touches the blocks that hold them alone."""

    def __init__(self, content):
        self.data = memoryview(content)
        magic, self.bits, n_docs, self.n_ids, self.block, n_blocks = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        at = HEAD.size
        self.offsets = np.frombuffer(self.data, "<u8", n_blocks + 1, at)
        at += 8 * (n_blocks + 1)
        nulls = np.unpackbits(np.frombuffer(self.data, np.uint8, -(-n_docs // 8), at), count=n_docs)
        at += -(-n_docs // 8)
        docs = np.frombuffer(self.data, "<i8", n_docs, at)
        self.doc_ids = [None if null else i for i, null in zip(docs.tolist(), nulls, strict=True)]
        at += 8 * n_docs
        self.starts = np.frombuffer(self.data, "<u8", n_docs + 1, at)
        self.base = at + 8 * (n_docs + 1)

    def ids(self, first: int, end: int) -> np.ndarray:
        if first >= end:
            return np.zeros(0, np.uint32)
        out = []
        for b in range(first // self.block, (end - 1) // self.block + 1):
            count = min(self.block, self.n_ids - b * self.block)
            out.append(unpack(self.data[self.base + int(self.offsets[b]) : self.base + int(self.offsets[b + 1])], count, self.bits))
        start = first // self.block * self.block
        return np.concatenate(out)[first - start : end - start]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of all documents in order; every block is unpacked once."""
        held, base = np.zeros(0, np.uint32), 0  # ids from base on
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if b > base + len(held):
                end = min(-(-b // self.block) * self.block, self.n_ids)
                held, base = np.concatenate([held[a - base :], self.ids(base + len(held), end)]), a
            yield held[a - base : b - base]


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Whole texts to ids by the tokenizers library.

    The pre-tokenizer never joins what stands before a space between two non-white characters with what follows, so a
    text may be cut there; the pieces' ids are remembered. Pieces of letters, each with at most one mark after it, over
    lines of one break each, are pre-tokens known beforehand, and the model takes them directly; other pieces, and
    texts with other white space at a cut, go through the library's whole chain. A batch's distinct pieces are found, and
    their ids put together, as arrays.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.chain = Tokenizer.from_file(path)
        self.model, self.letters = self.chain.model, _byte_letters()
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.marks = {m: array("I", [t.id for t in self.model.tokenize(m)]).tobytes() for m in MARKS}
        self.tokens: dict[str, bytes] = {}
        self.older_tokens: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.chain.encode(text, add_special_tokens=False).ids).tobytes()

    def _token(self, text: str) -> bytes:
        """Ids of one pre-token; those with another mark behind them, or at another place, are met again."""
        found = self.tokens.get(text)
        if found is None:
            found = self.older_tokens.get(text)
            if found is None:
                letters = f"Ġ{text[1:]}" if text[0] == " " and text.isascii() else text.encode().decode("latin-1").translate(self.letters)
                found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(self.tokens) >= REMEMBER:
                self.tokens, self.older_tokens = {}, self.tokens
            self.tokens[text] = found
        return found

    def _piece(self, piece: str) -> bytes | None:
        if piece.isalpha():
            return self._token(f" {piece}")
        if piece[-1:] in self.marks and piece[:-1].isalpha():
            return self._token(f" {piece[:-1]}") + self.marks[piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        ids: list[bytes] = []
        for n, line in enumerate(piece.split("\n")):
            word, mark = (line[:-1], line[-1]) if line[-1:] in self.marks else (line, "")
            if not word.isalpha():
                return self.whole(f" {piece}")
            if n:
                ids.append(self._token("\n"))
            ids.append(self._token(word if n else f" {word}"))
            if mark:
                ids.append(self.marks[mark])
        return b"".join(ids)

    def encode_all(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        begin, pieces = split.offsets.to_numpy(), split.values
        # the first piece has no space before it
        first = pieces.take(pa.array(begin[:-1])).to_pylist()
        cut = np.array([n > 1 and p != "" and not p[-1].isspace() for n, p in zip(np.diff(begin).tolist(), first, strict=True)], bool)
        after = np.repeat(cut, np.diff(begin))
        after[begin[:-1][cut]] = False
        found = pieces.filter(pa.array(after)).dictionary_encode()
        ids = self._known(found.dictionary.to_pylist())
        count = np.array([-1 if x is None else len(x) // 4 for x in ids], np.int64)
        place = np.cumsum(np.maximum(count, 0)) - count  # of each distinct piece's ids
        table = np.frombuffer(b"".join(x for x in ids if x), "<u4")
        code = found.indices.to_numpy()
        own, ends = count[code], np.cumsum(np.where(cut, np.diff(begin) - 1, 0))
        unknown, many = np.r_[0, np.cumsum(own < 0)], np.maximum(own, 0)
        upto = np.r_[0, np.cumsum(many)]
        packed = memoryview(table[np.arange(upto[-1]) + np.repeat(place[code] - upto[:-1], many)].tobytes())
        starts = np.r_[0, ends[:-1]]
        known = cut & (unknown[starts] == unknown[ends])  # else a piece is not known beforehand
        spans = zip(known.tolist(), first, (4 * upto[starts]).tolist(), (4 * upto[ends]).tolist(), strict=True)
        return [self.whole(p) + packed[a:b] if k else self.whole(texts[i].as_py()) for i, (k, p, a, b) in enumerate(spans)]

    def _known(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of each piece; None if it is not known beforehand."""
        known, older, piece = self.known, self.older, self._piece
        for p in pieces:
            if p not in known:
                known[p] = older[p] if p in older else piece(p)
        out = list(map(known.__getitem__, pieces))
        if len(known) > REMEMBER:  # what is in use comes back from the older half
            self.known, self.older = {}, known
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for a Python worker, whatever the tasks it runs."""
    return Encoder(path)


def write_shards(documents: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """shard, part, n_ids, content; part and shard are in ascending order of id."""
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # ranges of (id, text's hash, row's number), so that rows of one id, or equal rows, are dealt over many tasks
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    keys = [F.asc_nulls_first("id"), F.asc("hash"), F.asc("row")]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        bits = bits_for(max(encoder.chain.get_vocab_size(), end_id + 1))
        end, part, shard, held = struct.pack("<I", end_id), TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            content = write_shard(docs, [len(p) // 4 for p in parts], ids, bits, block)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([content], pa.binary())], names=["part", "shard", "n_ids", "content"])

        for batch in sliced(batches):
            for i, packed in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                docs.append(i)
                parts.append(packed + end)
                held += len(parts[-1]) // 4
                if held >= SHARD_IDS:
                    yield close()
                    docs, parts, held, shard = [], [], 0, shard + 1
        if docs:
            yield close()

    return stored(ordered.mapInArrow(run, "part int, shard int, n_ids long, content binary"), "packed")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, bits: each document's ids, unpacked from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, content in zip(*(batch.column(k).to_pylist() for k in ("part", "shard")), batch.column("content"), strict=True):
                shard = Shard(content.as_buffer())
                crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in shard.documents()]
                n = np.diff(shard.starts.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1].astype(np.int64)), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), shard.bits, np.int32)), pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), number, np.int32))], names=["doc_id", "own", "n_tokens", "ids_crc32", "bits", "part", "shard"])

    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))  # a row for each task that wrote
    starts = sizes.withColumn("in_part", before(Window.partitionBy("part").orderBy("shard"))).join(parts, "part").select("part", "shard", (F.col("base") + F.col("in_part")).alias("start"))
    rows = shards.select("part", "shard", "content").mapInArrow(run, "doc_id long, own long, n_tokens long, ids_crc32 long, bits int, part int, shard int")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", "bits")


#: The end id fixed by the query's contract.
END_ID = 2


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_documents(write_shards(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), END_ID))
