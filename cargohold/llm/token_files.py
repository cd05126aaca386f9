"""Token ids on disk as wavelet matrices.

Documents in ascending order of their ids are cut into shards. A shard is one
row, and so one compressed stretch, of a Parquet file: the sorted distinct ids
of the shard, one bit-plane per bit of an id's place among them, and a directory
of ranks. That is enough to read any token, count a token up to a place and find
its occurrences without unpacking the shard; reading all of it back undoes the
planes from the last to the first.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargohold.llm.bpe import SPACE, STRETCH_BYTES, Encoder, Vocabulary, file_digest, gathered, kept_encoder
from cargohold.llm.common import id_and_bytes, scratch_path, stretches

#: Tokens of a shard; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 21
#: Bits between two entries of the directory of ranks.
BLOCK = 4096
#: Bytes of text in a partition that is packed, on average.
PART_BYTES = 64 << 20


class WaveletMatrix:
    """A sequence of ids as bit-planes; all questions are answered from the planes."""

    def __init__(self, n: int, symbols: np.ndarray, planes: list[bytes], ranks: list[bytes]):
        self.n, self.symbols = n, symbols
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]  # ones before each block; the last: all
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @classmethod
    def built(cls, ids: np.ndarray) -> WaveletMatrix:
        """ids: non-negative integers."""
        present = np.bincount(ids) > 0
        symbols = np.flatnonzero(present)
        now = (np.cumsum(present, dtype=np.int32) - 1).astype(np.uint16 if len(symbols) <= 1 << 16 else np.uint32)[ids]
        planes, ranks = [], []
        for k in reversed(range(max(1, int(max(len(symbols) - 1, 0)).bit_length()))):
            bit = (now & now.dtype.type(1 << k)).astype(np.bool_)
            packed = np.packbits(bit)
            planes.append(packed.tobytes())
            padded = np.append(packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)).reshape(-1, BLOCK // 8)
            ranks.append(np.append(0, np.cumsum(np.bitwise_count(padded).sum(axis=1, dtype=np.uint32))).astype(np.uint32).tobytes())
            now = np.concatenate((np.compress(~bit, now), np.compress(bit, now)))
        return cls(len(ids), symbols.astype(np.uint32), planes, ranks)

    def _bit(self, k: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[k][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def _blocks(self, k: int, block: np.ndarray) -> np.ndarray:
        """(n, bytes) of these blocks of plane k; zeros follow the plane."""
        at = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
        return np.where(at < len(self.planes[k]), self.planes[k][np.minimum(at, len(self.planes[k]) - 1)], 0) if len(self.planes[k]) else np.zeros(at.shape, np.uint8)

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each place: by the directory, then within one block."""
        out = self.ranks[k][at // BLOCK].astype(np.int64)
        for i in range(0, len(at), 4096):
            own = at[i : i + 4096]
            bits = np.clip(own[:, None] % BLOCK - np.arange(0, BLOCK, 8), 0, 8)  # of each byte
            out[i : i + 4096] += np.bitwise_count(self._blocks(k, own // BLOCK) & (0xFF00 >> bits).astype(np.uint8)).sum(axis=1, dtype=np.int64)
        return out

    def _select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """The places of the nth (from 0) bits of this value in plane k: the block by the directory, then within it."""
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = np.searchsorted(before, nth, side="right") - 1
        out = np.zeros(len(nth), np.int64)
        for i in range(0, len(nth), 4096):
            own = slice(i, i + 4096)
            here, which = np.unique(block[own], return_inverse=True)
            bits = np.unpackbits(self._blocks(k, here), axis=1)
            seen = np.cumsum(bits == bit, axis=1, dtype=np.int32)
            # each block's running counts are ascending, and shifted so that blocks follow each other
            shifted = (seen + np.arange(len(here))[:, None] * (BLOCK + 1)).ravel()
            at = np.searchsorted(shifted, which * (BLOCK + 1) + (nth[own] - before[block[own]]) + 1)
            out[own] = block[own] * BLOCK + at - which * BLOCK
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        place, at = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, at), self._ones(k, at)
            place = 2 * place + bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return self.symbols[place]

    def _place_of(self, id_: int) -> int | None:
        place = int(np.searchsorted(self.symbols, id_))
        return place if place < len(self.symbols) and self.symbols[place] == id_ else None

    def rank(self, id_: int, at: int) -> int:
        """Occurrences of an id before a place."""
        place = self._place_of(id_)
        if place is None:
            return 0
        low, high = 0, min(at, self.n)
        for k in range(len(self.planes)):
            a, b = self._ones(k, np.array([low, high])).tolist()
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if place >> (len(self.planes) - 1 - k) & 1 else (low - a, high - b)
        return high - low

    def occurrences(self, id_: int) -> np.ndarray:
        """All places of an id, ascending: select, from the last plane up."""
        place = self._place_of(id_)
        if place is None:
            return np.zeros(0, np.int64)
        path = [place >> (len(self.planes) - 1 - k) & 1 for k in range(len(self.planes))]
        low, high = 0, self.n
        for k, bit in enumerate(path):
            a, b = self._ones(k, np.array([low, high])).tolist()
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if bit else (low - a, high - b)
        at = np.arange(low, high)
        for k in reversed(range(len(path))):
            at = self._select(k, path[k], at - self.zeros[k] * path[k])
        return at

    def ids(self) -> np.ndarray:
        """The whole sequence."""
        now = np.zeros(self.n, np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
        for k in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[k], count=self.n).view(np.bool_)
            before = np.empty_like(now)
            before[np.flatnonzero(~bit)] = now[: self.zeros[k]]
            before[np.flatnonzero(bit)] = now[self.zeros[k] :] | now.dtype.type(1 << (len(self.planes) - 1 - k))
            now = before
        return self.symbols[now]


def library_words(spec: str, vocabulary: Vocabulary, at_once: int = 64, joined: int = 256) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Encodes pre-tokens with the tokenizers library, as Vocabulary.encode_words does.

    A pre-token that is a space and a run can be encoded in one call with the
    next, as each space begins a new one; the ids of each follow from the number
    of bytes that ids stand for. Others are encoded by themselves.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encoded(texts: list[str]) -> Iterator[list[int]]:
        for k in range(0, len(texts), at_once):  # few results of the library at a time
            yield from (e.ids for e in tokenizer.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False))

    def encode(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.int32)
        start = np.cumsum(lengths) - lengths
        is_led = (raw[start] == 0x20) & (lengths > 1)
        second = (np.cumsum(raw & 0xC0 != 0x80) - 1)[np.minimum(start + 1, len(raw) - 1)]
        is_led &= vocabulary.classes[chars[second]] != SPACE
        order = np.concatenate((np.flatnonzero(is_led), np.flatnonzero(~is_led)))
        n_bytes = lengths[order]
        ordered = gathered(raw, start[order], n_bytes).tobytes()
        ends, n_led = np.append(0, np.cumsum(n_bytes)), int(is_led.sum())
        cuts = [*range(0, n_led, joined), *range(n_led, len(lengths))]  # where a call's words begin
        bounds = [*cuts, len(lengths)]
        length, parts = np.zeros(len(lengths), np.int64), []
        texts = [ordered[a:b].decode() for a, b in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), strict=True)]
        for a, b, found in zip(bounds[:-1], bounds[1:], encoded(texts), strict=True):
            if b - a == 1:
                length[a] = len(found)
                parts.append(found)
                continue
            ids = np.array(found, np.int32)
            length[a:b] = np.diff(np.searchsorted(np.cumsum(vocabulary.length[ids]), np.cumsum(n_bytes[a:b])) + 1, prepend=0)
            parts.append(found)
        flat = np.fromiter(chain.from_iterable(parts), np.int32)
        from_ = np.zeros(len(lengths), np.int64)
        from_[order] = np.cumsum(length) - length
        back = np.zeros(len(lengths), np.int64)
        back[order] = length
        return gathered(flat, from_, back), back

    return encode


Batches = Iterator[pa.RecordBatch]


def encoding(spark: SparkSession, tokenizer_path: str, end_id: int, kind: str) -> Callable[[Batches], Batches]:
    """From batches of (doc_id, text) to batches of (doc_id, ids): the ids of each whole text and end_id, as integers of `kind`.

    The tokenizers library encodes each distinct pre-token that a worker meets.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast((Vocabulary(tokenizer_path), f.read()))
    key = ("library", file_digest(tokenizer_path))

    def made() -> Encoder:
        v, spec = shared.value
        return Encoder(v, library_words(spec, v))

    def of(batches: Batches) -> Batches:
        encoder = kept_encoder(key, made)
        for b in batches:
            texts = b.column("text").to_pylist()
            for begin, end in stretches(texts, STRETCH_BYTES):
                for a, z, ids, n in encoder.encode(texts[begin:end]):
                    flat = np.insert(ids, np.cumsum(n), end_id).astype(kind)
                    ends = np.append(0, np.cumsum(n + 1) * flat.itemsize).astype(np.int32)
                    cells = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])
                    yield pa.record_batch([b.column("doc_id").slice(begin + a, z - a), cells], ["doc_id", "ids"])

    return of


def id_type(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


def in_order(docs: DataFrame, partitions: int) -> DataFrame:
    """docs in ascending ranges of doc_id, each sorted; null ids come first, and rows of one id lie by a hash of the text."""
    by = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    return docs.repartitionByRange(partitions, *by).sortWithinPartitions(*by)


def packing(kind: str, shard_tokens: int = SHARD_TOKENS) -> Callable[[Batches], Batches]:
    """From batches of (doc_id, ids) to rows of the files.

    A partition is cut into shards of at most shard_tokens tokens, or of one
    longer document, so a task holds one shard at a time.
    """

    def of(batches: Batches) -> Batches:
        part, shard, n = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            w = WaveletMatrix.built(np.concatenate(held))
            cells = [part, shard, docs, [len(x) for x in held], w.n, w.symbols.tobytes(), [p.tobytes() for p in w.planes], [r.tobytes() for r in w.ranks]]
            return pa.record_batch([pa.array([c], t.type) for c, t in zip(cells, _SCHEMA, strict=True)], _SCHEMA)

        for b in batches:
            for doc, cell in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(cell, kind)
                if held and n + len(ids) > shard_tokens:
                    yield row()
                    shard, n, docs, held = shard + 1, 0, [], []
                n += len(ids)
                docs.append(doc)
                held.append(ids)
        if held:
            yield row()

    return of


_FILE = "part long, shard long, docs array<long>, sizes array<long>, n long, symbols binary, planes array<binary>, ranks array<binary>"
_SCHEMA = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("symbols", pa.binary()), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def read_tokens(spark: SparkSession, path: str, only_digests: bool = False) -> DataFrame:
    """(doc_id, part, shard, at, n_tokens, crc32, ids) of each document, read back from the planes.

    at is its place in the shard; ids are little-endian integers of 32 bits, and
    crc32 is theirs. only_digests leaves ids out, and so in the tasks.
    """

    def of(batches: Batches) -> Batches:
        for b in batches:
            for k in range(b.num_rows):  # a shard at a time
                row = b.slice(k, 1).to_pylist()[0]
                w = WaveletMatrix(row["n"], np.frombuffer(row["symbols"], np.uint32), row["planes"], row["ranks"])
                raw, ends = w.ids().astype("<u4"), np.append(0, np.cumsum(row["sizes"]))
                crcs = [zlib.crc32(raw[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                where = [pa.array([row[c]] * len(crcs), pa.int64()) for c in ("part", "shard")]
                cells = [pa.array(row["docs"], pa.int64()), *where, pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())]
                if not only_digests:
                    cells.append(pa.Array.from_buffers(pa.binary(), len(crcs), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(raw.tobytes())]))
                yield pa.record_batch(cells, names)

    kind = "doc_id long, part long, shard long, at long, n_tokens long, crc32 long" + ", ids binary" * (not only_digests)
    names = [c.split(" ")[0] for c in kind.split(", ")]
    return spark.read.parquet(path).mapInArrow(of, kind)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, start): tokens before each shard. Sums of parts, which are as many as write partitions, then within each part."""
    shards = spark.read.parquet(path).select("part", "shard", "n")
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")
    return shards.withColumn("inside", inside).join(before, "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("start"))


def store_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> str:
    """Encodes docs, writes the token files under path (a scratch path if None) and returns it.

    A null text is the empty text, of which only end_id is written. Rows that
    repeat a doc_id lie next to each other, dealt over partitions by a hash of
    the text where they are many. A text longer than a shard is a shard of its
    own. An empty table gives files without rows. Other columns are not read.
    Partitions hold PART_BYTES of text on average, whatever the input's size.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    kind = id_type(max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id))
    encode, pack = encoding(spark, tokenizer_path, end_id, kind), packing(kind, shard_tokens)
    rows = id_and_bytes(docs, id_col, text_col)
    n_bytes = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ordered = in_order(rows, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / PART_BYTES)))
    # Spark's writer commits whole tasks: a lost executor leaves nothing half written
    ordered.mapInArrow(lambda batches: pack(encode(batches)), _FILE).write.parquet(path)
    return path


def stored_documents(spark: SparkSession, path: str, only_digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, crc32, ids) of each document in the files; start is the number of ids before its own."""
    rows = read_tokens(spark, path, only_digests)
    starts = shard_starts(spark, path).withColumnRenamed("start", "base")
    found = rows.join(starts, ["part", "shard"]).withColumn("start", F.col("base") + F.col("at"))
    return found.select("doc_id", "start", "n_tokens", "crc32", *([] if only_digests else ["ids"]))
