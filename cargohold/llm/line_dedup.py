"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line with ASCII white space stripped at both ends and A-Z
lower-cased, known by its SHA-256. The exact table counts, for each key, the
documents that have it; each shard's cuckoo filter has the keys found in
`min_docs` documents or more, whose lines go. Inserting and deleting documents
changes the counts, and keys that cross the limit enter or leave their filter,
so any insertion can be taken back. The filter keeps almost all keys away from
the exact table; those it lets through are compared with it.

Lines are looked up once per key and chunk of documents, with the chunk's
documents in a list, so a line that every document has makes a row per chunk and
not per document. Whether a key's lines go is decided once per key, and joined
back to the chunks' rows with the key salted, so a hot line's rows lie in many
tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import id_and_bytes, mixed, row_key, stretches, written

MIN_DOCS = 10
CHUNK_BYTES = 4 << 20
#: Keys of the exact table in a shard, on average, and shards at least.
SHARD_KEYS, LEAST_SHARDS = 2_000_000, 128
#: Tasks that the rows of one key are dealt over.
SALTS = 64
_FILTER = "shard long, slots binary, full boolean"


def key_of(line: bytes) -> bytes:
    return line.strip().lower()


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; whole arrays of keys are inserted, deleted and asked for at once."""

    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, 4), buckets a power of two; 0 is empty
        self.mask = len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(2, math.ceil(math.log2(max(keys, 1) / 4 / 0.6))), 4), np.uint16))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, fingerprint) of keys as (n, 2) 64-bit words."""
        f = (keys[:, 0] >> np.uint64(48)).astype(np.uint16)
        f[f == 0] = 1
        return (keys[:, 1] & np.uint64(self.mask)).astype(np.int64), f

    def _other(self, bucket: np.ndarray, f: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(f) & np.uint64(self.mask)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """False if there was no room; the filter is then of no use."""
        bucket, f = self._places(keys)
        for turn in range(500):
            for _ in range(2):  # both buckets of each
                for slot in range(4):
                    free = np.flatnonzero(self.table[bucket, slot] == 0)
                    first = free[np.unique(bucket[free], return_index=True)[1]]
                    self.table[bucket[first], slot] = f[first]
                    stay = np.ones(len(f), np.bool_)
                    stay[first] = False
                    bucket, f = bucket[stay], f[stay]
                if not len(f):
                    return True
                bucket = self._other(bucket, f)
            first = np.unique(bucket, return_index=True)[1]  # each puts out an old one
            out = self.table[bucket[first], turn % 4].copy()
            self.table[bucket[first], turn % 4] = f[first]
            f[first] = out
            bucket[first] = self._other(bucket[first], out)
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        bucket, f = self._places(keys)
        return (self.table[bucket] == f[:, None]).any(axis=1) | (self.table[self._other(bucket, f)] == f[:, None]).any(axis=1)

    def delete(self, keys: np.ndarray) -> None:
        """Of keys that were inserted."""
        bucket, f = self._places(keys)
        for at in (bucket, self._other(bucket, f)):
            for slot in range(4):
                hit = np.flatnonzero((f != 0) & (self.table[at, slot] == f))
                first = hit[np.unique(at[hit], return_index=True)[1]]
                self.table[at[first], slot] = 0
                f[first] = 0


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    """What the filters use of digests: their first 16 bytes as two words."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)[:, :2]


@dataclass(frozen=True)
class LineIndex:
    """refs: (shard, key, n), the exact counts, n > 0. filters: (shard, slots)."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, row): row stands for the document in joins, whatever its doc_id; rows that share one are looked up together."""
    return id_and_bytes(docs, id_col, text_col).withColumn("row", row_key())


def chunked_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, docs): for each chunk of documents and each non-empty key in it, the documents (by `row`) that have it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = b.column("text").to_pylist(), b.column("row").to_pylist()
            for a, z in stretches(texts, chunk_bytes):
                found = defaultdict(list)
                for text, i in zip(texts[a:z], rows[a:z], strict=True):
                    for key in set(map(key_of, text.split(b"\n"))):
                        if key:
                            found[key].append(i)
                yield pa.record_batch([pa.array(list(map(_digest, found)), pa.binary()), pa.array(found.values(), pa.list_(pa.int64()))], ["key", "docs"])

    return _rows(docs, id_col, text_col).select("text", "row").mapInArrow(of, "key binary, docs array<long>")


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))


def _built(hot: DataFrame) -> DataFrame:
    """New filters of (shard, key) rows."""

    def build(key: tuple, t: pa.Table) -> pa.Table:
        keys, room = _words(t["key"]), t.num_rows
        while not (new := CuckooFilter.sized(room)).insert(keys):
            room *= 2
        return pa.table({"shard": [key[0].as_py()], "slots": [new.table.tobytes()], "full": [False]})

    return hot.select("shard", "key").groupBy("shard").applyInArrow(build, _FILTER)


def empty_index(like: DataFrame, keys: int, min_docs: int = MIN_DOCS) -> LineIndex:
    """An index without documents, for about so many distinct keys; `like` names the session."""
    spark = like.sparkSession
    refs, filters = spark.createDataFrame([], "shard long, key binary, n long"), spark.createDataFrame([], "shard long, slots binary")
    return LineIndex(refs, filters, max(LEAST_SHARDS, math.ceil(keys / SHARD_KEYS)), min_docs)


def changed(index: LineIndex, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> LineIndex:
    """The index after inserting and deleting documents, given as chunked_lines.

    Deleting documents that were never inserted isn't noticed; counts don't fall
    below zero.
    """
    parts = [x.select("key", (F.size("docs") * sign).cast("long").alias("n")) for x, sign in ((inserted, 1), (deleted, -1)) if x is not None]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    delta = _sharded(rows.groupBy("key").agg(F.sum("n").alias("d")), index.shards)
    n, d, k = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0)), F.lit(index.min_docs)
    merged = index.refs.join(delta, ["shard", "key"], "full").select("shard", "key", (n + d).alias("n"), ((n + d >= k).cast("int") - (n >= k).cast("int")).alias("cross"))
    merged = written(merged, "line_refs")

    def update(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            empty = right.num_rows > 0
            return pa.table({"shard": right["shard"][:1], "slots": pa.nulls(int(empty), pa.binary()), "full": pa.array([True] * empty, pa.bool_())})
        table = CuckooFilter(np.frombuffer(left["slots"][0].as_py(), np.uint16).reshape(-1, 4).copy())
        keys, cross = _words(right["key"]), right["cross"].to_numpy()
        table.delete(keys[cross < 0])
        fits = table.insert(keys[cross > 0])
        return pa.table({"shard": left["shard"][:1], "slots": pa.array([table.table.tobytes() if fits else None], pa.binary()), "full": [not fits]})

    crossed = merged.filter("cross != 0").select("shard", "key", "cross")
    new = written(index.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(update, _FILTER), "line_filters")
    refs = merged.filter("n > 0").select("shard", "key", "n")
    again = refs.filter(F.col("n") >= k).join(new.filter("full").select("shard"), "shard", "left_semi")
    filters = written(new.filter("NOT full").unionByName(_built(again)).select("shard", "slots"), "line_filters")
    return replace(index, refs=refs, filters=filters)


def doomed(lines: DataFrame, index: LineIndex) -> DataFrame:
    """(row, keys): of each document in chunked lines, the keys whose lines go; documents without any don't appear."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(right.num_rows, np.bool_)
        if left.num_rows and right.num_rows:
            hit = CuckooFilter(np.frombuffer(left["slots"][0].as_py(), np.uint16).reshape(-1, 4)).contains(_words(right["key"]))
        return right.select(["key"]).filter(pa.array(hit))

    asked = _sharded(lines.select("key").distinct(), index.shards)
    maybe = index.filters.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(probe, "key binary")
    gone = maybe.join(index.refs.filter(F.col("n") >= index.min_docs).select("key"), "key", "left_semi")
    gone = gone.select("key", F.expr(f"explode(sequence(0L, {SALTS - 1}L))").alias("salt"))
    salted = lines.withColumn("salt", F.pmod(F.element_at("docs", 1), F.lit(SALTS)))
    return salted.join(gone, ["key", "salt"], "left_semi").select("key", F.explode("docs").alias("row")).groupBy("row").agg(F.collect_set("key").alias("keys"))


def without_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of docs without the lines whose keys `gone` lists."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(b.column("text").to_pylist(), b.column("keys").to_pylist(), strict=True):
                lines = kept = text.split(b"\n")
                if keys:
                    bad = set(keys)
                    kept = [x for x in lines if not (k := key_of(x)) or _digest(k) not in bad]
                    text = b"\n".join(kept)
                texts.append(text.decode("utf-8", "replace"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    joined = _rows(docs, id_col, text_col).join(gone, "row", "left").select("doc_id", "text", "keys")
    return joined.mapInArrow(of, "doc_id long, text string, n_lines long, n_dropped long")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Docs without the lines whose keys at least min_docs of them have: doc_id, text, n_lines, n_dropped.

    All lines with such a key go, in every document; a document all of whose
    lines go has an empty text. Blank lines have no key and stay. A null or
    empty text is one empty line. Each row counts as a document, so repeated
    rows count again, and rows that repeat or lack a doc_id are documents each.
    Keys are told apart by SHA-256. A very long text is split whole, alone in its
    chunk. An empty table gives an empty result; other columns are not read.
    """
    lines = written(chunked_lines(docs, id_col, text_col), "lines")
    index = changed(empty_index(docs, lines.count(), min_docs), inserted=lines)
    return without_lines(docs, doomed(lines, index), id_col, text_col)
