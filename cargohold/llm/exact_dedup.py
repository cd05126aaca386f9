"""Exact dedup: a minimal perfect hash over historical distinct digests.

Texts count as equal when they are identical after lower-casing A-Z. The
history is sharded by digest; each shard is one row of the index table with a
minimal perfect hash, and slots that hold full digests, winner locators and
group sizes. A digest is looked up by hash, then compared byte by byte: members
are repeats of a historical winner, nonmembers are grouped among themselves.

Hot digests cost nothing: groups are pre-aggregated before they are shuffled,
each distinct digest is looked up once, and the few answers that many rows want
are broadcast instead of gathering those rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import id_and_bytes, joined_hot, mixed, row_key, written

#: Digests of a shard, on average: what one task holds at once; and shards at least.
SHARD_DIGESTS, LEAST_SHARDS = 250_000, 64
_INDEX = "shard long, n long, sizes binary, bits binary, digests binary, winners binary, sizes_of_groups binary"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, digest): row_key and SHA-256 of each whole text with A-Z lower-cased; null counts as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashlib.sha256(t.lower()).digest() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("row"), pa.array(found, pa.binary())], ["doc_id", "row", "digest"])

    return id_and_bytes(docs, id_col, text_col).withColumn("row", row_key()).mapInArrow(of, "doc_id long, row long, digest binary")


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests, by levels.

    At each level a digest claims one bit; those alone on their bit stay, the
    others go to the next level. The slot of a digest is the rank of its bit.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @staticmethod
    def _at(words: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(words[:, 0] ^ mixed(words[:, 1] + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def built(cls, keys: np.ndarray) -> PerfectHash:
        """keys: (n, 4) of distinct rows of 64-bit words."""
        sizes, levels, left = [], [], keys
        while len(left):
            size = max(1, math.ceil(len(left) * 1.3))
            at = cls._at(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.bool_))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a nonmember -1 or any slot."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._at(keys[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + size
        return out


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """The index table of (doc_id, digest) rows: one row per shard. The largest doc_id of a digest wins; nulls lose."""

    def build(key: tuple, t: pa.Table) -> pa.Table:
        keys = _words(t["digest"])
        hashed = PerfectHash.built(keys)
        order = np.argsort(hashed.slots(keys))
        winners = t["winner"].to_numpy()
        cells = [key[0].as_py(), len(keys), np.array(hashed.sizes, np.int64).tobytes(), np.packbits(hashed.bits).tobytes(), keys[order].tobytes(), winners[order].tobytes(), t["n"].to_numpy()[order].tobytes()]
        return pa.table({n: [c] for n, c in zip(("shard", "n", "sizes", "bits", "digests", "winners", "sizes_of_groups"), cells, strict=True)})

    groups = rows.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(_NO_ID)).alias("winner"), F.count("*").alias("n"))
    return _sharded(groups, shards).groupBy("shard").applyInArrow(build, _INDEX)


#: Stands for a null doc_id in the index.
_NO_ID = -(1 << 63)


def lookup(distinct: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of those distinct digests that the index has, compared in full."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"digest": pa.array([], pa.binary()), "keep_id": pa.array([], pa.int64()), "group_size": pa.array([], pa.int64())}
        if left.num_rows and right.num_rows:
            row = {c: left[c][0].as_py() for c in left.column_names}
            sizes = np.frombuffer(row["sizes"], np.int64).tolist()
            hashed = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).view(np.bool_))
            have = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
            asked = _words(right["digest"])
            slots = hashed.slots(asked)
            same = (slots >= 0) & (have[slots] == asked).all(axis=1)
            winners, sizes_of = (np.frombuffer(row[c], np.int64)[slots[same]] for c in ("winners", "sizes_of_groups"))
            out = {"digest": right["digest"].filter(pa.array(same)), "keep_id": pa.array(winners), "group_size": pa.array(sizes_of)}
        return pa.table(out)

    found = index.groupBy("shard").cogroup(_sharded(distinct, shards).groupBy("shard")).applyInArrow(probe, "digest binary, keep_id long, group_size long")
    return found.withColumn("keep_id", F.expr(f"nullif(keep_id, {_NO_ID}L)"))


def shard_count(n_digests: int) -> int:
    return max(LEAST_SHARDS, math.ceil(n_digests / SHARD_DIGESTS))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row (its row_key), digest, keep_id, group_size, kept, is_repeat.

    history: the documents whose digests make the index, docs themselves if
    None. A text that the history has is a repeat of its winner (the largest
    doc_id) and keep_id names that; group_size is the number of historical
    rows. Other texts group among docs: the largest doc_id stays. kept is true
    where keep_id is the row's own doc_id.

    Nulls: a null text is the empty text; null doc_ids lose against others, and
    a group of null doc_ids only has a null keep_id and is kept. Repeated rows
    (equal doc_id and text) are one document: kept or dropped together, each
    counted in group_size. An empty table gives an empty result; very long texts
    count whole. Other columns of docs are not read.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    past = rows if history is None else written(digests(history, id_col, text_col), "history")
    shards = shard_count(past.count())
    index = written(build_index(past, shards), "mph_index")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("own_id"), F.count("*").alias("own_size"))
    known = lookup(groups.select("digest"), index, shards)
    decided = groups.join(known.withColumn("is_repeat", F.lit(True)), "digest", "left").select(
        "digest", "own_size",
        F.when(F.col("is_repeat"), F.col("keep_id")).otherwise(F.col("own_id")).alias("keep_id"),
        F.coalesce("group_size", "own_size").alias("group_size"),
        F.coalesce("is_repeat", F.lit(False)).alias("is_repeat"),
    )
    decided = written(decided, "decided")
    return joined_hot(rows, decided, "digest", "own_size").select("doc_id", "row", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "is_repeat")
