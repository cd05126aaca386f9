"""What the operators share: scratch tables, text as bytes, words and hashes in arrays, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.scratch import discard, scratch_path, written


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text as UTF-8 bytes); a null text is the empty text."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64 bits of a row's id and text, to tell rows apart that share or lack an id."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def stretches(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes; a longer text is alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if len(texts) > begin:
        yield begin, len(texts)


__all__ = ["FIRST_BYTES", "Words", "bucketed", "connected_components", "count_words", "eights", "id_and_bytes", "joined_hot", "mixed", "row_key", "scratch_path", "slice_hashes", "stretches", "written"]

#: 1 for bytes of words: digits, letters, and all of UTF-8 beyond ASCII.
_IS_WORD = np.zeros(256, np.bool_)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, other bytes unchanged.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def count_words(texts: list[bytes]) -> int:
    is_word = _IS_WORD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    return int(np.count_nonzero(is_word[:-1] & ~is_word[1:]))


#: For 0 to 8 bytes of a little-endian word: the bits that they take.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Sets slices of different lengths apart.
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte of buf on, as one integer; zeros follow buf."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))


def slice_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: dict | None = None) -> np.ndarray:
    """64 bits of each slice of buf, an array of bytes; eight bytes a step. The length is hashed apart from the bytes.

    prefixes: for each length in it, 8 bytes at most, gets the slices that are
    longer and the hashes of their beginnings.
    """
    every, lengths = eights(buf), end - start
    word = every[start]
    out = mixed((word & FIRST_BYTES[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) * _LENGTH))
    for n in prefixes or ():
        longer = np.flatnonzero(lengths > n)
        prefixes[n] = (longer, mixed((word[longer] & FIRST_BYTES[n]) ^ (np.array([n], np.uint64) * _LENGTH)))
    alive, done = np.flatnonzero(lengths > 8), 8
    while len(alive):
        left = lengths[alive] - done
        out[alive] = mixed(out[alive] ^ (every[start[alive] + done] & FIRST_BYTES[np.minimum(left, 8)]))
        alive, done = alive[left > 8], done + 8
    return out


class Words:
    """The words `[0-9A-Za-z and all beyond ASCII]+` of many texts, A-Z lower-cased, in arrays.

    buf: all texts, lower-cased, a space after each. start, end: of each word in
    buf. doc: the index of each word's text. hash: 64 bits of each word; equal
    words have equal hashes.
    """

    STEP = 1 << 20

    def __init__(self, texts: list[bytes], prefixes: tuple[int, ...] = ()):
        self.buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        is_word = _IS_WORD[self.buf]
        edges = np.flatnonzero(np.diff(is_word, prepend=False).view(np.int8))
        self.start, self.end = edges[::2], edges[1::2]
        self.doc = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        #: For each length in bytes: the words that are longer, and the hashes of their beginnings.
        self.prefixes = {n: (np.zeros(0, np.int64), np.zeros(0, np.uint64)) for n in prefixes}
        self.hash = slice_hashes(self.buf, self.start, self.end, self.prefixes)

    def counts(self, n_texts: int) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=n_texts)


#: A key with more than one in so many rows is hot, and there are at most so many hot keys.
HOT = 1000


def joined_hot(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined to table, which has a row for each key, with the number of rows that have it in `size` (dropped).

    The rows of hot keys stay where they are: those at most HOT rows of table are broadcast.
    """
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot, rest = (table.filter(F.expr(f"{size} * {HOT} {op} {total}L")).drop(size) for op in (">", "<="))
    stay = rows.join(F.broadcast(hot), key)
    move = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return stay.unionByName(move)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """df as a written table of n buckets by key: later groups by key need no shuffle of it. Its name is only kept while it is made."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay: the table is external
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph with edges (a, b): component is the least node reachable.

    Labels spread over the edges and are shortened by taking the label of the
    label, until none changes; each round is a written table, so no lineage
    grows and nothing but a count comes to the driver, and the tables of the
    round before are deleted. Nodes without an edge don't appear.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = table = written(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        spread = written(spread, "spread")
        up = spread.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = spread.join(up, "label").select("node", F.least("label", "up").alias("label"), (F.col("old") != F.least("label", "up")).alias("changed"))
        new = written(new, "labels")
        discard(spread, table)  # nothing but the new labels is read from here on
        table = new
        if not new.filter("changed").limit(1).count():
            discard(both)
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
