"""SimHash near-dedup: segment popcounts as a grid, range join under Manhattan distance, exact check.

A fingerprint is cut into segments of `SEGMENT_BITS` bits; the vector of their
bit counts is its place on a grid. Changing one bit moves one coordinate by one,
so the Manhattan distance of two places is a lower bound of the Hamming distance
of the fingerprints. Two places are within distance 2 if and only if they share
a cell within distance 1 of both, so the range join is an equi-join: each place
goes to its own cell and to all adjacent ones. What meets in a cell is within
the bound, and is verified exactly.

Places are joined before fingerprints are: a place is one row however many
fingerprints lie there, a cell has at most 129 places around it, and cells with
one fingerprint go at once. Cells with more than `MOST_IN_CELL` fingerprints are
split: those fingerprints are joined again on the grid of one-bit segments,
where at most 65 lie around a cell and the bound is the distance itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import connected_components, id_and_bytes, joined_hot, row_key, written

SEGMENT_BITS = 2
#: Fingerprints around a cell that are compared with each other; cells with more are split.
MOST_IN_CELL = 64
SHINGLE_WORDS = 3
SEED = 42


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64 bits of a text: A-Z lower-cased, split at ASCII white space, shingles with repeats; no words: 0."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # a very long text in parts
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row, fp): row is the row_key; fp holds the 64 bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("row"), pa.array(fps)], ["doc_id", "row", "fp"])

    return id_and_bytes(docs, id_col, text_col).withColumn("row", row_key()).mapInArrow(of, "doc_id long, row long, fp long")


def segment_popcounts(fp: np.ndarray, bits: int = SEGMENT_BITS) -> np.ndarray:
    """(n, segments) of bit counts."""
    return np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).reshape(len(fp), 64 // bits, bits).sum(axis=2, dtype=np.int8)


def _axes(bits: int) -> np.ndarray:
    """What a step along each axis adds to a packed cell: a segment's count takes as many bits as the segment."""
    return np.uint64(1) << np.arange(0, 64, bits, dtype=np.uint64)


def _cell_of(fp: np.ndarray, bits: int) -> np.ndarray:
    """The own cell of each fingerprint, its coordinates packed into 64 bits; of one-bit segments the fingerprint itself."""
    return (segment_popcounts(fp, bits)[:, ::-1].astype(np.uint64) * _axes(bits)).sum(axis=1, dtype=np.uint64)


def _around(own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of own): the packed cells within distance 1 of each."""
    axes = _axes(bits)
    counts = own[:, None] // axes & np.uint64((1 << bits) - 1)
    up, down = np.nonzero(counts < bits), np.nonzero(counts > 0)
    cells = np.concatenate((own, own[up[0]] + axes[up[1]], own[down[0]] - axes[down[1]]))
    return cells, np.concatenate((np.arange(len(own)), up[0], down[0]))


def _dealt(places: DataFrame, bits: int) -> DataFrame:
    """(cell, own, n): each place (own, a packed cell; n fingerprints) in every cell within distance 1 of it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, n = b.column("own").to_numpy().view(np.uint64), b.column("n").to_numpy()
            for k in range(0, len(own), 4096):
                cells, i = _around(own[k : k + 4096], bits)
                yield pa.record_batch([pa.array(cells.view(np.int64)), pa.array(own[k + i].view(np.int64)), pa.array(n[k + i])], ["cell", "own", "n"])

    return places.mapInArrow(of, "cell long, own long, n long")


def _placed(distinct: DataFrame, bits: int) -> DataFrame:
    """(fp, own): the packed place of each fingerprint."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _cell_of(b.column("fp").to_numpy().view(np.uint64), bits)
            yield pa.record_batch([b.column("fp"), pa.array(own.view(np.int64))], ["fp", "own"])

    return distinct.select("fp").mapInArrow(of, "fp long, own long")


def _verified(groups: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, at 2 or fewer differing bits among the lists `all` of groups."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("all")
            flat, size = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            from_ = np.cumsum(size) - size
            for m in np.unique(size).tolist():
                every = from_[size == m]
                for k in range(0, len(every), 256):
                    x = np.sort(flat[every[k : k + 256, None] + np.arange(m)].view(np.int64), axis=1).view(np.uint64)
                    i, a, b = np.nonzero(np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= 2)
                    up = a < b
                    pairs = np.unique(np.stack((x[i, a][up].view(np.int64), x[i, b][up].view(np.int64)), axis=1), axis=0)
                    yield pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, j])) for j in (0, 1)], ["a", "b"])

    return groups.select("all").mapInArrow(of, "a long, b long")


def links(distinct: DataFrame, bits: int = SEGMENT_BITS, most: int = MOST_IN_CELL) -> DataFrame:
    """Edges (a, b), a < b, of distinct fingerprints (fp) at 1 or 2 differing bits.

    All of them where cells have at most `most` fingerprints; in cells that are
    split, those from each one-bit cell's least fingerprint to its others, which
    connect all that pairs would connect.
    """
    placed = written(_placed(distinct, bits), "simhash_places")
    # places are few bytes, but become many cells each: as many tasks as a shuffle has
    places = placed.groupBy("own").agg(F.count("*").alias("n")).repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("own"))
    cells = _dealt(places, bits).groupBy("cell").agg(F.sum("n").alias("n"), F.collect_list("own").alias("owns")).filter("n > 1")
    met = written(cells.select("cell", "n", F.explode("owns").alias("own")), "simhash_cells")
    near = placed.join(met.filter(F.col("n") <= most).select("cell", "own"), "own")
    compared = _verified(near.groupBy("cell").agg(F.collect_list("fp").alias("all")))
    crowded = placed.join(met.filter(F.col("n") > most).select("own").distinct(), "own", "left_semi").select(F.col("fp").alias("own"), F.lit(1).cast("long").alias("n"))
    split = _dealt(crowded, 1).groupBy("cell").agg(F.min("own").alias("a"), F.collect_list("own").alias("all"))
    stars = split.filter(F.size("all") > 1).select("a", F.explode("all").alias("b")).filter("a < b AND bit_count(a ^ b) <= 2")
    return compared.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, row (its row_key), fp (signed long), component_id, is_first.

    component_id is the smallest doc_id that links reach, the row's own
    included. is_first is true for the row of that doc_id, the one with the
    smallest row_key if several have it. A null or blank text has fingerprint
    zero and links like any other. Null doc_ids come last; a component of null
    doc_ids only has a null component_id. Repeated rows give repeated results;
    an empty table an empty one; very long texts count whole. Other columns of
    docs are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = written(rows.groupBy("fp").agg(first, F.count("*").alias("n")), "distinct_fp")
    parts = connected_components(links(nodes))
    named = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = written(named.join(least, "component").select("fp", "n", "least"), "components")
    found = joined_hot(rows, named, "fp", "n")
    is_first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))
    return found.select("doc_id", "row", "fp", F.col("least.doc_id").alias("component_id"), is_first.alias("is_first"))
