"""Benchmark decontamination with suffix arrays over the training documents.

Documents are scanned in shards of bounded size. Each shard builds a suffix
array over its words, and every suffix of every benchmark item that is long
enough to matter is binary-searched in it: the longer common prefix with its two
neighbours there is the longest verbatim match in the shard. Where that is a
window or more, the range of suffixes that begin with the window are its
occurrences. Nothing is shuffled: a document's report depends on the document
and the benchmark.

The array is sparse without losing a match: a suffix can match only if as many
words as a window has, from it on, are words of the benchmark.

The benchmark is cut into blocks, which tasks build and which are searched one
at a time. A pass over the documents has as many blocks as are sent at once;
larger benchmarks take several passes, each of which adds to what the one before
has found.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import Words, id_and_bytes, stretches, written

WINDOW = 10
#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 6 << 20
#: Bytes of items in a block on average, and blocks that a pass sends to the tasks.
BLOCK_BYTES, PASS_BLOCKS = 4 << 20, 32
_MATCHES = "array<struct<item_id: string, item_word: int, doc_word: long, words: int>>"
_STATE = f"doc_id long, text binary, n_words long, n_hit long, hit binary, items array<string>, matches {_MATCHES}"


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text, a non-negative integer array, in order of their suffixes' first `depth` values at least."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while width < depth and rank.max(initial=0) < n:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:]
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    return np.argsort(rank, kind="stable")


class TestItems:
    """A block of benchmark items: word ids of all, and their suffixes.

    Items of the same words count as one sequence with several names.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        w = Words([t for _, t in items])
        first = np.searchsorted(w.doc, np.arange(len(items) + 1))
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        ids = ids.ravel().astype(np.int32) + 1
        same: dict[bytes, set[str]] = {}
        for (name, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                same.setdefault(ids[a:b].tobytes(), set()).add(name)
        self.names = [sorted(x) for x in same.values()]
        size = np.fromiter((len(x) // 4 for x in same), np.int64, len(same))
        self.ids = np.frombuffer(b"".join(same), np.int32)
        self.end = np.cumsum(size)
        self.longest = int(size.max(initial=0))
        #: Suffixes with a whole window, or that are a whole shorter item: where they begin, end and how many words they need.
        need = np.minimum(size, window)
        self.sequence = np.repeat(np.arange(len(size)), size - need + 1)
        self.at = np.arange(len(self.sequence)) + (np.cumsum(need - 1) - (need - 1))[self.sequence]
        self.stop, self.need = self.end[self.sequence], need[self.sequence]
        #: The window that each suffix begins with, and a suffix of each distinct window.
        padded = np.append(self.ids, np.full(window, -1, np.int32))
        rows = padded[self.at[:, None] + np.arange(window)]
        rows[np.arange(window) >= self.need[:, None]] = -1
        _, self.first, self.window = np.unique(np.ascontiguousarray(rows).view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
        #: Distinct (window, sequence); those of window k are sequences[from_[k]:from_[k + 1]].
        pairs = np.unique(self.window.astype(np.int64) * max(len(size), 1) + self.sequence)
        self.sequences = pairs % max(len(size), 1)
        self.from_ = np.searchsorted(pairs, np.arange(len(self.first) + 1) * max(len(size), 1))
        by = np.argsort(self.window, kind="stable")
        self.suffixes, self.suffixes_from = by, np.searchsorted(self.window[by], np.arange(len(self.first) + 1))
        #: For each number of words needed below a window: the first words of such items.
        self.begins = {int(n): np.unique(self.ids[self.at[self.need == n]]) for n in np.unique(self.need)}


def _common(text: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that text from each a on and ids from each b on have in common, `most` at most."""
    n = np.zeros(len(a), np.int64)
    alive = np.flatnonzero(most > 0)
    while len(alive):
        k = n[alive]
        same = text[a[alive] + k] == ids[b[alive] + k]
        n[alive[same]] += 1
        alive = alive[same & (k + 1 < most[alive])]
    return n


def searched(text: np.ndarray, order: np.ndarray, ids: np.ndarray, at: np.ndarray, stop: np.ndarray, past: bool = False) -> np.ndarray:
    """For the sequence ids[at:stop] of each pair: how many suffixes of the array `order` of text come before it, or with `past` don't come after it or begin with it.

    text ends with a value that ids don't have.
    """
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        a, b, most = order[mid], at[open_], stop[open_] - at[open_]
        n = _common(text, a, ids, b, most)
        inside = n < most
        less = np.full(len(open_), past)  # where all is in common
        less[inside] = text[a[inside] + n[inside]] < ids[b[inside] + n[inside]]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
    return low


class SparseArray:
    """The suffix array of a shard's words, of those suffixes that a block could match."""

    def __init__(self, words: Words, test: TestItems):
        at, known = _among(test.vocabulary, words.hash)
        new_doc = np.flatnonzero(np.diff(words.doc, prepend=-1))
        ids = np.insert(np.where(known, at + 1, 0).astype(np.int32), new_doc, 0)  # a break before each document
        where = np.insert(np.arange(len(known)), new_doc, -1)
        unknown = np.append(np.flatnonzero(ids == 0), len(ids))
        ahead = unknown[np.searchsorted(unknown, np.arange(len(ids)))] - np.arange(len(ids))  # known words from here on
        starts = np.zeros(len(ids), np.bool_)
        for n, begins in test.begins.items():
            first = np.zeros(len(test.vocabulary) + 1, np.bool_)
            first[begins] = True
            starts |= (ahead >= n) & first[ids]
        # what a suffix may be compared with ends at the next unknown word
        p = np.flatnonzero(starts)
        reach = np.zeros(len(ids) + 1, np.int64)
        np.add.at(reach, p, 1)
        np.add.at(reach, p + np.minimum(ahead[p], test.longest), -1)
        q = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
        cut = np.append(np.flatnonzero(np.diff(q, prepend=-2) > 1), len(q))
        self.text, self.where = np.insert(ids[q], cut, 0), np.insert(where[q], cut, -1)
        every = suffix_array(self.text, test.longest)
        self.order = every[np.insert(starts[q], cut, False)[every]]

    def longest(self, test: TestItems) -> np.ndarray:
        """Of each suffix of the block: the words of its longest match in the shard, by its neighbours in the array."""
        if not len(self.order):
            return np.zeros(len(test.at), np.int64)
        k, most = searched(self.text, self.order, test.ids, test.at, test.stop), test.stop - test.at
        near = (np.clip(k - 1, 0, len(self.order) - 1), np.clip(k, 0, len(self.order) - 1))
        return np.maximum(*(_common(self.text, self.order[x], test.ids, test.at, most) for x in near))

    def occurrences(self, test: TestItems, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word of the shard, window) of all occurrences of these windows."""
        first = test.first[windows]
        at, stop = test.at[first], test.at[first] + test.need[first]
        low, high = (searched(self.text, self.order, test.ids, at, stop, past) for past in (False, True))
        n = high - low
        spot = self.order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return self.where[spot], np.repeat(windows, n)


def _among(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, x), max(len(sorted_) - 1, 0))
    return at, (sorted_[at] == x if len(sorted_) else np.zeros(len(x), np.bool_))


class Shard:
    """What the benchmark's blocks have in common with the texts of a shard."""

    def __init__(self, texts: list[bytes], blocks: list[Broadcast], items: bool = False, matches: bool = False):
        self.words = Words(texts)
        self.n = len(texts)
        self.hit = np.zeros(len(self.words.hash) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in texts]
        self.matches: list[list[tuple]] = [[] for _ in texts]
        for block in blocks:
            self._search(block.value, items, matches)
            if len(blocks) > 1:  # hold one block at a time
                block.__dict__.pop("_value", None)
        self.is_hit = np.cumsum(self.hit[:-1]) > 0
        self.n_hit = np.bincount(self.words.doc, self.is_hit, minlength=self.n).astype(np.int64)

    def _search(self, test: TestItems, items: bool, matches: bool) -> None:
        if not len(test.at) or not len(self.words.hash):
            return
        array = SparseArray(self.words, test)
        windows = np.unique(test.window[array.longest(test) >= test.need])
        if not len(windows):
            return
        spot, window = array.occurrences(test, windows)
        np.add.at(self.hit, spot, 1)
        np.add.at(self.hit, spot + test.need[test.first[window]], -1)
        if not items:
            return
        # of each document and window the first occurrence: repeats within a document add nothing to its items
        doc = self.words.doc[spot]
        by = np.lexsort((spot, window, doc))
        doc, window, spot = doc[by], window[by], spot[by]
        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(window, prepend=-1) != 0))
        doc, window, spot = doc[new], window[new], spot[new]
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        for a, z in zip(cut.tolist(), np.append(cut, len(doc))[1:].tolist(), strict=True):
            sequences = np.unique(np.concatenate([test.sequences[test.from_[w] : test.from_[w + 1]] for w in window[a:z].tolist()]))
            self.items[doc[a]].update(name for s in sequences.tolist() for name in test.names[s])
        if matches:
            self._match(test, doc, window, spot)

    def _match(self, test: TestItems, doc: np.ndarray, window: np.ndarray, spot: np.ndarray) -> None:
        """Longest matches from the first occurrence of each window in a document, one for each place of the window in an item."""
        n = np.diff(test.suffixes_from)[window]
        suffix = test.suffixes[np.repeat(test.suffixes_from[window] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        doc, spot = np.repeat(doc, n), np.repeat(spot, n)
        ids = np.append(_ids(test, self.words), -1)
        begin, end = np.searchsorted(self.words.doc, doc), np.searchsorted(self.words.doc, doc, side="right")
        at, sequence = test.at[suffix], test.sequence[suffix]
        start = np.append(0, test.end)[sequence]
        # a match that could begin a word earlier is part of another
        whole = (spot > begin) & (at > start)
        whole[whole] = ids[spot[whole] - 1] == test.ids[at[whole] - 1]
        doc, spot, at, sequence, start, end, stop = (x[~whole] for x in (doc, spot, at, sequence, start, end, test.stop[suffix]))
        begin = np.searchsorted(self.words.doc, doc)
        words = _common(ids, spot, test.ids, at, np.minimum(stop - at, end - spot))
        for d, s, word, place, k in zip(doc.tolist(), sequence.tolist(), (at - start).tolist(), (spot - begin).tolist(), words.tolist(), strict=True):
            self.matches[d] += [(name, word, place, k) for name in test.names[s]]


def _ids(test: TestItems, words: Words) -> np.ndarray:
    at, known = _among(test.vocabulary, words.hash)
    return np.where(known, at + 1, 0).astype(np.int32)


def _blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, items): the benchmark's blocks, built in tasks and written. Items are dealt by a hash of their texts, so equal ones meet."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text).filter(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.length("text") + F.length("item")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block_bytes))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        found = TestItems(list(zip(t["item"].to_pylist(), t["text"].to_pylist(), strict=True)), window)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "items": pa.array([pickle.dumps(found, 5)], pa.binary())})

    return written(items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n))).groupBy("block").applyInArrow(build, "block long, items binary"), "benchmark_blocks")


def _passes(blocks: DataFrame, at_once: int) -> Iterator[list[Broadcast]]:
    """Broadcasts of at_once blocks each; the driver holds one block at a time, and the executors those of one pass."""
    sc = blocks.sparkSession.sparkContext
    numbers = sorted(r.block for r in blocks.select("block").collect())
    for k in range(0, max(len(numbers), 1), at_once):
        yield [sc.broadcast(pickle.loads(blocks.filter(F.col("block") == b).first().items)) for b in numbers[k : k + at_once]]


def _matched(state: DataFrame, blocks: list[Broadcast], matches: bool) -> DataFrame:
    """state with what these blocks add to it."""
    names = ("item_id", "item_word", "doc_word", "words")
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int64()), ("words", pa.int32())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, z in stretches(texts, SHARD_BYTES):
                s = Shard(texts[a:z], blocks, True, matches)
                n = s.words.counts(s.n)
                hit = [np.packbits(x).tobytes() for x in np.split(s.is_hit, np.cumsum(n)[:-1])]
                old = b.slice(a, z - a)
                for k, (bits, items, found) in enumerate(zip(*(old.column(c).to_pylist() for c in ("hit", "items", "matches")), strict=True)):
                    if bits is not None:
                        hit[k] = np.bitwise_or(np.frombuffer(hit[k], np.uint8), np.frombuffer(bits, np.uint8)).tobytes()
                    s.items[k].update(items or ())
                    s.matches[k] += [tuple(m[c] for c in names) for m in found or ()]
                n_hit = [int.from_bytes(x).bit_count() for x in hit]
                cells = [pa.array(n), pa.array(n_hit, pa.int64()), pa.array(hit, pa.binary()), pa.array([sorted(x) for x in s.items], pa.list_(pa.string())), pa.array([[dict(zip(names, m, strict=True)) for m in sorted(set(x))] for x in s.matches], kind)]
                yield pa.record_batch([old.column("doc_id"), old.column("text"), *cells], ["doc_id", "text", "n_words", "n_hit", "hit", "items", "matches"])

    return state.mapInArrow(of, _STATE)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", matches: bool = True, block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items, and if asked for matches.

    Words are runs of digits, letters and characters beyond ASCII, A-Z
    lower-cased. A window is `window` consecutive words of an item, or all words
    of a shorter item. n_hit counts the document's words inside an occurrence of
    a window; items are the ids (as strings, sorted) of items that occur;
    matches are the longest verbatim matches: item, its first word, the
    document's first word, and their number of words. What a document repeats is
    located where it first stands.

    Nulls: a null text has no words; a null item id is the empty string. Items
    that repeat, in id or text, are reported under each id once. Empty tables
    give no rows, or rows without hits. A very long document is searched whole,
    in a shard of its own. Other columns are not read. Words are told apart by
    64 bits. block_bytes and pass_blocks bound memory and change no result.
    """
    state = id_and_bytes(docs, id_col, text_col).select("doc_id", "text", *(F.lit(None).cast("long").alias(c) for c in ("n_words", "n_hit")), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(_MATCHES).alias("matches"))
    earlier: list[Broadcast] = []
    for blocks in _passes(_blocks(benchmark, window, item_col, item_text_col, block_bytes), pass_blocks):
        if earlier:  # only a benchmark of several passes is written in between
            state = written(state, "matched")
            for x in earlier:
                x.destroy()
        state, earlier = _matched(state, blocks, matches), blocks
    return state.select("doc_id", "n_words", "n_hit", "items", *(["matches"] if matches else []))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """The rows of docs, all columns unchanged, in which no window of the benchmark occurs.

    Nulls and empty texts have no words and stay; rows that repeat stay or go
    alike; an empty benchmark leaves all; very long texts are searched whole.
    """

    def without(rows: DataFrame, blocks: list[Broadcast]) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or b"" for t in b.column(text_col).cast(pa.binary()).to_pylist()]
                for a, z in stretches(texts, SHARD_BYTES):
                    yield b.slice(a, z - a).filter(pa.array(Shard(texts[a:z], blocks).n_hit == 0))

        return rows.mapInArrow(clean, docs.schema)

    earlier: list[Broadcast] = []
    for blocks in _passes(_blocks(benchmark, window, item_col, item_text_col, block_bytes), pass_blocks):
        if earlier:
            docs = written(docs, "clean")
            for x in earlier:
                x.destroy()
        docs, earlier = without(docs, blocks), blocks
    return docs
