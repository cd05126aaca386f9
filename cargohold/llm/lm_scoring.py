"""Language-model scores by stupid backoff, computed relationally.

Documents are packed into chunks, a compressed row each. A chunk explodes its
n-grams of all orders, counts them, and sends its distinct ones to the count
tables, which are partitioned by hash: one row per chunk and hash range, with
the n-grams' hashes and counts as arrays. A count table adds up what all chunks
have sent and answers each chunk with what the others have of its n-grams; an
n-gram that no other chunk has, as most have not, needs no answer. The chunk
joins the counts to its words' n-grams, backs off where one is missing, and sums
the logarithms per document.

A row never holds more than one chunk's n-grams of one range, however often an
n-gram occurs, so hot n-grams weigh as much as others. A chunk sends at most
2**FAN_BITS rows. Corpora that need more ranges than that are counted in levels:
the rows of as many chunks are merged first, cut by the next bits of the hash,
and sent on, and the answers come back the same way. Rows thus grow in proportion
to the corpus, but for the number of levels (one up to 64 GB of text, two up to
64 TB).

A document is scored against all others: its own counts are taken off.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import Words, bucketed, count_words, id_and_bytes, mixed, stretches

ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a chunk (a longer text is a chunk of its own), and of the corpus text whose n-grams meet in a hash range, on average.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 64 << 20
#: Bytes of text whose words are found and scored at once, and bits of the hash by which a chunk's n-grams are counted in parts.
STEP_BYTES, RANGE_BITS = 2 << 20, 3
#: Bits of the hash that cut a row's n-grams on their way to the next level.
FAN_BITS = 10
#: Planes of a difference of sorted hashes that are as good as random, and not compressed.
_RANDOM_PLANES = 5


@functools.cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@functools.cache
def _text_compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(6, enable_ldm=True, window_log=23))


@functools.cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _packed(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit integers as the byte planes of their differences."""
    planes = np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    return planes[:_RANDOM_PLANES].tobytes() + _compressor().compress(planes[_RANDOM_PLANES:].tobytes())


def _unpacked(cell: bytes, n: int) -> np.ndarray:
    low = n * _RANDOM_PLANES
    planes = np.frombuffer(cell[:low] + _decompressor().decompress(cell[low:]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _packed_counts(x: np.ndarray) -> bytes:
    """Non-negative integers, most of them zero: which are not, and those."""
    some = x[x > 0]
    width = max(1, (int(some.max(initial=0)).bit_length() + 7) // 8)
    values = np.ascontiguousarray(some.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + _compressor().compress(np.packbits(x > 0).tobytes() + values.tobytes())


def _unpacked_counts(cell: bytes, n: int) -> np.ndarray:
    raw, bits = np.frombuffer(_decompressor().decompress(cell[1:]), np.uint8), (n + 7) // 8
    out = np.zeros(n, np.int64)
    some = np.unpackbits(raw[:bits], count=n).view(np.bool_)
    for k, plane in enumerate(raw[bits:].reshape(cell[0], -1)):
        out[some] += plane.astype(np.int64) << (8 * k)
    return out


class Ngrams:
    """The n-grams of texts, by a hash of each, up to an order. Orders are gone through one by one, so that only one order's are held."""

    def __init__(self, texts: list[bytes], order: int):
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, z in stretches(texts, STEP_BYTES):
            words = Words(texts[a:z])
            hashes.append(words.hash)
            counts.append(words.counts(z - a))
        self.order, self.n_words, self.word = order, np.concatenate(counts), np.concatenate(hashes)

    def occurrences(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each order: the words that its n-grams end at, and those n-grams."""
        n = len(self.word)
        starts = np.zeros(n + 1, np.bool_)
        starts[np.cumsum(self.n_words) - self.n_words] = True  # where a document begins; for empty ones at the end, beyond the last word
        h, early = self.word, np.zeros(n, np.bool_)  # words with too few before them
        for o in range(1, self.order + 1):
            if o > 1:
                h = mixed(np.append(np.uint64(0), h[:-1]) * np.uint64(0x9E3779B97F4A7C15) + self.word + np.uint64(o))
                early[o - 2 :] |= starts[: max(n - (o - 2), 0)]
            fit = np.flatnonzero(~early).astype(np.int32)
            yield fit, h[fit]

    def counted(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sorted distinct n-grams of all orders, and how often each is found; one of 2**bits equal ranges of hashes at a time, ascending."""
        every = [keys for _, keys in self.occurrences()]
        for part in range(1 << bits):
            own = [k[k >> np.uint64(64 - bits) == np.uint64(part)] if bits else k for k in every]
            keys = np.concatenate(own)
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            yield keys[first], np.diff(np.append(first, len(keys))).astype(np.int32)

    def scores(self, distinct: np.ndarray, totals: np.ndarray, corpus_words: int, backoff: float, exclude_self: bool) -> np.ndarray:
        """Of each text: the sum over its words of log10 of the backed-off relative frequency. totals: of `distinct`, which has all n-grams of the texts."""
        n = len(self.word)
        doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        score, context = np.zeros(n), np.zeros(0, np.int64)
        for o, (ends, keys) in enumerate(self.occurrences(), 1):
            by = np.argsort(keys)
            keys = keys[by]
            new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            place = np.empty(len(keys), np.int64)
            place[by] = np.cumsum(new) - 1
            count = np.zeros(n, np.int64)
            count[ends] = totals[np.searchsorted(distinct, keys[new])][place]
            if exclude_self:
                count[ends] -= _in_document(place, doc[ends])
            if o == 1:
                corpus = np.maximum(corpus_words - (self.n_words if exclude_self else 0 * self.n_words), 1)
                score = np.log10(np.maximum(count, 1)) - np.log10(corpus)[doc]
            else:  # the higher order wins where it has been seen
                score[ends] += math.log10(backoff)
                seen = np.flatnonzero(count > 0)
                score[seen] = np.log10(count[seen]) - np.log10(np.maximum(context[seen], 1))
            context = np.append(0, count[:-1])  # of the n-gram that ends at the word before
        return np.bincount(doc, score, minlength=len(self.n_words)).astype(np.float64)


def _in_document(place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each occurrence of an n-gram, those in the same document. Occurrences stand in order of documents; place: the n-gram's number."""
    own = np.ones(len(place), np.int64)
    at = np.flatnonzero(np.bincount(place)[place] > 1)
    code = np.sort(place[at] << 32 | at)  # by n-gram, then by document
    at = code & 0xFFFFFFFF
    gram, doc = code >> 32, doc[at]
    start = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]))[: len(at)])
    size = np.diff(np.append(start, len(at)))
    own[at] = np.repeat(size, size)
    return own


def _cut(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges, by all bits above the lowest `shift`, that sorted keys lie in: (range numbers, bounds)."""
    prefix = keys >> np.uint64(shift)
    first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])[: len(keys)])
    return prefix[first].astype(np.int64), np.append(first, len(keys))


def _chunked(rows: DataFrame, chunk_bytes: int, side: int) -> DataFrame:
    """(chunk, n_words, ids, sizes, texts): texts one after the other, compressed."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, ids, n = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            words = sum(count_words(held[a:z]) for a, z in stretches(held, STEP_BYTES))
            cells = [(part << 33) + 2 * k + side, words, ids, list(map(len, held)), _text_compressor().compress(b"".join(held))]
            return pa.record_batch([pa.array([c], t.type) for c, t in zip(cells, schema, strict=True)], schema)

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if held and n + len(text) > chunk_bytes:
                    yield row()
                    k, held, ids, n = k + 1, [], [], 0
                held.append(text)
                ids.append(i)
                n += len(text)
        if held:
            yield row()

    schema = pa.schema([("chunk", pa.int64()), ("n_words", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])
    # whole chunks are read again when they are scored, and don't move then
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(rows.mapInArrow(of, "chunk long, n_words long, ids array<long>, sizes array<long>, texts binary"), "lm_chunks", "chunk", buckets)


def _texts(sizes: list[int], cell: bytes) -> list[bytes]:
    raw, ends = _decompressor().decompress(cell), np.cumsum([0, *sizes]).tolist()
    return [raw[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]


_SENT = "node long, bucket long, n long, keys binary, counts binary, adds boolean"
_SENT_SCHEMA = pa.schema([("node", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("adds", pa.bool_())])
_ANSWER = "node long, bucket long, adds boolean, more binary"

_ANSWER_SCHEMA = pa.schema([("node", pa.int64()), ("bucket", pa.int64()), ("adds", pa.bool_()), ("more", pa.binary())])


def _sent(node: int, keys: np.ndarray, count: np.ndarray, adds: bool, shift: int) -> pa.RecordBatch:
    bucket, at = _cut(keys, shift)
    ranges = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    cells = [[node] * len(ranges), bucket, np.diff(at), [_packed(keys[a:z]) for a, z in ranges], [_packed_counts(count[a:z] - 1) for a, z in ranges], [adds] * len(ranges)]
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(cells, _SENT_SCHEMA, strict=True)], _SENT_SCHEMA)


class _Merged:
    """The rows that meet in a hash range: their sorted distinct keys, what they add up to, and where each row's keys lie among them."""

    def __init__(self, t: pa.Table):
        self.rows = list(zip(t["node"].to_pylist(), t["bucket"].to_pylist(), t["adds"].to_pylist(), strict=True))
        sizes = t["n"].to_pylist()
        keys = [_unpacked(c, n) for c, n in zip(t["keys"].to_pylist(), sizes, strict=True)]
        # what a row itself adds: nothing if it only asks
        self.counts = [(_unpacked_counts(c, n) + 1) * a for c, n, a in zip(t["counts"].to_pylist(), sizes, t["adds"].to_pylist(), strict=True)]
        every = np.concatenate(keys)
        by = np.argsort(every).astype(np.int32)
        in_order = every[by]
        new = np.append(True, in_order[1:] != in_order[:-1])
        self.keys = in_order[new]
        of = np.empty(len(every), np.int32)
        of[by] = np.cumsum(new, dtype=np.int32) - 1
        self.of = np.split(of, np.cumsum(sizes)[:-1])
        self.total = np.zeros(len(self.keys), np.int64)
        for x, n in zip(self.of, self.counts, strict=True):
            self.total[x] += n

    def answers(self, more: np.ndarray | int = 0) -> pa.Table:
        """Of each row: what others have of its keys, without rows that only have their own. more: what there is besides these rows."""
        total = self.total + more
        found = ((row, total[x] - n) for row, x, n in zip(self.rows, self.of, self.counts, strict=True))
        kept = [(*row, _packed_counts(x)) for row, x in found if x.any()]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*kept, strict=True) if kept else [()] * 4, _ANSWER_SCHEMA, strict=True)], _ANSWER_SCHEMA)


def _answered(sent: DataFrame, nodes: int, levels: int, bits: int, depth: int = 1) -> DataFrame:
    """(node, bucket, more) for sent rows that are cut by depth * bits bits of the hash."""
    if depth == levels:
        return sent.groupBy("bucket").applyInArrow(lambda key, t: _Merged(t).answers(), _ANSWER)
    groups = math.ceil(nodes / (1 << bits))
    grouped = sent.withColumn("of", F.pmod(F.xxhash64("node"), F.lit(groups)))
    shift = 64 - bits * (depth + 1)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        m = _Merged(t)
        asks = m.total == 0  # keys that are only asked for
        parts = [_sent(key[0].as_py(), m.keys[~asks], m.total[~asks], True, shift), _sent(key[0].as_py(), m.keys[asks], np.ones(int(asks.sum()), np.int64), False, shift)]
        return pa.Table.from_batches(parts)

    above = _answered(grouped.groupBy("of", "bucket").applyInArrow(merge, _SENT), groups, levels, bits, depth + 1)

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("an answer without a question")
        m = _Merged(left)
        more = np.zeros(len(m.keys), np.int64)
        answered = {}
        for bucket, adds, cell in zip(right["bucket"].to_pylist(), right["adds"].to_pylist(), right["more"].to_pylist(), strict=True):
            answered[bucket, adds] = cell
        asks = m.total == 0
        for adds, at in ((True, np.flatnonzero(~asks)), (False, np.flatnonzero(asks))):
            bucket, ends = _cut(m.keys[at], shift)
            for b, a, z in zip(bucket.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if (b, adds) in answered:
                    more[at[a:z]] = _unpacked_counts(answered[b, adds], z - a)
        return m.answers(more)

    below = above.withColumn("prefix", F.shiftright("bucket", bits))
    return grouped.groupBy("of", "bucket").cogroup(below.groupBy("node", "prefix")).applyInArrow(back, _ANSWER)


def lm_scores(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, backoff: float = BACKOFF, exclude_self: bool = True, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, score.

    score: the sum over the words of log10 S, where S is the count of the n-gram
    that ends at the word over the count of its context if that n-gram occurs,
    else backoff times S of the next shorter one; a single word's is its count
    over the corpus words, a word that never occurs counting as one. Counts are
    over the whole of corpus, docs themselves if None. exclude_self takes a
    document's own n-grams and words off; it is for docs that are in the corpus.

    Words are runs of digits, letters and characters beyond ASCII, A-Z
    lower-cased. A null or empty text has no words and the score 0; repeated
    rows count and are scored each; a very long text is scored whole, in a chunk
    of its own; an empty table gives an empty result; other columns are not
    read. N-grams are told apart by 64 bits. The sizes bound memory and change
    no result.
    """
    chunks = _chunked(id_and_bytes(docs, id_col, text_col), chunk_bytes, 0)
    known = chunks if corpus is None else _chunked(id_and_bytes(corpus, id_col, text_col), chunk_bytes, 1)
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    n_chunks, corpus_words, n_bytes = known.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    inside, range_bits = corpus is None, min(RANGE_BITS, fan_bits)
    levels = max(1, math.ceil(math.log2(max(1.0, n_bytes / bucket_bytes)) / fan_bits))

    def asked(rows: DataFrame, adds: bool) -> DataFrame:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):  # a chunk at a time
                    texts = _texts(b.column("sizes")[k].as_py(), b.column("texts")[k].as_py())
                    for keys, count in Ngrams(texts, order).counted(range_bits):
                        yield _sent(b.column("chunk")[k].as_py(), keys, count, adds, 64 - fan_bits)

        return rows.select("chunk", "sizes", "texts").mapInArrow(of, _SENT)

    sent = asked(chunks, inside)
    nodes = n_chunks
    if not inside:
        sent, nodes = sent.unionByName(asked(known, True)), n_chunks + chunks.count()
    # chunks of docs are even; those of the corpus only add
    answers = _answered(sent, nodes, levels, fan_bits).withColumnRenamed("node", "chunk").filter("chunk % 2 = 0")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _texts(left["sizes"][0].as_py(), left["texts"][0].as_py())
        distinct, count = map(np.concatenate, zip(*Ngrams(texts, order).counted(range_bits), strict=True))
        totals = count.astype(np.int64) if inside else np.zeros(len(distinct), np.int64)
        bucket, at = _cut(distinct, 64 - fan_bits)
        own = {b: (a, z) for b, a, z in zip(bucket.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)}
        for b, cell in zip(right["bucket"].to_pylist(), right["more"].to_pylist(), strict=True):
            a, z = own[b]
            totals[a:z] += _unpacked_counts(cell, z - a)
        n_words, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, z in stretches(texts, STEP_BYTES):
            grams = Ngrams(texts[a:z], order)
            n_words.append(grams.n_words)
            scores.append(grams.scores(distinct, totals, corpus_words, backoff, exclude_self))
        return pa.table({"doc_id": pa.array(left["ids"][0].as_py(), pa.int64()), "n_words": pa.array(np.concatenate(n_words)), "score": pa.array(np.concatenate(scores))})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, score double")
