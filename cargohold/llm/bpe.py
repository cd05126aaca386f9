"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a stretch of a partition lie in one array of symbols
with links to their neighbours. An index maps each mergeable pair to all its
positions. Ranks are applied in ascending order: all positions of the lowest
active rank are merged at once, and only the lists of the pairs that this makes
are extended. Stale positions are recognised when their rank comes up. A merge
only makes pairs of higher ranks, so one pass over the active ranks is the
merge order of every single pre-token.

Documents then look their pre-tokens up; the encodings of pre-tokens stay with
the Python worker, up to a bounded number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from cargohold.llm.common import FIRST_BYTES, eights, id_and_bytes, slice_hashes, stretches

#: White space as the pre-token pattern means it, and what a contraction has after its apostrophe.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_LETTER, _DIGIT, SPACE, _OTHER, _END = range(5)
#: Bytes of text split at once, bytes whose new pre-tokens are encoded together, and pre-tokens kept by a worker.
SPLIT_BYTES, STRETCH_BYTES, KEPT_WORDS = 1 << 20, 8 << 20, 1_000_000


def char_classes(tokenizer_path: str) -> np.ndarray:
    """Letter, digit, space or other for each code point, for the Unicode version of the tokenizers library.

    Letters and digits that this machine's regex library knows, but that the
    tokenizer doesn't treat as such, are asked for one by one: only those that
    are younger than Python's own tables can differ.
    """
    split = Tokenizer.from_file(tokenizer_path).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110001, _OTHER, np.uint8)
    for kind, pattern, before in ((_LETTER, r"\p{L}", "a"), (_DIGIT, r"\p{N}", "1")):
        found = regex.findall(pattern, every)
        out[[ord(c) for c in found]] = kind
        out[[ord(c) for c in found if unicodedata.category(c) == "Cn" and len(split(before + c)) > 1]] = _OTHER
    out[_SPACES] = SPACE
    out[0x110000] = _END
    return out


def pre_tokens(chars: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pre-tokens in code points; one of class _END ends a text.

    They are those of byte-level BPE's pattern: a contraction, or a run of
    letters, of digits or of others with a space before it, or white space, of
    which the last character before a run stands apart.
    """
    n = len(chars)
    kind = classes[chars]
    new = kind == _END
    new[:1] = True
    new[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(new)
    kinds, last = kind[first], np.append(first[1:], n) - 1
    mark = np.zeros(n + 4, np.bool_)
    run, spaces = (kinds < SPACE) | (kinds == _OTHER), kinds == SPACE
    led = run & (first > 0) & (chars[first - 1] == 0x20)
    mark[first - led] = True  # the space before a run begins it
    mark[np.compress(led, first)] = False
    mark[np.compress(spaces & np.append(run[1:], False), last)] = True
    quote = first[(kinds == _OTHER) & (first == last) & ~led & (chars[first] == 0x27)]
    after = np.append(chars, np.zeros(3, chars.dtype))
    for text in _CONTRACTIONS:
        hit = quote[np.all([after[quote + 1 + i] == ord(c) for i, c in enumerate(text)], axis=0)]
        mark[hit + 1] = False
        mark[hit + 1 + len(text)] = True
    start = np.flatnonzero(mark[:n])
    end = np.append(start[1:], n)
    inside = kind[start] != _END
    return np.compress(inside, start), np.compress(inside, end)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file, as arrays; small enough to broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.classes = char_classes(path)
        to_byte = byte_symbols()
        tokens = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of = {i: bytes(map(to_byte.__getitem__, t)) for t, i in tokens.items() if t not in self.special}
        of |= {i: t.encode() for t, i in self.special.items()}
        pieces = [of.get(i, b"") for i in range(max(of) + 1)]
        self.size = len(pieces)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.fromiter(map(len, pieces), np.int64, self.size)
        self.from_ = np.cumsum(self.length) - self.length
        self.of_byte = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.of_byte[b] = tokens[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pair = np.array([(tokens[a], tokens[b]) for a, b in pairs], np.int64).reshape(-1, 2)
        self.result = np.array([tokens[a + b] for a, b in pairs], np.int64)
        code = self.pair[:, 0] * self.size + self.pair[:, 1]
        self.code_rank = np.argsort(code, kind="stable")
        self.code = code[self.code_rank]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where it doesn't merge."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.code_rank[at], -1)

    def encode_words(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw is words one after the other in UTF-8, lengths their bytes: (ids of all words, number of ids of each)."""
        symbol = self.of_byte[raw]
        n = len(symbol)
        last = np.cumsum(lengths) - 1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[last] = -1
        before[last[:-1] + 1] = -1
        occurrences: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cut = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, x, y in zip(rank[cut].tolist(), cut.tolist(), np.append(cut, len(rank))[1:].tolist(), strict=True):
                if r not in occurrences:
                    heapq.heappush(active, r)
                occurrences[r].append(at[x:y])

        index(np.arange(n, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            lists = occurrences.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, right = self.pair[r]
            at = at[(symbol[at] == left) & (after[at] >= 0)]
            at = at[symbol[after[at]] == right]
            if left == right and len(at) > 1:  # of overlapping positions each second one, from the left
                new = np.concatenate(([True], after[at[:-1]] != at[1:]))
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone] = self.result[r], -1
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            prior = before[at]
            index(np.unique(np.concatenate((at, prior[prior >= 0]))))
        live = symbol >= 0
        word = np.repeat(np.arange(len(lengths)), lengths)
        return symbol[live], np.bincount(word[live], minlength=len(lengths))


def gathered(flat: np.ndarray, from_: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at from_ and have these lengths, one after the other."""
    at = np.repeat((from_ - (np.cumsum(length) - length)).astype(np.int32), length)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


class Encoder:
    """Encodes texts in stretches; keeps the encodings of pre-tokens.

    Kept pre-tokens are found by a hash of their bytes in UTF-8, whatever the
    width of the stretch that they come from, and their bytes are compared in
    full: a hash that two share costs a step and no more. encode_words is as
    Vocabulary's, which is the default; split_bytes and kept_words bound what is
    split at once and what is kept.
    """

    def __init__(self, vocabulary: Vocabulary, encode_words: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, split_bytes: int = SPLIT_BYTES, kept_words: int = KEPT_WORDS):
        self.v = vocabulary
        self.latin = vocabulary.classes[:256].copy()
        self.latin[0] = _END
        self.encode_words = encode_words or vocabulary.encode_words
        self.split_bytes, self.kept_words = split_bytes, kept_words
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self._reset()

    def _reset(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        #: Of each kept pre-token: its first eight bytes, its bytes in `raw`, and its ids in `flat`.
        self.head, self.raw_from, self.raw_length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.raw = np.zeros(8, np.uint8)  # eight zeros at the end
        self.from_, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._index()

    def _index(self) -> None:
        """A table of the kept hashes, half full at most, searched from each hash's low bits on."""
        bits = max(12, int(len(self.hash)).bit_length() + 2)
        self.table, self.mask = np.full(1 << bits, -1, np.int32), np.uint64((1 << bits) - 1)
        self._enter(np.arange(len(self.hash)))

    def _enter(self, numbers: np.ndarray) -> None:
        at = self.hash[numbers] & self.mask
        while len(numbers):
            free = np.flatnonzero(self.table[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.table[at[first]] = numbers[first]
            stay = np.ones(len(numbers), np.bool_)
            stay[first] = False
            numbers, at = numbers[stay], (at[stay] + np.uint64(1)) & self.mask

    def _found(self, h: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The number of each pre-token among the kept, -1 for others. words: first eight bytes, lengths, starts, and the eight bytes from each byte on."""
        head, length, start, every = words
        out = self.table[h & self.mask]
        if not len(self.hash):
            return out
        kept = np.ndarray((len(self.raw) - 7,), "<u8", self.raw.data, strides=(1,))

        def other(t: np.ndarray) -> np.ndarray:
            """Those of the pre-tokens t whose table entry is another one."""
            t = t[out[t] >= 0]
            bad = (self.head[out[t]] != head[t]) | (self.raw_length[out[t]] != length[t])
            done, long = 8, np.flatnonzero(~bad & (length[t] > 8))
            while len(long):
                own = t[long]
                mask = FIRST_BYTES[np.minimum(length[own] - done, 8)]
                same = ((kept[self.raw_from[out[own]] + done] ^ every[start[own] + done]) & mask) == 0
                bad[long[~same]] = True
                done += 8
                long = long[same & (length[own] > done)]
            return t[bad]

        off, step = other(np.arange(len(h))), np.uint64(0)
        while len(off):
            step += np.uint64(1)
            out[off] = self.table[(h[off] + step) & self.mask]
            off = other(off)
        return out

    def _numbers(self, chars: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in chars, number among the kept) of each pre-token of chars, which are raw in UTF-8; new ones wait for _encode_waiting."""
        first, end = pre_tokens(chars, self.latin if chars.dtype == np.uint8 else self.v.classes)
        start = first
        if len(raw) > len(chars):
            place = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))
            start, end = place[first], place[end]
        h, length, every = slice_hashes(raw, start, end), end - start, eights(raw)
        words = (every[start] & FIRST_BYTES[np.minimum(length, 8)], length, start, every)
        number = self._found(h, words)
        while len(new := np.flatnonzero(number < 0)):  # again only if pre-tokens share a hash
            own = new[np.unique(h[new], return_index=True)[1]]
            text = gathered(raw, start[own], length[own])
            self.waiting.append((text, length[own]))
            n = len(self.hash)
            self.hash, self.head = np.append(self.hash, h[own]), np.append(self.head, words[0][own])
            self.raw_from = np.append(self.raw_from, len(self.raw) - 8 + np.cumsum(length[own]) - length[own])
            self.raw_length = np.append(self.raw_length, length[own].astype(np.int32))
            self.raw = np.concatenate((self.raw[:-8], text, np.zeros(8, np.uint8)))
            if 2 * len(self.hash) > len(self.table):
                self._index()
            else:
                self._enter(np.arange(n, len(self.hash)))
            number[new] = self._found(h[new], (words[0][new], length[new], start[new], every))
        return first, number

    def _encode_waiting(self) -> None:
        if self.waiting:
            flat, length = self.encode_words(*map(np.concatenate, zip(*self.waiting, strict=True)))
            self.from_ = np.append(self.from_, (len(self.flat) + np.cumsum(length) - length).astype(np.int32))
            self.length = np.append(self.length, length.astype(np.int32))
            self.flat = np.append(self.flat, flat.astype(np.int32))
            self.waiting = []

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges a:z of texts: (a, z, ids of those texts one after the other, number of ids of each)."""
        if len(self.hash) > self.kept_words:
            self._reset()
        try:
            split = [(a, z, *self._split(texts[a:z])) for a, z in stretches(texts, self.split_bytes)]
            self._encode_waiting()
        except BaseException:  # else a later task would find pre-tokens without their ids
            self._reset()
            raise
        for a, z, number, pre_count, special, pieces in split:
            length = self.length[number]
            ids = gathered(self.flat, self.from_[number], length)
            n = np.diff(np.append(0, np.cumsum(length, dtype=np.int64))[np.append(0, np.cumsum(pre_count))])
            if (special >= 0).any():
                ids = np.insert(ids, np.cumsum(n)[special >= 0], special[special >= 0])
                n += special >= 0
            yield a, z, ids, np.add.reduceat(n, np.cumsum(pieces) - pieces)

    def _split(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each pre-token, pre-tokens of each piece, the special id after each piece or -1, pieces of each text)."""
        pieces, special = [], []  # a piece is a text, or what lies between special tokens
        counts = np.ones(len(texts), np.int64)
        for i, t in enumerate(texts):
            text = t.decode("utf-8", "replace")
            parts = self.split.split(text) if self.split and any(s in text for s in self.v.special) else (text,)
            counts[i] = (len(parts) + 1) // 2
            pieces += parts[::2]
            special += [self.v.special[s] for s in parts[1::2]]
            special.append(-1)
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))) - 1
        joined = "\0".join([*pieces, ""])
        raw = np.frombuffer(joined.encode(), np.uint8)
        try:  # most stretches have one byte per code point; in those 0 only ends texts
            if joined.count("\0") > len(pieces):
                raise ValueError("a text has the code point 0")
            chars = raw if len(raw) == len(joined) else np.frombuffer(joined.encode("latin-1"), np.uint8)
        except ValueError:
            chars = np.frombuffer(joined.encode("utf-32-le"), np.int32).copy()
            chars[ends] = 0x110000
        start, number = self._numbers(chars, raw)
        return number, np.bincount(np.searchsorted(ends, start), minlength=len(pieces)), np.array(special, np.int64), counts


#: The encoder that this Python worker keeps from task to task.
_KEPT: dict[tuple, Encoder] = {}


def kept_encoder(key: tuple, make: Callable[[], Encoder]) -> Encoder:
    """The worker's encoder for a key, which names all that it depends on; another one goes."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _lists(flat: np.ndarray, length: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(flat, kind))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", stretch_bytes: int = STRETCH_BYTES, split_bytes: int = SPLIT_BYTES, kept_words: int = KEPT_WORDS) -> DataFrame:
    """(doc_id, ids array<int>) of each whole text, as the tokenizers library encodes it without adding special tokens.

    The tokenizer file is read by the driver and broadcast (a few MB). Strings
    of special tokens inside a text become their ids. A null text is the empty
    text and has no ids; repeated rows give repeated results, an empty table an
    empty one; other columns are not read. A text longer than stretch_bytes is
    encoded whole, alone in its stretch. The sizes bound memory and change no
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, split_bytes=split_bytes, kept_words=kept_words)
        for b in batches:
            texts = b.column("text").to_pylist()
            for begin, end in stretches(texts, stretch_bytes):
                for a, z, ids, n in encoder.encode(texts[begin:end]):
                    yield pa.record_batch([b.column("doc_id").slice(begin + a, z - a), _lists(ids, n, pa.int32())], ["doc_id", "ids"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(of, "doc_id long, ids array<int>")


def _texts_of(v: Vocabulary, ids: np.ndarray, n: np.ndarray) -> list[str]:
    """What the ids of texts stand for, n of each; bytes that aren't UTF-8 become U+FFFD."""
    size = v.length[ids]
    raw = gathered(v.bytes, v.from_[ids], size).tobytes()
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n))].tolist()
    return [raw[a:z].decode("utf-8", "replace") for a, z in zip(ends[:-1], ends[1:], strict=True)]


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", stretch_bytes: int = STRETCH_BYTES, split_bytes: int = SPLIT_BYTES, kept_words: int = KEPT_WORDS) -> DataFrame:
    """(doc_id, ids, text): decode of encode, in one Python process for each task instead of two. See those for nulls and sizes."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder = Encoder(v, split_bytes=split_bytes, kept_words=kept_words)
        for b in batches:
            texts = b.column("text").to_pylist()
            for begin, end in stretches(texts, stretch_bytes):
                for a, z, ids, n in encoder.encode(texts[begin:end]):
                    yield pa.record_batch([b.column("doc_id").slice(begin + a, z - a), _lists(ids, n, pa.int32()), pa.array(_texts_of(v, ids, n), pa.string())], ["doc_id", "ids", "text"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(of, "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded (with doc_id and ids) with the text that its ids stand for: (doc_id, ids, text).

    Bytes that aren't UTF-8 become U+FFFD; null ids are no ids; ids beyond the
    vocabulary stand for nothing. Repeated rows give repeated results, an empty
    table an empty one; very long lists are decoded whole; other columns are not
    read.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                b = batch.slice(begin, 256)
                ids = b.column("ids")
                rows = []
                for k in range(b.num_rows):
                    x = ids[k].values.to_numpy(zero_copy_only=False) if ids[k].is_valid else np.zeros(0, np.int32)
                    x = x[(x >= 0) & (x < v.size)]
                    rows.append(gathered(v.bytes, v.from_[x], v.length[x]).tobytes().decode("utf-8", "replace"))
                yield pa.record_batch([b.column("doc_id"), ids, pa.array(rows, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(of, "doc_id long, ids array<int>, text string")
