"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargohold.llm import bpe, decontamination, exact_dedup, license_scan, license_texts, line_dedup, lm_scoring, simhash, token_files, toxicity, warc
from cargohold.llm.common import Words, connected_components, joined_hot

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word after word goes on " * 4000
TEXTS = [None, "", "   \n\t ", "Same text here, twice.", "same TEXT here, twice.", "é\x00ü <|endoftext|> it's 12 \U0001f600", LONG, "one\ntwo\none", "a b c d e f g h i j k l m", "x", "\n\n", "Line shared by all\nown line"]
CLASH = ["digest", "shard", "key", "n", "fp", "cell", "word", "node", "label", "component", "chunk", "bucket", "part", "at", "ids", "bytes", "salt", "of", "stays", "winner", "batch"]


def documents(spark):
    rows = [(i if i != 7 else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "x"), (50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH))


def empty(spark):
    return documents(spark).limit(0)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(spark):
    rows = exact_dedup.exact_dedup(documents(spark)).collect()
    docs = [(r.doc_id, lowered(r.text)) for r in documents(spark).collect()]
    groups = {}
    for i, t in docs:
        groups.setdefault(hashlib.sha256(t.encode()).digest(), []).append(i)
    assert len(rows) == len(docs)
    for r in rows:
        own = groups[bytes(r.digest)]
        best = max((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(own), r.doc_id == best)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_against_history(spark):
    past = spark.createDataFrame([(1, "Old"), (2, "old"), (3, "other")], "doc_id long, text string")
    new = spark.createDataFrame([(10, "OLD"), (11, "new"), (12, "New"), (13, None)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept, r.is_repeat) for r in exact_dedup.exact_dedup(new, past).collect()}
    assert got == {10: (2, False, True), 11: (12, False, False), 12: (12, True, False), 13: (13, True, False)}
    assert exact_dedup.exact_dedup(new, past.limit(0)).filter("is_repeat").count() == 0


@given(st.sets(st.binary(min_size=32, max_size=32), max_size=300), st.sets(st.binary(min_size=32, max_size=32), max_size=20))
def test_perfect_hash(keys, others):
    a = np.frombuffer(b"".join(sorted(keys)), np.uint64).reshape(-1, 4)
    h = exact_dedup.PerfectHash.built(a)
    assert sorted(h.slots(a).tolist()) == list(range(len(a)))
    b = np.frombuffer(b"".join(sorted(others)), np.uint64).reshape(-1, 4)
    assert all(-1 <= s < max(len(a), 1) for s in h.slots(b).tolist())


def test_simhash(spark):
    rows = simhash.simhash_components(documents(spark)).collect()
    assert len(rows) == documents(spark).count()
    blank = [r.component_id for r in rows if r.fp == 0]
    assert blank == [0] * len(blank) and len(blank) == 5
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_hot_keys_are_joined_where_they_are(spark):
    """Rows of a key that a third of all have, of rare keys and of keys that the table lacks."""
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, -1, id div 2) AS k")
    table = rows.filter("k <> 7").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = joined_hot(rows, table, "k", "n")
    assert found.columns == ["k", "id", "least"]
    want = rows.filter("k <> 7").join(table.drop("n"), "k")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert joined_hot(rows, table.limit(0), "k", "n").count() == 0


def test_links_are_complete(spark):
    """Chains, clusters and random fingerprints: components equal those of all pairs, at every segment width."""
    random.seed(5)
    fps = {random.getrandbits(64) for _ in range(40)}
    for start in list(fps)[:4]:
        x = start
        for _ in range(30):
            x ^= 1 << random.randrange(64)
            if random.random() < 0.5:
                x ^= 1 << random.randrange(64)
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 1, 3}
    root = {x: x for x in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b], key=lambda v: v - (1 << 64) if v >> 63 else v)
        if all(root[a] == root[b] for a in fps for b in fps if (a ^ b).bit_count() <= 2):
            break
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    true = {(min(a, b, key=signed), max(a, b, key=signed)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    for bits, most in ((1, 64), (2, 64), (4, 64), (8, 1000), (2, 2), (4, 5)):
        edges = simhash.links(df, bits, most)
        found = {(r.a % (1 << 64), r.b % (1 << 64)) for r in edges.collect()}
        assert found <= true and (most < 64 or found == true)
        got = {r.node % (1 << 64): r.component % (1 << 64) for r in connected_components(edges).collect()}
        assert all(got.get(x, x) == root[x] for x in fps)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=8), st.sampled_from([1, 2, 4, 8]), st.lists(st.integers(0, 63), max_size=2))
def test_grid_neighbours_share_a_cell(fps, bits, flips):
    """A fingerprint and one with two bits changed meet in a cell, and all that meet in a cell are within distance 2."""
    other = fps[0]
    for f in flips:
        other ^= 1 << f
    x = np.array([*fps, other], np.uint64)
    cells, i = simhash._around(simhash._cell_of(x, bits), bits)
    own = [set(cells[i == k].tolist()) for k in range(len(x))]
    assert own[0] & own[-1]
    counts = simhash.segment_popcounts(x, bits).astype(int)
    for a in range(len(x)):
        for b in range(len(x)):
            assert bool(own[a] & own[b]) == (np.abs(counts[a] - counts[b]).sum() <= 2)


@given(st.integers(0, (1 << 64) - 1), st.integers(0, (1 << 64) - 1), st.sampled_from([1, 2, 4, 8]))
def test_popcounts_bound_from_below(a, b, bits):
    p = simhash.segment_popcounts(np.array([a, b], np.uint64), bits).astype(int)
    assert np.abs(p[0] - p[1]).sum() <= (a ^ b).bit_count()


def plain_words(t):
    out, word = [], ""
    for c in lowered(t) + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


@settings(max_examples=60)
@given(st.lists(st.text(alphabet="ab Z9é-日\n\x00", max_size=40), min_size=1, max_size=5))
def test_words(texts):
    w = Words([t.encode() for t in texts], (4,))
    got = [bytes(w.buf[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in plain_words(t)]
    assert w.doc.tolist() == [i for i, t in enumerate(texts) for _ in plain_words(t)]
    assert len(set(zip(got, w.hash.tolist()))) == len(set(got)) == len(set(w.hash.tolist()))
    first, h = w.prefixes[4]
    four = Words([bytes(w.buf[w.start[i] : w.start[i] + 4]) for i in first.tolist()] or [b""])
    assert h.tolist() == Words([b" ".join(bytes(w.buf[w.start[i] : w.start[i] + 4]) for i in first.tolist())]).hash.tolist() or len(four.hash) != len(first)


def test_decontamination(spark):
    items = [(1, "a b c d e f g h i j k"), (2, "word after word goes on"), (2, "x"), (None, "x"), (4, None), (5, ""), (6, "b c d e f g h i j k l zz")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(0).alias("doc_id"))
    rows = decontamination.contamination(documents(spark), benchmark).collect()
    want = []
    for d in documents(spark).collect():
        w, hit, names = plain_words(d.text), set(), set()
        for i, t in items:
            item = plain_words(t)
            n = min(10, len(item))
            for k in range(len(item) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == item[k : k + n]:
                        hit |= set(range(p, p + n))
                        names.add("" if i is None else str(i))
        want.append((d.doc_id, len(w), len(hit), sorted(names)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_hit, r.items)) for r in rows)
    match = next(m for r in rows if r.doc_id == 8 for m in r.matches if m.item_id == "1")
    assert (match.item_word, match.doc_word, match.words) == (0, 0, 11)
    clean = decontamination.decontaminated(documents(spark), benchmark)
    assert clean.columns == documents(spark).columns and clean.count() == sum(n == 0 for _, _, n, _ in want)
    assert decontamination.contamination(documents(spark), benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.contamination(empty(spark), benchmark).count() == 0


@settings(max_examples=100)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=9), min_size=1, max_size=5))
def test_suffix_array(text, items):
    """Ranges by binary search are all occurrences, and a neighbour has the longest common prefix."""
    text, width = np.array([*text, 0], np.int32), max(map(len, items))
    order = decontamination.suffix_array(text, width)
    ids, stop = np.concatenate([np.array(w, np.int32) for w in items]), np.cumsum(list(map(len, items)))
    at = stop - list(map(len, items))
    padded = np.append(text, np.zeros(width, np.int32))
    low, high = (decontamination.searched(padded, order, ids, at, stop, past) for past in (False, True))
    for k, w in enumerate(items):
        assert sorted(order[low[k] : high[k]].tolist()) == [i for i in range(len(text)) if text[i : i + len(w)].tolist() == w]
        longest = max(next((j for j in range(len(w)) if i + j >= len(text) or text[i + j] != w[j]), len(w)) for i in range(len(text)))
        near = [order[j] for j in (low[k] - 1, low[k]) if 0 <= j < len(order)]
        assert max(decontamination._common(padded, np.array([i]), ids, at[k : k + 1], np.array([len(w)]))[0] for i in near) == longest


WORD = st.sampled_from("a b c d".split())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(WORD, max_size=12), min_size=1, max_size=4), st.lists(st.lists(WORD, max_size=9), min_size=1, max_size=6), st.integers(1, 5), st.sampled_from([1, 2]))
def test_shard_finds_every_window(docs, items, window, n_blocks):
    """Hits, items and longest matches against plain loops, for benchmarks in one block and in two."""

    class Block:
        def __init__(self, part):
            self.value = decontamination.TestItems([(str(k), " ".join(w).encode()) for k, w in part], window)

    parts = list(enumerate(items))
    s = decontamination.Shard([" ".join(w).encode() for w in docs], [Block(parts[k::n_blocks]) for k in range(n_blocks)], True, True)
    for d, w in enumerate(docs):
        hit, names = set(), set()
        for k, item in parts:
            n = min(window, len(item))
            for i in range(len(item) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == item[i : i + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(k))
        assert (s.n_hit[d], s.items[d]) == (len(hit), names)
        assert {m[0] for m in s.matches[d]} == names
        for name, i, p, n in s.matches[d]:
            item = items[int(name)]
            assert item[i : i + n] == w[p : p + n] and n >= min(window, len(item))
            assert i + n == len(item) or p + n == len(w) or item[i + n] != w[p + n]


def test_decontamination_in_blocks_and_passes(spark):
    """Many blocks, several passes, and a document longer than a shard, against one block and pass."""
    shared = " ".join(f"s{k}" for k in range(15))
    items = [(k, f"own {k} words of item {k} {shared} and {k} more") for k in range(40)] + [(99, "brief")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"x {shared} y " * 50), (2, "nothing to see"), (3, items[7][1]), (4, "so brief it is"), (5, ("filler words only " * 450_000) + items[3][1]), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = [{r.doc_id: (r.n_words, r.n_hit, r.items, sorted(map(tuple, r.matches))) for r in decontamination.contamination(docs, benchmark, **sizes).collect()} for sizes in ({}, {"block_bytes": 200, "pass_blocks": 3})]
    assert got[0] == got[1]
    assert got[0][1][1] == 15 * 50 and len(got[0][1][2]) == 40 and len(got[0][1][3]) == 40  # one match an item, however often repeated
    assert got[0][2][1:3] == (0, []) and got[0][4][1:3] == (1, ["99"]) and "3" in got[0][5][2] and got[0][6] == (0, 0, [], [])
    for sizes in ({}, {"block_bytes": 200, "pass_blocks": 3}):
        assert {r.doc_id for r in decontamination.decontaminated(docs, benchmark, **sizes).collect()} == {2, 6}


def plain_scores(texts, corpus, order, exclude):
    def grams(w):
        return Counter(tuple(w[i : i + o]) for o in range(1, order + 1) for i in range(len(w) - o + 1))

    words = [plain_words(t) for t in texts]
    total, size = sum((grams(plain_words(t)) for t in corpus), Counter()), sum(len(plain_words(t)) for t in corpus)
    for w in words:
        c = total - grams(w) if exclude else total
        n = max(size - len(w) * exclude, 1)
        s = 0.0
        for j in range(len(w)):
            factor = 0.0
            for o in range(min(order, j + 1), 1, -1):
                g = tuple(w[j - o + 1 : j + 1])
                if c[g] > 0:
                    s += factor + math.log10(c[g]) - math.log10(c[g[:-1]])
                    break
                factor += math.log10(0.4)
            else:
                s += factor + math.log10(max(c[(w[j],)], 1)) - math.log10(n)
        yield len(w), s


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, order):
    docs = documents(spark).filter("doc_id IS NULL OR doc_id <> 6")
    texts = [r.text for r in docs.collect()]
    got = sorted((r.n_words, r.score) for r in lm_scoring.lm_scores(docs, order=order).collect())
    assert np.allclose(got, sorted(plain_scores(texts, texts, order, True)))
    corpus = docs.filter("doc_id > 4")
    held = lm_scoring.lm_scores(docs, corpus, order, exclude_self=False)
    want = sorted(plain_scores(texts, [r.text for r in corpus.collect()], order, False))
    assert np.allclose(sorted((r.n_words, r.score) for r in held.collect()), want)
    assert lm_scoring.lm_scores(empty(spark), order=order).count() == 0
    if order == 3:  # many chunks, and count tables in three levels
        small = {"chunk_bytes": 40, "bucket_bytes": 60, "fan_bits": 1}
        got = sorted((r.n_words, r.score) for r in lm_scoring.lm_scores(docs, order=order, **small).collect())
        assert np.allclose(got, sorted(plain_scores(texts, texts, order, True)))
        held = lm_scoring.lm_scores(docs, corpus, order, exclude_self=False, **small)
        assert np.allclose(sorted((r.n_words, r.score) for r in held.collect()), want)


@settings(max_examples=40)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=50), st.lists(st.sampled_from([0, 0, 0, 1, 255, 256, 1 << 40]), max_size=50))
def test_packed_ngrams(keys, counts):
    keys = np.array(sorted(keys), np.uint64)
    assert np.array_equal(lm_scoring._unpacked(lm_scoring._packed(keys), len(keys)), keys)
    counts = np.array(counts, np.int64)
    assert np.array_equal(lm_scoring._unpacked_counts(lm_scoring._packed_counts(counts), len(counts)), counts)


def plain_line_dedup(texts, least):
    def keys(t):
        return [x.strip(" \t\n\x0b\x0c\r") for x in lowered(t).split("\n")]

    n = Counter(k for t in texts for k in set(keys(t)) if k)
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if not k or n[k] < least]
        yield "\n".join(kept), len(lines), len(lines) - len(kept)


def test_line_dedup(spark):
    docs = documents(spark).unionByName(documents(spark).filter("doc_id >= 10").withColumn("text", F.lit(" LINE shared by all \nother")))
    got = sorted((r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs, 2).collect())
    assert got == sorted(plain_line_dedup([r.text for r in docs.collect()], 2))
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_lines_come_back_after_deletion(spark):
    a, b = (spark.createDataFrame([(i, f"common\nown {i}") for i in ids], "doc_id long, text string") for ids in (range(5), range(5, 12)))
    lines = {k: line_dedup.chunked_lines(x) for k, x in (("a", a), ("b", b))}
    index = line_dedup.changed(line_dedup.empty_index(a, 10, 10), inserted=lines["a"])
    assert line_dedup.doomed(lines["a"], index).count() == 0
    index = line_dedup.changed(index, inserted=lines["b"])
    assert line_dedup.doomed(lines["a"], index).count() == 5
    index = line_dedup.changed(index, deleted=lines["b"])
    assert line_dedup.doomed(lines["a"], index).count() == 0
    assert index.refs.count() == 6


def test_hot_line_over_many_chunks(spark):
    """A line of every document, chunks of a document each, and rows without ids or with the same one."""
    rows = [(None if i % 3 else 5, f" Every DOCUMENT has it \nown {i}\npair {i // 2}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    lines = line_dedup.chunked_lines(docs, chunk_bytes=1)
    assert lines.groupBy("key").count().agg(F.max("count")).first()[0] == 300
    index = line_dedup.changed(line_dedup.empty_index(docs, 10, 10), inserted=lines)
    got = sorted((r.text, r.n_lines, r.n_dropped) for r in line_dedup.without_lines(docs, line_dedup.doomed(lines, index)).collect())
    assert got == sorted(plain_line_dedup([t for _, t in rows], 10)) and all(n == 1 for _, _, n in got)


def test_filter_that_overflows_is_built_anew(spark):
    """One shard whose filter was made for a few keys gets hundreds."""

    def texts(ids):
        return line_dedup.chunked_lines(spark.createDataFrame([(d, "\n".join(f"line {i}" for i in ids)) for d in range(2)], "doc_id long, text string"))

    index = line_dedup.changed(line_dedup.LineIndex(*(lambda x: (x.refs, x.filters))(line_dedup.empty_index(spark.range(1), 1)), 1, 2), inserted=texts(range(3)))
    small = index.filters.first()
    full = line_dedup.CuckooFilter(np.frombuffer(small.slots, np.uint16).reshape(-1, 4).copy())
    assert not full.insert(np.random.default_rng(3).integers(0, 1 << 64, (500, 2), np.uint64))
    index = line_dedup.changed(index, inserted=texts(range(3, 500)))
    assert index.filters.count() == 1 and len(index.filters.first().slots) > len(small.slots)
    assert line_dedup.doomed(texts(range(500)), index).selectExpr("size(keys)").collect() == [(500,), (500,)]


@settings(max_examples=25)
@given(st.integers(1, 400), st.integers(0, 2**32))
def test_cuckoo_filter(n, seed):
    keys = np.random.default_rng(seed).integers(0, 1 << 64, (n, 2), np.uint64)
    f = line_dedup.CuckooFilter.sized(n)
    assert f.insert(keys) and f.contains(keys).all()
    f.delete(keys[: n // 2])
    assert f.contains(keys[n // 2 :]).all()
    f.delete(keys[n // 2 :])
    assert not f.table.any()


def test_bpe_and_token_files(spark, tmp_path):
    t = Tokenizer.from_file(PATH)
    want = sorted((str(r.doc_id), t.encode(r.text or "", add_special_tokens=False).ids) for r in documents(spark).collect())
    encoded = bpe.encode(documents(spark), PATH)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == want
    assert sorted(r.text for r in bpe.decode(encoded, PATH).collect()) == sorted(r.text or "" for r in documents(spark).collect())
    both = bpe.round_trip(documents(spark), PATH).collect()
    assert sorted((str(r.doc_id), r.ids) for r in both) == want and sorted(r.text for r in both) == sorted(r.text or "" for r in documents(spark).collect())
    assert bpe.round_trip(empty(spark), PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [-5, 10**6, 50256])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(odd, PATH).orderBy("doc_id").collect()] == ["", "<|endoftext|>"]
    path = token_files.store_tokens(documents(spark), PATH, 2, str(tmp_path / "tokens"))
    rows = token_files.stored_documents(spark, path).orderBy("start").collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == [(i, [*x, 2]) for i, x in want]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert bpe.encode(empty(spark), PATH).count() == 0
    path = token_files.store_tokens(empty(spark), PATH, 2)
    assert token_files.stored_documents(spark, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab '\n\tsdmtrevl<|endoftext|>é12!")), max_size=60))
def test_bpe_equals_the_library(text):
    for encoder in both_encoders():
        want = CACHE["t"].encode(text, add_special_tokens=False).ids
        _, _, ids, n = next(encoder.encode([text.encode()]))
        assert ids.tolist() == want and n.tolist() == [len(want)]


CACHE: dict = {}


@settings(max_examples=50)
@given(st.lists(st.integers(0, 70000), max_size=400))
def test_wavelet_matrix(ids):
    ids = np.array(ids, np.int64)
    w = token_files.WaveletMatrix.built(ids)
    assert w.ids().tolist() == ids.tolist()
    at = np.arange(len(ids))
    assert w.access(at).tolist() == ids.tolist()
    for x in [*ids[:5].tolist(), 3]:
        assert w.occurrences(x).tolist() == np.flatnonzero(ids == x).tolist()
        assert w.rank(x, len(ids) // 2) == int((ids[: len(ids) // 2] == x).sum())


def test_wavelet_directory_over_many_blocks():
    ids = np.random.default_rng(1).integers(0, 9, 20_000)
    w = token_files.WaveletMatrix.built(ids)
    at = np.array([0, 4095, 4096, 8191, 12_345, 19_999])
    assert w.access(at).tolist() == ids[at].tolist() and w.rank(4, 12_288) == int((ids[:12_288] == 4).sum())


def test_toxicity(spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"plain words here number {i} " + ("awful" if i % 2 else "nice")) for i in range(60)], "doc_id long, text string")
    chain = toxicity.fit_chain(docs, labels, {"weak": "toxic * CAST(text LIKE '%awful%' AS INT)", "toxic": "toxic"}, ["toxic"])
    got = {r.doc_id: r.rejected for r in toxicity.toxicity(docs, chain).collect()}
    assert got == {i: bool(i % 2) for i in range(60)}
    assert toxicity.toxicity(documents(spark), chain).count() == documents(spark).count()
    assert toxicity.not_toxic(docs, chain).count() == 30
    assert toxicity.toxicity(empty(spark), chain).count() == 0
    blank = toxicity.fit_chain(docs, labels.limit(0), {"toxic": "toxic"}, ["toxic"])
    assert toxicity.toxicity(docs, blank).filter("rejected").count() == 0


def plain_features(text):
    """Counts of words and of word beginnings, of at most MOST_COUNT each."""
    n = Counter()
    for w in plain_words(text):
        n[w, "word"] += 1
        for k in toxicity.PREFIXES:
            if len(w.encode()) > k:
                n[w.encode()[:k], "beginning"] += 1
    return {f: min(c, toxicity.MOST_COUNT) for f, c in n.items()}


def plain_fit(x, y, penalty=toxicity.PENALTY):
    """Logistic regression by plain Newton steps in double precision."""
    x1, w = np.column_stack((x, np.ones(len(x)))).astype(float), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.full(x.shape[1], penalty), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 / len(x) + np.diag(ridge), x1.T @ (p - y) / len(x) + ridge * w)
        w -= step if np.abs(step).max() < 5 else step * 5 / np.abs(step).max()
    return w


def toxic_rows():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        rude, dull = rng.random() < 0.4, rng.random() < 0.5
        words = rng.choices(["river", "stone", "morning", "lantern", "window"], k=6) + rng.choices(["scoundrels", "rubbish", "river"] if rude else ["kindness", "stone"], k=2) + (["filler"] if dull else ["insight"])
        rows.append((i, " ".join(words), int(rude) if rng.random() < 0.9 else int(not rude), int(not dull) if rng.random() < 0.85 else int(dull)))
    return rows


def test_chain_equals_a_plain_refit(spark):
    """Features, out-of-fold probabilities and the chain's own against plain loops, in spite of repeated ids."""
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[5][:2], rows[6][:2]], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, t, q) for i, _, t, q in rows] + [(3, rows[3][2], rows[3][3]), (900, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    categories = {"useless": "1 - quality", "toxic": "toxic"}
    sample = toxicity.labelled_sample(docs, labels, categories, ["quality", "toxic"], n_features=10_000)
    assert len(sample.x) == 120 and set(sample.fold.tolist()) == set(range(5))
    y = np.array([(1 - q, t) for *_, t, q in rows], float)
    assert np.array_equal(sample.y, y)
    counts = [plain_features(t) for _, t, *_ in rows]

    def matrix(train):
        names = sorted({f for k in train for f in counts[k] if sum(f in counts[j] for j in train) >= toxicity.LEAST_DOCS}, key=str)
        return names, np.array([[c.get(f, 0) for f in names] for c in counts], float).reshape(len(counts), -1)

    earlier, fold = np.zeros((120, 0)), sample.fold
    chain = toxicity.fit_chain(docs, labels, categories, ["quality", "toxic"], n_features=10_000)
    got = {r.doc_id: (r.p_useless, r.p_toxic) for r in toxicity.toxicity(docs, chain).collect()}
    scored = np.zeros((120, 0))
    for k in range(2):
        oof = np.zeros(120)
        for f in range(5):
            train = np.flatnonzero(fold != f).tolist()
            names, x = matrix(train)
            assert len(names) == len(sample.chosen[f])
            w = plain_fit(np.column_stack((x, earlier))[train], y[train, k])
            held = fold == f
            oof[held] = 1 / (1 + np.exp(-(np.column_stack((x, earlier, np.ones(120)))[held] @ w)))
        assert np.abs(toxicity.out_of_fold(sample, k, earlier.astype(np.float32)) - oof).max() < 0.02
        _, x = matrix(list(range(120)))
        w = plain_fit(np.column_stack((x, earlier)), y[:, k])
        scored = np.column_stack((scored, 1 / (1 + np.exp(-(np.column_stack((x, scored, np.ones(120))) @ w)))))
        earlier = np.column_stack((earlier, oof))
    assert np.abs(np.array([got[i] for i in range(120)]) - scored).max() < 0.02


def test_no_label_has_a_part_in_its_own_prediction(spark):
    """Turning all labels of a fold around leaves that fold's features and probabilities as they are."""
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")

    def sample(turned):
        labels = spark.createDataFrame([(i, 1 - t if i in turned else t) for i, _, t, _ in rows], "doc_id long, toxic int")
        return toxicity.labelled_sample(docs, labels, {"toxic": "toxic"}, ["toxic"], n_features=4)

    a = sample(set())
    held = np.flatnonzero(a.fold == 2)
    b = sample(set(held.tolist()))
    none = np.zeros((120, 0), np.float32)
    assert np.array_equal(a.features[a.chosen[2]], b.features[b.chosen[2]])
    assert not np.array_equal(a.y, b.y) and not np.array_equal(toxicity.out_of_fold(a, 0, none), toxicity.out_of_fold(b, 0, none))
    assert np.array_equal(toxicity.out_of_fold(a, 0, none)[held], toxicity.out_of_fold(b, 0, none)[held])


def test_revisits(spark):
    rows = [
        (1, "http://www.Ex.org/a/?b=2&a=1#x", 1, "response", '"v1"', None, {"ETag": '"v1"', "Vary": "a", "X": "1"}),
        (2, "https://ex.org/a?a=1&b=2&utm_source=z", 2, "revisit", 'W/"v1"', None, {"vary": "b", "X": "2"}),
        (3, "ex.org/a?a=1&b=2", 2, "response", '"v2"', "d", None),
        (4, "ex.org/a?a=1&b=2", 3, "revisit", '"v1"', "d", None),
        (5, "ex.org/a?a=1&b=2", 3, "revisit", None, "d", {}),
        (6, "ex.org/a?a=1&b=2", 3, "revisit", None, None, None),
        (7, "ex.org/other", 3, "revisit", '"v1"', None, None),
        (8, None, 3, "revisit", '"v1"', None, None),
        (9, "ex.org/a?a=1&b=2", None, "revisit", '"v1"', None, None),
        (9, "ex.org/a?a=1&b=2", None, "response", '"v1"', None, None),
        (0, "ex.org/a?a=1&b=2", 1, "revisit", '"v1"', None, None),
        (None, "ex.org/a?a=1&b=2", 9, "metadata", None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    got = {r.record_id: (r.response_id, r.outcome) for r in warc.resolved_revisits(df.withColumn("part", F.lit(1)), merge_hosts=True).collect()}
    assert got == {2: (1, "resolved"), 4: (3, "mismatch"), 5: (3, "resolved"), 6: (3, "unverified"), 7: (None, "no_response"), 8: (None, "no_response"), 9: (None, "no_response"), 0: (None, "no_response")}
    headers = next(r.headers for r in warc.resolved_revisits(df, merge_hosts=True).collect() if r.record_id == 2)
    assert headers == {"etag": '"v1"', "vary": "b", "x": "1"}
    assert warc.resolved_revisits(df.limit(0)).count() == 0


def test_only_full_responses_answer(spark):
    rows = [(1, "a.org", 1, "response", 200, None), (2, "a.org", 2, "response", 404, None), (3, "a.org", 3, "response", 200, "length"), (4, "a.org", 4, "response", None, None), (5, "a.org", 5, "revisit", 304, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, truncated string")
    df = df.select("*", *(F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified")), F.lit(None).cast("map<string,string>").alias("headers"))
    assert [r.response_id for r in warc.resolved_revisits(df).collect()] == [1]
    assert [r.response_id for r in warc.resolved_revisits(df.drop("truncated")).collect()] == [3]
    assert [r.response_id for r in warc.resolved_revisits(df.drop("status", "truncated")).collect()] == [4]


def test_canonical_urls(spark):
    cases = {"HTTP://Ex.org:80/a/": "ex.org/a", "https://ex.org:443": "ex.org", "http://ex.org:443/": "ex.org:443", "ex.org:80": "ex.org:80", "http://www.ex.org/?ref=x&utm_id=1&b&a#f": "www.ex.org?a&b&ref=x", " ": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "u string").coalesce(1)
    assert [r[0] for r in df.select(warc.canonical_url(F.col("u"))).collect()] == list(cases.values())
    both = df.select(warc.canonical_url(F.col("u"), True, None)).collect()
    assert both[4][0] == "ex.org?a&b&ref=x&utm_id=1"


def test_hot_url_over_many_ranges(spark):
    rows = [(i, "hot.org" if i % 3 else f"cold{i % 7}.org", i // 2, "response" if i % 5 == 0 else "revisit", "t", None, None) for i in range(600)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    got = {r.record_id: r.response_id for r in warc.resolved_revisits(df, 9).collect()}
    for i, url, ts, kind, *_ in rows:
        if kind == "revisit":
            earlier = [(t, j) for j, u, t, k, *_ in rows if k == "response" and u == url and (t, j) < (ts, i)]
            assert got[i] == (max(earlier)[1] if earlier else None)


def plain_licenses(files, threshold=0.8):
    def bag(t):
        return Counter("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split())

    df = Counter(w for t, _ in files.values() for w in bag(t))
    def weigh(b):
        return {w: n * (math.log((1 + len(files)) / (1 + df[w])) + 1) for w, n in b.items()}

    def cosine(a, b):
        return sum(a[w] * b.get(w, 0) for w in a) / (math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values())))

    out = {}
    for i, (t, whole) in files.items():
        lines = (t or "").split("\n")
        units = [bag("\n".join(lines[i : i + k])) for i in range(len(lines)) for k in range(1, license_scan.LINES + 1) if i + k <= len(lines)] + [bag(t)] * whole
        best = max(((round(cosine(weigh(u), weigh(bag(x))), 6), name) for u in units if u for name, x in license_scan.TEMPLATES), default=(0, ""), key=lambda v: (v[0], [-ord(c) for c in v[1]]))
        out[i] = best[1] if best[0] >= threshold else None
    return out


def test_license_scan(spark):
    mit, apache = (next(x for n, x in license_scan.TEMPLATES if n == name) for name in ("MIT", "Apache-2.0"))
    files = [(1, "a/LICENSE", mit), (2, "a/b/c/code.py", "nothing here"), (3, "a/b/own.py", f"# {apache}\ncode"), (4, "z/x.py", None), (5, None, "text"), (6, "top.txt", ""), (7, "a/COPYING.txt", apache + " and a few more words of another kind"), (8, "a/b/almost.py", "Licensed under a tree, version of the day"), (9, "ab/y.py", "x"), (None, "a/q.py", "x")]
    df = spark.createDataFrame(files, "file_id long, path string, text string").select("*", *(F.lit(1).alias(c) for c in ("dir", "w", "unit", "license", "score", "salt", "key")))
    got = {r.file_id: r for r in license_scan.license_scan(df).collect()}
    own = plain_licenses({i: (t, i in (1, 7)) for i, _, t in files})
    assert {i: (r.license if r.origin == "own" else None) for i, r in got.items()} == own
    assert (got[2].license, got[2].origin, got[2].from_dir) == (got[1].license, "inherited", "a")
    assert got[3].license == "Apache-2.0" and got[4].origin == got[5].origin == got[6].origin == got[9].origin == "none" and got[None].origin == "inherited"
    assert license_scan.license_scan(df.limit(0)).count() == 0
    assert license_scan.license_scan(df, license_scan.template_table(spark).limit(0)).filter("license IS NOT NULL").count() == 0


def wrapped_files():
    """Notices wrapped at many widths behind comment marks, between lines of code; and whole licences under a line of names."""
    import textwrap

    rng, rows = random.Random(4), []
    code = ["import os", "def main(argv):", "    return run(argv, os.environ)", "class Reader:", "    pass  # nothing yet"]
    notices = [x for x in license_scan.TEMPLATES if 8 <= len(x[1].split()) <= 40]
    for k, (name, text) in enumerate(notices):
        for width in (60, 66, 72, 78, 100):
            mark = ("# ", " * ", "// ", "-- ")[(k + width) % 4]
            head = ["#!/usr/bin/env x", f"{mark}Copyright {2000 + k} by some people", mark]
            rows.append((len(rows), f"src/f{len(rows)}.x", "\n".join(head + textwrap.wrap(text, width, initial_indent=mark, subsequent_indent=mark) + [mark] + rng.sample(code, 4)), name))
    for k, (name, text) in enumerate(license_texts.WHOLE):
        body = "\n".join(line for p in text.split("\n") for line in (textwrap.wrap(p, 72) or [""]))
        rows.append((len(rows), f"lib{k}/LICENSE", f"Copyright (c) {1990 + k} The {name} Makers and others\n\n{body}", name))
    n = len(rows)
    rows += [(n + k, f"plain/p{k}.x", "\n".join(rng.choices(code, k=12) + ["# the version of the license file is checked below"]), None) for k in range(40)]
    return rows


def test_license_recall_on_wrapped_notices(spark):
    rows = wrapped_files()
    got = {r.file_id: r.license for r in license_scan.license_scan(spark.createDataFrame([r[:3] for r in rows], "file_id long, path string, text string")).collect()}
    right = [got[i] == name for i, _, _, name in rows if name]
    assert len(right) > 50 and sum(right) / len(right) >= 0.9
    assert all(got[i] is None for i, _, _, name in rows if not name)


def test_license_templates_beyond_what_is_sent(spark, monkeypatch):
    rows = [r[:3] for r in wrapped_files()[::3]]
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    want = sorted(map(str, license_scan.license_scan(df).collect()))
    monkeypatch.setattr(license_scan, "SENT_WORDS", 0)
    assert sorted(map(str, license_scan.license_scan(df).collect())) == want


def test_license_rows_that_share_an_id(spark):
    """Lines of different rows of one id don't mix, and the best of them counts for all."""
    apache = next(x for n, x in license_scan.TEMPLATES if n == "Apache-2.0")
    half = apache.split(" License, ")
    rows = [(1, "a", apache + "\nmore"), (1, "b", "quite other words\nare here"), (None, "c", half[0]), (None, "d", half[1]), (2, "e", apache), (2, "e", apache)]
    got = [(r.file_id, r.path, r.license) for r in license_scan.license_scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "a", "Apache-2.0"), (1, "b", "Apache-2.0"), (None, "c", None), (None, "d", None), (2, "e", "Apache-2.0"), (2, "e", "Apache-2.0")]))


def test_license_inheritance_takes_the_nearest(spark):
    mit, apache = (next(x for n, x in license_scan.TEMPLATES if n == name) for name in ("MIT", "Apache-2.0"))
    rows = [(1, "LICENSE", mit), (2, "p/q/LICENSE", apache), (3, "p/x", "x"), (4, "p/q/r/s/y", "y"), (5, "top", "t"), (6, "p/q/z", "z")]
    got = {r.file_id: (r.license, r.from_dir) for r in license_scan.license_scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert [got[i] for i in (3, 4, 5, 6)] == [("MIT", ""), ("Apache-2.0", "p/q"), ("MIT", ""), ("Apache-2.0", "p/q")]


MIXED = ["1 / d at \xe9 the caf\xe9", ". , a \u745f \u4e2d the caf\xe9 %x! !x!\0 ! !\0 %", "\u0416. end!", "x 1 (1) $5", "\u201cquoted\u201d and plain", "\U0001f600 don't internationally", "\0", "internationalisation internationalizing <|endoftext|>\0\0 %"]


def both_encoders(**sizes):
    if "v" not in CACHE:
        CACHE["v"], CACHE["t"] = bpe.Vocabulary(PATH), Tokenizer.from_file(PATH)
        with open(PATH, encoding="utf-8") as f:
            CACHE["lib"] = token_files.library_words(f.read(), CACHE["v"])
    return [bpe.Encoder(CACHE["v"], words, **sizes) for words in (None, CACHE["lib"])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(MIXED), st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab1.!% '\0\xe9\u4e2d")), max_size=20)), min_size=1, max_size=4), min_size=1, max_size=6), st.sampled_from([4, 40, 1 << 20]), st.sampled_from([3, 2_000_000]), st.sampled_from([None, 0, 3]))
def test_one_encoder_over_mixed_texts(batches, split_bytes, kept_words, hash_bits):
    """One encoder meets stretches of one byte and of four bytes a code point, forgets, and meets pre-tokens that share a hash."""
    exact = bpe.slice_hashes
    try:
        if hash_bits is not None:
            bpe.slice_hashes = lambda *a: exact(*a) & np.uint64(hash_bits)
        for encoder in both_encoders(split_bytes=split_bytes, kept_words=kept_words):
            for texts in batches:
                flat, counts = [], []
                for _, _, ids, n in encoder.encode([t.encode() for t in texts]):
                    flat += ids.tolist()
                    counts += n.tolist()
                want = [CACHE["t"].encode(t, add_special_tokens=False).ids for t in texts]
                assert counts == list(map(len, want)) and flat == [i for x in want for i in x]
    finally:
        bpe.slice_hashes = exact


def test_failed_encoding_leaves_nothing_behind():
    """What a kept encoder had begun when a task failed is forgotten."""
    encoder = both_encoders()[0]
    good = encoder.encode_words
    encoder.encode_words = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        list(encoder.encode([b"some words here"]))
    encoder.encode_words = good
    assert next(encoder.encode([b"some words"]))[2].tolist() == CACHE["t"].encode("some words", add_special_tokens=False).ids


def test_mixed_widths_through_spark(spark, tmp_path):
    """Every text once per neighbour, so that tasks meet the widths in every order, at stretches of a few bytes and of megabytes."""
    texts = [t for k in range(len(MIXED)) for t in (MIXED[k:] + MIXED[:k])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    t = Tokenizer.from_file(PATH)
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    for sizes in ({}, {"stretch_bytes": 30, "split_bytes": 10, "kept_words": 5}):
        encoded = bpe.encode(docs, PATH, **sizes)
        assert {r.doc_id: r.ids for r in encoded.collect()} == want
        assert {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()} == dict(enumerate(texts))
        assert {r.doc_id: (r.ids, r.text) for r in bpe.round_trip(docs, PATH, **sizes).collect()} == {i: (want[i], x) for i, x in enumerate(texts)}
    for shard_tokens in (7, 1 << 20):
        path = token_files.store_tokens(docs, PATH, 2, str(tmp_path / f"t{shard_tokens}"), shard_tokens=shard_tokens)
        rows = token_files.stored_documents(spark, path).orderBy("doc_id").collect()
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: [*x, 2] for i, x in want.items()}
        assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_wavelet_select_over_many_blocks():
    ids = np.random.default_rng(2).integers(0, 5, 50_001)
    ids[20_000:30_000] = 3
    w = token_files.WaveletMatrix.built(ids)
    for x in range(5):
        assert np.array_equal(w.occurrences(x), np.flatnonzero(ids == x))
        assert [w.rank(x, at) for at in (0, 1, 4096, 30_000, 50_001)] == [int((ids[:at] == x).sum()) for at in (0, 1, 4096, 30_000, 50_001)]
