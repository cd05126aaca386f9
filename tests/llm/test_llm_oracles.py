"""Every operator query that SQL can express, on DuckDB; the others against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargohold.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(name, spark, duck):
    same_rows(q.queries()[name](spark, SF), duck.execute(q.oracle_sql()[name]))


def documents(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op6(spark, duck):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.op6_bpe(spark, SF).collect()}
    for i, text in documents(duck):
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_op7(spark, duck):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in q.op7_token_files(spark, SF).collect()}
    start = 0
    for i, text in documents(duck):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op8(spark, duck):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op8_simhash_near_dedup(spark, SF).collect()}
    fps = [(i, plain_fingerprint(text)) for i, text in documents(duck)]
    component = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 2 and component[j] < component[i]:
                    component[i], changed = component[j], True
    assert got == {i: (f"{fp:016x}", component[i]) for i, fp in fps}


def test_op9_held_out(spark):
    """Models fitted without a fifth of the labelled rows, which then are predicted."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.filter("pmod(hash(doc_id), 5) = 0")
    chain = q.fitted_chain(docs, labels.join(held, "doc_id", "left_anti"))
    rows = q.toxicity(docs, chain).join(held, "doc_id").filter("toxic IS NOT NULL").collect()
    right = sum(r.rejected == bool(r.toxic) for r in rows)
    assert right / len(rows) >= 0.85
    clean = [r for r in rows if not r.toxic]
    assert sum(r.rejected for r in clean) / len(clean) <= 0.05
    assert all(0 <= r[f"p_{c}"] <= 1 for r in rows for c in chain.categories)
    assert [len(w) for w in chain.weights] == [len(chain.features) + k for k in range(2)]


def plain_windows(words, item):
    n = min(10, len(item))
    return {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()


def test_pipeline(spark, duck):
    """Each stage's rows against brute force over what its predecessor kept; with rows that repeat an id, a text or both, or lack an id."""
    import corpus_pipeline as cp
    from test_edges import plain_words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in cp.STAGES]
    assert len(cp.STAGES) == 5
    odd = docs.filter("doc_id < 6")
    extra = odd.unionAll(odd.filter("doc_id < 3")).unionAll(odd.withColumn("doc_id", F.lit(None).cast("long"))).unionAll(odd.withColumn("text", F.upper("text")))
    kept = docs.unionAll(extra.select(columns))
    for name, stage in cp.STAGES[:-1]:
        before = [(r.doc_id, r.text or "") for r in kept.collect()]
        kept = cp.written(stage(spark, kept, SF), "test_stage")
        assert kept.columns == columns
        after = [(r.doc_id, r.text or "") for r in kept.collect()]
        if name == names[0]:
            chain = q.fitted_chain(kept.sparkSession.createDataFrame(before, "doc_id long, text string"), spark.read.parquet(f"{SF}/labels.parquet"))
            # one text at a time, by the definition of the chain
            want = []
            for i, text in before:
                x = chain.matrix([text.encode()])[0]
                for w, b in zip(chain.weights, chain.intercepts):
                    x = np.append(x, 1 / (1 + np.exp(-float(x @ w + b))))
                if x[-1] < 0.5:
                    want.append((i, text))
            assert sorted(map(str, after)) == sorted(map(str, want))
        elif name == names[1]:
            best = {}
            for i, text in before:
                n = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                best[n] = max((x for x in (i, best.get(n)) if x is not None), default=None)
            lowered = [("".join(c.lower() if "A" <= c <= "Z" else c for c in text), i) for i, text in after]
            assert sorted(lowered, key=str) == sorted(best.items(), key=str)
        elif name == names[2]:
            fps = [plain_fingerprint(t) for _, t in before]
            group = list(range(len(before)))
            for a in range(len(before)):
                for b in range(a):
                    if (fps[a] ^ fps[b]).bit_count() <= 2 and group[a] != group[b]:
                        old, new = group[a], group[b]
                        group = [new if g == old else g for g in group]
            least = {}
            for g, (i, _) in zip(group, before):
                least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
            assert sorted(str(i) for i, _ in after) == sorted(map(str, least.values()))
        elif name == names[3]:
            items = [plain_words(t or "") for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
            windows = set().union(*(plain_windows(None, w) for w in items))
            sizes = {len(w) for w in windows}

            def clean(text):
                w = plain_words(text)
                return not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))

            assert sorted(map(str, after)) == sorted(str(x) for x in before if clean(x[1]))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, text in after:
        ids = t.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    last = cp.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last.collect()} == want
    assert {r.doc_id for r in cp.run(spark, SF).collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
