"""Toxicity by a classifier chain.

The categories are predicted one after the other. Each is a linear model on word
counts and on the probabilities of the categories before it; in training these
are out-of-fold predictions, so a later model learns from probabilities as
imperfect as those it meets in use.

Features are counts of words and of word beginnings, which carry the stems of
inflected languages. Which of them count is chosen by a chi-squared test over a
bounded sample of labelled rows, and for the out-of-fold predictions of each
fold over the other folds alone, so no label has a part in its own prediction.
The models are a few kilobytes and go to the tasks with the code. Scoring covers
every document and moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import Words, id_and_bytes, stretches, written
from cargohold.llm.decontamination import SHARD_BYTES

#: Labelled rows that a model is fitted on, at most: those whose doc_ids hash lowest.
MAX_ROWS = 12_000
FOLDS, MOST_COUNT, PENALTY = 5, 4, 1e-4
#: Features of a model, and labelled rows that a feature must have. Defaults of fit_chain.
FEATURES, LEAST_DOCS = 128, 8
#: Bytes of word beginnings.
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.5
_PREFIX_SALT = np.uint64(0xA5A5_5A5A_1234_8765)


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) of whole words, then of word beginnings of each length."""
    yield words.doc, words.hash
    for n in PREFIXES:
        at, h = words.prefixes[n]
        yield words.doc[at], h ^ _PREFIX_SALT


@dataclass
class Chain:
    """features: sorted hashes. weights[k]: of the features and the categories before k; intercepts[k]."""

    categories: list[str]
    features: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def matrix(self, texts: list[bytes]) -> np.ndarray:
        """Counts of the features in each text, MOST_COUNT at most."""
        words = Words(texts, PREFIXES)
        n = len(self.features)
        sieve = np.zeros(1 << 16, np.bool_)
        sieve[self.features >> np.uint64(48)] = True
        cells = [np.zeros(0, np.int64)]
        for doc, h in _features(words):
            some = np.flatnonzero(sieve[h >> np.uint64(48)])
            at = np.minimum(np.searchsorted(self.features, h[some]), max(n - 1, 0))
            same = self.features[at] == h[some] if n else np.zeros(0, np.bool_)
            cells.append(doc[some][same] * n + at[same])
        counts = np.bincount(np.concatenate(cells), minlength=len(texts) * n).reshape(len(texts), n)
        return np.minimum(counts, MOST_COUNT).astype(np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, categories), each from the features and the probabilities before it."""
        for w, b in zip(self.weights, self.intercepts, strict=True):
            x = np.column_stack((x, _sigmoid(x @ w + b)))
        return x[:, len(self.features) :]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).astype(np.float32)


def _fitted(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, most: int = 25) -> np.ndarray:
    """Logistic regression with an L2 penalty by Newton's method: weights, then the intercept."""
    x1 = np.column_stack((x, np.ones(len(x), np.float32)))
    n, d = max(len(x), 1), x1.shape[1]
    ridge = np.full(d, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(d)

    def loss(w: np.ndarray) -> float:
        z = (x1 @ w.astype(np.float32)).astype(np.float64)
        return float((np.logaddexp(0, z) - y * z).sum() / n + (ridge * w * w).sum() / 2)

    now = loss(w)
    for _ in range(most):
        p = _sigmoid(x1 @ w.astype(np.float32))
        slope = (x1.T @ (p - y)).astype(np.float64) / n + ridge * w
        curve = (x1.T @ (x1 * (p * (1 - p))[:, None])).astype(np.float64) / n + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-3 and (next_ := loss(w - size * step)) > now:
            size /= 2
        gain, now = now - next_, min(now, next_)
        if gain < 1e-6:
            break
        w = w - size * step
    return w


@dataclass
class Sample:
    """The labelled rows that a chain is fitted on, in order of their ids.

    x: counts of all candidate features. y: a column per category. fold: of each
    row. chosen[f]: the features chosen without fold f; chosen[FOLDS]: by all rows.
    """

    features: np.ndarray
    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    chosen: list[np.ndarray]


def out_of_fold(sample: Sample, k: int, earlier: np.ndarray) -> np.ndarray:
    """For each row the probability of category k by a model of the other folds' rows, on the features chosen by those and on `earlier`."""
    out = np.zeros(len(sample.x), np.float32)
    for f in range(FOLDS):
        held = sample.fold == f
        if not held.any() or held.all():
            continue
        x = np.column_stack((sample.x[:, sample.chosen[f]], earlier))
        w = _fitted(x[~held], sample.y[~held, k])
        out[held] = _sigmoid(x[held] @ w[:-1].astype(np.float32) + w[-1])
    return out


def _chain(categories: list[str], sample: Sample) -> Chain:
    every = sample.chosen[FOLDS]
    chain, earlier = Chain(categories, sample.features[every]), np.zeros((len(sample.x), 0), np.float32)
    for k in range(len(categories)):
        x = np.column_stack((sample.x[:, every], earlier))
        full = _fitted(x, sample.y[:, k]) if len(x) else np.append(np.zeros(x.shape[1]), -30.0)
        chain.weights.append(full[:-1].astype(np.float32))
        chain.intercepts.append(float(full[-1]))
        earlier = np.column_stack((earlier, out_of_fold(sample, k, earlier)))
    return chain


def _chosen(with_: DataFrame, rows: np.ndarray, sums: np.ndarray, n_features: int, least_docs: int) -> list[np.ndarray]:
    """The hashes of the features with the largest chi-squared against any category: without each fold, then by all rows.

    with_: h, and of the rows that have it their number m and labels s0, s1, ...
    in each fold. rows and sums: the same of all rows. At most FOLDS + 1 times
    n_features numbers come to the driver.
    """
    out = []
    for left_out in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left_out]
        n, m = float(rows[folds].sum()), sum((F.col(f"m_{f}") for f in folds), F.lit(0)).cast("double")
        scores = [F.lit(0.0)]
        for k in range(sums.shape[1]):  # n * (a*d - b*c)**2 / product of the margins
            a, c = sum((F.col(f"s{k}_{f}") for f in folds), F.lit(0)).cast("double"), F.lit(float(sums[folds, k].sum()))
            margins = m * (n - m) * c * (n - c)
            scores.append(F.when(margins > 0, F.pow(a * n - m * c, 2) / margins).otherwise(0.0))
        best = with_.select("h", m.alias("m"), F.greatest(*scores, F.lit(0.0)).alias("score")).filter(F.col("m") >= least_docs).orderBy(F.desc("score"), "h").limit(n_features)
        out.append(np.sort(np.array([r.h for r in best.select("h").collect()], np.int64).view(np.uint64)))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], label_cols: list[str], max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", n_features: int = FEATURES, least_docs: int = LEAST_DOCS) -> Sample:
    """The rows that fit_chain fits on; see there."""
    used = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*label_cols).alias("own")).filter(" AND ".join(f"own.`{c}` IS NOT NULL" for c in label_cols) + " AND doc_id IS NOT NULL")
    sample = used.groupBy("doc_id").agg(F.min("own").alias("own")).select("doc_id", F.xxhash64("doc_id").alias("h"), "own.*").orderBy("h", "doc_id").limit(max_rows).drop("h")
    ys = [f"y{k}" for k in range(len(categories))]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, z in stretches(texts, SHARD_BYTES):
                pairs = [np.stack((doc.astype(np.uint64), h)) for doc, h in _features(Words(texts[a:z], PREFIXES))]
                pairs = np.concatenate(pairs, axis=1)
                by = np.lexsort((pairs[1], pairs[0]))
                doc, h = pairs[0][by], pairs[1][by]
                new = np.flatnonzero(np.diff(doc, prepend=np.uint64(1 << 62)).astype(np.bool_) | np.diff(h, prepend=np.uint64(0)).astype(np.bool_))
                n = np.minimum(np.diff(np.append(new, len(h))), MOST_COUNT)
                doc, h = doc[new].astype(np.int64), h[new]
                cut = np.searchsorted(doc, np.arange(z - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (h.view(np.int64), n.astype(np.int8))]
                yield pa.record_batch([*(b.column(c).slice(a, z - a) for c in ("doc_id", "fold", *ys)), *lists], ["doc_id", "fold", *ys, "h", "n"])

    text = id_and_bytes(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")  # max_rows rows of numbers
    # of documents that share an id the one whose text hashes lowest
    text = text.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("of"), F.col("text").alias("bytes"), *label_cols)).alias("b")).select("doc_id", "b.*")
    text = text.withColumn("text", F.col("bytes").cast("string")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    text = text.select("doc_id", "fold", *(F.expr(e).cast("int").alias(y) for e, y in zip(categories.values(), ys, strict=True)), F.col("bytes").alias("text")).dropna()
    kind = f"doc_id long, fold int, {', '.join(f'{y} int' for y in ys)}, h array<long>, n array<byte>"
    rows = written(text.mapInArrow(extract, kind), "toxicity_sample")
    total = {r.fold: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).collect()}
    n = np.array([total[f].n if f in total else 0 for f in range(FOLDS)])
    sums = np.array([[total[f][y] if f in total else 0 for y in ys] for f in range(FOLDS)]).reshape(FOLDS, len(ys))
    own = [F.when(F.col("fold") == f, v).otherwise(0) for v in (F.lit(1), *map(F.col, ys)) for f in range(FOLDS)]
    names = [f"{v}_{f}" for v in ("m", *(f"s{k}" for k in range(len(ys)))) for f in range(FOLDS)]
    with_ = rows.select("fold", *ys, F.explode("h").alias("h")).groupBy("h").agg(*(F.sum(x).alias(c) for x, c in zip(own, names, strict=True)))
    with_ = written(with_.filter(sum((F.col(f"m_{f}") for f in range(FOLDS)), F.lit(0)) >= least_docs), "toxicity_features")
    best = _chosen(with_, n, sums, n_features, least_docs)
    features = np.unique(np.concatenate(best))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for h, c in zip(b.column("h"), b.column("n"), strict=True):
                h = h.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(features, h), max(len(features) - 1, 0))
                same = features[at] == h if len(features) else np.zeros(len(h), np.bool_)
                row = np.zeros(len(features), np.uint8)
                row[at[same]] = c.values.to_numpy()[same]
                cells.append(row.tobytes())
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "fold", *ys)), pa.array(cells, pa.binary())], ["doc_id", "fold", *ys, "x"])

    got = rows.mapInArrow(thinned, f"doc_id long, fold int, {', '.join(f'{y} int' for y in ys)}, x binary").orderBy("doc_id").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.uint8).reshape(got.num_rows, len(features)).astype(np.float32)
    y = np.stack([got[c].to_numpy() for c in ys], axis=1).astype(np.float32)
    return Sample(features, x, y, got["fold"].to_numpy(), [np.searchsorted(features, b) for b in best])


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], label_cols: list[str], max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", n_features: int = FEATURES, least_docs: int = LEAST_DOCS) -> Chain:
    """A chain over categories, in that order.

    categories: of each a name and its 0/1 label, in SQL over label_cols (columns
    of labels) and `text`. Of the labelled rows (no label_cols null) the max_rows
    whose ids hash lowest are used, which bounds what is broadcast and what comes
    to the driver; only their texts are looked at. Each model has the n_features
    features with the largest chi-squared against any category, of those in
    least_docs labelled rows or more; counts end at MOST_COUNT.

    Repeated ids count once: of labels the least, of documents the text that
    hashes lowest. Ids without a document don't count, nor rows with a null id
    or category. Very long texts count whole. Without any labelled row every
    probability is about zero.
    """
    return _chain(list(categories), labelled_sample(docs, labels, categories, label_cols, max_rows, id_col, text_col, n_features, least_docs))


def toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, p_<category> of each category, rejected.

    rejected: the last category's probability is `threshold` or more. A null
    text is the empty text; repeated rows give repeated results, an empty table
    an empty one; very long texts are scored whole; other columns are not read.
    """
    names = [f"p_{c}" for c in chain.categories]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, z in stretches(texts, SHARD_BYTES):
                p = chain.probabilities(chain.matrix(texts[a:z])).astype(np.float64)
                yield pa.record_batch([b.column("doc_id").slice(a, z - a), *map(pa.array, np.ascontiguousarray(p.T)), pa.array(p[:, -1] >= threshold)], ["doc_id", *names, "rejected"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(of, f"doc_id long, {', '.join(f'`{n}` double' for n in names)}, rejected boolean")


def not_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns unchanged, that the chain doesn't reject.

    Null and empty texts are scored as such; rows that repeat stay or go alike;
    an empty table gives an empty result; very long texts are scored whole.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(text_col).cast(pa.binary()).to_pylist()]
            for a, z in stretches(texts, SHARD_BYTES):
                p = chain.probabilities(chain.matrix(texts[a:z]))[:, -1]
                yield b.slice(a, z - a).filter(pa.array(p < threshold))

    return docs.mapInArrow(of, docs.schema)
