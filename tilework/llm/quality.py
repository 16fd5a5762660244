"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text gives a few statistics of its bytes, words and lines, transformed to be roughly normal.
A model is fitted on FIT_ROWS labelled rows at most, those with the least hash of their ids; their ids
are broadcast, so no text is shuffled. The class moments (counts, sums, products) of FOLDS folds are
added up inside the tasks and then by Spark, so the driver gets a fixed number of values. Each class
covariance is shrunk towards the pooled one and that towards its mean variance; of a grid of such
shrinkages the pair is taken under which the folds, each left out in turn, are likeliest, which their
moments tell. A Cholesky factor is computed once and travels with the task. A score is the logistic
of the difference of the classes' log densities.

Defined results: null and empty texts have statistics of zeros and get a score like any other;
labels other than 0 and 1, and labels of unknown documents, are not used; a document labelled more
than once counts for each label; without labels of both classes every score is the share of ones
(0.5 without labels); rows that repeat get equal scores. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.textkit import text_slices, words

#: Labelled rows that a model is fitted on at most, and folds that choose its shrinkage.
FIT_ROWS, FOLDS = 20_000, 4
#: Shrinkages that are tried: of a class's covariance to the pooled one, of that to its mean variance.
TO_POOLED, TO_SPHERE = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7), (0.001, 0.005, 0.02, 0.05, 0.1, 0.3)
#: A document is predicted to be of label 1 from this score on.
THRESHOLD = 0.3

_UPPER, _DIGIT, _SPACE, _NEWLINE, _SYMBOL, _STOP, _WIDE, _LETTER = range(8)
_KIND = np.full(256, _SYMBOL)
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[0x0A, 0x0B, 0x0C, 0x0D]] = _NEWLINE
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = _STOP
_KIND[128:] = _WIDE

FEATURES = ["length", "upper", "digit", "space", "newline", "symbol", "stop", "wide", "word_length", "short_words", "distinct", "repeats", "words_per_line", "capital_starts"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slice."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 8 + _KIND[data], minlength=8 * n).reshape(n, 8).astype(float)
    w = words(data, offsets, lower=False)
    h, count = w.hashes(), w.counts
    wide = np.maximum(count, 1)
    length = w.end - w.start
    order = np.lexsort((h, w.row))
    hs, rs = h[order], w.row[order]
    new = np.ones(len(hs), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    per_word = lambda x: np.bincount(w.row, weights=x, minlength=n) / wide
    share = np.sqrt(kinds / np.maximum(size, 1)[:, None])  # sqrt makes the variance of a share steadier
    return np.column_stack(
        [
            np.log1p(size),
            share[:, _UPPER],
            share[:, _DIGIT],
            share[:, _SPACE],
            share[:, _NEWLINE],
            share[:, _SYMBOL],
            share[:, _STOP],
            share[:, _WIDE],
            np.log1p(per_word(length)),
            per_word(length <= 3),
            np.bincount(rs, weights=new, minlength=n) / np.sqrt(wide),
            np.sqrt(per_word(again)),
            np.log1p(count / (kinds[:, _NEWLINE] + 1)),
            per_word(_KIND[w.data[w.start]] == _UPPER),
        ]
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns of keep, x): the statistics of every text."""
    names = [id_col, *keep]

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(len(names))):
                x = statistics(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(len(names))), flat], names=[*names, "x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*(F.col(c) for c in names), F.col(text_col)).mapInArrow(run, f"{kinds}, x array<double>")


@dataclass
class Discriminant:
    """Per class: log prior less half the log determinant, mean, inverse Cholesky factor."""

    base: float
    center: np.ndarray
    spread: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray]] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.base)
        z = (x - self.center) / self.spread
        low, high = (c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for c, m, f in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -40, 40)))


@dataclass
class Moments:
    """Per class: the number of rows, their sums, and the sums of their products."""

    n: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(flat: np.ndarray) -> Moments:
        p = len(FEATURES)
        return Moments(flat[:, 0], flat[:, 1 : p + 1], flat[:, p + 1 :].reshape(2, p, p))

    def cov(self, c: int, center: np.ndarray) -> np.ndarray:
        """Mean products of a class's differences from a center."""
        m = self.sums[c] / self.n[c]
        return self.products[c] / self.n[c] - np.outer(m, center) - np.outer(center, m) + np.outer(center, center)


def _densities(m: Moments, spread: np.ndarray, to_pooled: float, to_sphere: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, Cholesky factor) of each class, in units of spread."""
    means, p = [m.sums[c] / m.n[c] for c in (0, 1)], len(spread)
    covs = [m.cov(c, means[c]) / np.outer(spread, spread) for c in (0, 1)]
    pooled = (m.n[0] * covs[0] + m.n[1] * covs[1]) / m.n.sum()
    out = []
    for c in (0, 1):
        cov = (1 - to_pooled) * covs[c] + to_pooled * pooled
        cov = (1 - to_sphere) * cov + to_sphere * max(np.trace(cov) / p, 1e-6) * np.eye(p)
        out.append((means[c], np.linalg.cholesky(cov)))
    return out


def _likelihood(m: Moments, spread: np.ndarray, densities: list) -> float:
    """The sum of the log densities of the rows that the moments are of, each under its own class, less a constant."""
    total = 0.0
    for c, (mean, factor) in enumerate(densities):
        if m.n[c]:
            z = np.linalg.solve(factor, m.cov(c, mean) / np.outer(spread, spread))
            total -= m.n[c] * (np.log(factor.diagonal()).sum() + 0.5 * np.trace(np.linalg.solve(factor.T, z.T)))
    return total


def discriminant(folds: np.ndarray) -> Discriminant:
    """The model from the moments of each fold and class: (folds, 2, 1 + p + p * p)."""
    p, total = len(FEATURES), Moments.of(folds.sum(axis=0))
    n = total.n
    if not n.all():
        return Discriminant(float((n[1] + 1) / (n.sum() + 2)) if n.sum() else 0.5, np.zeros(p), np.ones(p), None)
    center = total.sums.sum(axis=0) / n.sum()
    spread = np.sqrt(np.maximum(total.products.sum(axis=0).diagonal() / n.sum() - center**2, 0))
    spread[spread < 1e-9] = 1.0
    rests = [(Moments.of(folds.sum(axis=0) - f), Moments.of(f)) for f in folds]
    rests = [(rest, own) for rest, own in rests if rest.n.all() and own.n.any()]
    fits = lambda pair: sum(_likelihood(own, spread, _densities(rest, spread, *pair)) for rest, own in rests)
    best = max(((a, b) for a in TO_POOLED for b in TO_SPHERE), key=fits)
    classes = []
    for c, (mean, factor) in enumerate(_densities(total, spread, *best)):
        classes.append((float(np.log(n[c] / n.sum()) - np.log(factor.diagonal()).sum()), (mean - center) / spread, np.linalg.inv(factor)))
    return Discriminant(float(n[1] / n.sum()), center, spread, classes)


def fit(labelled: DataFrame, id_col: str = "doc_id") -> Discriminant:
    """From (id, x, y) rows, y 0 or 1."""
    p = len(FEATURES)

    def moments(batches):
        sums = np.zeros((FOLDS, 2, 1 + p + p * p))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for f in range(FOLDS):
                for c in (0, 1):
                    own = x[(y == c) & (fold == f)]
                    sums[f, c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.argwhere(sums)
        yield pa.RecordBatch.from_arrays([*(pa.array(at[:, i], pa.int32()) for i in range(3)), pa.array(sums[tuple(at.T)])], names=["fold", "y", "at", "value"])

    total = np.zeros((FOLDS, 2, 1 + p + p * p))
    fold = F.pmod(F.xxhash64(F.col(id_col)), F.lit(FOLDS)).cast("int").alias("fold")
    # folds times two classes times the number of moments, whatever the input's size
    for f, y, at, value in labelled.select("x", F.col("y").cast("int").alias("y"), fold).mapInArrow(moments, "fold int, y int, at int, value double").groupBy("fold", "y", "at").agg(F.sum("value")).collect():
        total[f, y, at] = value
    return discriminant(total)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = FIT_ROWS) -> Discriminant:
    """A model from the labels of documents that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
    sample = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id", "y").limit(most))  # at most FIT_ROWS small rows
    labelled = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(sample, "__id")
    return fit(document_statistics(labelled, "__id", "text", ("y",)), "__id")


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores at least the threshold, in one pass without a shuffle."""
    where = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(where)):
                good = model.score(statistics(data, offsets)) >= threshold
                yield batch.slice(first, end - first).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def score_texts(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every text, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(model.score(statistics(data, offsets)))], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
