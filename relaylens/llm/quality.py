"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Every text becomes a vector of rates (symbols, capitals, repeated and distinct words, word
lengths and so on). A short text tells little about its rates, so all are drawn towards those of
ordinary prose as if ``PRIOR`` more words of it stood there, and then put on a logarithmic scale.
Each class has a mean and a covariance that is shrunk towards the pooled one and then towards a
multiple of the identity. A score is the difference of the classes' log densities, from Mahalanobis distances by Cholesky factors that are
computed once, with the classes' frequencies, through the logistic function.

Sums for means and covariances run over all labelled rows of the training part; only they reach
the driver. Null and empty texts have the vector of a text without words and are scored like any
other. A document labelled twice counts by its smallest label. If a class has no rows, all scores
are 0.5 and nothing is rejected. Repeated rows get the same score; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relaylens.llm.common import blank_words, fresh, raw_texts, remainder, written

FOLDS, HELD_OUT = 3, 1
TO_POOLED, TO_SPHERE = 0.30, 0.05  # shrinkage of the class covariances
PRIOR = 20  # words
#: What prose has of each statistic after the number of words, whatever the language.
PROSE = np.array([5.0, 2.5, 0, 0.03, 0, 0.13, 0, 0.02, 0.8, 0.97, 0, 0.35])
SYMBOLS, CAPITALS, DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))
POINTS = b".,;:!?"
FEATURES = 13


def count_of(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def vector(raw: bytes | None) -> list[float]:
    """The statistics of a text, before the transformation."""
    words = blank_words(raw) if raw else []
    if not words:
        return [0.0] * FEATURES
    n, size = len(words), len(raw)
    sizes = np.fromiter(map(len, words), np.int64, n)
    pairs = set(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [float(n), float(sizes.mean()), float(sizes.std()), count_of(raw, SYMBOLS) / n,
            count_of(raw, CAPITALS) / size, raw.count(b"!") / n, count_of(raw, POINTS) / n,
            count_of(raw, DIGITS) / size, same / n, len(set(words)) / n,
            len(pairs) / max(n - 1, 1), 1 - len(set(lines)) / max(len(lines), 1),
            float((sizes <= 3).mean())]


def transformed(x: np.ndarray) -> np.ndarray:
    """Rates drawn towards prose; lengths by their logarithm, rates by that of the rate plus a
    hundredth."""
    own = x[:, :1] / (x[:, :1] + PRIOR)
    x = np.column_stack([x[:, :1], own * x[:, 1:] + (1 - own) * PROSE])
    out = np.log(x + 0.01)
    out[:, :3] = np.log1p(x[:, :3])
    return out


def features(texts: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([vector(raw) for raw in raw_texts(batch)],
                            float).reshape(-1, FEATURES)
            ends = np.arange(0, rows.size + 1, FEATURES, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(transformed(rows).ravel()))

    return run(texts)


class Discriminant:
    """Means, log priors and cached inverse Cholesky factors of the two classes."""

    def __init__(self, sums: dict[int, np.ndarray]):
        self.classes = []
        if len(sums) < 2:
            return
        total = sum(sums.values())
        pooled = self._moments(total)[1]
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        for k in (0, 1):
            n = sums[k][-1, -1]
            mean, own = self._moments(sums[k])
            spread = (1 - TO_POOLED) * own + TO_POOLED * pooled
            spread = spread / np.outer(scale, scale)
            d = len(spread)
            spread = (1 - TO_SPHERE) * spread + (TO_SPHERE * np.trace(spread) / d + 1e-9) * np.eye(d)
            factor = np.linalg.cholesky(spread)
            inverse = np.linalg.inv(factor) / scale
            prior = np.log(n / total[-1, -1])
            self.classes.append((mean, inverse, prior - np.log(np.diag(factor)).sum()))

    @staticmethod
    def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = sums[-1, -1]
        mean = sums[-1, :-1] / n
        return mean, sums[:-1, :-1] / n - np.outer(mean, mean)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 0.5)
        logs = [constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1)
                for mean, inverse, constant in self.classes]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """From doc_id and features of all rows and the labels of the training part."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").filter(
        remainder(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(
        F.min("quality").cast("long").alias("quality"))
    width = FEATURES + 1

    def run(batches):
        sums = np.zeros((2, width, width))
        for batch in batches:
            x = np.column_stack([_matrix(batch.column(0)), np.ones(len(batch))])
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)),
                                          pa.array(sums.ravel())], ["cell", "total"])

    got = (measured.join(marks, "doc_id").select("features", "quality")
           .mapInArrow(run, "cell long, total double")
           .groupBy("cell").agg(F.sum("total").alias("total")).toPandas())
    sums = np.zeros(2 * width * width)
    sums[got["cell"].to_numpy(np.int64)] = got["total"].to_numpy()
    by = {k: m for k, m in enumerate(sums.reshape(2, width, width)) if m[-1, -1] > 0}
    return Discriminant(by)


def scores(column: Column, model: Discriminant) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.score(_matrix(batch)))

    return run(column)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for every row of ``docs``."""
    measured = written(docs.select("doc_id", features(F.col("text")).alias("features")),
                       "quality")
    model = fit(measured, labels)
    scored = measured.select("doc_id", scores(F.col("features"), model).alias("score"))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not rejected, with all their columns; texts are not shuffled."""
    measured = written(docs.select("doc_id", features(F.col("text")).alias("features")),
                       "quality")
    model, name = fit(measured, labels), fresh(docs, "score")
    return docs.withColumn(name, scores(features(F.col("text")), model)).filter(
        F.col(name) >= 0.5).drop(name)
