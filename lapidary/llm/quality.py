"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives ``FEATURES`` statistics, transformed so that they spread evenly (logarithms of sizes, square roots of
shares). Each class has a mean and a covariance, the covariance shrunk towards the pooled one and then towards a multiple of
the identity. The evidence for label 1 is the difference of the Mahalanobis log densities, taken with the classes' Cholesky
factors, which are found once on the driver and travel with the function; a logistic curve of the evidence, fitted on the
same rows' evidence histogram, makes it a score between 0 and 1.

Scale: texts never move and are read once: their statistics, ``len(FEATURES)`` numbers a row, are written under
spark.checkpoint.dir and serve learning, calibration and scoring. Only those of labelled training rows meet the labels; the
classes are learnt from sums of products, added by Spark: 2 x (p + 1)**2 numbers reach the driver, whatever the corpus. All
labelled training rows are used.

Results by definition: a null or empty text has statistics of a text without words and gets a score; a label that is not
0 or 1 or whose id is null is not learnt from; where one id has several labels the smallest counts; without training rows
of both classes every score is 0.5; equal rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.store import shared_folder
from lapidary.llm.text import Chunk, bounded_batches, chunks, windows

FEATURES = ["log_words", "mean_word", "spread_word", "symbols", "bars", "marks", "upper", "digits", "wide", "stops", "repeats", "windows", "distinct", "log_line"]
POOL_SHRINK = 0.05
IDENTITY_SHRINK = 0.02
BINS, REACH = 400, 12.0
_IS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"symbols": b"#*$%&<>@^~", "bars": b"|", "marks": b"!?", "upper": bytes(range(65, 91)), "digits": b"0123456789", "wide": bytes(range(0xC2, 0xF5)), "stops": b".,;:"}.items()}


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of features for each text."""
    texts = len(chunk)
    start, end, doc = chunk.words()
    h, chars = chunk.hashes(start, end), chunk.points(start, end).astype(float)
    per = lambda which, weight=None: np.bincount(which, weight, minlength=texts)
    n = per(doc)
    some = np.maximum(n, 1)
    total = np.maximum(per(doc, chars), 1)
    mean = total / some
    out = {"log_words": np.log1p(n), "mean_word": np.log(mean), "spread_word": np.sqrt(np.sqrt(np.maximum(per(doc, chars**2) / some - mean**2, 0)))}
    for name, flag in _IS.items():
        out[name] = np.sqrt(np.minimum(chunk.per_text(flag[chunk.buf]) / total, 1))
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    out["repeats"] = np.sqrt(per(doc[same]) / some)
    at, key = windows(h, doc, 3)
    out["windows"] = np.sqrt(1 - _distinct(doc[at], key, texts) / np.maximum(n - 2, 1).clip(min=1)) * (n > 2)
    out["distinct"] = np.log1p(_distinct(doc, h, texts)) / np.log1p(some)
    lines = chunk.per_text(chunk.buf == 0x0A) + 1
    out["log_line"] = np.log1p(n / lines)
    return np.stack([np.nan_to_num(out[f]) for f in FEATURES], axis=1)


def _distinct(doc: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return np.bincount(d[new], minlength=texts)


@dataclass
class Discriminant:
    means: np.ndarray  # class x feature
    inverse: np.ndarray  # class x feature x feature: inverses of the Cholesky factors
    constant: np.ndarray  # class: minus half the log determinant, plus the log share
    slope: float = 1.0
    offset: float = 0.0

    def evidence(self, x: np.ndarray) -> np.ndarray:
        z = [((x - m) @ i.T) for m, i in zip(self.means, self.inverse)]
        density = [c - 0.5 * (y * y).sum(axis=1) for c, y in zip(self.constant, z)]
        return np.arcsinh(density[1] - density[0])  # of one size far from the boundary too

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.evidence(x), -REACH, REACH) + self.offset, -500, 500)))


def discriminant(count: np.ndarray, first: np.ndarray, second: np.ndarray, pool: float = POOL_SHRINK, identity: float = IDENTITY_SHRINK) -> Discriminant | None:
    """From each class's count, sums and sums of products."""
    if (count < 1).any():
        return None
    p = first.shape[1]
    means = first / count[:, None]
    spread = second / count[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.tensordot(count / count.sum(), spread, 1)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    inverse, constant = [], []
    for c in (0, 1):
        cov = ((1 - pool) * spread[c] + pool * pooled) / np.outer(scale, scale)
        cov = (1 - identity) * cov + identity * np.eye(p) * max(np.trace(cov) / p, 1e-6)
        lower = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(lower) / scale)
        constant.append(-np.log(np.diag(lower)).sum() + np.log(count[c] / count.sum()))
    return Discriminant(means, np.array(inverse), np.array(constant))


def calibrate(model: Discriminant, bins: np.ndarray) -> None:
    """Fit slope and offset to counts of evidence (class x bin), by Newton steps of a logistic regression."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    n, y = bins.sum(axis=0) + 1e-9, bins[1]
    w, ridge = np.array([0.5, 0.0]), np.diag([0.1, 0.1])
    design = np.stack([x, np.ones(BINS)], axis=1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (n * p - y) + ridge @ w)
        w = w - np.clip(step, -0.2, 0.2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = max(float(w[0]), 1e-3), float(w[1])


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and features (array of double), as a table in the shared folder."""
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession, "statistics")
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            x = statistics(chunk)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([chunk.rows.column("doc_id"), lists], names=["doc_id", "features"])

    docs.mapInArrow(run, "doc_id long, features array<double>").write.parquet(path)
    return spark.read.parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fit(train: DataFrame) -> Discriminant | None:
    """Learn from rows (features, label), reading them twice."""
    p = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, p + 1, p + 1))
        for batch in batches:
            x, y = _matrix(batch.column("features")), batch.column("label").to_numpy(zero_copy_only=False)
            x = np.hstack([x, np.ones((len(x), 1))])
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "value"])

    got = np.zeros(2 * (p + 1) ** 2)
    for row in train.select("features", "label").mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        got[row["at"]] = row["value"]
    got = got.reshape(2, p + 1, p + 1)
    model = discriminant(got[:, p, p], got[:, p, :p], got[:, :p, :p])
    if model is None:
        return None

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((2, BINS))
        for batch in batches:
            x, y = _matrix(batch.column("features")), batch.column("label").to_numpy(zero_copy_only=False)
            at = np.clip((model.evidence(x) + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(int)
            for c in (0, 1):
                bins[c] += np.bincount(at[y == c], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins.size)), pa.array(bins.ravel())], names=["at", "value"])

    found = np.zeros(2 * BINS)
    for row in train.select("features", "label").mapInArrow(evidence, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        found[row["at"]] = row["value"]
    calibrate(model, found.reshape(2, BINS))
    return model


def training_rows(features: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Features and labels of the labelled rows that are not held out. ``held_out``: a Column function of the id."""
    # what is neither 0 nor 1, such as a half, is no label
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
    marks = marks.withColumn("label", F.col("label").cast("int"))
    return features.where(~held_out(F.col("doc_id"))).join(marks.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id")


def score(features: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id, evidence and score of ``featurise``'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("features"))
            found = (model.evidence(x), model.score(x)) if model else (np.zeros(len(x)), np.full(len(x), 0.5))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], names=["doc_id", "evidence", "score"])

    return features.mapInArrow(run, "doc_id long, evidence double, score double")
