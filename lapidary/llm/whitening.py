"""Whitening of embeddings by hierarchical merging of singular value decompositions.

An entry c counts as the whole number x = floor(64 * c) + 1000000. The fit list has each different x vector once. A task
that reads part of it keeps a ``Summary``: number, exact sums, and all singular values and right vectors of its centred
rows. Two summaries merge by putting their scaled vectors below each other, with one more row for the difference of their
means (root of n1 * n2 / (n1 + n2) times it), and decomposing that again: the result is the decomposition of all rows
centred by their common mean, and no dimension is cut off on the way. Squared singular values over n are the eigenvalues
of the covariance, which is never formed.

Scale: equal vectors are taken together before they are shuffled. Summaries are rows of dim * (dim + 1) doubles, one a
task, merged ``FAN`` at a time in rounds, each written to the shared folder; what reaches the driver is the model: sums,
trace and up to ``COMPONENTS`` vectors for each vector length of the table. The check of the whitened covariance runs the
same way over the stored fit list, and rows are whitened in one narrow pass.

Results by definition: a vector that is null, empty, or holds a null, a non-finite entry or one of 2**56 or more takes no
part; null and repeated ids are rows like others; vectors of different lengths are fitted apart; a component is there where its
singular value is above dim * 2.2e-16 times the largest, so that a list of one different vector has none, and its rows are
not returned; a deviation of 2**63 or more is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.store import shared_folder
from lapidary.llm.text import bounded_batches

COMPONENTS = 16
FAN = 16
SCALE, SHIFT = 64, 1_000_000
BLOCK = 2048  # rows decomposed at once
LARGEST = float(1 << 56)
_PART = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("counts", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])


@dataclass
class Summary:
    """Of whole-number rows: how many, their sums, and the decomposition of the centred rows."""

    n: int
    sums: list[int]
    s: np.ndarray
    vt: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        far = x - x[0]  # exact, and small where the rows are near each other
        d = far.astype(np.float64)
        return cls(len(x), exact_sums(x), *_decomposed(d - d.mean(axis=0)))

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        # quotients of whole numbers, rounded once
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        rows = np.concatenate([self.s[:, None] * self.vt, other.s[:, None] * other.vt, np.sqrt(self.n * (other.n / n)) * apart[None]])
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], *_decomposed(rows))

    def row(self) -> tuple[list[int], np.ndarray]:
        high = [a >> 32 for a in self.sums]
        return [self.n, *high, *(a - (h << 32) for a, h in zip(self.sums, high))], np.concatenate([self.s, self.vt.ravel()])

    @classmethod
    def back(cls, counts: list[int], values: np.ndarray) -> Summary:
        dim = (len(counts) - 1) // 2
        rank = len(values) // (dim + 1)
        return cls(counts[0], [(h << 32) + low for h, low in zip(counts[1 : dim + 1], counts[dim + 1 :])], values[:rank], values[rank:].reshape(rank, dim))


@dataclass
class Scatter:
    """Of rows of doubles: how many, their mean, and the sums of products of the centred rows."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, w: np.ndarray) -> Scatter:
        mean = w.mean(axis=0)
        return cls(len(w), mean, (w - mean).T @ (w - mean))

    def merge(self, other: Scatter) -> Scatter:
        n, apart = self.n + other.n, other.mean - self.mean
        return Scatter(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * (other.n / n)))

    def row(self) -> tuple[list[int], np.ndarray]:
        return [self.n], np.concatenate([self.mean, self.products.ravel()])

    @classmethod
    def back(cls, counts: list[int], values: np.ndarray) -> Scatter:
        k = int(np.sqrt(len(values) + 0.25))
        return cls(counts[0], values[:k], values[k:].reshape(k, k))


@dataclass
class Model:
    """Sums of the fit list, its components (rows of ``vt``) with their eigenvalues, and the trace of its covariance."""

    n: int
    sums: list[int]
    e: np.ndarray
    vt: np.ndarray
    trace: float
    identity_error: float | None = None

    @classmethod
    def of(cls, found: Summary, most: int) -> Model:
        keep = found.s[:most] > (found.s[0] if len(found.s) else 0) * len(found.sums) * np.finfo(float).eps
        vt = found.vt[:most][keep]
        sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)]) if len(vt) else np.ones(0)
        return cls(found.n, found.sums, found.s[:most][keep] ** 2 / found.n, vt * sign[:, None], float((found.s**2).sum() / found.n))

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """n * x - S over n, rounded once, and its exact sum of squares before the division."""
        far = np.abs(x).max(initial=0).item() * self.n + max(map(abs, self.sums), default=0)
        if far < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            if int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
                return d / self.n, (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, object)
        total = (d * d).sum(axis=1).tolist()
        return (d / self.n).astype(np.float64), [t if t < 1 << 63 else None for t in total]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vt.T / np.sqrt(self.e)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of up to 2**20 rows, of the upper and the lower half of the digits apart."""
    high = x >> 32
    return [(int(h) << 32) + int(low) for h, low in zip(high.sum(axis=0), (x - (high << 32)).sum(axis=0))]


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s, vt


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and whole-number vectors of the rows of each length."""
    x = batch.column("x")
    length = x.value_lengths().to_numpy()
    flat, start = x.flatten().to_numpy(), np.cumsum(length) - length
    for dim in np.unique(length):
        at = np.flatnonzero(length == dim)
        yield at, flat[start[at][:, None] + np.arange(dim)]


def _gathered(rows: DataFrame, start: Callable[[np.ndarray], Summary | Scatter | None]) -> DataFrame:
    """A row (dim, part, counts, values) for each task and vector length: what ``start`` makes of its vectors, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for _, x in _matrices(batch):
                for at in range(0, len(x), BLOCK):
                    new, dim = start(x[at : at + BLOCK]), x.shape[1]
                    if new is not None:
                        held[dim] = held[dim].merge(new) if dim in held else new
        for dim, found in held.items():
            yield _part(dim, part, found)

    return rows.mapInArrow(run, "dim int, part int, counts array<long>, values array<double>")


def _part(dim: int, part: int, found: Summary | Scatter) -> pa.RecordBatch:
    counts, values = found.row()
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([counts], pa.list_(pa.int64())), pa.array([values], pa.list_(pa.float64()))], schema=_PART)


def _merged(parts: DataFrame, kind: type, folder: str) -> DataFrame:
    """One row for each vector length, by rounds in which up to ``FAN`` neighbouring parts are merged."""
    spark = parts.sparkSession

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "counts", "values"))))
        found = kind.back(rows[0][1], np.array(rows[0][2]))
        for _, counts, values in rows[1:]:
            found = found.merge(kind.back(counts, np.array(values)))
        return pa.Table.from_batches([_part(table.column("dim")[0].as_py(), rows[0][0] // FAN, found)])

    def kept(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{folder}/{kind.__name__}-{n}")
        return spark.read.parquet(f"{folder}/{kind.__name__}-{n}")

    parts, n = kept(parts, 0), 0
    last = parts.agg(F.max("part")).first()[0] or 0
    while last:
        n, last = n + 1, last // FAN
        parts = kept(parts.groupBy("dim", F.floor(F.col("part") / FAN).alias("to")).applyInArrow(fold, parts.schema), n)
    return parts


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each vector length, from rows with a column x (``whole_numbers``)."""
    bounded_batches(rows.sparkSession)
    folder = shared_folder(rows.sparkSession, "whitening")
    rows.select("x").distinct().write.parquet(f"{folder}/list")
    different = rows.sparkSession.read.parquet(f"{folder}/list")
    found = _merged(_gathered(different, Summary.of), Summary, folder)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, counts, values in zip(*(batch.column(c).to_pylist() for c in ("dim", "counts", "values"))):
                m = Model.of(Summary.back(counts, np.array(values)), components)
                values = np.concatenate([[m.trace], m.e, m.vt.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([0], pa.int32()), pa.array([counts], pa.list_(pa.int64())), pa.array([values], pa.list_(pa.float64()))], schema=_PART)

    models = {}
    for r in found.mapInArrow(top, found.schema).collect():
        v, k = np.array(r["values"]), (len(r["values"]) - 1) // (r["dim"] + 1)
        plain = Summary.back(r["counts"], np.zeros(0))
        models[r["dim"]] = Model(plain.n, plain.sums, v[1 : k + 1], v[k + 1 :].reshape(k, r["dim"]), v[0])

    def whitened(x: np.ndarray) -> Scatter | None:
        m = models[x.shape[1]]
        return Scatter.of(m.whitened(m.centred(x)[0])) if len(m.e) else None

    for r in _merged(_gathered(different, whitened), Scatter, folder).collect():
        scatter = Scatter.back(r["counts"], np.array(r["values"]))
        models[r["dim"]].identity_error = float(np.abs(scatter.products / scatter.n - np.eye(len(scatter.mean))).max())
    return models


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, x) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    sound = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of rows (vec_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in _matrices(batch):
                m = models[x.shape[1]]
                centred, deviation = m.centred(x)
                w, k = m.whitened(centred), len(m.e)
                each = np.repeat(np.arange(len(at)), k)
                numbers = np.tile(np.arange(k), len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at[each])),
                        pa.array(numbers + 1, pa.int32()),
                        pa.array(np.full(len(each), m.n)),
                        pa.array(deviation, pa.int64()).take(pa.array(each)),
                        pa.array(w.ravel()),
                        pa.array((m.e / m.trace if k else m.e)[numbers]),
                        pa.array(np.full(len(each), np.nan if m.identity_error is None else m.identity_error)),
                    ],
                    schema=_OUT,
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
