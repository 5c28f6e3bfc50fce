"""Embedding whitening.

Moments are gathered by Welford's rank-one updates, one vector at a time inside every partition,
and merged between partitions by the parallel update formula, several at a time until one is
left. Householder reflections and symmetric QR steps solve the covariance's eigenproblem; what
goes to the driver is one matrix of dimension x dimension, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, stored, table


@dataclass(frozen=True)
class WhitenParams:
    """scale: entries are floored after this factor. components: at most so many are returned. fan_in:
    partial moments merged at a time. rank_tolerance: a component with a smaller share of the
    largest eigenvalue carries rounding alone and isn't whitened."""

    scale: int = 256
    components: int = 4
    fan_in: int = 16
    rank_tolerance: float = 1e-13


MOMENTS = T.StructType([T.StructField("part", T.LongType()), T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("spread", T.ArrayType(T.DoubleType())), T.StructField("total", T.ArrayType(T.DecimalType(38, 0)))])
_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64())), ("total", pa.list_(pa.decimal128(38, 0)))])


@dataclass
class Moments:
    """Count, mean, sum of outer products of deviations, and exact sums of whole numbers."""

    n: int
    mean: np.ndarray
    spread: np.ndarray
    total: list[int]

    @classmethod
    def none(cls, dim: int) -> Moments:
        return cls(0, np.zeros(dim), np.zeros((dim, dim)), [0] * dim)

    def update(self, rows: np.ndarray) -> None:
        """Welford's update by every row in turn."""
        for x in rows.astype(np.float64):
            self.n += 1
            delta = x - self.mean
            self.mean += delta / self.n
            self.spread += np.outer(delta, x - self.mean)
        if rows.dtype == np.int64 and len(rows):
            small = float(np.abs(rows.astype(np.float64)).max()) * len(rows) < 2.0**62
            sums = rows.sum(0) if small else rows.astype(object).sum(0)
            self.total = [a + int(b) for a, b in zip(self.total, sums, strict=True)]

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        n = self.n + other.n
        if not n:
            return
        delta = other.mean - self.mean
        self.spread += other.spread + np.outer(delta, delta) * (self.n * other.n / n)
        self.mean = self.mean + delta * (other.n / n)
        self.n = n
        self.total = [a + b for a, b in zip(self.total, other.total, strict=True)]

    def covariance(self) -> np.ndarray:
        """With divisor n; symmetric to the last digit."""
        return (self.spread + self.spread.T) / (2 * self.n)

    def row(self, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"part": part, "n": self.n, "mean": self.mean.tolist(), "spread": self.spread.ravel().tolist(), "total": self.total}], schema=_ARROW)

    @classmethod
    def of(cls, row: dict) -> Moments:
        dim = len(row["mean"])
        return cls(row["n"], np.array(row["mean"], float), np.array(row["spread"], float).reshape(dim, dim), [int(v) for v in row["total"]])


def _matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), dim)


def gather_moments(vectors: DataFrame, column: str, dim: int, params: WhitenParams) -> Moments:
    """Moments of all vectors of a column of ``dim`` numbers each (longs or doubles, none null)."""
    kind = np.int64 if isinstance(vectors.schema[column].dataType.elementType, T.LongType) else np.float64

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Moments.none(dim)
        for batch in batches:
            held.update(_matrix(batch.column(0), dim, kind))
        if held.n:
            yield held.row(TaskContext.get().partitionId())

    def merged(key: tuple, group: pa.Table) -> pa.Table:
        held = Moments.none(dim)
        for at in range(group.num_rows):  # fan_in rows
            held.merge(Moments.of(group.slice(at, 1).to_pylist()[0]))
        return pa.Table.from_batches([held.row(key[0].as_py())])

    size = max(2, params.fan_in)
    made = stored(vectors.select(column).mapInArrow(partial, MOMENTS), "moments")
    while (made.agg(F.max("part")).first()[0] or 0) >= size:  # a row for each partition at first, a fan_in-th each time
        above = stored(made.withColumn("part", F.floor(F.col("part") / size)).groupBy("part").applyInArrow(merged, MOMENTS), "moments")
        discard(made)
        made = above
    held = Moments.none(dim)
    for row in made.orderBy("part").toLocalIterator():  # fan_in rows at most
        held.merge(Moments.of(row.asDict()))
    discard(made)
    return held


def _tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and the orthogonal matrix of Householder reflections that lead there."""
    a, q = v.copy(), np.eye(len(v))
    for k in range(len(v) - 2):
        x = a[k + 1 :, k].copy()
        tail = np.linalg.norm(x[1:])
        if not tail:
            continue
        x[0] += math.copysign(math.hypot(x[0], tail), x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns, by implicit symmetric QR steps with Wilkinson's shift."""
    d, e, q = _tridiagonal(v)
    high = len(d) - 1
    for _ in range(60 * max(1, len(d))):
        small = np.abs(e) <= np.finfo(float).eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[small] = 0.0
        while high > 0 and e[high - 1] == 0.0:
            high -= 1
        if high <= 0:
            break
        low = high - 1
        while low > 0 and e[low - 1] != 0.0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # the bulge goes down the band
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            a, b, g = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * a + 2 * c * s * b + s * s * g, s * s * a - 2 * c * s * b + c * c * g
            e[k] = c * s * (g - a) + (c * c - s * s) * b
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[:, k], q[:, k + 1] = c * q[:, k] + s * q[:, k + 1], c * q[:, k + 1] - s * q[:, k]
    else:
        raise ArithmeticError("the QR steps did not converge")
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def quantised(vectors: DataFrame, vector_col: str, params: WhitenParams) -> tuple[DataFrame, int]:
    """The rows with a usable vector, ``__x`` its floored entries, and the vectors' dimension.

    Null and empty vectors, and those with null or non-finite entries, are dropped. All others
    have one dimension; should there be several, the most frequent one stays (the largest on ties).
    """
    entries = F.col(f"`{vector_col}`").cast("array<double>")
    usable = (F.size(entries) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter(F.coalesce(usable, F.lit(False)))
    sizes = kept.groupBy(F.size(f"`{vector_col}`").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    dim = sizes["dim"] if sizes else 0
    floored = F.transform(entries, lambda c: F.floor(c * float(params.scale)).cast("long"))
    return kept.filter(F.size(f"`{vector_col}`") == dim).withColumn("__x", floored), dim


@dataclass
class Whitening:
    """A fitted transform: count and sums of the fit list, unit components, their eigenvalues, the trace."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.total])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre()) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
        most = max(float(np.abs(x.astype(np.float64)).max(initial=0)) * self.n, max(abs(s) for s in self.total)) * 2
        if most * most * len(self.total) < 2.0**62:
            return ((self.n * x - np.array(self.total, np.int64)) ** 2).sum(1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.total, object)) ** 2).sum(1).tolist()
        return [v if v < 2**63 else None for v in exact]


def fit_whitening(fit_list: DataFrame, dim: int, params: WhitenParams) -> Whitening:
    """Fit on a column ``__x`` of longs, and measure on it how far the whitened covariance is from the identity."""
    held = gather_moments(fit_list, "__x", dim, params)
    values, components = symmetric_eigen(held.covariance()) if held.n else (np.zeros(dim), np.eye(dim))
    good = min(params.components, int((values > params.rank_tolerance * values[0]).sum())) if held.n else 0
    made = Whitening(held.n, held.total, components[:, :good], values[:good], float(np.trace(held.covariance())) if held.n else 0.0)
    if good:

        def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = made.project(_matrix(batch.column(0), dim, np.int64))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, good), pa.int32()), pa.array(w.ravel()))], names=["w"])

        again = gather_moments(fit_list.select("__x").mapInArrow(white, "w array<double>"), "w", good, params)
        made.identity_error = float(np.abs(again.covariance() - np.eye(good)).max())
    return made


def whiten(vectors: DataFrame, params: WhitenParams = WhitenParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(<id_col>, component, n, deviation, whitened, explained, identity_error)``: a row for each usable vector and component.

    The transform is fitted on the distinct floored vectors, so copies don't weigh; it is applied
    to all rows, repeated ones and null ids too. For what is dropped see :func:`quantised`. Where
    the covariance has a lower rank (equal vectors, few of them, constant entries) only the
    components with variance are returned, none for a single vector. An empty table gives no
    rows. Other columns are not read. A deviation beyond 64 bits is null.
    """
    rows, dim = quantised(vectors.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{vector_col}`").alias("__vector")), "__vector", params)
    schema = T.StructType([
        T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    fit_list = stored(rows.select("__x").distinct(), "whitening-fit")
    made = fit_whitening(fit_list, dim, params)
    discard(fit_list)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(made.values)
        for batch in batches:
            x = _matrix(batch.column(1), dim, np.int64)
            at = np.repeat(np.arange(len(x)), k)
            numbers = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(at), made.n)]
            shares = [np.tile(made.values / made.trace, len(x)) if k else np.zeros(0), np.full(len(at), made.identity_error)]
            deviation = pa.array(made.deviations(x), pa.int64()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(numbers[0]), pa.array(numbers[1], pa.int64()), deviation, pa.array(made.project(x).ravel()), *map(pa.array, shares)], names=schema.names)

    return rows.select("__id", "__x").mapInArrow(applied, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first four whitened components of their distinct vectors."""
    return whiten(table(spark, sf_dir, "embeddings"))
