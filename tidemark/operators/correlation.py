"""Correlations of many columns from one pass: blocked Gram matrices.

Each Arrow batch is one matrix product, tasks add their products up, and partial sums are merged
``fan_in`` at a time. The plan has the same size for any number of columns, and what reaches the
driver are a few matrices of columns x columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTIAL = "part int, sums binary"


@dataclass
class Gram:
    """Sums over the rows where both columns of a pair have a value: rows, the first column, its square, the product."""

    sums: np.ndarray  # (4, k, k)

    def correlations(self) -> np.ndarray:
        """Pearson's r of all pairs; NaN where either column is constant or a pair has no rows."""
        n, x, xx, xy = self.sums
        spread = n * xx - x * x
        with np.errstate(invalid="ignore", divide="ignore"):
            r = (n * xy - x * x.T) / np.sqrt(spread * spread.T)
        return np.where((n > 1) & (spread > 0) & (spread.T > 0), r, np.nan)


def block_sums(values: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The sums of one block of rows; NaN stands for no value."""
    there = (~np.isnan(values)).astype(float)
    x = np.where(there > 0, values - shift, 0.0)
    return np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])


def moved(sums: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The same sums after ``by`` has been added to every value of each column."""
    n, x, xx, xy = sums
    i, j = by[:, None], by[None, :]
    return np.stack([n, x + n * i, xx + 2 * i * x + n * i * i, xy + i * x.T + j * x + n * i * j])


def gram(df: DataFrame, columns: list[str], fan_in: int = 64) -> Gram:
    """Sums of all pairs of columns, each around a shift (a task's first value), so that digits aren't lost to large means.

    Null and NaN count as no value, pair by pair. An empty table gives sums of 0.
    """
    k = len(columns)
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{j}") for j, c in enumerate(columns)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shift = np.zeros((4, k, k)), None
        for batch in batches:
            if batch.num_rows:
                values = np.stack([np.asarray(c.fill_null(float("nan"))) for c in batch.columns], axis=1)
                if shift is None:
                    shift = np.nan_to_num(values[(~np.isnan(values)).argmax(0), np.arange(k)])
                held += block_sums(values, shift)
        if shift is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % fan_in], pa.int32()), pa.array([held.tobytes() + shift.tobytes()], pa.binary())], names=["part", "sums"])

    def added(parts: list[bytes]) -> bytes:
        """All sums around the shift of the first."""
        total, first = np.zeros((4, k, k)), np.frombuffer(parts[0], float)[4 * k * k :]
        for part in parts:
            numbers_ = np.frombuffer(part, float)
            total += moved(numbers_[: 4 * k * k].reshape(4, k, k), numbers_[4 * k * k :] - first)
        return total.tobytes() + first.tobytes()

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([0], pa.int32()), "sums": pa.array([added(group["sums"].to_pylist())], pa.binary())})

    rows = numbers.mapInArrow(partial, PARTIAL).groupBy("part").applyInArrow(merge, PARTIAL).collect()  # fan_in rows at most
    return Gram(np.frombuffer(added([r["sums"] for r in rows]), float)[: 4 * k * k].reshape(4, k, k) if rows else np.zeros((4, k, k)))


def correlation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, n, r)`` for each pair of columns, a before b; r is null where it isn't defined."""
    made = gram(df, columns)
    r = made.correlations()
    rows = [(a, b, int(made.sums[0, i, j]), None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, n long, r double")


def prune_correlated(df: DataFrame, columns: list[str], limit: float) -> list[str]:
    """Columns without an absolute correlation above ``limit`` with any earlier one, dropped ones included; a constant column correlates with nothing and stays."""
    high = np.abs(np.nan_to_num(gram(df, columns).correlations())) > limit
    return [b for j, b in enumerate(columns) if not high[:j, j].any()]
