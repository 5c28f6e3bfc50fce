"""Forward barrier labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import EngineConfig
from tidemark.operators.chunks import numbers
from tidemark.operators.scan import Scan, chunk_of, prefix_scan


def first_passage(high: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """For each search the first position in [start, end) with a high of at least ``up`` or a low of at most ``down``, or its end.

    A sparse table holds maxima and minima of all stretches of 2^k rows; a search skips the longest
    stretch without a hit, then shorter ones. NaN hits nothing.
    """
    tops, bottoms = [np.where(np.isnan(high), -np.inf, high)], [np.where(np.isnan(low), np.inf, low)]
    longest = int((ends - starts).max(initial=0))
    while 2 ** len(tops) <= longest:
        half = 2 ** (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
        bottoms.append(np.minimum(bottoms[-1][:-half], bottoms[-1][half:]))
    at = starts.copy()
    for k in range(len(tops) - 1, -1, -1):
        fits = np.nonzero(at + 2**k <= ends)[0]
        clear = ~(tops[k][at[fits]] >= up[fits]) & ~(bottoms[k][at[fits]] <= down[fits])
        at[fits[clear]] += 2**k
    return at


def barrier_labels(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Add ``label``: 1 if the target is reached first within the horizon, -1 if the stop is, 0 if neither.

    A bar that reaches both counts for the nearer one, the target on ties. Chunks of time are
    searched on their own, each with as many bars after it as the horizon has.
    """
    tp, sl, horizon = config.tp_pips * config.pip, config.sl_pips * config.pip, config.horizon
    both = 1 if tp <= sl else -1

    def ahead(after: list) -> tuple[tuple[np.ndarray, np.ndarray], bool]:
        enough = sum(len(a[0]) for a in after) >= horizon
        return tuple(np.concatenate([np.zeros(0), *[a[k] for a in after]])[:horizon] for k in (0, 1)), enough

    def passed(rows: pa.Table, state: None, after: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        high, low, close = numbers(rows, "high", "low", "close")
        n = len(close)
        high, low = np.concatenate([high, after[0]]), np.concatenate([low, after[1]])
        ends = np.minimum(np.arange(n) + 1 + horizon, len(high))
        at = first_passage(high, low, np.minimum(np.arange(n) + 1, ends), ends, close + tp, close - sl)
        found = np.minimum(at, len(high) - 1)
        up, down = (at < ends) & (high[found] >= close + tp), (at < ends) & (low[found] <= close - sl)
        return {"label": np.where(up & down, both, np.where(up, 1, np.where(down, -1, 0))).astype(float)}

    scan = Scan(lambda: None, lambda rows: tuple(x[:horizon] for x in numbers(rows, "high", "low")), lambda state, said: None, passed, ahead)
    chunks = bars.withColumn("chunk", chunk_of("ts", config.parent_width, max(config.chunk_bars, 4 * horizon)))
    return prefix_scan(chunks, scan, [T.StructField("label", T.IntegerType())])


def label_distribution(labelled: DataFrame) -> DataFrame:
    """``(symbol, label, n, pct)``."""
    counts = labelled.groupBy("symbol", "label").agg(F.count("*").alias("n"))
    totals = labelled.groupBy("symbol").agg(F.count("*").alias("total"))
    return counts.join(totals, "symbol").select("symbol", "label", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def class_of(label: str = "label"):
    """0 no trade, 1 buy, 2 sell."""
    return F.when(F.col(label) == 0, 0).when(F.col(label) == 1, 1).when(F.col(label) == -1, 2)


def class_weights(labelled: DataFrame, cls: str = "cls") -> DataFrame:
    """``(cls, n, weight)`` with weight = rows / (classes * rows of the class)."""
    counts = labelled.groupBy(cls).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))  # one row
    return counts.join(F.broadcast(totals)).select(cls, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))
