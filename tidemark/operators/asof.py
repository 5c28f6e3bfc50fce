"""As-of joins of two series with times of their own.

Both series meet in chunks of time; each chunk's last right row is carried on, over as many empty
chunks as there are, so a left row finds its partner whatever gaps lie between, and one hot symbol
is many tasks.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scan import Scan, chunk_of, prefix_scan


def asof_join(left: DataFrame, right: DataFrame, values: list[str], chunk: str = "30 days", within: str | None = None) -> DataFrame:
    """Left rows with numeric ``values`` of the last right row of their symbol at or before them, null where there is none.

    Of several right rows of one time the one with the largest values counts, in the order of
    ``values``. Any number of left rows may share a time. ``chunk``: span of time that a task holds; ``within``: a right
    row older than this doesn't count. A null symbol is a symbol of its own; a value that is null
    in the right row is null.
    """
    count, unit = chunk.split()
    clash = [v for v in values if v in left.columns]
    if clash:
        raise ValueError(f"columns of both sides: {clash}")
    none = lambda field: F.lit(None).cast(field.dataType).alias(field.name)
    rows = left.select("*", F.lit(True).alias("__left"), *[F.lit(None).cast("double").alias(f"__{v}") for v in values])
    others = right.select(*[F.col(c.name) if c.name in ("symbol", "ts") else none(c) for c in left.schema.fields], F.lit(False).alias("__left"), *[F.col(f"`{v}`").cast("double").alias(f"__{v}") for v in values])
    both = rows.unionByName(others).withColumn("chunk", chunk_of("ts", f"1 {unit}", int(count))).withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    span = left.sparkSession.range(1).select(F.expr(f"cast(interval {within} as interval day to second)")).first()[0].total_seconds() * 1e6 if within else np.inf

    def ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Times, sides, values, and the order: by time, right rows before left ones."""
        us = np.asarray(table["__us"].combine_chunks())
        is_left = np.asarray(table["__left"].combine_chunks().cast(pa.uint8())).astype(bool)
        numbers = [np.asarray(table[f"__{v}"].combine_chunks().fill_null(float("nan"))) for v in values]
        return us, is_left, numbers, np.lexsort([*reversed(numbers), is_left, us])

    def last_of(table: pa.Table) -> tuple[float, list[float]] | None:
        us, is_left, numbers, order = ordered(table)
        mine = order[~is_left[order]]
        return (float(us[mine[-1]]), [float(x[mine[-1]]) for x in numbers]) if len(mine) else None

    def passed(table: pa.Table, held: Any, after: None) -> dict[str, np.ndarray]:
        us, is_left, numbers, order = ordered(table)
        place = np.maximum.accumulate(np.where(is_left[order], -1, np.arange(len(order))))
        at = np.empty(len(order), np.int64)
        at[order] = np.where(place >= 0, order[np.maximum(place, 0)], -1)
        since = np.where(at >= 0, us[np.maximum(at, 0)].astype(float), held[0] if held else -np.inf)
        fits = is_left & (us - since <= span)
        return {f"__found_{v}": np.where(fits, np.where(at >= 0, x[np.maximum(at, 0)], held[1][k] if held else np.nan), np.nan) for k, (v, x) in enumerate(zip(values, numbers, strict=True))}

    scan = Scan(lambda: None, last_of, lambda held, said: said or held, passed)
    found = prefix_scan(both, scan, [T.StructField(f"__found_{v}", T.DoubleType()) for v in values], "__us")
    kinds = {f.name: f.dataType for f in right.schema.fields}
    return found.filter("__left").select(*left.columns, *[F.col(f"__found_{v}").cast(kinds[v]).alias(v) for v in values])
