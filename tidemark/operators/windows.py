"""Ordered-series primitives: everything is partitioned by ``symbol`` and ordered by ``ts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def series() -> WindowSpec:
    """Each symbol's rows in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def trailing(n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return series().rowsBetween(-(n - 1), 0)


def so_far(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or series()).rowsBetween(Window.unboundedPreceding, 0)


def before(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or series()).rowsBetween(Window.unboundedPreceding, -1)


def ordinal(df: DataFrame) -> DataFrame:
    """Add ``i``, the position from 0 in the series."""
    return df.withColumn("i", (F.row_number().over(series()) - 1).cast("int"))


def fill_forward(value: Column, spec: WindowSpec | None = None) -> Column:
    """The last value that isn't null, the current one included."""
    return F.last(value, ignorenulls=True).over(so_far(spec))


def island(changed: Column, spec: WindowSpec | None = None) -> Column:
    """Number of changes so far."""
    return F.sum(F.when(changed, 1).otherwise(0)).over(so_far(spec)).cast("int")


def full(value: Column, n: int, spec: WindowSpec) -> Column:
    """``value`` where the frame has n rows, else null."""
    return F.when(F.count(F.lit(1)).over(spec) >= n, value)


def rolling_z_high(value: Column, n: int, sigma: float) -> Column:
    """Whether the value exceeds mean + sigma deviations (sample) of the last n rows, itself included; false before n rows."""
    spec = trailing(n)
    bound = F.avg(value).over(spec) + sigma * F.stddev_samp(value).over(spec)
    return F.coalesce(full(value > bound, n, spec), F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def binned_interval_join(points: DataFrame, intervals: DataFrame, width: int, at: str = "i", start: str = "start_i", end: str = "end_i") -> DataFrame:
    """Inner join of points and intervals of the same symbol with start <= at < end.

    Both sides meet on ``symbol`` and ``at div width``: an equi-join, where a range condition
    alone would compare all pairs. An interval is copied into each bin that it meets.
    """
    bins = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    placed = intervals.filter(F.col(end) > F.col(start)).withColumn("__bin", bins)
    return points.withColumn("__bin", F.floor(F.col(at) / width)).join(placed, ["symbol", "__bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")
