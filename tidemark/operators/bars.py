"""Ticks to bars, resampling, nesting and joining of bar grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(ts: str | Column, width: str) -> Column:
    """The start of the bar that a time falls into; keeps zone-less times zone-less."""
    return F.window(ts, width)["start"]


def ticks_to_bars(ticks: DataFrame, width: str, symbol: str = "event_type", ts: str = "ts", price: str = "value", tie: str = "event_id") -> DataFrame:
    """``(symbol, ts, open, high, low, close, volume)``; volume counts ticks, ties in time go by ``tie``."""
    order = F.struct(ts, tie)
    return ticks.groupBy(F.col(symbol).alias("symbol"), bucket(ts, width).alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume")
    )


def resample(bars: DataFrame, width: str) -> DataFrame:
    """Bars of a wider grid; empty ones don't exist."""
    return bars.groupBy("symbol", bucket("ts", width).alias("bar_ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("bar_ts", "ts")


def nest_children(children: DataFrame, width: str) -> DataFrame:
    """``(symbol, ts, children, m1_count)``: each bucket's children in time order."""
    row = F.struct("ts", "open", "high", "low", "close")
    return children.groupBy("symbol", bucket("ts", width).alias("bar_ts")).agg(F.array_sort(F.collect_list(row)).alias("children"), F.count("*").alias("m1_count")).withColumnRenamed("bar_ts", "ts")


def join_children(parents: DataFrame, nested: DataFrame) -> DataFrame:
    """Parents with their children; those without a counterpart are dropped."""
    renamed = parents.select("symbol", "ts", *[F.col(c).alias(f"m15_{c}") for c in ("open", "high", "low", "close", "volume")])
    return renamed.join(nested, ["symbol", "ts"])


def completeness(nested: DataFrame, expected: int = 15) -> DataFrame:
    """Per symbol: parents, incomplete parents, and their share in percent."""
    short = F.count_if(F.col("m1_count") < expected)
    return nested.groupBy("symbol").agg(F.count("*").alias("n_parents"), short.alias("n_incomplete"), (100.0 * short / F.count("*")).alias("pct_incomplete"))


def last_complete(parents: DataFrame, children: DataFrame, width: str, most: int = 15) -> DataFrame:
    """Per symbol the second-to-last parent and its first ``most`` children, in one row."""
    order = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    parent = parents.withColumn("__rn", F.row_number().over(order)).filter("__rn = 2").drop("__rn")
    nested = nest_children(children, width).withColumn("children", F.slice("children", 1, most))
    return parent.join(nested, ["symbol", "ts"], "left")


def fill_gap(history: DataFrame, live: DataFrame) -> DataFrame:
    """Live rows after the last stored time of their symbol are added; of equal times the live row stays."""
    last = history.groupBy("symbol").agg(F.max("ts").alias("__last"))
    newer = live.join(last, "symbol", "left").filter(F.col("__last").isNull() | (F.col("ts") > F.col("__last"))).drop("__last")
    return keep_last(history.withColumn("__src", F.lit(0)).unionByName(newer.withColumn("__src", F.lit(1))), "__src").drop("__src")


def keep_last(rows: DataFrame, version: str) -> DataFrame:
    """One row per symbol and time: that of the highest ``version``."""
    order = Window.partitionBy("symbol", "ts").orderBy(F.col(version).desc())
    return rows.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")
