"""Layer 1: aggregates over a bar's children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import EngineConfig
from tidemark.operators.bars import bucket


def _velocity(first_open: Column, last_close: Column, n: Column) -> Column:
    return F.when(n > 0, (last_close - first_open) / n).otherwise(0.0)


def layer1(parents: DataFrame, children: DataFrame, config: EngineConfig) -> DataFrame:
    """Parents (those with children) with the eight columns of the layer and ``l1_m1_count``.

    Children stay flat: one window for positions and the last direction, then one grouped
    aggregate with partial sums. Early and late are positions among the children there are.
    """
    at = Window.partitionBy("symbol", "bar_ts").orderBy("ts")
    sign = F.signum(F.col("close") - F.col("open"))
    flat = children.withColumn("bar_ts", bucket("ts", config.parent_width)).select(
        "symbol", "bar_ts", "ts", "open", "close", (F.col("high") - F.col("low")).alias("rng"), F.abs(F.col("close") - F.col("open")).alias("body"), sign.alias("sign"),
        F.row_number().over(at).alias("rn"), F.last(F.when(sign != 0, sign), ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
    )
    early, late = F.col("rn") <= config.early_split, F.col("rn") > config.early_split
    absorbing = (F.col("rng") != 0) & (F.col("body") / (F.col("rng") + config.eps) < config.absorption_body)
    part = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
    ends = lambda cond: _velocity(F.min_by("open", F.when(cond, F.col("rn"))), F.max_by("close", F.when(cond, F.col("rn"))), F.count_if(cond))
    sums = flat.groupBy("symbol", "bar_ts").agg(
        F.count_if(F.col("rng") != 0).alias("l1_custom_volume"), F.sum("rng").alias("l1_volatility_energy"), F.count_if((F.col("sign") != 0) & (F.col("sign") != F.col("before"))).alias("l1_reversal_count"),
        part(early, F.col("rng")).alias("e"), part(late, F.col("rng")).alias("l"), ends(early).alias("ve"), ends(late).alias("vl"),
        F.count_if(absorbing).alias("l1_absorption_count"), part(absorbing, F.col("rng")).alias("a"), F.count("*").alias("l1_m1_count"),
    )
    made = sums.select(
        "symbol", F.col("bar_ts").alias("ts"), "l1_custom_volume", "l1_volatility_energy", "l1_reversal_count", (F.col("l") / (F.col("e") + F.col("l") + config.eps)).alias("l1_early_late_ratio"),
        (F.col("vl") - F.col("ve")).alias("l1_price_acceleration"), "l1_absorption_count", (F.col("a") / (F.col("l1_volatility_energy") + config.eps)).alias("l1_absorption_intensity"), "l1_m1_count",
    )
    velocity = _velocity(F.col("open"), F.col("close"), F.col("l1_custom_volume"))
    return parents.join(made, ["symbol", "ts"]).withColumn("l1_price_velocity", velocity)


def nested_columns(a: Column, config: EngineConfig) -> dict[str, Column]:
    """The layer's columns, but for the velocity, over an array of child structs in time order."""
    rng = lambda x: x["high"] - x["low"]
    total = lambda xs: F.aggregate(F.transform(xs, rng), F.lit(0.0), lambda s, x: s + x)
    signs = F.filter(F.transform(a, lambda x: F.signum(x["close"] - x["open"])), lambda s: s != 0)
    flips = F.size(F.filter(F.transform(signs, lambda s, i: (i > 0) & (s != F.get(signs, F.greatest(i - 1, F.lit(0))))), lambda x: x))
    early, late = F.slice(a, 1, config.early_split), F.slice(a, F.lit(config.early_split + 1), F.greatest(F.size(a), F.lit(1)))
    absorbing = F.filter(a, lambda x: (rng(x) != 0) & (F.abs(x["close"] - x["open"]) / (rng(x) + config.eps) < config.absorption_body))
    speed = lambda xs: F.when(F.size(xs) > 0, (F.get(xs, F.size(xs) - 1)["close"] - F.get(xs, F.lit(0))["open"]) / F.size(xs)).otherwise(0.0)
    return {
        "l1_custom_volume": F.size(F.filter(a, lambda x: x["high"] != x["low"])).cast("long"), "l1_volatility_energy": total(a), "l1_reversal_count": flips.cast("long"),
        "l1_early_late_ratio": total(late) / (total(early) + total(late) + config.eps), "l1_price_acceleration": speed(late) - speed(early),
        "l1_absorption_count": F.size(absorbing).cast("long"), "l1_absorption_intensity": total(absorbing) / (total(a) + config.eps), "l1_m1_count": F.size(a).cast("long"),
    }
