"""Cleaning of loaded bars and what was removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def has_prices() -> Column:
    out = F.lit(True)
    for c in PRICES:
        out = out & F.col(c).isNotNull()
    return out


def positive() -> Column:
    out = F.lit(True)
    for c in PRICES:
        out = out & (F.col(c) > 0)
    return out


def alive() -> Column:
    """Not a dead candle, whose four prices are equal."""
    return ~((F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close")))


def weekday(ts: str = "ts") -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(ts)


def clean(bars: DataFrame) -> DataFrame:
    """Null prices, then non-positive prices, dead candles and weekends go."""
    return bars.filter(has_prices()).filter(positive()).filter(alive()).filter(weekday() < 5)


def clean_statistics(bars: DataFrame) -> DataFrame:
    """Rows before and after each filter, and the kept range of times, per symbol: one pass."""
    a = F.coalesce(has_prices(), F.lit(False))
    b = a & F.coalesce(positive(), F.lit(False))
    c = b & F.coalesce(alive(), F.lit(False))
    d = c & (weekday() < 5)
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n_raw"), F.count_if(a).alias("n_priced"), F.count_if(b).alias("n_positive"), F.count_if(c).alias("n_alive"), F.count_if(d).alias("n_kept"),
        F.min(F.when(d, F.col("ts"))).alias("first_ts"), F.max(F.when(d, F.col("ts"))).alias("last_ts"),
    )


def gap_report(rows: DataFrame, factor: float = 10.0) -> DataFrame:
    """Per symbol: median step in seconds, steps above ``factor`` medians, the largest step and where it ends; none for fewer than two rows."""
    order = Window.partitionBy("symbol").orderBy("ts")
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    steps = rows.select("symbol", "ts", (second("ts") - F.lag(second("ts")).over(order)).alias("step")).filter("step is not null")
    medians = steps.groupBy("symbol").agg(F.percentile("step", F.lit(0.5)).alias("median_step"), F.max("step").alias("max_step"), F.max_by("ts", F.struct("step", F.expr("-unix_timestamp(cast(ts as timestamp))"))).alias("max_at"))
    wide = steps.join(medians.select("symbol", "median_step"), "symbol").groupBy("symbol").agg(F.count_if(F.col("step") > factor * F.col("median_step")).alias("n_gaps"))
    return medians.join(wide, "symbol").select("symbol", "median_step", "n_gaps", "max_step", "max_at")


def feature_columns(df: DataFrame) -> list[str]:
    """Columns of the four layers, without the child count."""
    return [c for c in df.columns if c[:3] in ("l1_", "l2_", "l3_", "l4_") and c != "l1_m1_count"]


def between_days(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from the start of one day to the end of another."""
    return df.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.expr(f"cast('{end}' as timestamp_ntz) + interval 1 day")))


def fill_zero(df: DataFrame) -> DataFrame:
    """Missing features become 0."""
    return df.na.fill(0, feature_columns(df))


def drop_features(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])


def summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(feature, mean, std, min, max)`` for each column: one pass, then turned round."""
    columns = columns or feature_columns(df)
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{n}").alias(n) for n in ("mean", "std", "min", "max")]) for c in columns]))
    return one.select(rows.alias("r")).select("r.*")
