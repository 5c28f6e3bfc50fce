"""Layer 2: calendar and session windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import EngineConfig
from tidemark.operators.windows import clip, fill_forward, island, ordinal, rolling_z_high, series, so_far, trailing


def session(ts: str, config: EngineConfig) -> Column:
    hour = F.hour(ts)
    return F.when(hour >= config.london_end, 2).when(hour >= config.asian_end, 1).otherwise(0)


def kill_zone(ts: str, config: EngineConfig) -> Column:
    """The last zone that holds the minute of the day, or 0."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    out = F.lit(0)
    for start, end, value in config.kill_zones:
        out = F.when((minute >= start) & (minute < end), value).otherwise(out)
    return out


def calendar(bars: DataFrame, config: EngineConfig) -> DataFrame:
    hour = F.hour("ts")
    return bars.withColumns({
        "l2_session": session("ts", config), "l2_session_overlap": ((hour >= config.overlap[0]) & (hour < config.overlap[1])).cast("int"), "l2_kill_zone": kill_zone("ts", config),
        "l2_day_of_week": F.weekday("ts"), "l2_hour": hour,
    })


def session_islands(bars: DataFrame) -> DataFrame:
    """Add ``island``: runs of one session label, whatever the date."""
    before = F.lag("l2_session").over(series())
    return bars.withColumn("island", island(F.col("l2_session") != before))


def layer2(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Bars with ``l1_volatility_energy`` (0 if absent) and the columns of the layer that are windows of numbers; ``i`` and ``island`` stay.

    The rank among earlier rows of the session needs an ordered window: :mod:`tidemark.operators.market` has it.
    """
    if "l1_volatility_energy" not in bars.columns:
        bars = bars.withColumn("l1_volatility_energy", F.lit(0.0))
    base = session_islands(ordinal(calendar(bars, config)))
    run = Window.partitionBy("symbol", "island").orderBy("ts")
    energy = F.col("l1_volatility_energy")
    low, high = F.min("low").over(so_far(run)), F.max("high").over(so_far(run))
    base = base.withColumn("__spike", rolling_z_high(energy, config.spike_window, config.spike_sigma))
    base = base.withColumns({
        "l2_distance_from_session_open": (F.col("close") - F.first("open").over(so_far(run))) / config.pip,
        "l2_session_position": clip((F.col("close") - low) / (high - low + config.eps), 0.0, 1.0),
        "__k": (F.row_number().over(run) - 1).cast("double"),
        "__atr": F.avg(F.col("high") - F.col("low")).over(trailing(config.atr_window)),
        "l2_time_since_vol_spike": F.coalesce(F.least(F.col("i") - fill_forward(F.when(F.col("__spike"), F.col("i"))), F.lit(config.spike_cap)), F.lit(config.spike_cap)),
    })
    atr = F.when(F.col("__atr") > 0, F.col("__atr")).otherwise(config.eps)
    slope = F.when(F.col("__k") > 0, F.regr_slope("close", "__k").over(so_far(run)) / atr)
    return base.withColumn("l2_session_trend", F.coalesce(slope, F.lit(0.0))).drop("__spike", "__k", "__atr")
