"""Layer 4: derived scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import EngineConfig
from tidemark.operators.windows import clip, fill_forward, full, island, rolling_z_high, series, so_far, trailing


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def whale(config: EngineConfig) -> Column:
    return _flag(F.col("l1_custom_volume") >= config.whale_volume) + _flag(F.col("l1_reversal_count") < config.whale_reversals) + _flag(F.col("l1_absorption_count") >= config.whale_absorption)


def near_block(pips: float) -> Column:
    """Whether either block distance is small; without a block it is 0, which counts as near."""
    return (F.abs("l3_demand_ob_distance") < pips) | (F.abs("l3_supply_ob_distance") < pips)


def trap(config: EngineConfig) -> Column:
    score = 30 * _flag(F.col("l3_liquidity_sweep") != 0) + 20 * _flag(F.col("l2_kill_zone") > 0) + 20 * _flag(F.col("__reversal"))
    score = score + 15 * _flag(near_block(config.trap_ob_pips)) + 15 * _flag(F.col("l1_absorption_intensity") > config.trap_absorption)
    return F.least(F.greatest(score, F.lit(0)), F.lit(100))


def candle_range() -> Column:
    return F.col("high") - F.col("low")


def dna_kind(config: EngineConfig) -> Column:
    """The first candle type that fits, or -1; needs the trailing quantiles of velocity (``__v75``, ``__v95``) and range (``__r25``), ``__rng`` and ``__before``, the break of the bar before. Missing quantiles never fit."""
    vel, bos = F.col("l1_price_velocity"), F.col("l3_bos_direction")
    body = F.abs(F.col("close") - F.col("open")) / (F.col("__rng") + config.eps)
    return (
        F.when(F.col("l4_trap_score") >= config.dna_trap, 3)
        .when((vel > F.col("__v95")) & (bos != 0), 5)
        .when((F.col("__before") != 0) & (F.col("l3_choch_flag") != 0), 6)
        .when((vel > F.col("__v75")) & (F.col("l1_reversal_count") < config.whale_reversals) & (F.col("l1_custom_volume") >= config.whale_volume), 0)
        .when((F.col("l1_absorption_intensity") > config.trap_absorption) & (body < config.dna_body), 1)
        .when((F.col("l1_early_late_ratio") < config.dna_ratio) & (F.col("l1_price_acceleration") < config.dna_accel), 2)
        .when((F.col("__rng") < F.coalesce("__r25", F.lit(0.0))) & (F.col("l1_custom_volume") >= config.dna_volume) & near_block(config.dna_ob_pips), 7)
        .when((F.col("l1_custom_volume") < config.dna_dead_volume) & (F.col("l1_volatility_energy") < config.dna_dead_energy), 4)
        .otherwise(-1)
    )


def divergence(config: EngineConfig) -> Column:
    """Price and energy against those some bars ago; ties are not up."""
    old_close, old_energy = F.lag("close", config.divergence_lag).over(series()), F.lag("l1_volatility_energy", config.divergence_lag).over(series())
    up, more = F.col("close") > old_close, F.col("l1_volatility_energy") > old_energy
    return F.when(old_close.isNull(), 0).when(up & ~more, -1).when(~up & more, 1).otherwise(0)


def streak(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Add the signed run length of candle directions; a doji keeps the run without adding to it."""
    sign = F.signum(F.col("close") - F.col("open")).cast("int")
    base = bars.withColumn("__sign", sign)
    base = base.withColumn("__dir", fill_forward(F.when(F.col("__sign") != 0, F.col("__sign"))))
    base = base.withColumn("__run", island(~F.col("__dir").eqNullSafe(F.lag("__dir").over(series()))))
    run = Window.partitionBy("symbol", "__run").orderBy("ts")
    length = F.sum(F.abs("__sign")).over(so_far(run))
    value = F.coalesce(F.col("__dir") * F.least(length, F.lit(config.streak_cap)), F.lit(0)).cast("int")
    return base.withColumn("l4_consecutive_bias", value).drop("__sign", "__dir", "__run")


def climax(config: EngineConfig) -> Column:
    high = lambda c: rolling_z_high(F.col(c).cast("double"), config.climax_window, config.climax_sigma)
    return (high("l1_custom_volume") & high("l1_volatility_energy")).cast("int")


def compression(config: EngineConfig) -> Column:
    rng = F.col("high") - F.col("low")
    mean = F.avg(rng).over(trailing(config.range_window))
    return F.when(mean <= config.eps, 1.0).otherwise(rng / mean)


def continuation(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Add the estimated probability that the session goes on as the one before.

    Everything happens on the first bar of a session run, where the bar before it has the closed
    session's label and last trend. Outcomes form windows of their own for the moving means; what
    holds on a run's first bar is carried forward.
    """
    starts = F.col("l2_session") != F.lag("l2_session").over(series())
    base = bars.withColumns({"__prev": F.when(starts, F.lag("l2_session").over(series())), "__end": F.when(starts, F.lag("l2_session_trend").over(series()))})
    step = lambda a, b: (F.col("__prev") == a) & (F.col("l2_session") == b)
    base = base.withColumns({"__asian": fill_forward(F.when(step(0, 1), F.col("__end"))), "__london": fill_forward(F.when(step(1, 2), F.col("__end")))})
    went = lambda then, sure: (((F.col("__end") > 0) == (F.col(then) > 0)) & (F.col(sure) != 0)).cast("double")
    base = base.withColumns({
        "__l": F.when(step(1, 2) & F.col("__asian").isNotNull(), went("__asian", "__asian")),
        "__n": F.when(step(2, 0) & (F.col("__london") != 0), went("__london", "__end")),
    })
    for name in ("__l", "__n"):
        outcomes = Window.partitionBy("symbol", F.col(name).isNotNull()).orderBy("ts").rowsBetween(-(config.continuation_window - 1), 0)
        base = base.withColumn(f"{name}m", F.when(F.col(name).isNotNull(), F.avg(name).over(outcomes)))
        base = base.withColumn(f"{name}p", F.coalesce(fill_forward(F.col(f"{name}m")), F.lit(0.5)))
    p = F.when(step(0, 1), F.when(F.col("__asian") != 0, F.col("__lp")).otherwise(0.5)).when(step(1, 2), F.when(F.col("__london") != 0, F.col("__np")).otherwise(0.5)).when(step(2, 0), 0.5)
    base = base.withColumn("__p", p)
    return base.withColumn("l4_session_continuation", F.coalesce(fill_forward(F.col("__p")), F.lit(0.5))).drop("__prev", "__end", "__asian", "__london", "__l", "__n", "__lm", "__nm", "__lp", "__np", "__p")


def confluence() -> Column:
    score = F.signum("l2_session_trend").cast("int") + F.col("l3_structure_trend") + F.col("l3_h1_trend") + F.col("l3_h4_trend") - F.col("l3_premium_discount")
    return F.least(F.greatest(score, F.lit(-5)), F.lit(5))


def regime(config: EngineConfig) -> Column:
    short, long = F.avg("l1_volatility_energy").over(trailing(config.regime_short)), F.avg("l1_volatility_energy").over(trailing(config.regime_long))
    band = F.abs(long) * config.regime_band
    return F.when(short > long + band, 1).when(short < long - band, -1).otherwise(0)
