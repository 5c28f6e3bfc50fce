"""The batch plan from bars to the 43 features, one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import EVENTS, EngineConfig
from tidemark.operators.bars import ticks_to_bars
from tidemark.operators.layer1 import layer1
from tidemark.operators.layer2 import calendar
from tidemark.operators.layer3 import liquidity_columns
from tidemark.operators.layer4 import candle_range, confluence, dna_kind, trap, whale
from tidemark.operators.market import market_columns

# The features' names and order.
L1 = ["l1_custom_volume", "l1_volatility_energy", "l1_price_velocity", "l1_reversal_count", "l1_early_late_ratio", "l1_price_acceleration", "l1_absorption_count", "l1_absorption_intensity"]
L2 = ["l2_session", "l2_session_overlap", "l2_kill_zone", "l2_day_of_week", "l2_hour", "l2_distance_from_session_open", "l2_session_position", "l2_time_since_vol_spike", "l2_session_volatility_rank", "l2_session_trend"]
L3 = ["l3_swing_high", "l3_swing_low", "l3_bos_direction", "l3_choch_flag", "l3_demand_ob_distance", "l3_supply_ob_distance", "l3_fvg_active", "l3_fvg_distance", "l3_buy_liq_distance", "l3_sell_liq_distance",
      "l3_liquidity_sweep", "l3_premium_discount", "l3_structure_trend", "l3_h1_trend", "l3_h4_trend"]
L4 = ["l4_whale_footprint", "l4_trap_score", "l4_candle_dna", "l4_momentum_divergence", "l4_consecutive_bias", "l4_volume_climax", "l4_range_compression", "l4_session_continuation", "l4_multi_layer_confluence", "l4_time_volatility_regime"]
FEATURES = L1 + L2 + L3 + L4


def build(parents: DataFrame, children: DataFrame, config: EngineConfig) -> DataFrame:
    """All features of the parents that have children.

    Layer 1 is a join and a grouped aggregate, what is left are expressions of a row, and one
    prefix scan: no window takes a whole symbol into one task.
    """
    return scored(market_columns(calendar(layer1(parents, children, config), config), config), config)


def scored(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Bars with the scan's columns and those that are expressions of one row."""
    rows = bars.withColumns({**liquidity_columns(config), "__rng": candle_range(), "__reversal": F.col("__reversal") == 1, "l4_whale_footprint": whale(config), "l4_multi_layer_confluence": confluence()})
    rows = rows.withColumn("l4_trap_score", trap(config)).withColumn("l4_candle_dna", dna_kind(config))
    return rows.select("symbol", "ts", "open", "high", "low", "close", "volume", "l1_m1_count", *FEATURES)


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test ticks under two symbols, by parity of the user."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("symbol", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))


def event_bars(spark: SparkSession, sf_dir: str, width: str = EVENTS.parent_width) -> DataFrame:
    """Bars of the test ticks."""
    return ticks_to_bars(event_ticks(spark, sf_dir), width, "symbol")


def event_features(spark: SparkSession, sf_dir: str, config: EngineConfig = EVENTS) -> DataFrame:
    return build(event_bars(spark, sf_dir, config.parent_width), event_bars(spark, sf_dir, config.child_width), config)


def latest_features(parents: DataFrame, children: DataFrame, config: EngineConfig, context: int = 500) -> DataFrame:
    """The features of each symbol's last bar, from its last ``context`` bars alone."""
    back = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    recent = parents.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") <= context).drop("__back")
    full = build(recent, children, config)
    return full.withColumn("__back", F.row_number().over(back)).filter("__back = 1").drop("__back")
