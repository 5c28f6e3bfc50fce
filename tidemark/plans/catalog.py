"""The registered queries. Their DuckDB SQL is in :mod:`tidemark.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import EVENTS as C
from tidemark.operators import asof as A
from tidemark.operators import bars as B
from tidemark.operators import correlation as R
from tidemark.operators import evaluate as E
from tidemark.operators import ingest as I
from tidemark.operators import labels as L
from tidemark.operators import layer1 as L1
from tidemark.operators import layer2 as L2
from tidemark.operators import layer3 as L3
from tidemark.operators import layer4 as L4
from tidemark.operators import market as M
from tidemark.operators import signals as S
from tidemark.operators.windows import ordinal, rolling_z_high, series, trailing
from tidemark.plans import features as P
from tidemark.plans import oracle
from tidemark.plans import training as T
from tidemark.session import scratch
from tidemark.sources import csv_bars as CSV

Query = Callable[[SparkSession, str], DataFrame]


#: Means of prices in cents end in a 5 at the seventh digit now and then; these are rounded further on.
NINE_DIGITS = {"l3_buy_liq_distance", "l3_sell_liq_distance"}


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """Key and columns, whole numbers as long, fractions rounded to six digits (nine for some)."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        kind = kinds[c]
        col = F.col(c)
        out.append((F.round(col.cast("double"), 9 if c in NINE_DIGITS else 6) if kind in ("double", "float") or kind.startswith("decimal") else col.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else col).alias(c))
    return df.select(*out)


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Test ticks with two symbols, by parity of the user."""
    return P.event_ticks(spark, sf)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_bars(spark, sf)


def children(spark: SparkSession, sf: str) -> DataFrame:
    return P.event_bars(spark, sf, C.child_width)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of order prices, one symbol per priority."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return B.ticks_to_bars(orders, "1 day", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")


def energy_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars with the layer-1 columns."""
    return L1.layer1(hourly(spark, sf), children(spark, sf), C)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled hourly bars with class probabilities made from their ordinals."""
    base = ordinal(L.barrier_labels(hourly(spark, sf), C))
    power = lambda a, n: F.pow(F.pmod(F.col("i") * a, F.lit(n)) + 1, F.lit(4))
    w = [power(37, 101), power(59, 97), power(83, 89)]
    probs = F.array(*[x / (w[0] + w[1] + w[2]) for x in w])
    base = base.withColumn("probs", probs)
    pred, conf = E.prediction("probs")
    return base.withColumn("pred", pred).withColumn("conf", conf).withColumn("cls", L.class_of())


def _features(*columns: str) -> Query:
    return lambda spark, sf: tidy(P.event_features(spark, sf, C), "symbol", "ts", *columns)


def _layer1(*columns: str) -> Query:
    return lambda spark, sf: tidy(energy_bars(spark, sf), "symbol", "ts", *columns)


def _layer2(*columns: str) -> Query:
    return lambda spark, sf: tidy(L2.layer2(energy_bars(spark, sf), C), "symbol", "ts", *columns)


def _scanned(*columns: str) -> Query:
    """Columns of layers 2 and 4 that need the prefix scan alone."""
    return lambda spark, sf: tidy(M.market_columns(L2.calendar(energy_bars(spark, sf), C), C), "symbol", "ts", *columns)


def _layer3(*columns: str) -> Query:
    return lambda spark, sf: tidy(M.layer3(hourly(spark, sf), C), "symbol", "ts", *columns)


def _swung(bars: DataFrame) -> DataFrame:
    return bars.withColumns(L3.swing_columns(C.swing))


def _higher(bars: DataFrame) -> DataFrame:
    return L3.higher_trend(L3.higher_trend(bars, "1 hour", "l3_h1_trend", C), "4 hours", "l3_h4_trend", C)


def _layer3_light(step: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    """Columns that need one step of the layer only."""
    return lambda spark, sf: tidy(step(hourly(spark, sf)), "symbol", "ts", *columns)


def l4_confluence(spark: SparkSession, sf: str) -> DataFrame:
    """Trends of the session and of three time frames against the zone."""
    bars = M.market_columns(L2.calendar(energy_bars(spark, sf), C), C)
    return tidy(bars.withColumn("l4_multi_layer_confluence", L4.confluence()), "symbol", "ts", "l4_multi_layer_confluence")


def _layer4_light(step: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf: tidy(step(energy_bars(spark, sf)), "symbol", "ts", *columns)


def spike_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: ticks to 15-minute bars to volatility spikes."""
    bars = B.ticks_to_bars(ticks(spark, sf), "15 minutes", "symbol")
    spike = rolling_z_high(F.col("high") - F.col("low"), C.spike_window, C.spike_sigma).cast("int")
    return tidy(bars.withColumn("spike", spike), "symbol", "ts", "open", "high", "low", "close", "volume", "spike")


def ingest_clean(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(I.clean(daily(spark, sf)), "symbol", "ts", "open", "high", "low", "close", "volume")


def ingest_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(I.clean_statistics(daily(spark, sf)), "symbol", "n_raw", "n_priced", "n_positive", "n_alive", "n_kept", "first_ts", "last_ts")


def gap_report(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(I.gap_report(hourly(spark, sf), 2.0), "symbol", "median_step", "n_gaps", "max_step", "max_at")


def ohlc_bars(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(hourly(spark, sf), "symbol", "ts", "open", "high", "low", "close", "volume")


def ohlc_4h(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(B.resample(hourly(spark, sf), "4 hours"), "symbol", "ts", "open", "high", "low", "close", "volume")


def bucket_collect(spark: SparkSession, sf: str) -> DataFrame:
    """Children in order, told by a checksum of positions and closes."""
    nested = B.nest_children(children(spark, sf), C.parent_width)
    check = F.aggregate(F.transform("children", lambda x, i: x["close"] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return tidy(nested.withColumn("ordered_sum", check), "symbol", "ts", "m1_count", "ordered_sum")


def m1_m15_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = B.join_children(hourly(spark, sf), B.nest_children(I.clean(children(spark, sf)), C.parent_width))
    return tidy(joined, "symbol", "ts", "m15_open", "m15_high", "m15_low", "m15_close", "m15_volume", "m1_count")


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(B.completeness(B.nest_children(children(spark, sf), C.parent_width), 6), "symbol", "n_parents", "n_incomplete", "pct_incomplete")


def last_complete_bar(spark: SparkSession, sf: str) -> DataFrame:
    out = B.last_complete(hourly(spark, sf), children(spark, sf), C.parent_width, 3)
    return tidy(out.withColumn("n_children", F.coalesce(F.size("children"), F.lit(0))), "symbol", "ts", "open", "close", "n_children")


def l1_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Layer 1 over nested children."""
    nested = B.nest_children(children(spark, sf), C.parent_width)
    return tidy(nested.withColumns(L1.nested_columns(F.col("children"), C)), "symbol", "ts", "l1_custom_volume", "l1_volatility_energy", "l1_reversal_count", "l1_early_late_ratio", "l1_price_acceleration", "l1_absorption_count", "l1_absorption_intensity", "l1_m1_count")


def l3_order_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Block distances in their set-based form, an interval join."""
    base = L3.breaks(hourly(spark, sf).withColumns(L3.swing_columns(C.swing)), C)
    out = L3.block_distance(L3.block_distance(base, True, "l3_demand_ob_distance", C), False, "l3_supply_ob_distance", C)
    return tidy(out, "symbol", "ts", "l3_demand_ob_distance", "l3_supply_ob_distance")


def label_barrier(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(L.barrier_labels(hourly(spark, sf), C), "symbol", "ts", "label")


def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(L.label_distribution(L.barrier_labels(hourly(spark, sf), C)), "symbol", "label", "n", "pct")


def time_split(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and range of the three splits of daily bars."""
    bars, out = daily(spark, sf), None
    for name, (start, end) in {"train": ("1992-01-01", "1995-12-31"), "val": ("1996-01-01", "1996-12-31"), "test": ("1997-01-01", "1998-12-31")}.items():
        one = I.between_days(bars, start, end).groupBy(F.lit(name).alias("split")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        out = one if out is None else out.unionAll(one)
    return tidy(out, "split", "n", "first_ts", "last_ts")


def fold_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(T.fold_bounds(daily(spark, sf).withColumn("symbol", F.lit("all")), C, "1 day"), "fold", "val_start", "val_end", "train_rows", "val_rows")


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(L.class_weights(scored(spark, sf)), "cls", "n", "weight")


def corr_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of line items that stay when correlated ones go."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").withColumns({"l1_price": F.col("l_extendedprice"), "l1_quantity": F.col("l_quantity"), "l1_double": F.col("l_quantity") * 2 + 1, "l1_tax": F.col("l_tax"), "l1_net": F.col("l_extendedprice") * (1 - F.col("l_discount"))})
    kept = R.prune_correlated(items, ["l1_price", "l1_quantity", "l1_double", "l1_tax", "l1_net"], C.correlation)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def feature_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of all pairs of the 43 features, by one pass."""
    return tidy(R.correlation_table(P.event_features(spark, sf, C), P.FEATURES), "a", "b", "n", "r")


def asof_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases with the last hourly bar that had begun, on grids with gaps: bars of few ticks are left out."""
    rare = hourly(spark, sf).filter("volume % 3 = 0").select("symbol", "ts", F.col("close").alias("bar_close"), F.col("volume").alias("bar_volume"))
    events = ticks(spark, sf).filter("event_type = 'purchase'").select("symbol", "ts", "event_id")
    return tidy(A.asof_join(events, rare, ["bar_close", "bar_volume"], "2 days"), "symbol", "ts", "event_id", "bar_close", "bar_volume")


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(E.confusion(scored(spark, sf), "cls", "pred", [0, 1, 2]), "truth", "pred_0", "pred_1", "pred_2")


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(E.class_report(scored(spark, sf), "cls", "pred", [0, 1, 2]), "name", "precision", "recall", "f1", "support")


def trading_sim(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(E.simulate(E.trades(scored(spark, sf), C), C, "symbol"), "symbol", *E.METRICS)


def tier_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(E.tiers(E.trades(scored(spark, sf), C), C), "tier", *E.METRICS)


def _signal_base(spark: SparkSession, sf: str) -> DataFrame:
    """Scored bars with the features that reasons look at."""
    keys = scored(spark, sf).select("symbol", "ts", "i", "pred", "conf", "label")
    return keys.join(P.event_features(spark, sf, C), ["symbol", "ts"])


def signal_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = S.with_levels(S.candidates(_signal_base(spark, sf), C), C).withColumn("top_reasons", F.array_join("top_reasons", " | "))
    return tidy(out, "symbol", "ts", "direction", "tier", "entry_price", "stop_loss", "take_profit", "risk_reward", "top_reasons", "candle_dna")


def cooldown(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(S.cool_down(S.candidates(scored(spark, sf), C), replace(C, cooldown=3)), "symbol", "i")


def daily_loss_limit(spark: SparkSession, sf: str) -> DataFrame:
    acted = E.trades(scored(spark, sf), C).withColumn("loss", F.col("pnl") == -C.sl_pips)
    return tidy(S.under_daily_limit(acted, C), "symbol", "ts", "pnl")


def session_filter(spark: SparkSession, sf: str) -> DataFrame:
    base = L2.calendar(scored(spark, sf), C)
    return tidy(S.candidates(base, C, (1, 2)), "symbol", "ts", "l2_session", "pred")


def dedupe_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Of a user's events in one hour the last stays."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("symbol"), B.bucket("ts", "1 hour").alias("ts"), "event_id", "value")
    return tidy(B.keep_last(rows, "event_id"), "symbol", "ts", "event_id", "value")


def fill_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Later bars of a finer grid appended to a history."""
    history, live = hourly(spark, sf).filter("day(ts) <= 15"), B.ticks_to_bars(ticks(spark, sf), "30 minutes", "symbol")
    return tidy(B.fill_gap(history, live), "symbol", "ts", "open", "close")


def _signal_log(spark: SparkSession, sf: str) -> DataFrame:
    acted = E.trades(scored(spark, sf), C)
    result = F.when(F.col("pnl") > 0, "win").when(F.col("pnl") == -C.sl_pips, "loss").otherwise("open")
    return acted.select("symbol", "ts", result.alias("result"), F.when(F.col("pnl") != -1, F.col("pnl")).alias("pips"))


def perf_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(E.performance(_signal_log(spark, sf)), "symbol", "total", "wins", "losses", "open", "win_rate", "pips", "profit_factor")


def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(E.equity_curve(_signal_log(spark, sf)), "symbol", "ts", "equity")


def feature_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(I.summary(energy_bars(spark, sf)), "feature", "mean", "std", "min", "max")


def signal_history(spark: SparkSession, sf: str) -> DataFrame:
    """The latest fifty acted-on bars."""
    return tidy(S.history(S.candidates(scored(spark, sf), C)), "symbol", "ts", "pred")


def display_names(spark: SparkSession, sf: str) -> DataFrame:
    out = M.layer2(energy_bars(spark, sf), C).withColumns({"volatility": S.volatility_bucket(), "session": S.session_name(), "zone": S.zone_name(), "trend": S.trend_text("l2_session_trend"), **S.candle_geometry()})
    return tidy(out, "symbol", "ts", "volatility", "session", "zone", "trend", "body_low", "body_height")


def labels_report(spark: SparkSession, sf: str) -> DataFrame:
    """Report of ``toxic`` as a prediction of poor quality."""
    rows = spark.read.parquet(f"{sf}/labels.parquet").withColumn("poor", 1 - F.col("quality"))
    return tidy(E.class_report(rows, "poor", "toxic", [0, 1]), "name", "precision", "recall", "f1", "support")


def lineitem_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling statistics over a tall table, one series per supplier."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("symbol"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("ts"), "l_orderkey", "l_linenumber", "l_extendedprice")
    out = rows.withColumns({"mean20": F.avg("l_extendedprice").over(trailing(20)), "max20": F.max("l_extendedprice").over(trailing(20)), "previous": F.lag("l_extendedprice").over(series())})
    return tidy(out, "l_orderkey", "l_linenumber", "mean20", "max20", "previous")


def latest_features(spark: SparkSession, sf: str) -> DataFrame:
    """Each symbol's last bar, recomputed from its last 500 bars."""
    return tidy(P.latest_features(hourly(spark, sf), children(spark, sf), C, 500), "symbol", "ts", *P.FEATURES)


def csv_m1_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written with date and time columns and read back."""
    path = scratch(spark, "csv-m1")
    bars = hourly(spark, sf).filter("symbol = 'even'")
    bars.select(F.date_format("ts", "yyyy.MM.dd").alias("date"), F.date_format("ts", "HH:mm").alias("time"), "open", "high", "low", "close", "volume").write.option("header", True).csv(path)
    return tidy(CSV.as_doubles(CSV.read_bars(spark, path, "even")), "symbol", "ts", "open", "high", "low", "close", "volume")


def csv_m15_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written with one timestamp column and no volume, read back."""
    path = scratch(spark, "csv-m15")
    hourly(spark, sf).filter("symbol = 'odd'").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "open", "high", "low", "close").write.option("header", True).csv(path)
    return tidy(CSV.as_doubles(CSV.read_bars(spark, path, "odd")), "symbol", "ts", "open", "high", "low", "close", "volume")


def stage_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Layer 1 as a stage by symbol and year, read back through the chain of fallbacks."""
    path = scratch(spark, "stage")
    CSV.write_stage(energy_bars(spark, sf), path)
    return tidy(CSV.read_stage(spark, f"{path}-later", path), "symbol", "ts", "l1_volatility_energy", "l1_m1_count")


def signal_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Signal records of the whole scored history, cool-down included."""
    out = S.scan(_signal_base(spark, sf), replace(C, cooldown=3)).withColumn("top_reasons", F.array_join("top_reasons", " | "))
    return tidy(out, "symbol", "ts", "direction", "conf", "tier", "entry_price", "stop_loss", "take_profit", "risk_reward", "top_reasons", "candle_dna")


def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same records from a stream of the scored bars, by state instead of a scan."""
    out = S.with_levels(T.stream_choice(_signal_base(spark, sf), replace(C, cooldown=3)), C).withColumns({"conf": F.round("conf", 2), "top_reasons": F.array_join("top_reasons", " | ")})
    return tidy(out, "symbol", "ts", "direction", "conf", "tier", "entry_price", "stop_loss", "take_profit", "risk_reward", "top_reasons", "candle_dna")


def queries() -> dict[str, Query]:
    named = [
        spike_flags, ingest_clean, ingest_statistics, gap_report, ohlc_bars, ohlc_4h, bucket_collect, m1_m15_join, completeness, last_complete_bar, l1_nested, l3_order_blocks, label_barrier,
        label_distribution, time_split, fold_bounds, class_weights, corr_prune, feature_correlation, asof_bars, confusion, class_report, trading_sim, tier_analysis, signal_rules, cooldown, daily_loss_limit, session_filter,
        dedupe_keep_last, fill_gap, perf_summary, equity_curve, feature_summary, signal_history, latest_features, display_names, labels_report, lineitem_rolling, csv_m1_scan, csv_m15_scan,
        stage_round_trip, signal_scan, stream_scan,
    ]
    made: dict[str, Query] = {f.__name__: f for f in named}
    made |= {
        "l1_custom_volume": _layer1("l1_custom_volume", "l1_m1_count"), "l1_energy": _layer1("l1_volatility_energy"), "l1_velocity": _layer1("l1_price_velocity"), "l1_reversals": _layer1("l1_reversal_count"),
        "l1_early_late": _layer1("l1_early_late_ratio"), "l1_acceleration": _layer1("l1_price_acceleration"), "l1_absorption": _layer1("l1_absorption_count", "l1_absorption_intensity"),
        "l2_session": _layer2("l2_session", "l2_day_of_week", "l2_hour"), "l2_overlap_killzone": _layer2("l2_session_overlap", "l2_kill_zone"), "l2_session_stats": _layer2("l2_distance_from_session_open", "l2_session_position"),
        "l2_vol_spike": _layer2("l2_time_since_vol_spike"), "l2_vol_rank": _scanned("l2_session_volatility_rank"), "l2_session_trend": _layer2("l2_session_trend"),
        "l3_swings": _layer3_light(_swung, "l3_swing_high", "l3_swing_low"), "l3_structure": _layer3_light(lambda d: L3.structure_trend(_swung(d)), "l3_structure_trend"), "l3_htf_trend": _layer3_light(_higher, "l3_h1_trend", "l3_h4_trend"),
        "l3_bos_choch": _layer3_light(lambda d: L3.breaks(_swung(d), C), "l3_bos_direction", "l3_choch_flag"),
        "l3_block_scan": _layer3("l3_demand_ob_distance", "l3_supply_ob_distance"), "l3_fvg": _layer3("l3_fvg_active", "l3_fvg_distance"), "l3_liquidity": _layer3("l3_buy_liq_distance", "l3_sell_liq_distance"),
        "l3_sweep": _layer3("l3_liquidity_sweep"), "l3_premium_discount": _layer3_light(lambda d: L3.premium_discount(L3.breaks(_swung(d), C), C), "l3_premium_discount"),
        "l4_whale": _layer4_light(lambda d: d.withColumn("l4_whale_footprint", L4.whale(C)), "l4_whale_footprint"),
        "l4_divergence": _layer4_light(lambda d: d.withColumn("l4_momentum_divergence", L4.divergence(C)), "l4_momentum_divergence"),
        "l4_streak": _layer4_light(lambda d: L4.streak(d, C), "l4_consecutive_bias"), "l4_climax": _layer4_light(lambda d: d.withColumn("l4_volume_climax", L4.climax(C)), "l4_volume_climax"),
        "l4_compression": _layer4_light(lambda d: d.withColumn("l4_range_compression", L4.compression(C)), "l4_range_compression"),
        "l4_regime": _layer4_light(lambda d: d.withColumn("l4_time_volatility_regime", L4.regime(C)), "l4_time_volatility_regime"),
        "l4_continuation": _scanned("l4_session_continuation"),
        "l4_trap": _features("l4_trap_score"), "l4_dna": _features("l4_candle_dna"), "l4_confluence": l4_confluence, "features_all": _features(*P.FEATURES),
        "train_predict": T.train_predict, "walk_forward": T.walk_forward, "stream_bars": T.stream_bars, "stream_signals": T.stream_signals,
    }
    return made


def oracle_sql() -> dict[str, str]:
    return oracle.sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spike_flags(spark, sf_dir)
