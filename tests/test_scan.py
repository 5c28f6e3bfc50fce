"""Prefix scans over time chunks against windows over whole series."""

import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_structure import COLUMNS, C, walk

SMALL = replace(C, dna_window=50, dna_least=5, regime_long=60, regime_short=20, rank_window=30)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(11)
    rows = [r for seed, symbol, n in ((1, "a", 900), (2, "b", 300), (3, "c", 4), (4, "d", 1)) for r, there in zip(walk(seed, n, symbol), rng.random(n) > 0.1, strict=True) if there or n < 5]
    made = spark.createDataFrame(rows, COLUMNS)
    made = made.withColumns({"l1_volatility_energy": F.round(F.col("high") - F.col("low"), 2), "l1_custom_volume": F.pmod(F.hash("ts"), F.lit(16)).cast("long"), "l1_price_velocity": (F.col("close") - F.col("open")) / 3})
    return made.withColumn("open", F.when(F.pmod(F.hash("ts", "open"), F.lit(9)) == 0, F.col("close")).otherwise(F.col("open"))).cache()  # some candles without a body


@pytest.fixture(scope="module")
def windowed(bars):
    """The columns as windows over each whole series."""
    from tidemark.operators import layer3 as L3
    from tidemark.operators import layer4 as L4
    from tidemark.operators.layer2 import layer2
    from tidemark.operators.windows import series

    same = Window.partitionBy("symbol", "l2_session").orderBy("ts").rowsBetween(-SMALL.rank_window, -1)
    past = F.collect_list("l1_volatility_energy").over(same)
    out = layer2(bars, SMALL).withColumn("__past", past)
    out = out.withColumn("l2_session_volatility_rank", F.when(F.size("__past") > 0, F.size(F.filter("__past", lambda x: x <= F.col("l1_volatility_energy"))) / F.size("__past")).otherwise(0.0))
    out = L3.higher_trend(L3.higher_trend(out, "1 hour", "l3_h1_trend", SMALL), "4 hours", "l3_h4_trend", SMALL)
    out = L3.structure_trend(out.withColumns(L3.swing_columns(SMALL.swing)))
    out = L3.premium_discount(L3.breaks(out, SMALL), SMALL)
    out = L3.block_distance(L3.block_distance(out, True, "l3_demand_ob_distance", SMALL), False, "l3_supply_ob_distance", SMALL)
    out = out.withColumn("__before", F.coalesce(F.lag("l3_bos_direction").over(series()), F.lit(0)))
    quantile = lambda c, p: F.when(F.row_number().over(series()) >= SMALL.dna_least, F.percentile(c, p).over(series().rowsBetween(1 - SMALL.dna_window, 0)))
    out = out.withColumns({"__v75": quantile("l1_price_velocity", 0.75), "__v95": quantile("l1_price_velocity", 0.95), "__r25": quantile(F.col("high") - F.col("low"), 0.25)})
    out = L4.continuation(L4.streak(out, SMALL), SMALL)
    out = out.withColumns({"l4_momentum_divergence": L4.divergence(SMALL), "l4_volume_climax": L4.climax(SMALL), "l4_range_compression": L4.compression(SMALL), "l4_time_volatility_regime": L4.regime(SMALL)})
    return {(r.symbol, r.ts): r.asDict() for r in out.collect()}


@pytest.mark.parametrize("size", [7, 64, 8192])
def test_market_columns_equal_windows(bars, windowed, size):
    from tidemark.operators.layer2 import calendar
    from tidemark.operators.market import PARTS, WHOLE, market_columns

    found = market_columns(calendar(bars, SMALL), replace(SMALL, chunk_bars=size)).collect()
    assert len(found) == len(windowed)
    shared = [c for c in (*WHOLE, *PARTS) if c in next(iter(windowed.values()))]
    assert len(shared) == 26
    for r in found:
        want, got = windowed[r.symbol, r.ts], r.asDict()
        for c in shared:
            assert (got[c] is None) == (want[c] is None) and (got[c] is None or math.isclose(got[c], want[c], rel_tol=1e-9, abs_tol=1e-8)), (c, r.symbol, r.i, got[c], want[c])


def test_features_need_no_window_over_a_symbol(spark, sf):
    from tidemark.config import EVENTS
    from tidemark.plans import features as P

    made = P.event_features(spark, sf, EVENTS)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("bar_ts" in line for line in windows)  # children of one bar, once for each use of the bars
    assert made.count() > 500


def test_scan_of_one_series_is_dealt_over_tasks(spark):
    from tidemark.operators.scan import Scan, chunk_of, prefix_scan

    start = dt.datetime(2024, 1, 1)
    rows = [(symbol, start + dt.timedelta(minutes=k * step), float(k % 7)) for symbol, n, step in (("s", 4000, 1), (None, 50, 3), ("t", 1, 1)) for k in range(n)]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double").withColumn("chunk", chunk_of("ts", "1 minute", 96))
    values = lambda t: np.asarray(t["x"])
    total = Scan(begin=lambda: 0.0, summarise=lambda t: float(values(t).sum()), fold=lambda a, b: a + b, passed=lambda t, s, after: {"sum": s + np.cumsum(values(t)), "later": np.full(t.num_rows, float(after or 0))}, enough=lambda after: (sum(after[:2]), len(after) >= 2))
    fields = [T.StructField("sum", T.DoubleType()), T.StructField("later", T.DoubleType())]
    out = prefix_scan(frame, total, fields)
    assert out.columns == ["symbol", "ts", "x", "sum", "later"]
    spread = out.select("symbol", "ts", "sum", "later", F.spark_partition_id().alias("task"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = spread.collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for symbol in ("s", None, "t"):
        mine = sorted((r for r in got if r.symbol == symbol), key=lambda r: r.ts)
        x = np.array([r[2] for r in rows if r[0] == symbol])
        assert np.allclose([r.sum for r in mine], np.cumsum(x))
        if symbol == "s":
            assert len({r.task for r in mine}) > 1
            assert mine[0].later == x[96:288].sum() and mine[3750].later == x[3840:].sum() and mine[-1].later == 0
    assert prefix_scan(frame.limit(0), total, fields).count() == 0


def listed_labels(frame, config):
    """The label by a list of the rows ahead of each row."""
    from tidemark.operators.windows import series

    tp, sl = config.tp_pips * config.pip, config.sl_pips * config.pip
    close = F.col("close")
    first = F.get(F.filter(F.col("__ahead"), lambda x: (x["high"] >= close + tp) | (x["low"] <= close - sl)), F.lit(0))
    up, down = first["high"] >= close + tp, first["low"] <= close - sl
    label = F.when(up & down, 1 if tp <= sl else -1).when(up, 1).when(down, -1).otherwise(0)
    return frame.withColumn("__ahead", F.collect_list(F.struct("high", "low")).over(series().rowsBetween(1, config.horizon))).withColumn("label", label)


@pytest.mark.parametrize(("chunk", "horizon", "tp"), [(7, 12, 3.0), (16, 50, 4.0), (8192, 96, 2.0), (3, 200, 9.0)])
def test_labels_equal_lists(bars, chunk, horizon, tp):
    from tidemark.operators.labels import barrier_labels

    config = replace(C, tp_pips=tp, sl_pips=3.0, horizon=horizon, chunk_bars=chunk)
    want = {(r.symbol, r.ts): r.label for r in listed_labels(bars, config).collect()}
    got = {(r.symbol, r.ts): r.label for r in barrier_labels(bars, config).collect()}
    assert got == want and len(set(want.values())) == 3


def test_long_horizons_cost_little():
    """The search, not Spark around it: 40,000 bars under horizons of 96 and 10,000, with barriers that are rarely met."""
    import time

    from tidemark.operators.labels import first_passage

    rng = np.random.default_rng(2)
    close = 100 + np.cumsum(rng.normal(0, 1, 50_000))
    high, low = close + 0.5, close - 0.5

    def took(horizon, far):
        ends = np.minimum(np.arange(40_000) + 1 + horizon, len(close))
        began = time.perf_counter()
        for _ in range(3):
            at = first_passage(high, low, np.arange(40_000) + 1, ends, close[:40_000] + far, close[:40_000] - far)
        return time.perf_counter() - began, at

    (short, _), (long, at) = took(96, 60.0), took(10_000, 60.0)
    assert long < 4 * short  # twice the levels, and all of them are searched
    for i in rng.integers(0, 40_000, 200).tolist():
        hit = np.nonzero((high[i + 1 : i + 10_001] >= close[i] + 60) | (low[i + 1 : i + 10_001] <= close[i] - 60))[0]
        assert at[i] == (i + 1 + hit[0] if len(hit) else min(i + 10_001, 50_000))


def test_drawdown_over_chunks(spark):
    """Against the running sum over the whole history."""
    from tidemark.operators.evaluate import simulate, tiers

    rng = np.random.default_rng(6)
    start = dt.datetime(2024, 1, 1)
    rows = [("ab"[k % 2], start + dt.timedelta(minutes=15 * k), float(rng.choice([150.0, -100.0, -1.0])), float(rng.uniform(55, 100))) for k in range(900)] + [("c", start, -100.0, 65.0), ("d", start, 150.0, 99.0), ("d", start + dt.timedelta(days=3), 150.0, 99.0)]
    acted = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, pnl double, conf double").withColumn("label", F.when(F.col("pnl") == -1, 0).otherwise(F.when(F.col("pnl") > 0, 1).otherwise(-1)))

    def plain(pnl):
        eq = np.cumsum(pnl)
        won, lost = pnl[pnl > 0].sum(), -pnl[(pnl < 0) & (pnl != -1)].sum()
        return (len(pnl), (pnl > 0).mean(), won, lost, won / max(lost, 1e-10), (np.maximum.accumulate(eq) - eq).max(), pnl.mean() / pnl.std() * math.sqrt(C.bars_per_year) if pnl.std() > 0 else 0.0)

    for chunk in (5, 64, 8192):
        config = replace(C, chunk_bars=chunk)
        got = {r.symbol: tuple(r)[1:] for r in simulate(acted, config, "symbol").collect()}
        assert set(got) == {"a", "b", "c", "d"}
        for s, have in got.items():
            assert np.allclose(have, plain(np.array([r[2] for r in rows if r[0] == s])))
        by_tier = {r.tier: tuple(r)[1:] for r in tiers(acted, config).collect()}
        for number, low, high in C.tiers:
            inside = sorted((r for r in rows if low <= r[3] < high), key=lambda r: (r[1], r[0]))
            assert np.allclose(by_tier[number], plain(np.array([r[2] for r in inside])))
    assert {r.tier: r.total_trades for r in tiers(acted.limit(0), C).collect()} == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize(("chunk", "cooldown"), [(3, 2), (7, 5), (64, 3), (64, 100), (8192, 3), (10, 0), (10, 1)])
def test_cool_down_over_chunks(spark, chunk, cooldown):
    from tidemark.operators.signals import cool_down

    rng = np.random.default_rng(chunk + cooldown)
    found = {"dense": list(range(400)), "some": sorted(rng.choice(2000, 300, replace=False).tolist()), "one": [5]}
    rows = [(s, i, f"{s}{i}") for s, at in found.items() for i in at] + [("some", found["some"][0], "again")]
    got = cool_down(spark.createDataFrame(rows, "symbol string, i int, other string").repartition(6), replace(C, chunk_bars=chunk, cooldown=cooldown))
    assert got.columns == ["symbol", "i", "other"]
    kept = {s: sorted({r.i for r in got.collect() if r.symbol == s}) for s in found}
    for s, at in found.items():
        want, last = [], -math.inf
        for i in at:
            if i - last >= cooldown:
                want.append(i)
                last = i
        assert kept[s] == want
    assert got.filter("other = 'again'").count() == 1


def test_ranks_and_quantiles_cost_the_same_for_any_width():
    import time

    from tidemark.operators.chunks import trailing_quantiles, trailing_rank

    values = np.random.default_rng(5).normal(size=12_000)
    values[rng_at := np.arange(0, 12_000, 97)] = np.nan

    def took(width):
        began = time.perf_counter()
        out = trailing_rank(values, 0, width), *trailing_quantiles(values, 0, width, 5, [0.25, 0.9])
        return time.perf_counter() - began, out

    (short, narrow), (long, wide) = took(100), took(5000)
    assert long < 3 * short
    for width, (rank, low, high) in ((100, narrow), (5000, wide)):
        for i in (0, 3, 4, 99, 100, 101, 4999, 5001, 11_999):
            before, now = values[max(0, i - width) : i], values[max(0, i - width + 1) : i + 1]
            before, now = before[~np.isnan(before)], now[~np.isnan(now)]
            if i not in rng_at:
                assert math.isclose(rank[i], (before <= values[i]).mean() if len(before) else 0.0)
            if i >= 4:
                assert math.isclose(low[i], np.quantile(now, 0.25), abs_tol=1e-12) and math.isclose(high[i], np.quantile(now, 0.9), abs_tol=1e-12)
            else:
                assert np.isnan(low[i])


def test_correlations_in_one_pass(spark):
    import pandas as pd

    from tidemark.operators.correlation import correlation_table, gram, prune_correlated

    rng = np.random.default_rng(9)
    x = rng.normal(1e6, 1, (500, 6))
    x[:, 2], x[:, 3] = x[:, 0] * 2 + 1, 7.0
    x[:, 4] = x[:, 1] + rng.normal(0, 0.1, 500)
    table = pd.DataFrame(x, columns=list("abcdef"))
    table = table.mask(rng.random(table.shape) < 0.1)
    rows = [[None if v != v else v for v in r] for r in table.to_numpy().tolist()]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in "abcdef")).repartition(7)
    want = table.corr()
    got = {(r.a, r.b): (r.n, r.r) for r in correlation_table(frame, list("abcdef")).collect()}
    assert len(got) == 15
    for (a, b), (n, r) in got.items():
        assert n == (table[a].notna() & table[b].notna()).sum()
        assert (r is None) == math.isnan(want.loc[a, b]) and (r is None or math.isclose(r, want.loc[a, b], abs_tol=1e-9))
    assert prune_correlated(frame, list("abcdef"), 0.95) == ["a", "b", "d", "f"]
    assert np.array_equal(gram(frame.limit(0), ["a", "b"]).sums, np.zeros((4, 2, 2))) and prune_correlated(frame.limit(0), ["a", "b"], 0.5) == ["a", "b"]


@pytest.mark.parametrize("chunk", ["7 minutes", "1 day"])
def test_asof_join(spark, chunk):
    """Two grids with gaps, one hot symbol, equal times, nulls, and a limit of age, against a search."""
    from tidemark.operators.asof import asof_join

    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    at = lambda k: start + dt.timedelta(minutes=int(k))
    left = [(s, at(k), j) for j, (s, k) in enumerate([("hot", k) for k in rng.integers(0, 900, 700)] + [("cold", 500), (None, 3), (None, 700), ("alone", 1)])]
    right = [("hot", at(k), float(v), None if v % 5 == 0 else int(v)) for k, v in zip(rng.integers(100, 800, 60), rng.integers(0, 100, 60), strict=True)] + [("cold", at(2), 7.0, 7), (None, at(600), 8.0, 8), ("never", at(1), 9.0, 9)]
    a, b = spark.createDataFrame(left, "symbol string, ts timestamp_ntz, id int").repartition(5), spark.createDataFrame(right, "symbol string, ts timestamp_ntz, x double, y int").repartition(3)

    def partner(s, ts, age):
        found = [r for r in right if r[0] == s and r[1] <= ts and ts - r[1] <= age]
        return max(found, key=lambda r: (r[1], r[2], math.inf if r[3] is None else r[3]))[2:] if found else (None, None)

    for within, age in ((None, dt.timedelta(days=99)), ("40 minutes", dt.timedelta(minutes=40))):
        got = asof_join(a, b, ["x", "y"], chunk, within)
        assert got.columns == ["symbol", "ts", "id", "x", "y"] and dict(got.dtypes)["y"] == "int"
        assert {r.id: (r.x, r.y) for r in got.collect()} == {j: partner(s, ts, age) for s, ts, j in left}
    with pytest.raises(ValueError, match="both sides"):
        asof_join(a, b.withColumnRenamed("x", "id"), ["id"])
    assert asof_join(a, b.limit(0), ["x"]).filter("x is not null").count() == 0 and asof_join(a.limit(0), b, ["x"]).count() == 0
