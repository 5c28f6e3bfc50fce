"""Layers 2 to 4 against plain sequential models on random walks."""

import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest

from tidemark.config import EngineConfig

C = EngineConfig(pip=1.0, liq_tolerance_pips=0.5, gap_pips=0.2, block_age=40, liq_window=30)
COLUMNS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(seed, n=320, symbol="s"):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n)).round(2)
    open_ = np.concatenate([[100.0], close[:-1]]) + rng.normal(0, 0.4, n).round(2)
    high, low = np.maximum(open_, close) + rng.random(n).round(2), np.minimum(open_, close) - rng.random(n).round(2)
    start = dt.datetime(2024, 1, 1)
    return [(symbol, start + dt.timedelta(minutes=15 * i), *(float(round(x[i], 2)) for x in (open_, high, low, close)), 1.0) for i in range(n)]


def swings(high, low, n=5):
    size = len(high)
    sh, sl = [0] * size, [0] * size
    for i in range(n, size - n):
        around = [*range(i - n, i), *range(i + 1, i + n + 1)]
        sh[i] = int(all(high[i] > high[k] for k in around))
        sl[i] = int(all(low[i] < low[k] for k in around))
    return sh, sl


def trend(high, low, sh, sl):
    points, out = [], []
    for i in range(len(high)):
        points += [("H", high[i])] * sh[i] + [("L", low[i])] * sl[i]
        h, lo = ([p for k, p in points[-4:] if k == kind] for kind in "HL")
        ok = len(points) >= 4 and len(h) == 2 and len(lo) == 2
        out.append(1 if ok and h[1] > h[0] and lo[1] > lo[0] else -1 if ok and h[1] < h[0] and lo[1] < lo[0] else 0)
    return out


def machine(bars, n=5):
    """Breaks, changes of character, blocks, gaps and zones, one bar after the other."""
    o, h, lo, c = ([b[k] for b in bars] for k in (2, 3, 4, 5))
    sh, sl = swings(h, lo)
    up = down = top = bottom = None
    demand, supply, bulls, bears, out, last = [], [], [], [], [], 0
    for i in range(len(bars)):
        j = i - n
        if j >= 0 and sh[j]:
            up, top = j, h[j]
        if j >= 0 and sl[j]:
            down, bottom = j, lo[j]
        bos = 0
        if up is not None and not (isinstance(up, tuple)) and c[i] > h[up]:
            bos = 1
            found = [k for k in range(up, i) if c[k] < o[k]]
            if found:
                demand.append((i, c[found[-1]], o[found[-1]]))
            up = (up,)
        elif down is not None and not isinstance(down, tuple) and c[i] < lo[down]:
            bos = -1
            found = [k for k in range(down, i) if c[k] > o[k]]
            if found:
                supply.append((i, o[found[-1]], c[found[-1]]))
            down = (down,)
        choch = bos if bos and last == -bos else 0
        last = bos or last
        demand = [b for b in demand if c[i] >= b[1] and i - b[0] <= C.block_age]
        supply = [b for b in supply if c[i] <= b[2] and i - b[0] <= C.block_age]
        dem = min((c[i] - (a + z) / 2 for _, a, z in demand), key=abs, default=0.0)
        sup = min(((a + z) / 2 - c[i] for _, a, z in supply), key=abs, default=0.0)
        bulls = [g for g in bulls if lo[i] > g[1]]
        bears = [g for g in bears if h[i] < g[0]]
        if i >= 2 and lo[i] - h[i - 2] >= C.gap_pips:
            bulls.append((h[i - 2], lo[i]))
        if i >= 2 and lo[i - 2] - h[i] >= C.gap_pips:
            bears.append((h[i], lo[i - 2]))
        gap = min((c[i] - (a + z) / 2 for a, z in bulls), key=abs, default=None)
        if gap is None:
            gap = min(((a + z) / 2 - c[i] for a, z in bears), key=abs, default=0.0)
        side = 1 if bulls else -1 if bears else 0
        zone = 0
        if top is not None and bottom is not None and top - bottom > 1e-10:
            at = (c[i] - bottom) / (top - bottom)
            zone = 1 if at > 0.55 else -1 if at < 0.45 else 0
        out.append((bos, choch, dem, sup, side, gap, zone))
    return out


def pool(prices):
    best, level = 2, None
    for a in prices:
        near = [x for x in prices if abs(x - a) <= 0.5]
        if len(near) > best:
            best, level = len(near), sum(near) / len(near)
    return level


@pytest.fixture(scope="module")
def bars(spark):
    rows = walk(1, symbol="a") + walk(2, symbol="b") + walk(3, 8, symbol="c")
    return rows, spark.createDataFrame(rows, COLUMNS)


def by_symbol(rows):
    return {s: [r for r in rows if r[0] == s] for s in sorted({r[0] for r in rows})}


@pytest.mark.parametrize("chunk", [8192, 37])
def test_layer3_matches_machine(bars, chunk):
    from tidemark.operators.market import layer3

    rows, frame = bars
    found = layer3(frame, replace(C, chunk_bars=chunk)).collect()
    assert len(found) == len(rows)
    got = {s: sorted((r for r in found if r.symbol == s), key=lambda r: r.ts) for s in "abc"}
    for s, own in by_symbol(rows).items():
        h, lo, c = ([b[k] for b in own] for k in (3, 4, 5))
        sh, sl = swings(h, lo)
        assert [(r.l3_swing_high, r.l3_swing_low) for r in got[s]] == list(zip(sh, sl, strict=True))
        assert [r.l3_structure_trend for r in got[s]] == trend(h, lo, sh, sl)
        for i, (r, want) in enumerate(zip(got[s], machine(own), strict=True)):
            have = (r.l3_bos_direction, r.l3_choch_flag, r.l3_demand_ob_distance, r.l3_supply_ob_distance, r.l3_fvg_active, r.l3_fvg_distance, r.l3_premium_discount)
            assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(have, want, strict=True)), (s, i, have, want)
            buy, sell = pool(h[max(0, i - 29) : i + 1]), pool([-x for x in lo[max(0, i - 29) : i + 1]])
            sell = None if sell is None else -sell
            assert math.isclose(r.l3_buy_liq_distance, 0.0 if buy is None else buy - c[i], abs_tol=1e-9)
            assert math.isclose(r.l3_sell_liq_distance, 0.0 if sell is None else c[i] - sell, abs_tol=1e-9)


def test_gaps_that_stay_open_over_many_chunks(spark):
    """A rise with gaps, then a fall that closes them one after the other."""
    from tidemark.operators.market import layer3

    rng = np.random.default_rng(8)
    steps = np.concatenate([np.full(120, 1.5), np.full(170, -1.1)]) + rng.normal(0, 0.3, 290).round(2)
    close = 100 + np.cumsum(steps).round(2)
    start = dt.datetime(2024, 1, 1)
    rows = [("s", start + dt.timedelta(minutes=15 * i), *(float(round(x, 2)) for x in (c - d / 2, max(c, c - d / 2) + 0.1, min(c, c - d / 2) - 0.1, c)), 1.0) for i, (c, d) in enumerate(zip(close, steps, strict=True))]
    want = [(w[4], w[5]) for w in machine(rows)]
    assert sum(side == 1 for side, _ in want) > 150
    for chunk in (16, 8192):
        got = sorted(layer3(spark.createDataFrame(rows, COLUMNS), replace(C, chunk_bars=chunk)).collect(), key=lambda r: r.ts)
        assert all(r.l3_fvg_active == side and math.isclose(r.l3_fvg_distance, gap, abs_tol=1e-9) for r, (side, gap) in zip(got, want, strict=True))


def test_trailing_quantiles():
    from tidemark.operators.chunks import trailing_quantiles

    values = np.random.default_rng(1).normal(0, 1, 60).round(1)
    values[[3, 40]] = np.nan
    for own in (0, 25):
        low, high = trailing_quantiles(values, own, 20, 5, [0.25, 0.95])
        for k, i in enumerate(range(own, 60)):
            window = values[max(0, i - 19) : i + 1]
            for got, q in ((low[k], 0.25), (high[k], 0.95)):
                assert np.isnan(got) if len(window) < 5 else math.isclose(got, np.nanquantile(window, q), abs_tol=1e-12)


def test_block_join_equals_scan(bars):
    from tidemark.operators import layer3 as L3
    from tidemark.operators.market import layer3

    _, frame = bars
    base = L3.breaks(frame.withColumns(L3.swing_columns(5)), C)
    joined = L3.block_distance(L3.block_distance(base, True, "d", C), False, "s", C)
    a = {(r.symbol, r.ts): (round(r.d, 9), round(r.s, 9)) for r in joined.collect()}
    b = {(r.symbol, r.ts): (round(r.l3_demand_ob_distance, 9), round(r.l3_supply_ob_distance, 9)) for r in layer3(frame, C).collect()}
    assert a == b and any(x != (0.0, 0.0) for x in a.values())


def test_layer2_and_4(bars):
    from pyspark.sql import functions as F

    from tidemark.operators.layer4 import continuation, streak
    from tidemark.operators.market import layer2

    rows, frame = bars
    out = layer2(frame.withColumn("l1_volatility_energy", F.col("high") - F.col("low")), C)
    got = continuation(streak(out, C), C).collect()
    for s, own in by_symbol(rows).items():
        mine = sorted((r for r in got if r.symbol == s), key=lambda r: r.ts)
        run, past, since, energies = [], {0: [], 1: [], 2: []}, None, []
        asian = london = None
        p, lo_hist, ny_hist, bias = 0.5, [], [], 0
        for i, (b, r) in enumerate(zip(own, mine, strict=True)):
            o, h, lo, c = b[2:6]
            label = 0 if b[1].hour < 8 else 1 if b[1].hour < 16 else 2
            if i and label != before:
                if (before, label) == (0, 1):
                    asian = end
                    p = (np.mean(lo_hist) if lo_hist else 0.5) if asian else 0.5
                elif (before, label) == (1, 2):
                    london = end
                    if asian is not None:
                        lo_hist.append((end > 0) == (asian > 0) and asian != 0)
                    p = (np.mean(ny_hist) if ny_hist else 0.5) if london else 0.5
                elif (before, label) == (2, 0):
                    if london:
                        ny_hist.append((end > 0) == (london > 0) and end != 0)
                    p = 0.5
                run = []
            run.append(b)
            assert r.l2_session == label and math.isclose(r.l4_session_continuation, p)
            assert math.isclose(r.l2_distance_from_session_open, c - run[0][2], abs_tol=1e-9)
            top, bottom = max(x[3] for x in run), min(x[4] for x in run)
            assert math.isclose(r.l2_session_position, min(max((c - bottom) / (top - bottom + 1e-10), 0), 1), abs_tol=1e-9)
            hist = past[label][-100:]
            assert math.isclose(r.l2_session_volatility_rank, sum(x <= h - lo for x in hist) / len(hist) if hist else 0.0)
            past[label].append(h - lo)
            energies.append(h - lo)
            w = energies[-20:]
            if len(w) == 20 and h - lo > np.mean(w) + 2 * np.std(w, ddof=1):
                since = i
            assert r.l2_time_since_vol_spike == (50 if since is None else min(i - since, 50))
            atr = np.mean([x[3] - x[4] for x in own[max(0, i - 13) : i + 1]])
            slope = np.polyfit(range(len(run)), [x[5] for x in run], 1)[0] / atr if len(run) > 1 else 0.0
            assert math.isclose(r.l2_session_trend, slope, abs_tol=1e-7)
            way = (c > o) - (c < o)
            bias = bias + way if way and bias * way > 0 else way or bias
            assert r.l4_consecutive_bias == max(-20, min(20, bias))
            before, end = label, r.l2_session_trend


def test_labels(bars):
    from tidemark.operators.labels import barrier_labels

    rows, frame = bars
    config = EngineConfig(pip=1.0, tp_pips=3.0, sl_pips=2.0, horizon=12)
    got = {(r.symbol, r.ts): r.label for r in barrier_labels(frame, config).collect()}
    for own in by_symbol(rows).values():
        for i, b in enumerate(own):
            want = 0
            for f in own[i + 1 : i + 13]:
                up, down = f[3] >= b[5] + 3, f[4] <= b[5] - 2
                if up or down:
                    want = -1 if down else 1
                    break
            assert got[b[0], b[1]] == want


def test_interval_join(spark):
    from tidemark.operators.windows import binned_interval_join

    rng = np.random.default_rng(4)
    spans = [("s", int(a), int(a + rng.integers(0, 40))) for a in rng.integers(0, 100, 30)]
    points = spark.createDataFrame([("s", i) for i in range(120)], "symbol string, i int")
    got = binned_interval_join(points, spark.createDataFrame(spans, "symbol string, start_i int, end_i int"), 16).collect()
    assert sorted((r.i, r.start_i, r.end_i) for r in got) == sorted((i, a, z) for i in range(120) for _, a, z in spans if a <= i < z)


def test_pool_means_add_up_from_the_oldest_price():
    import functools
    import operator

    import numpy as np

    from tidemark.operators.layer3 import _pools

    rng = np.random.default_rng(5)
    prices = np.round(rng.uniform(0, 40, 400), 2)
    got = _pools(prices, 0, 100, 5.0, 3)
    for t in range(len(prices)):
        window = prices[max(0, t - 99) : t + 1].tolist()
        near = [[x for x in window if abs(x - a) <= 5.0] for a in window]
        most = max(near, key=len)
        assert (np.isnan(got[t]) and len(most) < 3) or got[t] == functools.reduce(operator.add, most, 0.0) / len(most)
