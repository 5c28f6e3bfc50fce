"""DuckDB SQL for the registered queries, built from common table expressions."""

from __future__ import annotations

import re

P, U = "PARTITION BY symbol ORDER BY ts", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

#: Each table expression may use those before it.
CTES: dict[str, str] = {}


def _bars(source: str, width: str) -> str:
    return (
        f"SELECT symbol, time_bucket(INTERVAL '{width}', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, "
        f"count(*)::DOUBLE AS volume FROM {source} GROUP BY 1, 2"
    )


def _resample(width: str) -> str:
    return f"SELECT symbol, time_bucket(INTERVAL '{width}', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2"


def _roll(n: int) -> str:
    return f"({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _spike(x: str) -> str:
    w = _roll(20)
    return f"coalesce(count(*) OVER {w} = 20 AND {x} > avg({x}) OVER {w} + 2 * stddev_samp({x}) OVER {w}, false)"


def _swings(source: str) -> str:
    a, z = f"({P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", f"({P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
    full = f"count(*) OVER {a} = 5 AND count(*) OVER {z} = 5"
    return (
        f"SELECT *, (row_number() OVER ({P}) - 1)::INT AS i, coalesce({full} AND high > max(high) OVER {a} AND high > max(high) OVER {z}, false)::INT AS sh, "
        f"coalesce({full} AND low < min(low) OVER {a} AND low < min(low) OVER {z}, false)::INT AS sl FROM {source}"
    )


def _trend(source: str) -> str:
    """Events in a table of their own, the last state of each bar carried forward by an as-of join."""
    return f"""SELECT s.*, coalesce(e.state, 0) AS trend FROM {source} s ASOF LEFT JOIN (
      SELECT symbol, ts, arg_max(state, kind) AS state FROM (
        SELECT symbol, ts, kind, CASE WHEN len(four) = 4 AND len(h) = 2 AND h[2] > h[1] AND l[2] > l[1] THEN 1 WHEN len(four) = 4 AND len(h) = 2 AND h[2] < h[1] AND l[2] < l[1] THEN -1 ELSE 0 END AS state FROM (
          SELECT *, list_transform(list_filter(four, lambda x: x.kind = 0), lambda x: x.price) AS h, list_transform(list_filter(four, lambda x: x.kind = 1), lambda x: x.price) AS l FROM (
            SELECT symbol, ts, kind, list({{'kind': kind, 'price': price}}) OVER (PARTITION BY symbol ORDER BY ts, kind ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS four FROM (
              SELECT symbol, ts, 0 AS kind, high AS price FROM {source} WHERE sh = 1 UNION ALL SELECT symbol, ts, 1, low FROM {source} WHERE sl = 1)))) GROUP BY 1, 2) e
      ON s.symbol = e.symbol AND s.ts >= e.ts"""


def _blocks(side: str) -> str:
    up = side == "dem"
    cmp, kill, sign = ("<", "f.close < o.lo", 1) if up else (">", "f.close > o.hi", -1)
    ref = "sh_i" if up else "sl_i"
    return f"""SELECT p.symbol, p.i, arg_min({sign} * (p.close - o.mid), (abs(p.close - o.mid), o.start_i)) AS dist FROM brk p JOIN (
      SELECT o.*, least(o.start_i + 501, coalesce((SELECT min(f.i) FROM brk f WHERE f.symbol = o.symbol AND f.i >= o.start_i AND {kill}), 1000000000)) AS end_i FROM (
        SELECT symbol, i AS start_i, least(c.o, c.c) AS lo, greatest(c.o, c.c) AS hi, (c.o + c.c) / 2 AS mid FROM (
          SELECT *, last_value(CASE WHEN close {cmp} open THEN {{'j': i, 'o': open, 'c': close}} END IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM brk)
        WHERE bos = {1 if up else -1} AND c.j >= greatest({ref}, 0)) o) o ON p.symbol = o.symbol AND p.i >= o.start_i AND p.i < o.end_i GROUP BY 1, 2"""


def _gaps(bull: bool) -> str:
    lo, hi, fill, d = ("g2", "low", "f.low <= g.hi", "p.close - (g.lo + g.hi) / 2") if bull else ("high", "g2", "f.high >= g.lo", "(g.lo + g.hi) / 2 - p.close")
    lag = "lag(high, 2)" if bull else "lag(low, 2)"
    return f"""SELECT p.symbol, p.i, arg_min({d}, (abs({d}), g.start_i)) AS dist FROM sw p JOIN (
      SELECT g.*, coalesce((SELECT min(f.i) FROM sw f WHERE f.symbol = g.symbol AND f.i > g.start_i AND {fill}), 1000000000) AS end_i FROM (
        SELECT symbol, i AS start_i, {lo} AS lo, {hi} AS hi FROM (SELECT *, {lag} OVER ({P}) AS g2 FROM sw) WHERE {hi} - {lo} >= 0.5) g) g
      ON p.symbol = g.symbol AND p.i >= g.start_i AND p.i < g.end_i GROUP BY 1, 2"""


def _pool(column: str) -> str:
    """Mean of the cluster around the first anchor with most neighbours, at least three."""
    return f"""list_avg(list_filter({column}s, lambda x: abs(x - {column}s[list_position({column}n, list_max({column}n))]) <= 5.0))"""


CTES["ticks"] = "SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS symbol, ts, event_id, value FROM events"
CTES["b"] = _bars("ticks", "1 hour")
CTES["c"] = _bars("ticks", "10 minutes")
CTES["orders_ticks"] = "SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS event_id, o_totalprice AS value FROM orders"
CTES["d"] = _bars("orders_ticks", "1 day")
CTES["kids"] = f"""SELECT *, high - low AS rng, abs(close - open) AS body, sign(close - open) AS sg, row_number() OVER w AS rn, last_value(CASE WHEN close <> open THEN sign(close - open) END IGNORE NULLS) OVER (PARTITION BY symbol, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, time_bucket(INTERVAL '1 hour', ts) AS bts
  FROM c WINDOW w AS (PARTITION BY symbol, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts)"""
_ABS = "rng <> 0 AND body / (rng + 1e-10) < 0.3"
CTES["l1s"] = f"""SELECT symbol, bts AS ts, count(*) FILTER (WHERE rng <> 0) AS cv, sum(rng) AS ve, count(*) FILTER (WHERE sg <> 0 AND bf IS NOT NULL AND sg <> bf) AS rev, coalesce(sum(rng) FILTER (WHERE rn <= 2), 0) AS e, coalesce(sum(rng) FILTER (WHERE rn > 2), 0) AS l,
  coalesce((arg_max(close, rn) FILTER (WHERE rn <= 2) - arg_min(open, rn) FILTER (WHERE rn <= 2)) / nullif(count(*) FILTER (WHERE rn <= 2), 0), 0) AS v1, coalesce((arg_max(close, rn) FILTER (WHERE rn > 2) - arg_min(open, rn) FILTER (WHERE rn > 2)) / nullif(count(*) FILTER (WHERE rn > 2), 0), 0) AS v2,
  count(*) FILTER (WHERE {_ABS}) AS ab, coalesce(sum(rng) FILTER (WHERE {_ABS}), 0) AS abr, count(*) AS n FROM kids GROUP BY 1, 2"""
CTES["l1"] = """SELECT b.*, cv AS l1_custom_volume, ve AS l1_volatility_energy, CASE WHEN cv > 0 THEN (close - open) / cv ELSE 0 END AS l1_price_velocity, rev AS l1_reversal_count, l / (e + l + 1e-10) AS l1_early_late_ratio, v2 - v1 AS l1_price_acceleration,
  ab AS l1_absorption_count, abr / (ve + 1e-10) AS l1_absorption_intensity, n AS l1_m1_count FROM b JOIN l1s USING (symbol, ts)"""
CTES["cal"] = f"""SELECT *, (row_number() OVER ({P}) - 1)::INT AS i, CASE WHEN hour(ts) >= 16 THEN 2 WHEN hour(ts) >= 8 THEN 1 ELSE 0 END AS l2_session, (hour(ts) BETWEEN 13 AND 15)::INT AS l2_session_overlap, isodow(ts) - 1 AS l2_day_of_week, hour(ts) AS l2_hour,
  CASE WHEN hour(ts) * 60 + minute(ts) >= 930 AND hour(ts) * 60 + minute(ts) < 990 THEN 3 WHEN hour(ts) = 13 THEN 2 WHEN hour(ts) = 8 THEN 1 ELSE 0 END AS l2_kill_zone FROM l1"""
CTES["isl"] = f"SELECT *, sum(CASE WHEN l2_session <> ps THEN 1 ELSE 0 END) OVER ({P} {U}) AS island FROM (SELECT *, lag(l2_session) OVER ({P}) AS ps FROM cal)"
_RUN = "PARTITION BY symbol, island ORDER BY ts"
CTES["l2a"] = f"""SELECT *, (close - first_value(open) OVER ({_RUN} {U})) AS l2_distance_from_session_open,
  greatest(least((close - min(low) OVER ({_RUN} {U})) / (max(high) OVER ({_RUN} {U}) - min(low) OVER ({_RUN} {U}) + 1e-10), 1), 0) AS l2_session_position, row_number() OVER ({_RUN}) - 1 AS k, avg(high - low) OVER {_roll(14)} AS atr, {_spike("l1_volatility_energy")} AS spike,
  list(l1_volatility_energy) OVER (PARTITION BY symbol, l2_session ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS past FROM isl"""
CTES["l2"] = f"""SELECT * EXCLUDE (k, atr, spike, past), coalesce(least(i - last_value(CASE WHEN spike THEN i END IGNORE NULLS) OVER ({P} {U}), 50), 50) AS l2_time_since_vol_spike, coalesce(len(list_filter(past, lambda x: x <= l1_volatility_energy))::DOUBLE / nullif(len(past), 0), 0) AS l2_session_volatility_rank,
  CASE WHEN k > 0 THEN coalesce((regr_sxy(close, k) OVER ({_RUN} {U})) / nullif(regr_sxx(close, k) OVER ({_RUN} {U}), 0) / CASE WHEN atr > 0 THEN atr ELSE 1e-10 END, 0) ELSE 0 END AS l2_session_trend FROM l2a"""
CTES["sw0"] = _swings("b")
CTES["sw"] = _trend("sw0")
CTES["h1"] = f"{_swings('(' + _resample('1 hour') + ')')}"
CTES["h1t"] = _trend("h1")
CTES["h4"] = f"{_swings('(' + _resample('4 hours') + ')')}"
CTES["h4t"] = _trend("h4")
CTES["conf"] = f"""SELECT *, last_value(CASE WHEN psh = 1 THEN i - 5 END IGNORE NULLS) OVER ({P} {U}) AS sh_i, last_value(CASE WHEN psh = 1 THEN ph END IGNORE NULLS) OVER ({P} {U}) AS shp, last_value(CASE WHEN psl = 1 THEN i - 5 END IGNORE NULLS) OVER ({P} {U}) AS sl_i,
  last_value(CASE WHEN psl = 1 THEN pl END IGNORE NULLS) OVER ({P} {U}) AS slp FROM (SELECT *, lag(sh, 5) OVER ({P}) AS psh, lag(sl, 5) OVER ({P}) AS psl, lag(high, 5) OVER ({P}) AS ph, lag(low, 5) OVER ({P}) AS pl FROM sw)"""
CTES["bull"] = "SELECT symbol, sh_i, min(i) AS i FROM conf WHERE close > shp GROUP BY 1, 2"
CTES["bear"] = "SELECT c.symbol, c.sl_i, min(c.i) AS i FROM conf c ANTI JOIN bull u ON c.symbol = u.symbol AND c.i = u.i WHERE c.close < c.slp GROUP BY 1, 2"
CTES["brk"] = "SELECT c.*, CASE WHEN u.i IS NOT NULL THEN 1 WHEN d.i IS NOT NULL THEN -1 ELSE 0 END AS bos FROM conf c LEFT JOIN bull u ON c.symbol = u.symbol AND c.i = u.i LEFT JOIN bear d ON c.symbol = d.symbol AND c.i = d.i"
CTES["choch"] = f"SELECT *, CASE WHEN bos <> 0 AND last_value(nullif(bos, 0) IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = -bos THEN bos ELSE 0 END AS ch FROM brk"
CTES["dem"] = _blocks("dem")
CTES["sup"] = _blocks("sup")
CTES["gb"] = _gaps(True)
CTES["gs"] = _gaps(False)
CTES["pools"] = f"""SELECT symbol, i, CASE WHEN list_max(hn) >= 3 THEN {_pool("h")} END AS buy, CASE WHEN list_max(ln) >= 3 THEN {_pool("l")} END AS sell FROM (
  SELECT *, list_transform(hs, lambda a: len(list_filter(hs, lambda x: abs(x - a) <= 5.0))) AS hn, list_transform(ls, lambda a: len(list_filter(ls, lambda x: abs(x - a) <= 5.0))) AS ln FROM (
    SELECT symbol, i, list(high) OVER {_roll(100)} AS hs, list(low) OVER {_roll(100)} AS ls FROM sw))"""
CTES["l3"] = """SELECT c.symbol, c.ts, c.i, c.open, c.high, c.low, c.close, c.sh AS l3_swing_high, c.sl AS l3_swing_low, c.bos AS l3_bos_direction, c.ch AS l3_choch_flag, coalesce(dem.dist, 0) AS l3_demand_ob_distance, coalesce(sup.dist, 0) AS l3_supply_ob_distance,
  CASE WHEN gb.dist IS NOT NULL THEN 1 WHEN gs.dist IS NOT NULL THEN -1 ELSE 0 END AS l3_fvg_active, coalesce(gb.dist, gs.dist, 0) AS l3_fvg_distance, coalesce(buy - c.close, 0) AS l3_buy_liq_distance, coalesce(c.close - sell, 0) AS l3_sell_liq_distance,
  CASE WHEN c.low < sell AND c.close > sell THEN -1 WHEN c.high > buy AND c.close < buy THEN 1 ELSE 0 END AS l3_liquidity_sweep,
  CASE WHEN shp - slp > 1e-10 AND (c.close - slp) / (shp - slp) > 0.55 THEN 1 WHEN shp - slp > 1e-10 AND (c.close - slp) / (shp - slp) < 0.45 THEN -1 ELSE 0 END AS l3_premium_discount,
  c.trend AS l3_structure_trend, coalesce(h1t.trend, 0) AS l3_h1_trend, coalesce(h4t.trend, 0) AS l3_h4_trend
  FROM choch c LEFT JOIN dem ON c.symbol = dem.symbol AND c.i = dem.i LEFT JOIN sup ON c.symbol = sup.symbol AND c.i = sup.i LEFT JOIN gb ON c.symbol = gb.symbol AND c.i = gb.i LEFT JOIN gs ON c.symbol = gs.symbol AND c.i = gs.i
  LEFT JOIN pools p ON c.symbol = p.symbol AND c.i = p.i LEFT JOIN h1t ON c.symbol = h1t.symbol AND time_bucket(INTERVAL '1 hour', c.ts) = h1t.ts LEFT JOIN h4t ON c.symbol = h4t.symbol AND time_bucket(INTERVAL '4 hours', c.ts) = h4t.ts"""
CTES["l4a"] = f"""SELECT l2.*, l3.* EXCLUDE (symbol, ts, i, open, high, low, close), (l1_custom_volume >= 3)::INT + (l1_reversal_count < 2)::INT + (l1_absorption_count >= 1)::INT AS l4_whale_footprint,
  coalesce(lag(l2.close, 1) OVER w, first_value(l2.close) OVER w) AS c1, coalesce(lag(l2.close, 2) OVER w, first_value(l2.close) OVER w) AS c2, coalesce(lag(l3_bos_direction) OVER w, 0) AS pbos, count(*) OVER {_roll(200).replace("symbol", "l2.symbol").replace("ORDER BY ts", "ORDER BY l2.ts")} AS seen,
  quantile_cont(l1_price_velocity, 0.75) OVER {_roll(200).replace("symbol", "l2.symbol").replace("ORDER BY ts", "ORDER BY l2.ts")} AS q75, quantile_cont(l1_price_velocity, 0.95) OVER {_roll(200).replace("symbol", "l2.symbol").replace("ORDER BY ts", "ORDER BY l2.ts")} AS q95, quantile_cont(l2.high - l2.low, 0.25) OVER {_roll(200).replace("symbol", "l2.symbol").replace("ORDER BY ts", "ORDER BY l2.ts")} AS q25
  FROM l2 JOIN l3 ON l2.symbol = l3.symbol AND l2.ts = l3.ts WINDOW w AS (PARTITION BY l2.symbol ORDER BY l2.ts)"""
_NEAR = "(abs(l3_demand_ob_distance) < 25 OR abs(l3_supply_ob_distance) < 25)"
CTES["l4b"] = f"""SELECT *, least(30 * (l3_liquidity_sweep <> 0)::INT + 20 * (l2_kill_zone > 0)::INT + 20 * ((c1 > c2 AND close < c1) OR (c1 < c2 AND close > c1))::INT + 15 * {_NEAR}::INT + 15 * (l1_absorption_intensity > 0.4)::INT, 100) AS l4_trap_score,
  greatest(least(sign(l2_session_trend)::INT + l3_structure_trend + l3_h1_trend + l3_h4_trend - l3_premium_discount, 5), -5) AS l4_multi_layer_confluence FROM l4a"""
CTES["l4c"] = f"""SELECT *, CASE WHEN l4_trap_score >= 60 THEN 3 WHEN seen >= 10 AND l1_price_velocity > q95 AND l3_bos_direction <> 0 THEN 5 WHEN pbos <> 0 AND l3_choch_flag <> 0 THEN 6 WHEN seen >= 10 AND l1_price_velocity > q75 AND l1_reversal_count < 2 AND l1_custom_volume >= 3 THEN 0
  WHEN l1_absorption_intensity > 0.4 AND abs(close - open) / (high - low + 1e-10) < 0.3 THEN 1 WHEN l1_early_late_ratio < 0.35 AND l1_price_acceleration < -10 THEN 2 WHEN high - low < CASE WHEN seen >= 10 THEN q25 ELSE 0 END AND l1_custom_volume >= 2 AND {_NEAR} THEN 7
  WHEN l1_custom_volume < 2 AND l1_volatility_energy < 60 THEN 4 ELSE -1 END AS l4_candle_dna FROM l4b"""
CTES["light0"] = f"""SELECT *, sign(close - open)::INT AS sg, last_value(nullif(sign(close - open), 0) IGNORE NULLS) OVER ({P} {U}) AS dir, lag(close, 5) OVER ({P}) AS c5, lag(l1_volatility_energy, 5) OVER ({P}) AS e5, ({_spike("l1_volatility_energy")} AND {_spike("l1_custom_volume")})::INT AS l4_volume_climax,
  avg(high - low) OVER {_roll(20)} AS mr, avg(l1_volatility_energy) OVER {_roll(50)} AS ms, avg(l1_volatility_energy) OVER {_roll(200)} AS ml FROM l1"""
CTES["light1"] = f"SELECT *, sum((dir IS DISTINCT FROM pd)::INT) OVER ({P} {U}) AS run FROM (SELECT *, lag(dir) OVER ({P}) AS pd FROM light0)"
CTES["light"] = f"""SELECT *, coalesce(dir * least(sum(abs(sg)) OVER (PARTITION BY symbol, run ORDER BY ts {U}), 20), 0)::INT AS l4_consecutive_bias, CASE WHEN c5 IS NULL THEN 0 WHEN close > c5 AND NOT l1_volatility_energy > e5 THEN -1 WHEN NOT close > c5 AND l1_volatility_energy > e5 THEN 1 ELSE 0 END AS l4_momentum_divergence,
  CASE WHEN mr <= 1e-10 THEN 1.0 ELSE (high - low) / mr END AS l4_range_compression, CASE WHEN ms > ml + abs(ml) * 0.1 THEN 1 WHEN ms < ml - abs(ml) * 0.1 THEN -1 ELSE 0 END AS l4_time_volatility_regime,
  (l1_custom_volume >= 3)::INT + (l1_reversal_count < 2)::INT + (l1_absorption_count >= 1)::INT AS l4_whale_footprint FROM light1"""
CTES["runs0"] = "SELECT symbol, island, first(l2_session) AS s, arg_max(l2_session_trend, ts) AS fin FROM l2 GROUP BY 1, 2"
_O = "PARTITION BY symbol ORDER BY island"
CTES["runs1"] = f"SELECT *, lag(s) OVER ({_O}) AS pv, lag(fin) OVER ({_O}) AS pe FROM runs0"
CTES["runs2"] = f"SELECT *, last_value(CASE WHEN pv = 0 AND s = 1 THEN pe END IGNORE NULLS) OVER ({_O} {U}) AS asian, last_value(CASE WHEN pv = 1 AND s = 2 THEN pe END IGNORE NULLS) OVER ({_O} {U}) AS london FROM runs1"
CTES["runs3"] = """SELECT *, CASE WHEN pv = 1 AND s = 2 AND asian IS NOT NULL THEN ((pe > 0) = (asian > 0) AND asian <> 0)::DOUBLE END AS lo, CASE WHEN pv = 2 AND s = 0 AND london <> 0 THEN ((pe > 0) = (london > 0) AND pe <> 0)::DOUBLE END AS ny FROM runs2"""
CTES["lop"] = f"SELECT symbol, island, avg(lo) OVER ({_O} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS p FROM runs3 WHERE lo IS NOT NULL"
CTES["nyp"] = f"SELECT symbol, island, avg(ny) OVER ({_O} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS p FROM runs3 WHERE ny IS NOT NULL"
CTES["runs4"] = """SELECT r.*, coalesce(a.p, 0.5) AS lp, coalesce(z.p, 0.5) AS np FROM runs3 r ASOF LEFT JOIN lop a ON r.symbol = a.symbol AND r.island >= a.island ASOF LEFT JOIN nyp z ON r.symbol = z.symbol AND r.island >= z.island"""
CTES["cont"] = f"""SELECT symbol, island, coalesce(last_value(CASE WHEN pv = 0 AND s = 1 THEN CASE WHEN asian <> 0 THEN lp ELSE 0.5 END WHEN pv = 1 AND s = 2 THEN CASE WHEN london <> 0 THEN np ELSE 0.5 END WHEN pv = 2 AND s = 0 THEN 0.5 END IGNORE NULLS) OVER ({_O} {U}), 0.5) AS l4_session_continuation FROM runs4"""
CTES["feat"] = "SELECT l4c.*, light.l4_consecutive_bias, light.l4_momentum_divergence, light.l4_volume_climax, light.l4_range_compression, light.l4_time_volatility_regime, cont.l4_session_continuation FROM l4c JOIN light ON l4c.symbol = light.symbol AND l4c.ts = light.ts JOIN cont ON l4c.symbol = cont.symbol AND l4c.island = cont.island"
CTES["lab"] = """SELECT a.*, CASE WHEN f.high >= a.close + 150 THEN CASE WHEN f.low <= a.close - 100 THEN -1 ELSE 1 END WHEN f.low <= a.close - 100 THEN -1 ELSE 0 END AS label FROM (
    SELECT x.*, (SELECT min(f.i) FROM sw f WHERE f.symbol = x.symbol AND f.i > x.i AND f.i <= x.i + 96 AND (f.high >= x.close + 150 OR f.low <= x.close - 100)) AS fi FROM sw x) a LEFT JOIN sw f ON f.symbol = a.symbol AND f.i = a.fi"""
CTES["sc"] = """SELECT *, CASE WHEN m = w0 THEN 0 WHEN m = w1 THEN 1 ELSE 2 END AS pred, m / (w0 + w1 + w2) * 100 AS conf, CASE label WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS cls FROM (
  SELECT *, greatest(w0, w1, w2) AS m FROM (SELECT *, ((i * 37) % 101 + 1)::BIGINT ** 4 AS w0, ((i * 59) % 97 + 1)::BIGINT ** 4 AS w1, ((i * 83) % 89 + 1)::BIGINT ** 4 AS w2 FROM lab))"""
CTES["tr"] = "SELECT *, CASE WHEN label = 0 THEN -1.0::DOUBLE WHEN label = CASE WHEN pred = 1 THEN 1 ELSE -1 END THEN 150.0::DOUBLE ELSE -100.0::DOUBLE END AS pnl FROM sc WHERE pred <> 0 AND conf >= 60"

CTES["cand"] = "SELECT symbol, i FROM sc WHERE pred <> 0 AND conf >= 60"
CTES["pickd"] = "SELECT symbol, min(i) AS i FROM cand GROUP BY 1 UNION ALL SELECT p.symbol, (SELECT min(c.i) FROM cand c WHERE c.symbol = p.symbol AND c.i >= p.i + 3) FROM pickd p WHERE p.i IS NOT NULL"


CTES["live"] = f"SELECT symbol, ts, (row_number() OVER ({P}) - 1)::BIGINT AS i, close, {_spike('(high - low)')} AS spike, lag(close) OVER ({P}) AS prev FROM b"
CTES["live_able"] = "SELECT symbol, i FROM live WHERE spike AND close <> prev"
CTES["live_pick"] = "SELECT symbol, min(i) AS i FROM live_able GROUP BY 1 UNION ALL SELECT p.symbol, (SELECT min(c.i) FROM live_able c WHERE c.symbol = p.symbol AND c.i >= p.i + 2) FROM live_pick p WHERE p.i IS NOT NULL"


def with_(final: str) -> str:
    """The final select with the table expressions that it needs, directly or not."""
    needed, queue = set(), [final]
    while queue:
        text = queue.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                queue.append(CTES[name])
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in CTES.items() if n in needed) + " " + final if needed else final


DOUBLES = {
    "open", "high", "low", "close", "volume", "l1_volatility_energy", "l1_price_velocity", "l1_early_late_ratio", "l1_price_acceleration", "l1_absorption_intensity", "l2_distance_from_session_open", "l2_session_position", "l2_session_volatility_rank",
    "l2_session_trend", "l3_demand_ob_distance", "l3_supply_ob_distance", "l3_fvg_distance", "l3_buy_liq_distance", "l3_sell_liq_distance", "l4_range_compression", "l4_session_continuation",
}


def pick(source: str, *columns: str) -> str:
    shown = [f"round({c}::DOUBLE, {9 if c.endswith('_liq_distance') else 6}) AS {c}" if c in DOUBLES else f"{c}::BIGINT AS {c}" for c in columns]
    return with_(f"SELECT symbol, ts, {', '.join(shown)} FROM {source}")


def _report(rows: str, classes: list[int]) -> str:
    parts = []
    for c in classes:
        parts.append(f"SELECT '{c}' AS name, {c} AS k, count(*) FILTER (WHERE t = {c} AND p = {c}) AS tp, count(*) FILTER (WHERE p = {c}) AS np, count(*) FILTER (WHERE t = {c}) AS nt, count(*) AS n FROM rows")
    return f"""WITH rows AS ({rows}), per AS ({" UNION ALL ".join(parts)}),
      pr AS (SELECT *, coalesce(tp / nullif(np, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(nt, 0)::DOUBLE, 0) AS recall FROM per), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr),
      al AS (SELECT name, precision, recall, f1, nt AS support FROM f UNION ALL SELECT 'accuracy', sum(tp) / max(n), sum(tp) / max(n), sum(tp) / max(n), max(n) FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), max(n) FROM f
        UNION ALL SELECT 'weighted avg', sum(precision * nt) / max(n), sum(recall * nt) / max(n), sum(f1 * nt) / max(n), max(n) FROM f)
      SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM al"""


def _metrics(key: str, order: str) -> str:
    return f"""SELECT {key}, count(*)::BIGINT AS total_trades, round(avg((pnl > 0)::INT), 6) AS win_rate, round(coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0), 6) AS total_pips_won, round(coalesce(sum(-pnl) FILTER (WHERE pnl < 0 AND label <> 0), 0), 6) AS total_pips_lost,
      round(coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / greatest(coalesce(sum(-pnl) FILTER (WHERE pnl < 0 AND label <> 0), 0), 1e-10), 6) AS profit_factor, round(max(peak - eq), 6) AS max_drawdown, round(CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * sqrt(24192.0) ELSE 0 END, 6) AS sharpe_ratio
      FROM (SELECT *, max(eq) OVER (PARTITION BY {key} ORDER BY {order} {U}) AS peak FROM (SELECT *, sum(pnl) OVER (PARTITION BY {key} ORDER BY {order} {U}) AS eq FROM tr))"""


def _bars_of(source: str) -> str:
    return with_(f"SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM {source}")


def sql() -> dict[str, str]:
    keep = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"
    pos = "open > 0 AND high > 0 AND low > 0 AND close > 0"
    live = "NOT (open = high AND high = low AND low = close)"
    l1 = ["l1_custom_volume", "l1_volatility_energy", "l1_price_velocity", "l1_reversal_count", "l1_early_late_ratio", "l1_price_acceleration", "l1_absorption_count", "l1_absorption_intensity", "l1_m1_count"]
    log = "SELECT symbol, ts, CASE WHEN pnl > 0 THEN 'win' WHEN pnl = -100 THEN 'loss' ELSE 'open' END AS result, CASE WHEN pnl <> -1 THEN pnl END AS pips FROM tr"
    reasons = [("Whale footprint detected", "l4_whale_footprint >= 2"), ("Kill zone active", "l2_kill_zone > 0"), ("Liquidity sweep detected", "l3_liquidity_sweep <> 0"), ("Institutional climax volume", "l4_volume_climax = 1"), ("Multi-layer confluence", "abs(l4_multi_layer_confluence) >= 3"),
               ("Structure break (BOS)", "l3_bos_direction <> 0"), ("Change of character (CHoCH)", "l3_choch_flag <> 0"), ("Near demand order block", "abs(l3_demand_ob_distance) < 10"), ("Near supply order block", "abs(l3_supply_ob_distance) < 10"), ("Momentum divergence", "l4_momentum_divergence <> 0")]
    listed = "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{text}' END" for text, cond in reasons) + "], lambda x: x IS NOT NULL)[1:3]"
    rules = f"""SELECT f.symbol, f.ts, CASE WHEN pred = 1 THEN 'BUY' ELSE 'SELL' END AS direction, (CASE WHEN conf >= 80 THEN 3 WHEN conf >= 70 THEN 2 ELSE 1 END)::BIGINT AS tier, round(f.close, 6) AS entry_price, round(round(f.close - CASE WHEN pred = 1 THEN 100 ELSE -100 END, 5), 6) AS stop_loss, round(round(f.close + CASE WHEN pred = 1 THEN 150 ELSE -150 END, 5), 6) AS take_profit, 1.5::DOUBLE AS risk_reward,
            CASE WHEN len({listed}) > 0 THEN array_to_string({listed}, ' | ') ELSE 'Model prediction' END AS top_reasons, CASE l4_candle_dna WHEN 0 THEN 'Clean Push' WHEN 1 THEN 'Absorption' WHEN 2 THEN 'Exhaustion' WHEN 3 THEN 'Trap' WHEN 4 THEN 'Dead Zone' WHEN 5 THEN 'Breakout' WHEN 6 THEN 'Fakeout' WHEN 7 THEN 'Accumulation' WHEN -1 THEN 'Unclassified' ELSE 'Unknown' END AS candle_dna
            FROM (SELECT l4c.*, light.l4_volume_climax, light.l4_momentum_divergence FROM l4c JOIN light ON l4c.symbol = light.symbol AND l4c.ts = light.ts) f JOIN sc ON f.symbol = sc.symbol AND f.ts = sc.ts WHERE pred <> 0 AND conf >= 60"""
    from tidemark.plans.features import FEATURES

    out = {
        "spike_flags": with_(f"SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, ({_spike('(high - low)')})::BIGINT AS spike FROM ({_bars('ticks', '15 minutes')})"),
        "ingest_clean": with_(f"SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM d WHERE {keep} AND {pos} AND {live} AND isodow(ts) < 6"),
        "ingest_statistics": with_(f"SELECT symbol, count(*)::BIGINT AS n_raw, (count(*) FILTER (WHERE {keep}))::BIGINT AS n_priced, (count(*) FILTER (WHERE {keep} AND {pos}))::BIGINT AS n_positive, (count(*) FILTER (WHERE {keep} AND {pos} AND {live}))::BIGINT AS n_alive, (count(*) FILTER (WHERE {keep} AND {pos} AND {live} AND isodow(ts) < 6))::BIGINT AS n_kept, "
                                   f"min(ts) FILTER (WHERE {keep} AND {pos} AND {live} AND isodow(ts) < 6) AS first_ts, max(ts) FILTER (WHERE {keep} AND {pos} AND {live} AND isodow(ts) < 6) AS last_ts FROM d GROUP BY 1"),
        "gap_report": with_(f"SELECT s.symbol, round(any_value(m.med), 6) AS median_step, (count(*) FILTER (WHERE step > 2.0 * m.med))::BIGINT AS n_gaps, max(step)::BIGINT AS max_step, arg_max(ts, (step, -epoch(ts))) AS max_at FROM (SELECT symbol, ts, (epoch(ts) - epoch(lag(ts) OVER ({P})))::BIGINT AS step FROM b) s JOIN (SELECT symbol, median(step) AS med FROM (SELECT symbol, (epoch(ts) - epoch(lag(ts) OVER ({P})))::BIGINT AS step FROM b) GROUP BY 1) m ON s.symbol = m.symbol WHERE step IS NOT NULL GROUP BY 1"),
        "ohlc_bars": _bars_of("b"), "ohlc_4h": _bars_of(f"({_resample('4 hours')})"),
        "bucket_collect": with_("SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*)::BIGINT AS m1_count, round(sum(close * rn), 6) AS ordered_sum FROM kids GROUP BY 1, 2"),
        "m1_m15_join": with_(f"SELECT b.symbol, b.ts, round(open, 6) AS m15_open, round(high, 6) AS m15_high, round(low, 6) AS m15_low, round(close, 6) AS m15_close, round(volume, 6) AS m15_volume, m1_count FROM b JOIN (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*)::BIGINT AS m1_count FROM c WHERE {pos} AND {live} AND isodow(ts) < 6 GROUP BY 1, 2) k ON b.symbol = k.symbol AND b.ts = k.ts"),
        "completeness": with_("SELECT symbol, count(*)::BIGINT AS n_parents, (count(*) FILTER (WHERE n < 6))::BIGINT AS n_incomplete, round(100.0 * count(*) FILTER (WHERE n < 6) / count(*), 6) AS pct_incomplete FROM l1s GROUP BY 1"),
        "last_complete_bar": with_("SELECT b.symbol, b.ts, round(open, 6) AS open, round(close, 6) AS close, least(coalesce(n, 0), 3)::BIGINT AS n_children FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM b) b LEFT JOIN l1s USING (symbol, ts) WHERE r = 2"),
        "l1_nested": pick("l1", *[c for c in l1 if c != "l1_price_velocity"]), "l3_order_blocks": pick("l3", "l3_demand_ob_distance", "l3_supply_ob_distance"), "label_barrier": pick("lab", "label"),
        "label_distribution": with_("SELECT symbol, label::BIGINT AS label, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS pct FROM lab GROUP BY 1, 2"),
        "time_split": " UNION ALL ".join(f"SELECT '{n}' AS split, count(*)::BIGINT AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT DISTINCT o_orderpriority, date_trunc('day', o_orderdate)::TIMESTAMP AS ts FROM orders) WHERE year(ts) BETWEEN {a} AND {z}" for n, a, z in (("train", 1992, 1995), ("val", 1996, 1996), ("test", 1997, 1998))),
        "fold_bounds": """WITH RECURSIVE d AS (SELECT DISTINCT o_orderpriority AS s, date_trunc('day', o_orderdate)::TIMESTAMP AS ts FROM orders), lim AS (SELECT min(ts) AS a, max(ts) AS z FROM d), f AS (SELECT a + INTERVAL 2 YEAR AS st, z FROM lim UNION ALL SELECT st + INTERVAL 3 MONTH, z FROM f WHERE st + INTERVAL 3 MONTH < z),
            g AS (SELECT st AS val_start, st + INTERVAL 3 MONTH AS val_end, (SELECT count(*) FROM d WHERE ts <= st - INTERVAL 1 DAY)::BIGINT AS train_rows, (SELECT count(*) FROM d WHERE ts >= st AND ts <= st + INTERVAL 3 MONTH)::BIGINT AS val_rows FROM f)
            SELECT (row_number() OVER (ORDER BY val_start) - 1)::BIGINT AS fold, val_start, val_end, train_rows, val_rows FROM g WHERE train_rows >= 100 AND val_rows >= 10""",
        "class_weights": with_("SELECT cls::BIGINT AS cls, count(*)::BIGINT AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM sc GROUP BY 1"),
        "corr_prune": """WITH t AS (SELECT l_extendedprice AS a, l_quantity AS b, l_quantity * 2 + 1 AS c, l_tax AS d, l_extendedprice * (1 - l_discount) AS e FROM lineitem), k AS (SELECT abs(corr(a, b)) ab, abs(corr(a, c)) ac, abs(corr(b, c)) bc, abs(corr(a, d)) ad, abs(corr(b, d)) bd, abs(corr(c, d)) cd, abs(corr(a, e)) ae, abs(corr(b, e)) be, abs(corr(c, e)) ce, abs(corr(d, e)) de FROM t)
            SELECT 'l1_price' AS feature FROM k UNION ALL SELECT 'l1_quantity' FROM k WHERE ab <= 0.95 UNION ALL SELECT 'l1_double' FROM k WHERE greatest(ac, bc) <= 0.95 UNION ALL SELECT 'l1_tax' FROM k WHERE greatest(ad, bd, cd) <= 0.95 UNION ALL SELECT 'l1_net' FROM k WHERE greatest(ae, be, ce, de) <= 0.95""",
        "confusion": with_("SELECT t::BIGINT AS truth, (count(cls) FILTER (WHERE pred = 0))::BIGINT AS pred_0, (count(cls) FILTER (WHERE pred = 1))::BIGINT AS pred_1, (count(cls) FILTER (WHERE pred = 2))::BIGINT AS pred_2 FROM (SELECT unnest([0, 1, 2]) AS t) g LEFT JOIN sc ON cls = t GROUP BY 1"),
        "class_report": _report(with_("SELECT cls AS t, pred AS p FROM sc"), [0, 1, 2]),
        "labels_report": _report("SELECT 1 - quality AS t, toxic AS p FROM labels", [0, 1]),
        "trading_sim": with_(_metrics("symbol", "ts, symbol") + " GROUP BY 1"),
        "tier_analysis": with_("SELECT g.t::BIGINT AS tier, " + ", ".join(f"coalesce({m}, 0) AS {m}" for m in ("total_trades", "win_rate", "total_pips_won", "total_pips_lost", "profit_factor", "max_drawdown", "sharpe_ratio")) + " FROM (SELECT unnest([1, 2, 3]) AS t) g LEFT JOIN (" + _metrics("tier", "ts, symbol").replace("FROM tr", "FROM (SELECT *, CASE WHEN conf >= 80 AND conf < 101 THEN 3 WHEN conf >= 70 AND conf < 80 THEN 2 WHEN conf >= 60 AND conf < 70 THEN 1 END AS tier FROM tr)") + " GROUP BY 1) m ON g.t = m.tier"),
        "signal_rules": with_(rules),
        "cooldown": with_("SELECT symbol, i::BIGINT AS i FROM pickd WHERE i IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1),
        "daily_loss_limit": with_("SELECT symbol, ts, round(pnl, 6) AS pnl FROM (SELECT *, coalesce(sum((pnl = -100)::INT) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM tr) WHERE n < 3"),
        "session_filter": with_("SELECT symbol, ts, (CASE WHEN hour(ts) >= 16 THEN 2 ELSE 1 END)::BIGINT AS l2_session, pred::BIGINT AS pred FROM sc WHERE pred <> 0 AND conf >= 60 AND hour(ts) >= 8"),
        "dedupe_keep_last": "SELECT user_id::VARCHAR AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, max(event_id)::BIGINT AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2",
        "fill_gap": with_(f"SELECT symbol, ts, round(open, 6) AS open, round(close, 6) AS close FROM (SELECT symbol, ts, open, close FROM b WHERE day(ts) <= 15 UNION ALL SELECT l.symbol, l.ts, l.open, l.close FROM ({_bars('ticks', '30 minutes')}) l LEFT JOIN (SELECT symbol, max(ts) AS z FROM b WHERE day(ts) <= 15 GROUP BY 1) m ON l.symbol = m.symbol WHERE z IS NULL OR l.ts > z)"),
        "perf_summary": with_(f"SELECT symbol, count(*)::BIGINT AS total, (count(*) FILTER (WHERE result = 'win'))::BIGINT AS wins, (count(*) FILTER (WHERE result = 'loss'))::BIGINT AS losses, (count(*) FILTER (WHERE result = 'open'))::BIGINT AS open, round(100.0 * count(*) FILTER (WHERE result = 'win') / count(*), 6) AS win_rate, round(coalesce(sum(pips), 0), 6) AS pips, "
                              f"coalesce(round(coalesce(sum(pips) FILTER (WHERE pips > 0), 0) / nullif(sum(-pips) FILTER (WHERE pips < 0), 0), 6), 'Infinity'::DOUBLE) AS profit_factor FROM ({log}) GROUP BY 1"),
        "equity_curve": with_(f"SELECT symbol, ts, round(sum(coalesce(pips, 0)) OVER ({P} {U}), 6) AS equity FROM ({log})"),
        "feature_summary": with_(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max FROM l1" for c in l1 if c != "l1_m1_count")),
        "signal_history": with_("SELECT symbol, ts, pred::BIGINT AS pred FROM sc WHERE pred <> 0 AND conf >= 60 ORDER BY ts DESC, symbol LIMIT 50"),
        "display_names": with_("SELECT symbol, ts, CASE WHEN l2_session_volatility_rank >= 0.66 THEN 'HIGH' WHEN l2_session_volatility_rank >= 0.33 THEN 'MED' ELSE 'LOW' END AS volatility, ['Asian', 'London', 'New York'][l2_session + 1] AS session, ['None', 'London Open', 'NY Open', 'London Close'][l2_kill_zone + 1] AS zone, CASE WHEN l2_session_trend > 0 THEN 'BULL ▲' WHEN l2_session_trend < 0 THEN 'BEAR ▼' ELSE 'NEUTRAL ─' END AS trend, round(least(open, close), 6) AS body_low, round(CASE WHEN close <> open THEN abs(close - open) ELSE (high - low) * 0.001 END, 6) AS body_height FROM l2"),
        "lineitem_rolling": "SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(avg(l_extendedprice) OVER w, 6) AS mean20, round(max(l_extendedprice) OVER w, 6) AS max20, round(lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber), 6) AS previous FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
        "l1_custom_volume": pick("l1", "l1_custom_volume", "l1_m1_count"), "l1_energy": pick("l1", "l1_volatility_energy"), "l1_velocity": pick("l1", "l1_price_velocity"), "l1_reversals": pick("l1", "l1_reversal_count"), "l1_early_late": pick("l1", "l1_early_late_ratio"),
        "l1_acceleration": pick("l1", "l1_price_acceleration"), "l1_absorption": pick("l1", "l1_absorption_count", "l1_absorption_intensity"), "l2_session": pick("l2", "l2_session", "l2_day_of_week", "l2_hour"), "l2_overlap_killzone": pick("l2", "l2_session_overlap", "l2_kill_zone"),
        "l2_session_stats": pick("l2", "l2_distance_from_session_open", "l2_session_position"), "l2_vol_spike": pick("l2", "l2_time_since_vol_spike"), "l2_vol_rank": pick("l2", "l2_session_volatility_rank"), "l2_session_trend": pick("l2", "l2_session_trend"),
        "l3_swings": pick("l3", "l3_swing_high", "l3_swing_low"), "l3_structure": pick("l3", "l3_structure_trend"), "l3_htf_trend": pick("l3", "l3_h1_trend", "l3_h4_trend"), "l3_bos_choch": pick("l3", "l3_bos_direction", "l3_choch_flag"), "l3_block_scan": pick("l3", "l3_demand_ob_distance", "l3_supply_ob_distance"),
        "l3_fvg": pick("l3", "l3_fvg_active", "l3_fvg_distance"), "l3_liquidity": pick("l3", "l3_buy_liq_distance", "l3_sell_liq_distance"), "l3_sweep": pick("l3", "l3_liquidity_sweep"), "l3_premium_discount": pick("l3", "l3_premium_discount"),
        "l4_whale": pick("light", "l4_whale_footprint"), "l4_divergence": pick("light", "l4_momentum_divergence"), "l4_streak": pick("light", "l4_consecutive_bias"), "l4_climax": pick("light", "l4_volume_climax"), "l4_compression": pick("light", "l4_range_compression"), "l4_regime": pick("light", "l4_time_volatility_regime"),
        "l4_continuation": pick("(SELECT l2.symbol, l2.ts, l4_session_continuation FROM l2 JOIN cont ON l2.symbol = cont.symbol AND l2.island = cont.island)", "l4_session_continuation"),
        "l4_trap": pick("l4c", "l4_trap_score"), "l4_dna": pick("l4c", "l4_candle_dna"), "l4_confluence": pick("l4c", "l4_multi_layer_confluence"),
        "features_all": pick("feat", *FEATURES),
    }
    long = f"SELECT symbol, ts, unnest([{', '.join(map(repr, FEATURES))}]) AS name, unnest(range({len(FEATURES)})) AS k, unnest([{', '.join(f'{c}::DOUBLE' for c in FEATURES)}]) AS v FROM feat"
    out["feature_correlation"] = with_(f"""SELECT x.name AS a, y.name AS b, count(*)::BIGINT AS n, CASE WHEN stddev_pop(x.v) > 0 AND stddev_pop(y.v) > 0 THEN round(corr(x.v, y.v), 6) END AS r
      FROM ({long}) x JOIN ({long}) y ON x.symbol = y.symbol AND x.ts = y.ts AND x.k < y.k GROUP BY 1, 2""")
    recent = "SELECT symbol, ts FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM b) WHERE back = 1"
    cut = f"SELECT symbol, ts, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM ({CTES['b']})) WHERE back <= 500"
    out["latest_features"] = f"SELECT f.* FROM ({out['features_all'].replace(CTES['b'], cut)}) f JOIN ({with_(recent)}) r ON f.symbol = r.symbol AND f.ts = r.ts"
    single = ", ".join(f"round({c}::FLOAT::DOUBLE, 6) AS {c}" for c in ("open", "high", "low", "close"))
    out["csv_m1_scan"] = with_(f"SELECT symbol, ts, {single}, volume FROM b WHERE symbol = 'even'")
    out["csv_m15_scan"] = with_(f"SELECT symbol, ts, {single}, 0.0::DOUBLE AS volume FROM b WHERE symbol = 'odd'")
    out["stage_round_trip"] = pick("l1", "l1_volatility_energy", "l1_m1_count")
    chosen = rules.replace("SELECT f.symbol, f.ts,", "SELECT f.symbol, f.ts, round(conf, 2) AS conf,", 1) + " AND EXISTS (SELECT 1 FROM pickd k WHERE k.symbol = sc.symbol AND k.i = sc.i)"
    out["signal_scan"] = with_(chosen).replace("WITH ", "WITH RECURSIVE ", 1)
    out["asof_bars"] = with_("""SELECT e.symbol, e.ts, e.event_id::BIGINT AS event_id, round(r.close, 6) AS bar_close, round(r.volume, 6) AS bar_volume
      FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS symbol, ts, event_id FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM b WHERE volume % 3 = 0) r ON e.symbol = r.symbol AND e.ts >= r.ts""")
    out["stream_scan"] = out["signal_scan"]
    out["stream_signals"] = with_("SELECT l.symbol, ts, l.i, close, spike, CASE WHEN k.i IS NULL THEN NULL WHEN close > prev THEN 'BUY' ELSE 'SELL' END AS direction FROM live l LEFT JOIN live_pick k ON l.symbol = k.symbol AND l.i = k.i").replace("WITH ", "WITH RECURSIVE ", 1)
    closed = "SELECT symbol, ts, open, high, low, close, volume FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
    out["stream_bars"] = with_(closed)
    return out
