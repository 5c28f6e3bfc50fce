"""All windowed columns of layers 2 to 4 by one prefix scan over time chunks.

What a chunk has to know of the rows before it is a state of bounded size: the last rows as they
are, the open session, energies by session, swing points and their higher-timeframe bars, targets
of breaks, young order blocks, open gaps, the streak. A chunk's first rows (its head) can't be
judged without that state; the rest can, from the point where all of the state has been replaced.
So a summary is the head's rows and what the rest leaves behind, and folding passes the head.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import EngineConfig
from tidemark.operators.chunks import numbers, trailing_quantiles, trailing_rank, trailing_windows
from tidemark.operators.layer2 import calendar
from tidemark.operators.layer3 import _block_distances, _born, _first_at_most, _gap_distance, _pools, liquidity_columns
from tidemark.operators.scan import Scan, chunk_of, prefix_scan

#: Columns that the scan reads, besides the time.
READ = ("open", "high", "low", "close", "l1_volatility_energy", "l1_custom_volume", "l1_price_velocity", "l2_session")
#: Microseconds of the higher timeframes.
WIDE = {"l3_h1_trend": 3_600_000_000, "l3_h4_trend": 14_400_000_000}
WHOLE = (
    "i", "l2_time_since_vol_spike", "l3_swing_high", "l3_swing_low", "l3_bos_direction", "l3_choch_flag", "l3_fvg_active", "l3_premium_discount", "l3_structure_trend", *WIDE,
    "l4_momentum_divergence", "l4_consecutive_bias", "l4_volume_climax", "l4_time_volatility_regime", "__before", "__reversal",
)
PARTS = (
    "l2_distance_from_session_open", "l2_session_position", "l2_session_volatility_rank", "l2_session_trend", "l3_demand_ob_distance", "l3_supply_ob_distance", "l3_fvg_distance", "__buy_pool", "__sell_pool",
    "l4_range_compression", "l4_session_continuation", "__v75", "__v95", "__r25",
)


@dataclass
class Rows:
    """A stretch of rows as arrays."""

    open: np.ndarray
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    energy: np.ndarray
    volume: np.ndarray
    velocity: np.ndarray
    session: np.ndarray

    def __len__(self) -> int:
        return len(self.close)

    def arrays(self) -> list[np.ndarray]:
        return [self.open, self.high, self.low, self.close, self.energy, self.volume, self.velocity, self.session]

    def cut(self, start: int, stop: int | None = None) -> Rows:
        return Rows(*[a[start:stop].copy() for a in self.arrays()])

    def then(self, other: Rows) -> Rows:
        return Rows(*[np.concatenate(pair) for pair in zip(self.arrays(), other.arrays(), strict=True)])

    @classmethod
    def none(cls) -> Rows:
        return cls(*[np.zeros(0)] * 8)


@dataclass
class Session:
    """The open session: label, first open, lowest, highest, and the regression of closes on positions so far."""

    label: float
    first: float
    low: float
    high: float
    line: tuple[int, float, float, float, float]  # rows, means of position and close, sums of products and squares around them


@dataclass
class Targets:
    """Swings that a close can break, upwards and downwards: position, price, and whether that has happened."""

    high_i: int = -1
    high: float = np.nan
    high_used: bool = False
    low_i: int = -1
    low: float = np.nan
    low_used: bool = False
    last: int = 0


@dataclass
class Wide:
    """The last bars of a higher timeframe (bucket, high, low), the newest maybe unfinished, and the last four swing points before the ones that they can still give."""

    bars: list[tuple[int, float, float]] = field(default_factory=list)
    points: list[tuple[int, float]] = field(default_factory=list)


@dataclass
class Odds:
    """Continuation of sessions: last trends, outcomes, and the estimate that holds."""

    asian: float | None = None
    london: float | None = None
    london_went: list[float] = field(default_factory=list)
    york_went: list[float] = field(default_factory=list)
    p: float = 0.5


@dataclass
class State:
    n: int = 0
    tail: Rows = field(default_factory=Rows.none)
    session: Session | None = None
    trend: float = 0.0
    odds: Odds = field(default_factory=Odds)
    energies: dict[float, np.ndarray] = field(default_factory=dict)
    points: list[tuple[int, float]] = field(default_factory=list)
    targets: Targets = field(default_factory=Targets)
    way: int = 0
    falling: tuple[int, float, float] | None = None
    rising: tuple[int, float, float] | None = None
    demand: list[tuple[int, float, float]] = field(default_factory=list)
    supply: list[tuple[int, float, float]] = field(default_factory=list)
    bulls: tuple[list[float], list[float]] = ([], [])
    bears: tuple[list[float], list[float]] = ([], [])
    streak: tuple[int, int] = (0, 0)
    wide: dict[str, Wide] = field(default_factory=lambda: {name: Wide() for name in WIDE})


def sliding_mean(values: np.ndarray, own: int, width: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the last ``width`` rows, added up from the oldest as a window aggregate does; NaN before ``least`` rows."""
    windows = trailing_windows(values, own, width)
    n, total, mean, m2 = (np.zeros(len(windows)) for _ in range(4))
    for k in range(width):
        x = windows[:, k]
        there = ~np.isnan(x)
        n = n + there
        total = np.where(there, total + x, total)
        delta = np.where(there, x - mean, 0.0)
        step = delta / np.maximum(n, 1)
        mean = mean + step
        m2 = m2 + delta * (delta - step)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n >= least, total / n, np.nan), np.where(n >= max(least, 2), np.sqrt(m2 / (n - 1)), np.nan)


def _lagged(values: np.ndarray, own: int, k: int) -> np.ndarray:
    """The value k rows before each row from ``own`` on, NaN before the first."""
    return np.concatenate([np.full(k, np.nan), values])[own : own + len(values) - own]


def swings(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of rows strictly above (below) the n rows on either side, which have to be there."""
    size = len(high)
    up, down = np.zeros(size, bool), np.zeros(size, bool)
    if size > 2 * n:
        mid = slice(n, size - n)
        up[mid] = down[mid] = True
        for k in range(1, n + 1):
            for other in (slice(n - k, size - n - k), slice(n + k, size - n + k)):
                up[mid] &= high[mid] > high[other]
                down[mid] &= low[mid] < low[other]
    return up, down


def points_at(is_high: bool, high: float, is_low: bool, low: float) -> list[tuple[int, float]]:
    """The swing points of a bar, the high first."""
    return ([(0, float(high))] if is_high else []) + ([(1, float(low))] if is_low else [])


def points_trend(points: list[tuple[int, float]]) -> int:
    """Higher highs and lows 1, lower ones -1, else 0: of the last four points, two of each kind."""
    four = points[-4:]
    highs, lows = [p for kind, p in four if kind == 0], [p for kind, p in four if kind == 1]
    if len(four) < 4 or len(highs) != 2:
        return 0
    return 1 if highs[1] > highs[0] and lows[1] > lows[0] else -1 if highs[1] < highs[0] and lows[1] < lows[0] else 0


def find_breaks(close: np.ndarray, up_i: np.ndarray, up: np.ndarray, down_i: np.ndarray, down: np.ndarray, t: Targets) -> tuple[np.ndarray, Targets, np.ndarray, np.ndarray, np.ndarray]:
    """Breaks, targets afterwards, and by row the targets' prices and the broken side's swing position.

    up_i, up, down_i, down: position and price of the swing that each row confirms, -1 where none.
    """

    def tenures(at: np.ndarray, price: np.ndarray, held_i: int, held: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = np.nonzero(at >= 0)[0]
        tenure = np.cumsum(at >= 0)
        return tenure, np.concatenate([[held], price[new]])[tenure], np.concatenate([[held_i], at[new]])[tenure]

    def first_of(cond: np.ndarray, tenure: np.ndarray, used: bool) -> tuple[np.ndarray, bool]:
        hit = np.nonzero(cond)[0]
        if used:
            hit = hit[tenure[hit] > 0]
        _, first = np.unique(tenure[hit], return_index=True)
        out = np.zeros(len(cond), bool)
        out[hit[first]] = True
        last = tenure[-1] if len(tenure) else 0
        return out, bool((tenure[hit] == last).any()) or (used and last == 0)

    with np.errstate(invalid="ignore"):
        high_tenure, high, high_i = tenures(up_i, up, t.high_i, t.high)
        bull, high_used = first_of(close > high, high_tenure, t.high_used)
        low_tenure, low, low_i = tenures(down_i, down, t.low_i, t.low)
        bear, low_used = first_of((close < low) & ~bull, low_tenure, t.low_used)
    way = bull.astype(int) - bear
    if not len(close):
        return way, t, high, low, high_i
    some = np.nonzero(way)[0]
    after = Targets(int(high_i[-1]), float(high[-1]), high_used, int(low_i[-1]), float(low[-1]), low_used, int(way[some[-1]]) if len(some) else t.last)
    return way, after, high, low, np.where(way > 0, high_i, low_i)


def blocks_made(rows: Rows, base: int, way: np.ndarray, broken: np.ndarray, falling: Any, rising: Any) -> tuple[list, list, Any, Any]:
    """Order blocks (position, low, high) of both sides, and the last falling and rising candle afterwards."""
    out = []
    for side, opposite, held in ((1, rows.close < rows.open, falling), (-1, rows.close > rows.open, rising)):
        last = np.maximum.accumulate(np.where(opposite, np.arange(len(rows)), -1)) if len(rows) else np.zeros(0, int)
        candle = lambda k: (base + int(k), float(min(rows.open[k], rows.close[k])), float(max(rows.open[k], rows.close[k])))  # noqa: E731, B023
        made = []
        for t in np.nonzero(way == side)[0].tolist():
            before = candle(last[t - 1]) if t and last[t - 1] >= 0 else held
            if before and before[0] >= max(int(broken[t]), 0):
                made.append((base + t, before[1], before[2]))
        out.append((made, candle(last[-1]) if len(rows) and last[-1] >= 0 else held))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def session_columns(rows: Rows, lead: np.ndarray, held: Session | None, config: EngineConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Session | None]:
    """Distance from the session's open, position in its range, trend, where a session starts, and the session that stays open.

    lead: ranges of the rows before. held: the session that is open before the first row.
    """
    n = len(rows)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0, bool), held
    starts = np.concatenate([[held is not None and rows.session[0] != held.label], rows.session[1:] != rows.session[:-1]])
    goes_on = held is not None and not starts[0]
    at = np.unique(np.concatenate([[0], np.nonzero(starts)[0]]))
    size = np.diff(np.concatenate([at, [n]]))
    run = np.repeat(np.arange(len(at)), size)
    first = rows.open[at].copy()
    low, high = rows.low.copy(), rows.high.copy()
    if goes_on:
        first[0] = held.first
        low[0], high[0] = min(low[0], held.low), max(high[0], held.high)
    for a, m in zip(at.tolist(), size.tolist(), strict=True):
        low[a : a + m], high[a : a + m] = np.minimum.accumulate(low[a : a + m]), np.maximum.accumulate(high[a : a + m])
    y = rows.close - first[run]
    slope, fresh = np.zeros(n), set(at[1:].tolist())
    m, ka, ca, products, squares = held.line if goes_on else (0, 0.0, 0.0, 0.0, 0.0)
    for t, close in enumerate(rows.close.tolist()):  # updated as a regression aggregate is, to the last digit
        if t in fresh:
            m, ka, ca, products, squares = 0, 0.0, 0.0, 0.0, 0.0
        dk, m = m - ka, m + 1
        step = dk / m
        ka, ca, squares = ka + step, ca + (close - ca) / m, squares + dk * (dk - step)
        products += dk * (close - ca)
        slope[t] = products / squares if squares else 0.0
    mean_range, _ = sliding_mean(np.concatenate([lead, rows.high - rows.low]), len(lead), config.atr_window)
    trend = slope / np.where(mean_range > 0, mean_range, config.eps)
    position = np.clip((rows.close - low) / (high - low + config.eps), 0.0, 1.0)
    last = Session(float(rows.session[-1]), float(first[-1]), float(low[-1]), float(high[-1]), (m, ka, ca, products, squares))
    return y / config.pip, position, np.nan_to_num(trend), starts, last


def advance_odds(odds: Odds, before: float, label: float, end: float, config: EngineConfig) -> Odds:
    """The estimate when a session begins: ``before`` and ``end`` are the closed one's label and last trend."""
    odds = replace(odds, london_went=list(odds.london_went), york_went=list(odds.york_went))
    window = config.continuation_window
    mean = lambda went: sum(went) / len(went) if went else 0.5
    if (before, label) == (0, 1):
        odds.asian = end
        odds.p = mean(odds.london_went) if end != 0 else 0.5
    elif (before, label) == (1, 2):
        odds.london = end
        if odds.asian is not None:
            odds.london_went = [*odds.london_went, float((end > 0) == (odds.asian > 0) and odds.asian != 0)][-window:]
        odds.p = mean(odds.york_went) if end != 0 else 0.5
    elif (before, label) == (2, 0):
        if odds.london is not None and odds.london != 0:
            odds.york_went = [*odds.york_went, float((end > 0) == (odds.london > 0) and end != 0)][-window:]
        odds.p = 0.5
    return odds


def by_bucket(ts: np.ndarray, high: np.ndarray, low: np.ndarray, width: int) -> list[tuple[int, float, float]]:
    """Bars of a higher timeframe: bucket, high and low."""
    if not len(ts):
        return []
    bucket = ts // width
    at = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1])
    return list(zip(bucket[at].tolist(), np.maximum.reduceat(high, at).tolist(), np.minimum.reduceat(low, at).tolist(), strict=True))


def add_wide(wide: Wide, bars: list[tuple[int, float, float]], n: int) -> Wide:
    """The higher timeframe after more bars: a new one finishes the one before, which may make a swing of the one n earlier."""
    held, points = list(wide.bars), list(wide.points)
    for bucket, high, low in bars:
        if held and held[-1][0] == bucket:
            held[-1] = (bucket, max(held[-1][1], high), min(held[-1][2], low))
            continue
        held.append((bucket, high, low))
        if len(held) >= 2 * n + 2:
            points = (points + _points_of(held[-2 * n - 2 : -1], n))[-4:]
            held = held[-2 * n - 2 :]
    return Wide(held, points)


def _points_of(bars: list[tuple[int, float, float]], n: int) -> list[tuple[int, float]]:
    """Swing points of bars that have n others on both sides."""
    up, down = swings(np.array([b[1] for b in bars]), np.array([b[2] for b in bars]), n)
    return [p for k, (_, high, low) in enumerate(bars) for p in points_at(up[k], high, down[k], low)]


def wide_trend(ts: np.ndarray, high: np.ndarray, low: np.ndarray, width: int, before: Wide, after: list[tuple[int, float, float]], n: int) -> np.ndarray:
    """The structure trend of each row's bucket on the higher timeframe."""
    own = by_bucket(ts, high, low, width)
    bars: list[tuple[int, float, float]] = []
    for bar in [*before.bars, *own, *after]:
        if bars and bars[-1][0] == bar[0]:
            bars[-1] = (bar[0], max(bars[-1][1], bar[1]), min(bars[-1][2], bar[2]))
        else:
            bars.append(bar)
    up, down = swings(np.array([b[1] for b in bars]), np.array([b[2] for b in bars]), n)
    judged = len(before.bars) > 2 * n + 1  # swings of the oldest n + 1 bars are among the points already
    points, trend, out = list(before.points), points_trend(before.points), {}
    for k, (bucket, h, lo) in enumerate(bars):
        if k >= n + judged and (up[k] or down[k]):
            points = (points + points_at(up[k], h, down[k], lo))[-4:]
            trend = points_trend(points)
        out[bucket] = trend
    return np.array([out[b] for b in (ts // width).tolist()], float)


def _left_open(high: np.ndarray, low: np.ndarray, own: int, least: float) -> tuple[list[float], list[float]]:
    stays = [g for g in _born(high, low, own, least) if _first_at_most(low, g + 1, low[g]) == len(low)]
    return [float(low[g]) for g in stays], [float(high[g - 2] + low[g]) / 2 for g in stays]


class Market:
    """The scan of a series of bars under one configuration."""

    def __init__(self, config: EngineConfig):
        self.c = config
        n = config.swing
        self.tail = max(config.block_age, config.liq_window - 1, config.dna_window - 1, config.regime_long - 1, config.spike_cap + config.spike_window, config.climax_window, config.range_window, config.atr_window, config.divergence_lag, 2 * n, 2)
        self.least = config.gap_pips * config.pip

    def rows(self, table: pa.Table) -> tuple[Rows, np.ndarray]:
        return Rows(*numbers(table, *READ)), np.asarray(table["ts"].combine_chunks().cast(pa.int64()))

    def confirmed(self, rows: Rows, lead: int, base: int) -> tuple[np.ndarray, ...]:
        """Position and price of the swing that each row from ``lead`` on confirms, n rows after it; base: position of the first row after the lead."""
        n = self.c.swing
        up, down = swings(rows.high, rows.low, n)
        out = []
        for flag, price in ((up, rows.high), (down, rows.low)):
            held = np.concatenate([np.zeros(n, bool), flag])[: len(rows)]
            value = np.concatenate([np.full(n, np.nan), price])[: len(rows)]
            out += [np.where(held, np.arange(len(rows)) - n + base - lead, -1)[lead:], np.where(held, value, np.nan)[lead:]]
        return tuple(out)

    def summarise(self, table: pa.Table) -> dict[str, Any]:
        rows, ts = self.rows(table)
        c, size, n = self.c, len(rows), self.c.swing
        up_i, up, down_i, down = self.confirmed(rows, 0, 0)
        first_up = np.nonzero(up_i >= 0)[0]
        # from here on a low target counts that was confirmed while the high one was known
        reset = np.nonzero((down_i >= 0) & (np.arange(size) >= (first_up[0] if len(first_up) else size)))[0]
        cut = int(reset[0]) if len(reset) else size
        starts = np.nonzero(rows.session[1:] != rows.session[:-1])[0] + 1
        starts = starts[starts >= c.atr_window]
        opens = int(starts[0]) if len(starts) else size
        head = max(cut, opens, min(size, 2 * n))
        way, targets, _, _, broken = find_breaks(rows.close, up_i, up, down_i, down, Targets())
        way[:cut] = 0
        demand, supply, falling, rising = blocks_made(rows, 0, way, broken, None, None)
        some = np.nonzero(way)[0]
        rest = rows.cut(opens)
        _, _, trend, begins, session = session_columns(rest, (rows.high - rows.low)[max(0, opens - c.atr_window + 1) : opens], None, c)
        ends = [(float(rest.session[t - 1]), float(rest.session[t]), float(trend[t - 1])) for t in np.nonzero(begins)[0].tolist() if t]
        points = [p for t in range(min(2 * n, size), size) for p in points_at(up_i[t] >= 0, up[t], down_i[t] >= 0, down[t])]
        sign = np.sign(rows.close - rows.open)
        moved = sign[sign != 0]
        turn = np.nonzero(np.diff(moved))[0]
        wide = {}
        for name, width in WIDE.items():
            bars, edge = by_bucket(ts, rows.high, rows.low, width), 2 * n + 2
            long = len(bars) > 2 * edge
            wide[name] = (bars[:edge], _points_of(bars[1:-1], n)[-4:] if long else None, bars[-edge:] if long else bars[edge:])
        gaps = []
        for high, low in ((rows.high, rows.low), (-rows.low, -rows.high)):
            after = [float(low[k + 1 :].min()) if size > k + 1 else np.inf for k in (0, 1)]
            gaps.append((*_left_open(high, low, 2, self.least), high[:2].copy(), low[:2].copy(), after, float(low.min())))
        return {
            "size": size, "head": rows.cut(0, head), "cut": cut, "opens": opens, "tail": rows.cut(max(0, size - self.tail)), "targets": targets, "last": int(way[some[-1]]) if len(some) else 0, "way": int(way[-1]),
            "demand": [b for b in demand if b[0] >= size - c.block_age], "supply": [b for b in supply if b[0] >= size - c.block_age], "falling": falling, "rising": rising,
            "ends": ends, "session": session, "trend": float(trend[-1]) if len(trend) else 0.0, "first": (float(rows.session[opens - 1]), float(rows.session[opens])) if opens < size else None,
            "energies": {label: rows.energy[rows.session == label][-c.rank_window :] for label in np.unique(rows.session).tolist()}, "points": points[-4:],
            "streak": (int(moved[0]), int(turn[0]) + 1 if len(turn) else len(moved), int(moved[-1]), len(moved) - int(turn[-1]) - 1 if len(turn) else len(moved), bool(len(turn))) if len(moved) else None,
            "wide": wide, "gaps": gaps,
        }

    def fold(self, s: State, said: dict[str, Any]) -> State:
        c, n, size, head = self.c, self.c.swing, said["size"], said["head"]
        lead = s.tail.cut(max(0, len(s.tail) - 2 * n))
        up_i, up, down_i, down = self.confirmed(lead.then(head), len(lead), s.n)
        cut, opens = said["cut"], said["opens"]
        way, targets, _, _, broken = find_breaks(head.close[:cut], up_i[:cut], up[:cut], down_i[:cut], down[:cut], s.targets)
        demand, supply, falling, rising = blocks_made(head.cut(0, cut), s.n, way, broken, s.falling, s.rising)
        if cut < size:
            t = said["targets"]
            targets = replace(t, high_i=t.high_i + s.n, low_i=t.low_i + s.n, last=said["last"] or targets.last)
        moved = lambda blocks: [(b[0] + s.n, b[1], b[2]) for b in blocks]
        edge = min(2 * n, size)
        points = [p for t in range(edge) for p in points_at(up_i[t] >= 0, up[t], down_i[t] >= 0, down[t])]
        # the session's head, then its rest
        own = head.cut(0, opens)
        _, _, trend, begins, session = session_columns(own, (s.tail.high - s.tail.low)[max(0, len(s.tail) - c.atr_window + 1) :], s.session, c)
        odds, labels, ends = s.odds, np.concatenate([[s.session.label if s.session else np.nan], own.session]), np.concatenate([[s.trend], trend])
        for t in np.nonzero(begins)[0].tolist():
            odds = advance_odds(odds, labels[t], own.session[t], float(ends[t]), c)
        if said["first"]:
            odds = advance_odds(odds, *said["first"], float(ends[-1]), c)
            for before, label, end in said["ends"]:
                odds = advance_odds(odds, before, label, end, c)
            session = said["session"]
        young = s.n + size - c.block_age
        energies = dict(s.energies)
        for label, values in said["energies"].items():
            energies[label] = np.concatenate([energies.get(label, np.zeros(0)), values])[-c.rank_window :]
        streak = s.streak
        if said["streak"]:
            first, n_first, last, n_last, turned = said["streak"]
            streak = (last, n_last) if turned or first != s.streak[0] else (last, s.streak[1] + n_first)
        wide = {}
        for name, (firsts, inner, lasts) in said["wide"].items():
            w = add_wide(s.wide[name], firsts, n)
            if inner is None:
                w = add_wide(w, lasts, n)
            else:
                # points of the bars that lie wholly inside, but for those that the first ones gave already, and those that the last ones will give
                w = Wide(list(lasts), (w.points + inner)[-4:])
            wide[name] = w
        bulls, bears = (self._gaps_after(held, s, gap, side) for held, gap, side in ((s.bulls, said["gaps"][0], 1), (s.bears, said["gaps"][1], -1)))
        return State(
            s.n + size, s.tail.then(said["tail"]).cut(-self.tail), session, said["trend"] if said["first"] else float(ends[-1]), odds, energies, (s.points + points + said["points"])[-4:], targets, said["way"] if cut < size else int(way[-1]),
            (said["falling"][0] + s.n, *said["falling"][1:]) if said["falling"] else falling, (said["rising"][0] + s.n, *said["rising"][1:]) if said["rising"] else rising,
            [b for b in s.demand + demand + moved(said["demand"]) if b[0] >= young], [b for b in s.supply + supply + moved(said["supply"]) if b[0] >= young], bulls, bears, streak, wide,
        )

    def _gaps_after(self, held: tuple[list[float], list[float]], s: State, gap: tuple, side: int) -> tuple[list[float], list[float]]:
        """Open gaps after a chunk: older ones above its lowest low are closed, its first two rows may open some over the chunk's edge."""
        tops, middles, highs, lows, after, lowest = gap
        stays = int(np.searchsorted(held[0], lowest))
        before = (s.tail.high if side > 0 else -s.tail.low)[-2:]
        edge = np.concatenate([before, highs])
        new: tuple[list[float], list[float]] = ([], [])
        for k, low in enumerate(lows.tolist()):
            at = k + len(before) - 2
            if at >= 0 and low - edge[at] >= self.least and after[k] > low:
                new[0].append(low)
                new[1].append(float(edge[at] + low) / 2)
        return held[0][:stays] + new[0] + tops, held[1][:stays] + new[1] + middles

    def enough(self, after: list[dict[str, Any]]) -> tuple[Any, bool]:
        """Highs and lows of the n rows after a chunk, and the next higher-timeframe bars, one more than its swings need."""
        n = self.c.swing
        heads = [(x["head"].high[:n], x["head"].low[:n]) for x in after[:n]]
        high, low = (np.concatenate([np.zeros(0), *[h[k] for h in heads]])[:n] for k in (0, 1))
        wide, done = {}, len(high) >= n  # a summary with inner points has more bars than are needed
        for name in WIDE:
            bars: list[tuple[int, float, float]] = []
            for x in after:
                firsts, inner, lasts = x["wide"][name]
                bars += firsts + (lasts if inner is None else [])
                if inner is not None or len({b[0] for b in bars}) > n + 1:
                    break
            else:
                done = False
            wide[name] = bars
        return (high, low, wide), done

    def passed(self, table: pa.Table, s: State, after: tuple) -> dict[str, np.ndarray]:
        c, n = self.c, self.c.swing
        own, ts = self.rows(table)
        size, back = len(own), len(s.tail)
        full = s.tail.then(own)
        out: dict[str, np.ndarray] = {"i": np.arange(s.n, s.n + size, dtype=float)}
        # sessions
        ranges = full.high - full.low
        out["l2_distance_from_session_open"], out["l2_session_position"], trend, begins, _ = session_columns(own, ranges[max(0, back - c.atr_window + 1) : back], s.session, c)
        out["l2_session_trend"] = trend
        spike_from = max(0, back - c.spike_cap)
        mean, std = sliding_mean(full.energy, spike_from, c.spike_window, c.spike_window)
        with np.errstate(invalid="ignore"):
            spikes = full.energy[spike_from:] > mean + c.spike_sigma * std
        last = np.maximum.accumulate(np.where(spikes, np.arange(len(spikes)), -c.spike_cap - 1))
        out["l2_time_since_vol_spike"] = np.minimum(np.arange(len(spikes)) - last, c.spike_cap)[back - spike_from :].astype(float)
        rank = np.zeros(size)
        for label in np.unique(own.session).tolist():
            mine = np.nonzero(own.session == label)[0]
            held = s.energies.get(label, np.zeros(0))
            rank[mine] = trailing_rank(np.concatenate([held, own.energy[mine]]), len(held), c.rank_window)
        out["l2_session_volatility_rank"] = rank
        odds, p = s.odds, np.zeros(size)
        labels, ends = np.concatenate([[s.session.label if s.session else np.nan], own.session]), np.concatenate([[s.trend], trend])
        at = 0
        for t in np.nonzero(begins)[0].tolist():
            p[at:t] = odds.p
            odds, at = advance_odds(odds, labels[t], own.session[t], float(ends[t]), c), t
        p[at:] = odds.p
        out["l4_session_continuation"] = p
        # structure
        high, low = np.concatenate([full.high, after[0]]), np.concatenate([full.low, after[1]])
        up, down = swings(high, low, n)
        out["l3_swing_high"], out["l3_swing_low"] = up[back : back + size].astype(float), down[back : back + size].astype(float)
        points, state, trends = list(s.points), points_trend(s.points), np.zeros(size)
        at = 0
        for t in np.nonzero(up | down)[0].tolist():
            if t < back - n:
                continue
            points = (points + points_at(up[t], high[t], down[t], low[t]))[-4:]
            if t >= back + size:
                break
            trends[at : max(t - back, 0)] = state
            state, at = points_trend(points), max(t - back, 0)
        trends[at:] = state
        out["l3_structure_trend"] = trends
        for name, width in WIDE.items():
            out[name] = wide_trend(ts, own.high, own.low, width, s.wide[name], after[2][name], n)
        lead = min(back, 2 * n)
        up_i, up_price, down_i, down_price = self.confirmed(full.cut(back - lead), lead, s.n)
        way, _, above, under, broken = find_breaks(own.close, up_i, up_price, down_i, down_price, s.targets)
        out["l3_bos_direction"] = way.astype(float)
        before = np.concatenate([[s.targets.last], way])
        before = before[np.maximum.accumulate(np.where(before != 0, np.arange(len(before)), 0))][:-1]
        out["l3_choch_flag"] = np.where((way != 0) & (before == -way), way, 0).astype(float)
        out["__before"] = np.concatenate([[s.way], way[:-1]]).astype(float)
        spread = above - under
        with np.errstate(invalid="ignore", divide="ignore"):
            pos = np.where(spread > c.eps, (own.close - under) / spread, np.nan)
            out["l3_premium_discount"] = np.where(pos > 0.5 + c.equilibrium, 1.0, np.where(pos < 0.5 - c.equilibrium, -1.0, 0.0))
        # lifetimes
        demand, supply, _, _ = blocks_made(own, s.n, way, broken, s.falling, s.rising)
        for name, made, sign in (("l3_demand_ob_distance", s.demand + demand, 1), ("l3_supply_ob_distance", s.supply + supply, -1)):
            lo, hi = np.full(back + size, np.nan), np.full(back + size, np.nan)
            for start, bottom, top in made:
                if (k := start - s.n + back) >= 0:
                    lo[k], hi[k] = (bottom, top) if sign > 0 else (-top, -bottom)
            out[name] = np.nan_to_num(_block_distances(sign * full.close, lo, hi, back, c.block_age)) / c.pip
        gaps = []
        for (tops, middles), h, lw, cl in ((s.bulls, full.high, full.low, full.close), (s.bears, -full.low, -full.high, -full.close)):
            near = max(0, back - 2)
            reach = float(lw[back:].min())
            used = slice(max(int(np.searchsorted(tops, reach)) - 3, 0), None)  # those that close, and the three below
            gaps.append(_gap_distance(h[near:], lw[near:], cl[near:], back - near, self.least, np.array(tops[used], float), np.array(middles[used], float)))
        bull, bear = gaps
        out["l3_fvg_active"] = np.where(~np.isnan(bull), 1.0, np.where(~np.isnan(bear), -1.0, 0.0))
        out["l3_fvg_distance"] = np.nan_to_num(np.where(~np.isnan(bull), bull, bear)) / c.pip
        near = max(0, back - c.liq_window + 1)
        out["__buy_pool"], out["__sell_pool"] = (_pools(x[near:], back - near, c.liq_window, c.liq_tolerance_pips * c.pip, c.liq_touches) for x in (full.high, full.low))
        near = max(0, back - c.dna_window + 1)
        out["__v75"], out["__v95"] = trailing_quantiles(full.velocity[near:], back - near, c.dna_window, c.dna_least, [0.75, 0.95])
        (out["__r25"],) = trailing_quantiles(ranges[near:], back - near, c.dna_window, c.dna_least, [0.25])
        # scores
        one, two = _lagged(full.close, back, 1), _lagged(full.close, back, 2)
        first = full.close[0] if s.n < 2 else np.nan  # closes before the series are its first
        one, two = np.where(np.isnan(one), first, one), np.where(np.isnan(two), first, two)
        out["__reversal"] = (((one > two) & (own.close < one)) | ((one < two) & (own.close > one))).astype(float)
        old_close, old_energy = _lagged(full.close, back, c.divergence_lag), _lagged(full.energy, back, c.divergence_lag)
        rise, more = own.close > old_close, own.energy > old_energy
        out["l4_momentum_divergence"] = np.where(np.isnan(old_close), 0.0, np.where(rise & ~more, -1.0, np.where(~rise & more, 1.0, 0.0)))
        out["l4_consecutive_bias"] = self._streaks(own, s.streak)
        loud = []
        for values in (full.volume, full.energy):
            mean, std = sliding_mean(values, back, c.climax_window, c.climax_window)
            with np.errstate(invalid="ignore"):
                loud.append(values[back:] > mean + c.climax_sigma * std)
        out["l4_volume_climax"] = (loud[0] & loud[1]).astype(float)
        mean, _ = sliding_mean(ranges, back, c.range_window)
        with np.errstate(invalid="ignore", divide="ignore"):
            out["l4_range_compression"] = np.where(mean <= c.eps, 1.0, ranges[back:] / mean)
        short, _ = sliding_mean(full.energy, back, c.regime_short)
        long, _ = sliding_mean(full.energy, back, c.regime_long)
        band = np.abs(long) * c.regime_band
        out["l4_time_volatility_regime"] = np.where(short > long + band, 1.0, np.where(short < long - band, -1.0, 0.0))
        return out

    def _streaks(self, rows: Rows, held: tuple[int, int]) -> np.ndarray:
        sign = np.sign(rows.close - rows.open).astype(int)
        moved = np.concatenate([[held[0]], sign])
        way = moved[np.maximum.accumulate(np.where(moved != 0, np.arange(len(moved)), 0))]
        turned = way[1:] != way[:-1]
        count = np.cumsum(np.abs(sign)) + held[1]
        base = np.maximum.accumulate(np.where(turned, count - 1, 0))  # a turn is made by a row that counts itself
        return (way[1:] * np.minimum(count - base, self.c.streak_cap)).astype(float)

    def scan(self) -> Scan:
        return Scan(State, self.summarise, self.fold, self.passed, self.enough)


def market_fields() -> list[T.StructField]:
    return [T.StructField(c, T.IntegerType()) for c in WHOLE] + [T.StructField(c, T.DoubleType()) for c in PARTS]


def alike(told: tuple[State, tuple]) -> tuple:
    """What a chunk's columns but ``i`` depend on: positions count from the chunk, so that rows added long before change nothing."""
    s, after = told
    t = s.targets
    back = lambda i: i - s.n
    candle = lambda c: c and (back(c[0]), *c[1:])
    moved = replace(
        s, n=min(s.n, 2), targets=replace(t, high_i=back(t.high_i) if t.high_i >= 0 else None, low_i=back(t.low_i) if t.low_i >= 0 else None), falling=candle(s.falling), rising=candle(s.rising),
        demand=[candle(b) for b in s.demand], supply=[candle(b) for b in s.supply],
    )
    return moved, after


def market_columns(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Bars with ``l2_session`` and the windowed columns of layers 2 to 4 (WHOLE and PARTS); absent layer-1 columns count as 0."""
    held = bars.withColumns({c: F.lit(0.0) for c in READ if c not in bars.columns})
    out = prefix_scan(held.withColumn("chunk", chunk_of("ts", config.parent_width, config.chunk_bars)), Market(config).scan(), market_fields())
    return out.drop(*[c for c in READ if c not in bars.columns])


def layer3(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Bars with the fifteen columns of the layer and the ordinal ``i``."""
    out = market_columns(calendar(bars, config), config).withColumns(liquidity_columns(config))
    names = [c for c in (*WHOLE, *PARTS) if c.startswith("l3_")]
    return out.select(*bars.columns, "i", *names, *liquidity_columns(config))


def layer2(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Bars with the ten columns of the layer and the ordinal ``i``."""
    out = market_columns(calendar(bars, config), config)
    return out.select(*bars.columns, "i", *[c for c in out.columns if c.startswith("l2_") and c not in bars.columns])
