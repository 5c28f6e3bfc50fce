"""Stateful live signals: values, lists, maps and timers in the state store, symbol by symbol.

State lives in RocksDB beside the executors and in the checkpoint. Counters are value states, the
last bars a list state, losses by day and children of open bars map states. Event-time timers
close bars though no later one comes, and clear days that are over, so state doesn't grow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import EngineConfig

OUTPUT = "symbol string, ts timestamp, i long, close double, spike boolean, direction string"
BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_DAY = 86_400_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as these operators need; the setting before comes back."""
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER[0])
        else:
            spark.conf.set(_PROVIDER[0], before)


def _millis(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy() // 1000


class _Counted(StatefulProcessor):
    """Bars counted in time order; what is not after the last one seen is a repeat and is left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "seen long, signal long, last long")

    def fresh(self, frames: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, int, int]:
        """New rows in order, their first position, and the position of the last signal."""
        seen, signal, last = self.counts.get() if self.counts.exists() else (0, -(10**9), -(2**62))
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable").drop_duplicates("ts", keep="last")
        return rows[_millis(rows["ts"]) > last].reset_index(drop=True), seen, signal

    def keep(self, rows: pd.DataFrame, seen: int, signal: int) -> None:
        if len(rows):
            self.counts.update((seen + len(rows), signal, int(_millis(rows["ts"])[-1])))

    def close(self) -> None:
        pass


class SpikeSignals(_Counted):
    """A row for each new bar; the last ``context`` bars are a list state."""

    def __init__(self, config: EngineConfig, context: int):
        self.config, self.context = config, context

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", "energy double, close double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        c = self.config
        new, seen, signal = self.fresh(rows)
        ring = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        out = []
        for k, (ts, high, low, close) in enumerate(new[["ts", "high", "low", "close"]].itertuples(index=False)):
            before = ring[-1][1] if ring else None
            ring = [*ring, (float(high - low), float(close))][-self.context :]
            energy = np.array([e for e, _ in ring[-c.spike_window :]])
            spike = len(energy) == c.spike_window and high - low > energy.mean() + c.spike_sigma * energy.std(ddof=1)
            way = None
            if spike and before is not None and close != before and seen + k - signal >= c.cooldown:
                way, signal = ("BUY" if close > before else "SELL"), seen + k
            out.append((key[0], ts, seen + k, float(close), bool(spike), way))
        if out:
            self.ring.put(ring)
            self.keep(new, seen, signal)
        yield pd.DataFrame(out, columns=["symbol", "ts", "i", "close", "spike", "direction"])


def live_signals(bars: DataFrame, config: EngineConfig, lateness: str = "1 hour", context: int = 500) -> DataFrame:
    """A row for each new bar; ``direction`` is set where a volatility spike follows the bar before and the cool-down allows it.

    Bars at or before the last one seen of their symbol are repeats and are left out. State per
    symbol is bounded: the last ``context`` bars and three numbers.
    """
    return bars.withWatermark("ts", lateness).groupBy("symbol").transformWithStateInPandas(SpikeSignals(config, max(context, config.spike_window)), OUTPUT, "Append", "None")


class ScoredSignals(_Counted):
    """Scored bars that pass confidence, session, daily limit and cool-down, with their position ``i``."""

    def __init__(self, config: EngineConfig, sessions: tuple[int, ...] | None):
        self.config, self.sessions = config, sessions

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lost = handle.getMapState("lost", "day long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        c = self.config
        new, seen, signal = self.fresh(rows)
        able = (new["pred"] != 0) & (new["conf"] >= c.confidence)
        if self.sessions is not None and "l2_session" in new:
            able &= new["l2_session"].isna() | new["l2_session"].isin(self.sessions)
        lost = new["loss"].fillna(False).astype(bool).to_numpy() if "loss" in new else np.zeros(len(new), bool)
        days, at, losses, stays = _millis(new["ts"]) // _DAY, np.arange(len(new)) + seen, {}, []
        for k, (day, ok) in enumerate(zip(days.tolist(), able.to_numpy(bool).tolist(), strict=True)):
            if (ok or lost[k]) and day not in losses:
                losses[day] = self.lost.getValue((day,))[0] if self.lost.containsKey((day,)) else 0
            if ok and losses[day] < c.daily_losses and int(at[k]) - signal >= c.cooldown:
                signal = int(at[k])
                stays.append(k)
            if lost[k]:  # counts from the next bar on
                if not losses[day]:
                    self.handle.registerTimer((day + 2) * _DAY)
                losses[day] += 1
                self.lost.updateValue((day,), (losses[day],))
        self.keep(new, seen, signal)
        yield new.assign(i=at).iloc[stays]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """A day is over: its losses are forgotten."""
        day = expiredTimerInfo.getExpiryTimeInMs() // _DAY - 2
        if self.lost.containsKey((day,)):
            self.lost.removeKey((day,))
        yield pd.DataFrame()


def live_scan(scored: DataFrame, config: EngineConfig, sessions: Iterable[int] | None = None, lateness: str = "1 hour") -> DataFrame:
    """The bars of a scored stream (``pred``, ``conf``, maybe ``l2_session`` and ``loss``) that become signals, in the input's columns and ``i``.

    The choice is that of a scan over the whole history: enough confidence, sessions asked for,
    fewer than ``daily_losses`` losses (``loss``: the bar before hit a stop) earlier on the day, and the
    cool-down. State per symbol is three numbers and a counter for each day that isn't over.
    """
    kept = scored.select(*[c for c in scored.columns if c != "i"])
    schema = T.StructType([*kept.schema.fields, T.StructField("i", T.LongType())])
    return kept.withWatermark("ts", lateness).groupBy("symbol").transformWithStateInPandas(ScoredSignals(config, tuple(sessions) if sessions is not None else None), schema, "Append", "EventTime")


class BarCloser(StatefulProcessor):
    """Children of open bars are a map state by time, so that the last value of a time wins; a timer at a bar's end puts them together."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.children = handle.getMapState("children", "at long", "open double, high double, low double, close double, volume double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ends = set()
        for frame in rows:
            for at, *values in zip(_millis(frame["ts"]).tolist(), *[frame[c].astype(float).tolist() for c in ("open", "high", "low", "close", "volume")], strict=True):
                end = at // self.width * self.width + self.width
                if end > mark:  # else the bar is closed
                    self.children.updateValue((at,), tuple(values))
                    ends.add(end)
        for end in ends:
            self.handle.registerTimer(end)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        inside = sorted((k[0], tuple(v)) for k, v in self.children.iterator() if end - self.width <= k[0] < end)
        for at, _ in inside:
            self.children.removeKey((at,))
        if inside:
            o, h, lo, c, v = zip(*[values for _, values in inside], strict=True)
            ts = pd.to_datetime([end - self.width], unit="ms")
            yield pd.DataFrame({"symbol": [key[0]], "ts": ts, "open": [o[0]], "high": [max(h)], "low": [min(lo)], "close": [c[-1]], "volume": [float(sum(v))]})

    def close(self) -> None:
        pass


def timed_bars(children: DataFrame, width: str, lateness: str) -> DataFrame:
    """Parents of a stream of child bars ``(symbol, ts, open, high, low, close, volume)``: each comes once event time is ``lateness`` past its end, whether its symbol has later rows or not.

    Of a child that comes several times the last one counts; children of a closed bar are dropped.
    State per symbol: the children of its open bars.
    """
    span = children.sparkSession.range(1).select(F.expr(f"cast(interval {width} as interval day to second)")).first()[0]
    rows = children.select("symbol", "ts", "open", "high", "low", "close", "volume").withWatermark("ts", lateness)
    return rows.groupBy("symbol").transformWithStateInPandas(BarCloser(int(span.total_seconds() * 1000)), BARS, "Append", "EventTime")
