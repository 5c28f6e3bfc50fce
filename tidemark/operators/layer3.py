"""Layer 3: market structure.

Each column in the form that fits its own query: swings, structure trend, breaks and
higher-timeframe trends as windows and equi-joins, order blocks as an interval join. Blocks, gaps
and pools of a stretch of rows as arrays are here too; :mod:`tidemark.operators.market` has all
columns of the layer, for series of any length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import EngineConfig
from tidemark.operators.bars import bucket, resample
from tidemark.operators.chunks import trailing_windows
from tidemark.operators.windows import before, binned_interval_join, fill_forward, ordinal, series


def swing_columns(n: int) -> dict[str, Column]:
    """Flags of bars strictly above (below) the n bars on either side; both sides have to be full."""
    past, ahead = series().rowsBetween(-n, -1), series().rowsBetween(1, n)
    full = (F.count(F.lit(1)).over(past) == n) & (F.count(F.lit(1)).over(ahead) == n)
    high = full & (F.col("high") > F.max("high").over(past)) & (F.col("high") > F.max("high").over(ahead))
    low = full & (F.col("low") < F.min("low").over(past)) & (F.col("low") < F.min("low").over(ahead))
    return {"l3_swing_high": high.cast("int"), "l3_swing_low": low.cast("int")}


def structure_trend(bars: DataFrame, name: str = "l3_structure_trend") -> DataFrame:
    """Add the trend of the last four swing points: higher highs and lows 1, lower ones -1, else 0.

    Bars with swing points form a window of their own (at most two points each, the high first);
    their state is carried forward.
    """
    none = F.lit(None).cast("struct<kind:int,price:double>")
    points = F.array_compact(F.array(F.when(F.col("l3_swing_high") == 1, F.struct(F.lit(0).alias("kind"), F.col("high").alias("price"))).otherwise(none), F.when(F.col("l3_swing_low") == 1, F.struct(F.lit(1).alias("kind"), F.col("low").alias("price"))).otherwise(none)))
    marked = bars.withColumn("__points", points).withColumn("__event", F.size("__points") > 0)
    events = Window.partitionBy("symbol", "__event").orderBy("ts").rowsBetween(-3, 0)
    marked = marked.withColumn("__four", F.when(F.col("__event"), F.flatten(F.collect_list("__points").over(events))))
    marked = marked.withColumn("__four", F.when(F.size("__four") >= 4, F.slice("__four", -4, 4)))
    price = lambda kind: F.transform(F.filter("__four", lambda x: x["kind"] == kind), lambda x: x["price"])
    marked = marked.withColumns({"__h": price(0), "__l": price(1)})
    step = lambda c: F.signum(F.get(F.col(c), F.lit(1)) - F.get(F.col(c), F.lit(0)))
    pairs = (F.size("__h") == 2) & (F.size("__l") == 2)
    state = F.when(pairs & (step("__h") == 1) & (step("__l") == 1), 1).when(pairs & (step("__h") == -1) & (step("__l") == -1), -1).otherwise(0)
    marked = marked.withColumn("__state", F.when(F.col("__event"), state))
    return marked.withColumn(name, F.coalesce(fill_forward(F.col("__state")), F.lit(0))).drop("__points", "__event", "__four", "__h", "__l", "__state")


def higher_trend(bars: DataFrame, width: str, name: str, config: EngineConfig) -> DataFrame:
    """Add the structure trend of the wider grid, taken by the bar that each row falls into."""
    wide = structure_trend(resample(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), width).withColumns(swing_columns(config.swing)), name)
    wide = wide.select("symbol", F.col("ts").alias("__bucket"), name)
    return bars.withColumn("__bucket", bucket("ts", width)).join(wide, ["symbol", "__bucket"], "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("__bucket")


def breaks(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Add breaks of structure, changes of character, and the last confirmed swings (``__sh_*``, ``__sl_*``).

    A swing is a target from n bars on; the first close beyond it is the break and uses it up. A
    bar can't break both ways: the upward break goes first.
    """
    n = config.swing
    out = ordinal(bars)
    confirmed = lambda flag, value: fill_forward(F.when(F.lag(flag, n).over(series()) == 1, value))
    out = out.withColumns({
        "__sh_i": confirmed("l3_swing_high", F.col("i") - n), "__sh": confirmed("l3_swing_high", F.lag("high", n).over(series())),
        "__sl_i": confirmed("l3_swing_low", F.col("i") - n), "__sl": confirmed("l3_swing_low", F.lag("low", n).over(series())),
    })

    def first_of(cond: Column, target: str) -> Column:
        tenure = Window.partitionBy("symbol", target).orderBy("ts")
        return F.coalesce(cond, F.lit(False)) & (F.count_if(cond).over(before(tenure)) == 0)

    out = out.withColumn("__bull", first_of(F.col("close") > F.col("__sh"), "__sh_i"))
    out = out.withColumn("__bear", first_of((F.col("close") < F.col("__sl")) & ~F.col("__bull"), "__sl_i"))
    out = out.withColumn("l3_bos_direction", F.when(F.col("__bull"), 1).when(F.col("__bear"), -1).otherwise(0))
    bos = F.col("l3_bos_direction")
    previous = F.last(F.when(bos != 0, bos), ignorenulls=True).over(before())
    return out.withColumn("l3_choch_flag", F.when((bos != 0) & (previous == -bos), bos).otherwise(0)).drop("__bull", "__bear")


def premium_discount(bars: DataFrame, config: EngineConfig) -> DataFrame:
    """Add the zone of the close between the last confirmed swings."""
    rng = F.col("__sh") - F.col("__sl")
    pos = F.when(rng > config.eps, (F.col("close") - F.col("__sl")) / rng)
    zone = F.when(pos > 0.5 + config.equilibrium, 1).when(pos < 0.5 - config.equilibrium, -1).otherwise(0)
    return bars.withColumn("l3_premium_discount", zone)


def _block_made(demand: bool) -> tuple[Column, Column]:
    """Bottom and top of the order block that a break makes of the last opposite candle since the broken swing, else null."""
    opposite = F.col("close") < F.col("open") if demand else F.col("close") > F.col("open")
    candle = F.when(opposite, F.struct(F.col("i").alias("j"), F.least("open", "close").alias("lo"), F.greatest("open", "close").alias("hi")))
    last = F.last(candle, ignorenulls=True).over(before())
    made = (F.col("l3_bos_direction") == (1 if demand else -1)) & (last["j"] >= F.greatest(F.col("__sh_i" if demand else "__sl_i"), F.lit(0)))
    return F.when(made, last["lo"]), F.when(made, last["hi"])


def order_blocks(bars: DataFrame, demand: bool, config: EngineConfig) -> DataFrame:
    """Order blocks ``(symbol, start_i, lo, hi, mid)``."""
    lo, hi = _block_made(demand)
    made = bars.withColumns({"__lo": lo, "__hi": hi}).filter("__lo is not null")
    return made.select("symbol", F.col("i").alias("start_i"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), ((F.col("__lo") + F.col("__hi")) / 2).alias("mid"))


def block_distance(bars: DataFrame, demand: bool, name: str, config: EngineConfig) -> DataFrame:
    """Add the signed distance in pips to the nearest living block; 0 without one.

    A block lives from its break to the first close beyond it, for ``block_age`` bars at most, so
    the interval join is bounded. Of equal distances the older block counts.
    """
    blocks = order_blocks(bars, demand, config).withColumn("end_i", F.col("start_i") + config.block_age + 1)
    met = binned_interval_join(bars.select("symbol", "i", "close"), blocks, 128)
    killed = F.col("close") < F.col("lo") if demand else F.col("close") > F.col("hi")
    life = Window.partitionBy("symbol", "start_i").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    alive = met.withColumn("dead", F.count_if(killed).over(life)).filter("dead = 0")
    dist = (F.col("close") - F.col("mid")) / config.pip * (1 if demand else -1)
    nearest = alive.groupBy("symbol", "i").agg(F.min_by(dist, F.struct(F.abs(dist), "start_i")).alias("__dist"))
    return bars.join(nearest, ["symbol", "i"], "left").withColumn(name, F.coalesce("__dist", F.lit(0.0))).drop("__dist")


def _pools(prices: np.ndarray, own: int, width: int, tolerance: float, touches: int) -> np.ndarray:
    """For each row from ``own`` on the mean of the largest cluster around one of its last ``width`` prices (the oldest on ties), NaN below ``touches``."""
    windows = trailing_windows(prices, own, width)
    n, lags = len(prices), np.arange(1, width)
    # near[t, d]: whether t and t - d are close; counts of close partners before and after are sums along d
    padded = np.concatenate([np.full(width, np.nan), prices, np.full(width, np.nan)])
    at = np.arange(n) + width
    older = np.zeros((n, width), np.int16)
    newer = np.zeros((n, width), np.int16)
    for d in lags:
        older[:, d] = older[:, d - 1] + (np.abs(prices - padded[at - d]) <= tolerance)
        newer[:, d] = newer[:, d - 1] + (np.abs(prices - padded[at + d]) <= tolerance)
    age = np.arange(width - 1, -1, -1)  # oldest first
    rows = np.arange(own, n)[:, None] - age
    there = rows >= 0
    rows = np.maximum(rows, 0)
    counts = np.where(there, 1 + older[rows, width - 1 - age] + newer[rows, age], 0)
    best = counts.argmax(1)
    most = np.take_along_axis(counts, best[:, None], 1)[:, 0]
    middle = np.take_along_axis(windows, best[:, None], 1)
    inside = np.abs(windows - middle) <= tolerance
    total = np.zeros(len(windows))
    for k in range(width):  # from the oldest, as a list's mean adds up: a sum in another order can fall on the other side of a price
        total = np.where(inside[:, k], total + windows[:, k], total)
    mean = total / np.maximum(inside.sum(1), 1)
    return np.where(most >= touches, mean, np.nan)


def _first_at_most(values: np.ndarray, start: int, bound: float) -> int:
    """The first position from ``start`` on of a value up to ``bound``, or the end."""
    for at in range(start, len(values), 256):
        hit = np.nonzero(values[at : at + 256] <= bound)[0]
        if len(hit):
            return at + int(hit[0])
    return len(values)


def _born(high: np.ndarray, low: np.ndarray, own: int, least: float) -> np.ndarray:
    """Where price gaps open, in coordinates where price falls into them from above."""
    at = np.nonzero(low[2:] - high[:-2] >= least)[0] + 2
    return at[at >= own]


def _gap_distance(high: np.ndarray, low: np.ndarray, close: np.ndarray, own: int, least: float, tops: np.ndarray, middles: np.ndarray) -> np.ndarray:
    """Distance of each close from ``own`` on over the nearest open gap's middle, NaN where none is open.

    tops, middles: older open gaps, in ascending order. A new gap's top is the bar's low and all
    open tops are below it, so gaps close from the end and their spans are nested. Gaps two or
    more bars apart don't overlap: the nearest middle is among the last three.
    """
    born = _born(high, low, own, least)
    tops, middles = np.concatenate([tops, low[born]]), np.concatenate([middles, (high[born - 2] + low[born]) / 2])
    starts = np.concatenate([np.full(len(tops) - len(born), own), born]).astype(int)
    latest = np.full(len(low), -1)
    below = np.full(len(tops) + 1, -1)  # the open gap under each; the last place stands for none
    for k, (start, top) in enumerate(zip(starts.tolist(), tops.tolist(), strict=True)):
        old = k < len(tops) - len(born)
        below[k] = k - 1 if old else latest[start]
        latest[start : _first_at_most(low, start if old else start + 1, top)] = k
    found = [latest[own:]]
    for _ in range(2):
        found.append(below[found[-1]])
    best = np.full(len(low) - own, np.nan)
    for at in reversed(found):  # the oldest first
        dist = np.where(at >= 0, close[own:] - np.concatenate([middles, [np.nan]])[at], np.nan)
        best = np.where(np.isnan(best) | (np.abs(dist) < np.abs(best)), np.where(np.isnan(dist), best, dist), best)
    return best


def _block_distances(close: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: int, age: int) -> np.ndarray:
    """Distance of each close from ``own`` on over the nearest living block's middle, NaN without one, in coordinates where price breaks upwards."""
    best = np.full(len(close), np.nan)
    for start in np.nonzero(~np.isnan(lo))[0]:
        end = min(start + age + 1, len(close))
        dead = np.nonzero(close[start:end] < lo[start])[0]
        part = slice(start, start + int(dead[0]) if len(dead) else end)
        dist = close[part] - (lo[start] + hi[start]) / 2
        best[part] = np.where(np.isnan(best[part]) | (np.abs(dist) < np.abs(best[part])), dist, best[part])
    return best[own:]


def liquidity_columns(config: EngineConfig) -> dict[str, Column]:
    """Distances to the pools above and below and the sweep flag (the lower sweep overrides)."""
    buy, sell = F.col("__buy_pool"), F.col("__sell_pool")
    swept = F.when((F.col("low") < sell) & (F.col("close") > sell), -1).when((F.col("high") > buy) & (F.col("close") < buy), 1).otherwise(0)
    return {
        "l3_buy_liq_distance": F.coalesce((buy - F.col("close")) / config.pip, F.lit(0.0)), "l3_sell_liq_distance": F.coalesce((F.col("close") - sell) / config.pip, F.lit(0.0)), "l3_liquidity_sweep": swept,
    }
