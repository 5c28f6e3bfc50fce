"""Signals from scored bars: filters, price levels, reasons, cool-down."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import EngineConfig
from tidemark.operators.scan import Scan, prefix_scan
from tidemark.operators.windows import ordinal

# Candle type names and reason texts.
DNA_NAMES = {0: "Clean Push", 1: "Absorption", 2: "Exhaustion", 3: "Trap", 4: "Dead Zone", 5: "Breakout", 6: "Fakeout", 7: "Accumulation", -1: "Unclassified"}
REASONS = [
    ("Whale footprint detected", "l4_whale_footprint >= 2"), ("Kill zone active", "l2_kill_zone > 0"), ("Liquidity sweep detected", "l3_liquidity_sweep <> 0"),
    ("Institutional climax volume", "l4_volume_climax = 1"), ("Multi-layer confluence", "abs(l4_multi_layer_confluence) >= 3"), ("Structure break (BOS)", "l3_bos_direction <> 0"),
    ("Change of character (CHoCH)", "l3_choch_flag <> 0"), ("Near demand order block", "abs(l3_demand_ob_distance) < 10"), ("Near supply order block", "abs(l3_supply_ob_distance) < 10"),
    ("Momentum divergence", "l4_momentum_divergence <> 0"),
]


def tier(conf: str = "conf") -> Column:
    return F.when(F.col(conf) >= 80, 3).when(F.col(conf) >= 70, 2).otherwise(1)


def dna_name(dna: str = "l4_candle_dna") -> Column:
    names = F.create_map(*[x for k, v in DNA_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, F.col(dna).cast("int")), F.lit("Unknown"))


def top_reasons(most: int = 3) -> Column:
    """The first reasons that hold, or the model itself."""
    held = F.slice(F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(text)) for text, cond in REASONS])), 1, most)
    return F.when(F.size(held) > 0, held).otherwise(F.array(F.lit("Model prediction")))


def with_levels(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """Add direction, tier, entry, stop, target, risk-reward, reasons and the candle's name."""
    way = F.when(F.col("pred") == 1, 1).otherwise(-1)
    tp, sl = config.tp_pips * config.pip, config.sl_pips * config.pip
    return rows.withColumns({
        "direction": F.when(F.col("pred") == 1, "BUY").otherwise("SELL"), "tier": tier(), "entry_price": F.round("close", 5), "stop_loss": F.round(F.col("close") - way * sl, 5),
        "take_profit": F.round(F.col("close") + way * tp, 5), "risk_reward": F.lit(round(tp / sl, 2) if sl > 0 else 0.0), "top_reasons": top_reasons(), "candle_dna": dna_name(),
    })


def candidates(scored: DataFrame, config: EngineConfig, sessions: Iterable[int] | None = None) -> DataFrame:
    """Directions with enough confidence, in the sessions asked for."""
    out = scored.filter((F.col("pred") != 0) & (F.col("conf") >= config.confidence))
    return out.filter(F.col("l2_session").isNull() | F.col("l2_session").isin(*sessions)) if sessions is not None else out


def under_daily_limit(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """Rows of days with fewer earlier losses (``loss`` flags) than allowed."""
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__losses", F.coalesce(F.sum(F.col("loss").cast("int")).over(day), F.lit(0))).filter(F.col("__losses") < config.daily_losses).drop("__losses")


def greedy(i: np.ndarray, start: int, step: int) -> list[int]:
    """Indexes of the sorted positions that stay, from position ``start`` on: each at least ``step`` after the one before."""
    out, at = [], int(np.searchsorted(i, start))
    while at < len(i):
        out.append(at)
        at = int(np.searchsorted(i, i[at] + max(step, 1)))
    return out


def cool_down(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """Greedy choice in time order: a row stays if the last one that stayed is at least ``cooldown`` bars (``i``) before.

    What a chunk of positions does depends only on how many of its first positions are still
    blocked: 0 to ``cooldown``. Its summary is the table from that number to the last position
    that stays. Tables are followed from chunk to chunk, then all chunks are judged at once. Rows
    of equal position stay or go together.
    """
    step, size = config.cooldown, config.chunk_bars

    def positions(table: pa.Table) -> tuple[np.ndarray, int]:
        i = np.asarray(table["i"].combine_chunks().cast(pa.int64()))
        return i, int(i[0]) // size * size

    def summarise(table: pa.Table) -> tuple[int, list[int | None]]:
        i, first = positions(table)
        stays = (greedy(i, first + blocked, step) for blocked in range(step + 1))
        return first, [int(i[s[-1]]) if s else None for s in stays]

    def fold(last: int | None, said: tuple[int, list[int | None]]) -> int | None:
        first, ends = said
        end = ends[0 if last is None else min(max(last + step - first, 0), step)]
        return last if end is None else end

    def passed(table: pa.Table, last: int | None, after: None) -> dict[str, np.ndarray]:
        i, first = positions(table)
        return {"__stays": np.isin(i, i[greedy(i, first if last is None else last + step, step)]).astype(float)}

    chunks = rows.withColumn("chunk", F.floor(F.col("i") / size))
    return prefix_scan(chunks, Scan(lambda: None, summarise, fold, passed), [T.StructField("__stays", T.IntegerType())], "i").filter("__stays = 1").drop("__stays")


def scan(scored: DataFrame, config: EngineConfig, sessions: Iterable[int] | None = None) -> DataFrame:
    """Signal records of a scored history."""
    base = scored if "i" in scored.columns else ordinal(scored)
    chosen = cool_down(candidates(base, config, sessions), config)
    record = ["ts", "direction", "conf", "tier", "entry_price", "stop_loss", "take_profit", "risk_reward", "top_reasons", "candle_dna"]
    return with_levels(chosen, config).withColumn("conf", F.round("conf", 2)).select("symbol", *record)


def history(signals: DataFrame, most: int = 50) -> DataFrame:
    """The latest signals, for display: a top-k report."""
    return signals.orderBy(F.col("ts").desc(), "symbol").limit(most)


def volatility_bucket(rank: str = "l2_session_volatility_rank") -> Column:
    return F.when(F.col(rank) >= 0.66, "HIGH").when(F.col(rank) >= 0.33, "MED").otherwise("LOW")


def trend_text(trend: str) -> Column:
    return F.when(F.col(trend) > 0, "BULL ▲").when(F.col(trend) < 0, "BEAR ▼").otherwise("NEUTRAL ─")


def session_name(session: str = "l2_session") -> Column:
    return F.when(F.col(session) == 0, "Asian").when(F.col(session) == 1, "London").when(F.col(session) == 2, "New York")


def zone_name(zone: str = "l2_kill_zone") -> Column:
    return F.when(F.col(zone) == 1, "London Open").when(F.col(zone) == 2, "NY Open").when(F.col(zone) == 3, "London Close").otherwise("None")


def candle_geometry() -> dict[str, Column]:
    """Bottom and height of a candle's body for drawing; a doji gets a thousandth of its range."""
    height = F.abs(F.col("close") - F.col("open"))
    return {"body_low": F.least("open", "close"), "body_height": F.when(height > 0, height).otherwise((F.col("high") - F.col("low")) * 0.001)}


def _pips(level: str, pip: float) -> Column:
    return F.abs(F.col(level) - F.col("entry_price")) / pip


def _time() -> Column:
    return F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm 'GMT'")


def plain_message() -> Column:
    """A signal as one line: what, where from, where to, how sure, when."""
    return F.concat_ws(
        " ", "symbol", F.lower("direction"), F.format_string("at %.2f, target %.2f, stop %.2f", "entry_price", "take_profit", "stop_loss"), F.format_string("(%.0f percent sure, tier %d)", "conf", "tier"), F.concat(F.lit("@ "), _time()),
    )


def full_message(pip: float = 0.1) -> Column:
    """A signal as a short text: a headline, the levels with distances in pips, the candle, and the reasons in one sentence."""
    reward = F.format_string("%.0f pips to gain, %.0f at risk (ratio %.1f)", _pips("take_profit", pip), _pips("stop_loss", pip), F.col("risk_reward"))
    return F.concat_ws(
        "\n", F.concat_ws(" ", _time(), F.lit("-"), "symbol", F.lower("direction"), F.format_string("[tier %d, %.0f percent]", "tier", "conf")),
        F.format_string("enter %.2f, leave at %.2f or %.2f", "entry_price", "take_profit", "stop_loss"), reward,
        F.concat(F.lit("because of: "), F.array_join("top_reasons", "; "), F.lit("; candle type "), F.col("candle_dna")),
    )
