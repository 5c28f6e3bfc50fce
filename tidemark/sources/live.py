"""Live candles: a terminal adapter, its rates as bars, and sinks for signals and messages."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.csv_bars import write_csv

# Minutes of the time frames that a terminal knows.
TIME_FRAMES = (1, 5, 15, 30, 60, 240, 1440)
RATES = "time double, open double, high double, low double, close double, tick_volume double, spread double, real_volume double"


class Terminal(Protocol):
    """What an adapter of a trading terminal offers."""

    def connect(self) -> bool: ...
    def disconnect(self) -> None: ...
    def rates(self, symbol: str, minutes: int, count: int) -> list[tuple]: ...
    def tick(self, symbol: str) -> tuple[float, float] | None: ...


def connected(terminal: Terminal, tries: int = 3, wait: float = 1.0) -> bool:
    """Connect, with pauses between tries."""
    for k in range(tries):
        if terminal.connect():
            return True
        if k + 1 < tries:
            time.sleep(wait)
    return False


def candles(spark: SparkSession, terminal: Terminal, symbol: str, minutes: int, count: int) -> DataFrame:
    """The last candles of a time frame as bars; ValueError for an unknown frame."""
    if minutes not in TIME_FRAMES:
        raise ValueError(f"no such time frame: {minutes}")
    rows = spark.createDataFrame(terminal.rates(symbol, minutes, count), RATES)
    return rates_to_bars(rows, symbol)


def rates_to_bars(rates: DataFrame, symbol: str) -> DataFrame:
    """Terminal rates with epoch seconds as bars."""
    return rates.select(F.lit(symbol).alias("symbol"), F.timestamp_seconds("time").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", F.col("tick_volume").alias("volume"))


def quote(terminal: Terminal, symbol: str) -> dict[str, float] | None:
    """The current bid and ask, or None where the terminal has none or fails."""
    try:
        found = terminal.tick(symbol)
    except (OSError, RuntimeError):
        return None
    return None if found is None else {"bid": float(found[0]), "ask": float(found[1])}


def log_signals(signals: DataFrame, path: str) -> None:
    """Write a batch of the signal log, again if it is repeated; reasons become one text."""
    signals.withColumn("top_reasons", F.concat_ws(" | ", "top_reasons")).write.mode("overwrite").parquet(path)


# Columns of the CSV form of the signal log.
LOG_COLUMNS = {"timestamp": "ts", "direction": "direction", "confidence": "conf", "tier": "tier", "entry_price": "entry_price", "stop_loss": "stop_loss", "take_profit": "take_profit", "risk_reward": "risk_reward", "candle_dna": "candle_dna", "top_reasons": "top_reasons"}


def log_as_csv(log: DataFrame, path: str) -> None:
    """The signal log as one CSV file with a header, in time order."""
    write_csv(log.orderBy("ts", "symbol").select(*[F.col(c).alias(name) for name, c in LOG_COLUMNS.items()]), path)


def file_notifier(path: str) -> Callable[[str], None]:
    """Messages appended to a file."""

    def send(text: str) -> None:
        with Path(path).open("a") as out:
            out.write(text + "\n")

    return send


def http_notifier(url: str, fallback: Callable[[str], None], timeout: float = 10.0) -> Callable[[str], None]:
    """Messages posted as JSON; what can't be sent goes to the fallback."""

    def send(text: str) -> None:
        try:
            body = json.dumps({"text": text}).encode()
            urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout).close()
        except OSError:
            fallback(text)

    return send


def notify(signals: DataFrame, send: Callable[[str], None], pip: float = 0.1) -> int:
    """Send one message per new signal of a micro-batch, in time order; returns how many."""
    from tidemark.operators.signals import full_message

    n = 0
    for row in signals.orderBy("ts").select(full_message(pip).alias("text")).toLocalIterator():
        send(row["text"])
        n += 1
    return n


def alert(send: Callable[[str], None], text: str) -> None:
    """An error or a notice, marked as such."""
    send(f"ALERT: {text}")


def daily_report(total: int, wins: int, losses: int, pips: float) -> str:
    """The day in one line; the share of wins is 0 without signals."""
    rate = 100 * wins / total if total else 0.0
    return f"today: {total} signals, {wins} won, {losses} lost ({rate:.1f} percent won), {pips:+.0f} pips in all"
