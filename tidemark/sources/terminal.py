"""Candles of a trading terminal as a Spark data source, in batch and as a stream.

The terminal is named by ``module:function``; the function is called with the options wherever
candles are read, so rows go from the terminal to the executors and never through the driver.
A stream's offsets are epoch seconds by symbol: what lies between two of them is read again alike
after a restart. Every read connects, with retries, and disconnects, whatever happens in between.
"""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.live import TIME_FRAMES, Terminal, connected

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
#: Fixed value: candles that a terminal gives at once.
MOST_CANDLES = 50_000


class Offline(ConnectionError):
    """The terminal can't be reached."""


def terminal_of(options: dict[str, str]) -> Terminal:
    """The adapter that ``terminal`` names."""
    module, _, function = options["terminal"].partition(":")
    return getattr(importlib.import_module(module), function)(dict(options))


class Candles:
    """What both readers share: options, connections, and candles between two times."""

    def __init__(self, options: dict[str, str]):
        self.options = {k: v for k, v in options.items() if v is not None}
        self.symbols = [s for s in self.options["symbols"].split(",") if s]
        self.minutes = int(self.options.get("minutes", "1"))
        if self.minutes not in TIME_FRAMES:
            raise ValueError(f"no such time frame: {self.minutes}")
        self.tries, self.wait = int(self.options.get("tries", "3")), float(self.options.get("wait", "1"))
        self.slice = int(self.options.get("slice", "10000")) * 60 * self.minutes

    @contextmanager
    def connection(self) -> Iterator[Terminal]:
        terminal = terminal_of(self.options)
        if not connected(terminal, self.tries, self.wait):
            raise Offline(f"no connection after {self.tries} tries")
        try:
            yield terminal
        finally:
            terminal.disconnect()

    def between(self, terminal: Terminal, symbol: str, start: int, end: int) -> list[tuple]:
        """Rates with start <= time < end, in order; of equal times the last. Ever more are asked for until they reach back to ``start``."""
        count = 256
        while True:
            found = terminal.rates(symbol, self.minutes, count)
            if len(found) < count or count >= MOST_CANDLES or min(r[0] for r in found) <= start:
                break
            count = min(2 * count, MOST_CANDLES)
        return [r for _, r in sorted({r[0]: r for r in found if start <= r[0] < end}.items())]

    def batch(self, symbol: str, rates: list[tuple]) -> pa.RecordBatch:
        times = [dt.datetime.fromtimestamp(r[0], dt.timezone.utc) for r in rates]
        columns = [pa.array([symbol] * len(rates), pa.string()), pa.array(times, pa.timestamp("us", tz="UTC")), *[pa.array([float(r[k]) for r in rates], pa.float64()) for k in range(1, 6)]]
        return pa.RecordBatch.from_arrays(columns, names=["symbol", "ts", "open", "high", "low", "close", "volume"])


class Span(InputPartition):
    """Candles of one symbol with start <= time < end."""

    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


class CandleReader(DataSourceReader):
    """The last ``count`` candles of each symbol, the forming one included: one task for each symbol."""

    def __init__(self, options: dict[str, str]):
        self.candles, self.count = Candles(options), min(int(options.get("count", "100")), MOST_CANDLES)

    def partitions(self) -> list[Span]:
        return [Span(s, 0, 0) for s in self.candles.symbols]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        with self.candles.connection() as terminal:
            yield self.candles.batch(partition.symbol, terminal.rates(partition.symbol, self.candles.minutes, self.count))


class CandleStreamReader(DataSourceStreamReader):
    """Complete candles from ``start`` (epoch seconds) on; the forming one comes when it is complete.

    While the terminal can't be reached the stream stands still, and goes on from where it was.
    """

    def __init__(self, options: dict[str, str]):
        self.candles = Candles(options)
        self.first = {s: int(float(options.get("start", "0"))) for s in self.candles.symbols}
        self.known = dict(self.first)

    def initialOffset(self) -> dict[str, int]:
        return dict(self.first)

    def latestOffset(self) -> dict[str, int]:
        try:
            with self.candles.connection() as terminal:
                for symbol in self.candles.symbols:
                    last = terminal.rates(symbol, self.candles.minutes, 1)
                    if last:  # it is still forming, all before it are complete
                        self.known[symbol] = max(self.known[symbol], int(last[-1][0]))
        except (Offline, OSError, RuntimeError):
            pass
        return dict(self.known)

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[Span]:
        # the reader may be new after a restart: it never falls back behind what was read
        self.known = {s: max(int(end.get(s, 0)), t) for s, t in self.known.items()}
        out = []
        for symbol, first in self.first.items():
            at, stop = int(start.get(symbol, first)), int(end.get(symbol, first))
            while at < stop:
                out.append(Span(symbol, at, min(at + self.candles.slice, stop)))
                at = out[-1].end
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        with self.candles.connection() as terminal:
            yield self.candles.batch(partition.symbol, self.candles.between(terminal, partition.symbol, partition.start, partition.end))


class CandleSource(DataSource):
    """``spark.read`` or ``spark.readStream`` of format ``candles`` after ``spark.dataSource.register(CandleSource)``.

    Options: ``terminal`` (module:function), ``symbols`` (separated by commas), ``minutes`` of a candle, ``tries`` and
    ``wait`` of a connection; in batch ``count``, as a stream ``start`` (epoch seconds) and ``slice`` (candles of a task).
    """

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CandleReader:
        return CandleReader(dict(self.options))

    def streamReader(self, schema: StructType) -> CandleStreamReader:
        return CandleStreamReader(dict(self.options))


def candle_stream(spark: SparkSession, terminal: str, symbols: list[str], **options: str) -> DataFrame:
    """Complete candles of a terminal as a stream, ready for the live loop."""
    spark.dataSource.register(CandleSource)
    return spark.readStream.format("candles").options(terminal=terminal, symbols=",".join(symbols), **options).load()
