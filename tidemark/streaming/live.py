"""The live loop as one streaming query: store, recompute, predict, filter, log, notify."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import EngineConfig
from tidemark.operators.bars import resample
from tidemark.operators.signals import candidates, cool_down, with_levels
from tidemark.operators.windows import ordinal
from tidemark.plans import features
from tidemark.plans.training import Model
from tidemark.sources.csv_bars import exists
from tidemark.sources.live import log_signals, notify

RECORD = ["symbol", "ts", "direction", "conf", "tier", "entry_price", "stop_loss", "take_profit", "risk_reward", "top_reasons", "candle_dna"]
STATE = "symbol string, done timestamp_ntz, signal timestamp_ntz"


def _state(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """``(symbol, done, signal)`` after the batch before: the last bar judged and the last one that gave a signal.

    Without it every bar would be judged again, and its signals sent again: that is an error.
    """
    if not number:
        return spark.createDataFrame([], STATE)
    path = f"{folder}/batch={number - 1}"
    if not exists(spark, path):
        raise FileNotFoundError(f"no state of the batch before: {path}")
    return spark.read.schema(STATE).parquet(path)


def latest_rows(seen: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each symbol and time: of several the one that came last, by batch and then by its place in it."""
    values = [c for c in columns if c not in ("symbol", "ts")]
    last = F.max_by(F.struct(*values), F.struct("batch", "place")).alias("__v")
    return seen.groupBy("symbol", "ts").agg(last).select("symbol", "ts", *[F.col(f"__v.{c}").alias(c) for c in values]).select(*columns)


def below_limit(rows: DataFrame, losses: DataFrame, config: EngineConfig) -> DataFrame:
    """Rows before which their day has fewer losses ``(symbol, ts)`` than allowed."""
    lost = losses.select(F.col("symbol").alias("__s"), F.col("ts").alias("__at"))
    same_day = (F.col("symbol") == F.col("__s")) & (F.to_date("ts") == F.to_date("__at")) & (F.col("__at") < F.col("ts"))
    full = rows.join(lost, same_day).groupBy("symbol", "ts").agg(F.count("*").alias("n")).filter(F.col("n") >= config.daily_losses)
    return rows.join(full, ["symbol", "ts"], "left_anti")


def live_query(
    children: DataFrame, store: str, log: str, checkpoint: str, model: Model, config: EngineConfig, send: Callable[[str], None] | None = None, context: int = 500,
    every: str | None = None, losses: Callable[[], DataFrame] | None = None, sessions: Iterable[int] | None = None,
) -> StreamingQuery:
    """Start the loop over a stream of child bars ``(symbol, ts, open, high, low, close, volume)``.

    Each micro-batch is written to ``store`` by day under its own number, its signals to ``log``
    and what carries over (last bar judged, last signal) beside it, so a repeated batch replaces
    itself and messages are sent once. Of a child bar that came several times (still forming, or
    corrected) the last one counts. A parent counts once a later one of its symbol has begun.
    Parents since the last batch are scored from themselves and the ``context`` parents before;
    only the days that can hold those are read (three times their span and two days), whatever
    the store has grown to. What passes confidence, ``sessions``, the daily limit on ``losses()``
    (rows ``(symbol, ts)`` of stops that were hit) and the cool-down since the last signal is
    logged and sent. ``every``: trigger interval; without it the query ends when the input is
    used up.
    """
    folder, sent = f"{log.rstrip('/')}-state", f"{log.rstrip('/')}-sent"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        dated = rows.withColumns({"place": F.monotonically_increasing_id(), "day": F.to_date("ts"), "batch": F.lit(number)})
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(store)
        before = _state(spark, folder, number)
        since = rows.agg(F.min("ts")).unionAll(before.agg(F.min("done"))).toDF("t").agg(F.min("t")).first()[0]
        if since is None:
            before.write.mode("overwrite").parquet(f"{folder}/batch={number}")
            return
        width = spark.range(1).select(F.expr(f"cast(interval {config.parent_width} as interval day to second)")).first()[0]
        days = 2 + math.ceil(3 * (context + 1) * width.total_seconds() / 86400)
        seen = spark.read.schema(dated.schema).parquet(store).filter((F.col("day") >= F.lit(since.date()) - days) & (F.col("batch") <= number))
        kids = latest_rows(seen, rows.columns)
        parents = resample(kids, config.parent_width)
        last = parents.groupBy("symbol").agg(F.max("ts").alias("__open"))
        complete = ordinal(parents.join(last, "symbol").filter("ts < __open").drop("__open")).join(before, "symbol", "left").persist()
        fresh = F.col("done").isNull() | (F.col("ts") > F.col("done"))
        first = complete.filter(fresh).groupBy("symbol").agg(F.min("i").alias("__first"))
        recent = complete.join(first, "symbol").filter(F.col("i") >= F.col("__first") - context + 1).drop("__first", "i", "done", "signal")
        made = model.predict(features.build(recent, kids, config)).join(complete.filter(fresh).select("symbol", "ts", "i"), ["symbol", "ts"])
        able = candidates(made, config, sessions)
        able = below_limit(able, losses(), config) if losses else able
        # the last signal stands before the new candidates and keeps its cool-down
        stands = complete.filter(F.col("ts") == F.col("signal")).select("symbol", "i")
        taken = cool_down(able.select("symbol", "i").unionByName(stands), config)
        signals = with_levels(able.join(taken, ["symbol", "i"], "left_semi"), config).select(*RECORD).persist()
        log_signals(signals, f"{log}/batch={number}")
        done = complete.groupBy("symbol").agg(F.max("ts").alias("d")).join(signals.groupBy("symbol").agg(F.max("ts").alias("s")), "symbol", "left")
        after = before.join(done, "symbol", "full").select("symbol", F.greatest("done", "d").alias("done"), F.greatest("signal", "s").alias("signal"))
        after.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if send and not exists(spark, f"{sent}/batch={number}"):
            notify(signals, send, config.pip)
            spark.range(0).write.mode("overwrite").parquet(f"{sent}/batch={number}")
        signals.unpersist()
        complete.unpersist()

    writer = children.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
