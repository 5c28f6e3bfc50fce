"""Streaming bars: watermarks close them, late ticks within the watermark still count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bars(ticks: DataFrame, width: str, lateness: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    grouped = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return grouped.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def closed_bars(ticks: DataFrame, width: str, lateness: str) -> DataFrame:
    """Bars of ``(symbol, ts, event_id, value)`` ticks, for append mode: a bar comes once the watermark has passed its end."""
    return _bars(ticks, width, lateness)


def forming_bars(ticks: DataFrame, width: str, lateness: str) -> DataFrame:
    """The same bars for update mode: the forming bar is sent again with every batch that changes it."""
    return _bars(ticks, width, lateness)


def unique_ticks(ticks: DataFrame, lateness: str) -> DataFrame:
    """Ticks without repeats of (symbol, event_id) within the watermark."""
    return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["symbol", "event_id"])


def run_to_end(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Process all input there is and return what was written, as a table of Parquet files."""
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{checkpoint}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{checkpoint}/out/*")
