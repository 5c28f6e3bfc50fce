"""CSV bar files of two layouts, and Parquet stages with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_TYPES = "open float, high float, low float, close float"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at the path, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_bars(spark: SparkSession, path: str, symbol: str = "default") -> DataFrame:
    """Bars ``(symbol, ts, open, high, low, close, volume)`` from either layout, told by the header.

    ``date`` (2024.01.02) and ``time`` (09:00) columns, or one ``timestamp`` column. Prices are
    read as single precision; an absent volume is 0. Raises FileNotFoundError for a missing
    path and ValueError for another header.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    header = [c.strip().lower() for c in spark.read.option("header", True).csv(path).columns]
    if "date" in header and "time" in header:
        ts = F.to_timestamp_ntz(F.concat_ws(" ", F.trim("date"), F.trim("time")), F.lit("yyyy.MM.dd HH:mm"))
    elif "timestamp" in header:
        ts = F.to_timestamp_ntz(F.trim("timestamp"))
    else:
        raise ValueError(f"Unrecognized CSV format: {', '.join(header)}")
    kinds = {c: "float" if c in ("open", "high", "low", "close", "volume") else "string" for c in header}
    rows = spark.read.schema(", ".join(f"`{c}` {k}" for c, k in kinds.items())).option("header", True).csv(path)
    volume = F.coalesce(F.col("volume"), F.lit(0.0)) if "volume" in header else F.lit(0.0)
    return rows.select(F.lit(symbol).alias("symbol"), ts.alias("ts"), "open", "high", "low", "close", volume.cast("float").alias("volume"))


def as_doubles(bars: DataFrame) -> DataFrame:
    """Prices and volume widened for arithmetic; single-precision values stay what they are."""
    return bars.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")})


def read_stage(spark: SparkSession, *paths: str) -> DataFrame:
    """The first stage that exists, e.g. layer 4 before layers 2 and 3 before layer 1."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


def write_stage(features: DataFrame, path: str) -> None:
    """Features by symbol and year, so that time ranges prune files."""
    features.withColumn("year", F.year("ts")).repartition("symbol", "year").write.mode("overwrite").partitionBy("symbol", "year").parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """A small report frame as one CSV file."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
