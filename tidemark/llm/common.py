"""Shared pieces of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import scratch

#: Text bytes handled at a time inside a Python worker.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test layout, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote and nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove_path(df.sparkSession, path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns whose name (in any case) clashes with a computed one."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])


def release() -> None:
    """Give freed memory back to the system: workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (a longer row stays whole)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(size)
    start, n = 0, batch.num_rows
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    release()


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as ``c0, c1, ...``: no input column can clash with a computed one."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def attach(df: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Append columns computed per slice of rows by an Arrow function; clashing input columns are replaced."""
    kept = without(df, [f.name for f in fields])
    inner = [f"c{i}" for i in range(len(kept.columns))]
    source = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(kept.columns, inner, strict=True)], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "__text"):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in inner] + fn(part), names=schema.names)

    return source.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "__text") -> pa.Array:
    """The texts of a batch, null as empty.

    They are copied: ``ascii_lower`` of a slice that was cast reads from the wrong place.
    """
    return pc.fill_null(pa.concat_arrays([batch.column(column)]), "").cast(pa.large_string())


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the number of words of each text."""
    split = pc.ascii_split_whitespace(texts)
    values = split.flatten()
    lengths = np.asarray(pc.list_value_length(split)).astype(np.int64)
    full = np.asarray(pc.not_equal(values, "").cast(pa.uint8())).astype(bool) if len(values) else np.zeros(0, bool)
    counts = segment_sums(full.astype(np.int64), lengths)
    return values.filter(pa.array(full)) if not full.all() else values, counts


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of values and the distinct values they stand for."""
    enc = values.dictionary_encode()
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    return np.asarray(enc.indices).astype(np.int64), enc.dictionary


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments; empty segments give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _C1
        x = (x ^ (x >> np.uint64(30))) * _C2
        x = (x ^ (x >> np.uint64(27))) * _C3
        return x ^ (x >> np.uint64(31))
