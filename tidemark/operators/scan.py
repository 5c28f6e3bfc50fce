"""Prefix scans over time chunks: state that reaches back without bound, for series of any length.

A series is cut into chunks of time. Each chunk is summarised on its own; one pass over the
summaries (a few numbers for thousands of rows, in order) folds them into the state before every
chunk; then all chunks are passed at once, each with its state. The rows are shuffled once, by
chunk, and no task holds more of them than one chunk.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Scan:
    """begin: the state before a series. summarise: what a chunk's rows say. fold: the state after a
    chunk, from the one before it and the chunk's summary; folding has to give what passing the
    rows would. enough: of the summaries after a chunk, in order, what the chunk is told of them,
    and whether that is all it needs. passed: the new columns of a chunk's rows, from the state
    before it and what it is told of those after it."""

    begin: Callable[[], Any]
    summarise: Callable[[pa.Table], Any]
    fold: Callable[[Any, Any], Any]
    passed: Callable[[pa.Table, Any, Any], dict[str, np.ndarray]]
    enough: Callable[[list[Any]], tuple[Any, bool]] = lambda after: (None, True)


def chunk_of(ts: str, width: str, size: int):
    """The chunk of time that a bar falls into: ``size`` bars of a width like ``15 minutes``."""
    count, unit = width.split()
    return F.window(ts, f"{int(count) * size} {unit}")["start"]


def _arrow(column: np.ndarray, field: T.StructField) -> pa.Array:
    kind = pa.float64() if isinstance(field.dataType, T.DoubleType) else pa.int32()
    return pa.array(column, pa.float64(), from_pandas=True).cast(kind)


def summaries(rows: DataFrame, scan: Scan, order: str = "ts") -> DataFrame:
    """``(symbol, chunk, said)``: what each chunk's rows say, pickled."""

    def summarised(key: tuple, group: pa.Table) -> pa.Table:
        said = pickle.dumps(scan.summarise(group.sort_by(order)), protocol=5)
        return pa.table({"symbol": pa.array([key[0].as_py()], pa.string()), "chunk": pa.array([key[1].as_py()], group.schema.field("chunk").type), "said": pa.array([said], pa.binary())})

    return rows.groupBy("symbol", "chunk").applyInArrow(summarised, T.StructType([rows.schema["symbol"], rows.schema["chunk"], T.StructField("said", T.BinaryType())]))


def states(said: DataFrame, scan: Scan) -> DataFrame:
    """``(symbol, chunk, told)``: each chunk's state and what it has to know of later ones, pickled."""

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, state, kind = object(), None, None
        waiting: deque[tuple[Any, Any, list[Any]]] = deque()

        def told(last: bool) -> list[tuple[Any, bytes]]:
            out = []
            while waiting:
                chunk, before, after = waiting[0]
                knows, done = scan.enough(after)
                if not (done or last):
                    break
                out.append((chunk, pickle.dumps((before, knows), protocol=5)))
                waiting.popleft()
            return out

        def rows_of(name: str | None, made: list[tuple[Any, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(made), pa.string()), pa.array([m[0] for m in made], kind), pa.array([m[1] for m in made], pa.binary())], names=["symbol", "chunk", "told"])

        for batch in batches:
            kind = batch.schema.field("chunk").type
            for name, chunk, said in zip(batch.column("symbol").to_pylist(), batch.column("chunk").to_pylist(), batch.column("said"), strict=True):
                if name != symbol:
                    if made := told(True):
                        yield rows_of(symbol, made)
                    symbol, state = name, scan.begin()
                summary = pickle.loads(said.as_py())  # written by the stage before
                for entry in waiting:
                    entry[2].append(summary)
                waiting.append((chunk, state, []))
                if made := told(False):
                    yield rows_of(symbol, made)
                state = scan.fold(state, summary)
        if made := told(True):
            yield rows_of(symbol, made)

    schema = T.StructType([said.schema["symbol"], said.schema["chunk"], T.StructField("told", T.BinaryType())])
    return said.repartition("symbol").sortWithinPartitions("symbol", "chunk").mapInArrow(carried, schema)


def passed(rows: DataFrame, told: DataFrame, scan: Scan, fields: list[T.StructField], order: str = "ts") -> DataFrame:
    """Rows ``(symbol, chunk, <order>, ...)`` without ``chunk``, with the columns that the scan gives them from each chunk's state."""
    kept = [f for f in rows.schema.fields if f.name != "chunk"]
    names = [f.name for f in kept]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.sort_by(order)
        if own.num_rows:
            before, after = pickle.loads(right["told"][0].as_py())
            made = scan.passed(own, before, after)
        else:  # a state without rows
            made = {f.name: np.zeros(0) for f in fields}
        out = own.select(names)
        for f in fields:
            out = out.append_column(f.name, _arrow(made[f.name], f))
        return out

    return rows.groupBy("symbol", "chunk").cogroup(told.groupBy("symbol", "chunk")).applyInArrow(run, T.StructType([*kept, *fields]))


def prefix_scan(rows: DataFrame, scan: Scan, fields: list[T.StructField], order: str = "ts") -> DataFrame:
    """Rows ``(symbol, chunk, <order>, ...)`` without ``chunk``, with the columns that the scan gives them.

    New columns are doubles or ints; NaN becomes null. Rows of a chunk come in order. The symbol
    has to be a string; a null one is a symbol of its own.
    """
    return passed(rows, states(summaries(rows, scan, order), scan), scan, fields, order)
