"""Incremental stages against full rebuilds."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F
from test_scan import SMALL
from test_structure import COLUMNS, walk

from tidemark.operators.layer2 import calendar
from tidemark.operators.market import PARTS, WHOLE, Market, alike, market_columns, market_fields


def stage_at(spark, root, size=96):
    from tidemark.sources.incremental import Stage

    schema = calendar(spark.createDataFrame([], COLUMNS + ", l1_volatility_energy double, l1_custom_volume long, l1_price_velocity double"), SMALL).schema
    return Stage(spark, str(root), schema, Market(SMALL).scan(), market_fields(), "15 minutes", size, alike)


def bars_of(spark, rows):
    made = spark.createDataFrame(rows, COLUMNS)
    made = made.withColumns({"l1_volatility_energy": F.round(F.col("high") - F.col("low"), 2), "l1_custom_volume": F.pmod(F.hash("ts"), F.lit(16)).cast("long"), "l1_price_velocity": (F.col("close") - F.col("open")) / 3})
    return calendar(made, SMALL)


def same(got, want):
    columns = [c for c in (*WHOLE, *PARTS) if c != "i"]
    want = {(r.symbol, r.ts): r for r in want}
    assert len(want) == len(got)
    for r in got:
        for c in columns:
            a, b = r[c], want[r.symbol, r.ts][c]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (c, r.symbol, r.ts, a, b)


def test_updates_equal_rebuilds(spark, tmp_path):
    """Growth, a missing stretch that comes later, corrections, and a second symbol."""
    rng = np.random.default_rng(1)
    rows = {(r[0], r[1]): r for r in walk(3, 900, "a") + walk(4, 200, "b")}
    keys = sorted(rows, key=lambda k: k[1])
    late = {keys[k] for k in rng.choice(len(keys), 40, replace=False)}
    stage = stage_at(spark, tmp_path)
    batches = [[rows[k] for k in keys[:600] if k not in late], [rows[k] for k in keys[600:] if k not in late], [rows[k] for k in sorted(late)]]
    corrected = [(s, t, o, h + 5.0, lo, c, v) for s, t, o, h, lo, c, v in (rows[k] for k in keys[50:53])]
    batches.append(corrected)
    seen = {}
    for batch in batches:
        done = stage.update(bars_of(spark, batch))
        seen |= {(r[0], r[1]): r for r in batch}
        assert done.touched <= done.passed <= done.chunks
        same(stage.read().collect(), market_columns(bars_of(spark, list(seen.values())), SMALL).collect())
    assert stage.version() == 4
    assert stage.read(1).count() == len(batches[0])  # an earlier version still reads as it was
    nothing = stage.update(bars_of(spark, batches[0]).limit(0))
    assert nothing.version == 4 and nothing.passed == 0


def test_one_changed_day_costs_little(spark, tmp_path):
    rows = walk(8, 96 * 40, "a")
    stage = stage_at(spark, tmp_path)
    assert stage.update(bars_of(spark, rows)).passed == 40
    # one bar of the twentieth day, inside that day's range: nothing that lasts depends on it
    k = 96 * 20 + 40
    s, t, o, h, lo, c, v = rows[k]
    rows[k] = (s, t, o, h, lo, round((o + c) / 2, 2), v)
    done = stage.update(bars_of(spark, [rows[k]]))
    assert done.touched == 1 and done.chunks == 40 and done.passed <= 4
    read = stage.read()
    files = stage._of("rows", stage.schema.fields, stage.manifest().filter(F.col("rows_gen") == done.version).select("symbol", "chunk", "part", F.col("rows_gen").alias("gen"))).inputFiles()
    assert len(files) > 0 and len({f for f in files if f"gen={done.version}" in f}) <= 4
    same(read.collect(), market_columns(bars_of(spark, rows), SMALL).collect())
    # a bar after the end touches the last day alone
    new = ("a", rows[-1][1] + dt.timedelta(minutes=15), 100.0, 101.0, 99.0, 100.5, 1.0)
    done = stage.update(bars_of(spark, [new]))
    assert done.touched == 1 and done.passed <= 3
    same(stage.read().collect(), market_columns(bars_of(spark, [*rows, new]), SMALL).collect())
