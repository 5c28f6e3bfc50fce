"""Stateful streams: equality with batch, timers, last values, bounded state."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_structure import C

DAY = dt.datetime(2024, 1, 2)
BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def feed(spark, folder, batches, schema):
    """A stream that reads one batch after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        del k
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, stream, folder):
    from tidemark.streaming.bars import run_to_end
    from tidemark.streaming.signals import rocksdb

    with rocksdb(spark):
        return run_to_end(stream, "append", f"{folder}/run")


def test_timers_close_bars(spark, tmp_path):
    from tidemark.streaming.signals import timed_bars

    minute = lambda k: DAY + dt.timedelta(minutes=k)
    child = lambda s, k, close, volume=1.0: (s, minute(k), close - 0.5, close + 1.0, close - 1.0, close, volume)
    # "early" ends in the middle of its second bar; "late" goes on, so event time passes that bar's end
    first = [child("early", k, 10.0 + k) for k in range(0, 20)] + [child("late", k, 50.0 + k) for k in range(0, 25)]
    second = [child("early", 19, 99.0), child("late", 24, 80.0)] + [child("late", k, 50.0 + k) for k in range(25, 61)]  # both corrected
    third = [child("early", 3, 0.0)] + [child("late", k, 50.0 + k) for k in range(61, 75)]  # too late for its bar
    got = run(spark, timed_bars(feed(spark, tmp_path, [first, second, third], BAR), "15 minutes", "2 minutes"), tmp_path).collect()
    found = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in got}
    assert len(found) == len(got)
    want = {}
    for s, rows in {"early": [*first[:19], second[0]], "late": [*first[20:44], second[1], *second[2:], *third[1:]]}.items():
        for start in range(0, 60, 15):
            inside = [r for r in rows if minute(start) <= r[1] < minute(start + 15)]
            if inside:
                want[s, minute(start)] = (inside[0][2], max(r[3] for r in inside), min(r[4] for r in inside), inside[-1][5], float(len(inside)))
    assert found == want and ("early", minute(15)) in found


def test_scan_over_batches_equals_the_whole(spark, tmp_path):
    from tidemark.operators.signals import candidates, cool_down, under_daily_limit
    from tidemark.operators.windows import ordinal
    from tidemark.streaming.signals import live_scan

    rng = np.random.default_rng(3)
    config = replace(C, cooldown=4, daily_losses=2, confidence=60.0)
    rows = [(s, DAY + dt.timedelta(hours=k), int(rng.integers(0, 3)), float(rng.uniform(40, 100)), int(k % 24 // 8), bool(rng.random() < 0.2)) for s in ("a", "b") for k in range(240)]
    schema = "symbol string, ts timestamp, pred int, conf double, l2_session int, loss boolean"
    rows.sort(key=lambda r: r[1])
    cuts = [0, 37, 38, 150, 300, 480]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    batches[3] = batches[3] + batches[2][-5:]  # repeats
    got = run(spark, live_scan(feed(spark, tmp_path, batches, schema), config, (0, 2)), tmp_path).collect()
    whole = ordinal(spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    allowed = cool_down_in_order(rows, config)
    assert sorted((r.symbol, r.ts, r.i) for r in got) == allowed and len(allowed) > 20
    # without losses it is the batch scan
    plain = feed(spark, tmp_path / "plain", [[r[:5] for r in b] for b in batches], schema.rpartition(",")[0])
    got = run(spark, live_scan(plain, config, (0, 2)), tmp_path / "plain").collect()
    want = cool_down(candidates(whole, config, (0, 2)), config).collect()
    assert sorted((r.symbol, r.ts, r.i) for r in got) == sorted((r.symbol, r.ts, r.i) for r in want)
    assert under_daily_limit(whole, config).count() < whole.count()


def cool_down_in_order(rows, config):
    out, seen, last, lost = [], {}, {}, {}
    for s, ts, pred, conf, session, loss in rows:
        i = seen.get(s, 0)
        seen[s] = i + 1
        day = (s, ts.date())
        if pred and conf >= config.confidence and session in (0, 2) and lost.get(day, 0) < config.daily_losses and i - last.get(s, -(10**9)) >= config.cooldown:
            last[s] = i
            out.append((s, ts, i))
        lost[day] = lost.get(day, 0) + loss
    return sorted(out)


def test_state_does_not_grow(spark, tmp_path):
    """Ten days of losses and bars: the number of state rows after the last day is that after the second."""
    from tidemark.streaming.signals import live_scan, live_signals, rocksdb

    config = replace(C, cooldown=2, daily_losses=2, confidence=0.0)
    days = [[("s", DAY + dt.timedelta(days=d, hours=h), 1, 90.0, h % 3 == 0, 1.0 + h, 0.5, 1.0 + h / 2) for h in range(24)] for d in range(10)]
    schema = "symbol string, ts timestamp, pred int, conf double, loss boolean, high double, low double, close double"

    def rows_of_state(stream, folder):
        seen = []
        with rocksdb(spark):
            query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).foreachBatch(lambda b, k: b.count() and None).start()
            query.awaitTermination()
        for p in query.recentProgress:
            seen += [o["numRowsTotal"] for o in p["stateOperators"]]
        return seen

    counts = rows_of_state(live_scan(feed(spark, tmp_path / "a", days, schema), config), tmp_path / "a")
    assert len(counts) >= 10 and max(counts) <= 12 and counts[-1] <= max(counts[:5])
    counts = rows_of_state(live_signals(feed(spark, tmp_path / "b", days, schema), config, context=50), tmp_path / "b")
    assert len(counts) >= 10 and counts[-1] == counts[4]


@pytest.mark.parametrize("name", ["stream_scan", "stream_signals"])
def test_stateful_queries_equal_sql(spark, sf, name):
    import duckdb
    from tidemark.plans import catalog

    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    frame = catalog.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, want)) and want
