"""Exact cases, sources, signals, training and the registered queries."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.config import EVENTS, EngineConfig

C = EngineConfig()
DAY = dt.datetime(2024, 1, 2, 9, 0)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def up(b=1800.0, m=1.0, w=0.2):
    return (b, b + m + w, b - w, b + m)


def down(b=1801.0, m=1.0, w=0.2):
    return (b, b + w, b - m - w, b - m)


def doji(b=1800.0, w=0.5):
    return (b, b + w, b - w, b)


def dead(p=1800.0):
    return (p, p, p, p)


def absorbing(r=2.0, body=0.1, b=1800.0):
    return (b + r / 2, b + r, b, b + r / 2 + body)


CASES = {
    "volume": ([up()] * 10 + [dead()] * 5, {"l1_custom_volume": 10, "l1_m1_count": 15}), "alternating": ([up(), down()] * 7 + [up()], {"l1_reversal_count": 14}), "one turn": ([up()] * 7 + [down()] * 8, {"l1_reversal_count": 1}),
    "doji between": ([up(), doji(), down()], {"l1_reversal_count": 1}), "all doji": ([doji()] * 5, {"l1_reversal_count": 0}), "late": ([dead()] * 7 + [up()] * 8, {"l1_early_late_ratio": 1.0}), "early": ([up()] * 7 + [dead()] * 8, {"l1_early_late_ratio": 0.0}),
    "single": ([up()], {"l1_early_late_ratio": 0.0, "l1_price_acceleration": -1.0}), "absorbing": ([absorbing()] * 15, {"l1_absorption_count": 15, "l1_absorption_intensity": 1.0}), "mixed": ([up(m=1.6, w=0.2)] * 10 + [absorbing(r=4.0)] * 5, {"l1_absorption_count": 5, "l1_absorption_intensity": 0.5}),
}


def test_layer1_cases(spark):
    from tidemark.operators.bars import nest_children
    from tidemark.operators.layer1 import layer1, nested_columns

    kids = [(name, DAY + dt.timedelta(minutes=k), *map(float, c), 1.0) for name, (candles, _) in CASES.items() for k, c in enumerate(candles)]
    children = spark.createDataFrame(kids, BAR)
    parents = spark.createDataFrame([(n, DAY, 1800.0, 1806.0, 1799.0, 1805.0, 1.0) for n in CASES], BAR)
    flat = {r.symbol: r for r in layer1(parents, children, C).collect()}
    nested = {r.symbol: r for r in nest_children(children, "15 minutes").withColumns(nested_columns(F.col("children"), C)).collect()}
    for name, (_, want) in CASES.items():
        for column, value in want.items():
            assert math.isclose(flat[name][column], value, abs_tol=1e-6) and math.isclose(nested[name][column], value, abs_tol=1e-6), (name, column)
    assert flat["volume"].l1_price_velocity == 0.5


def test_csv_layouts(spark, tmp_path):
    from tidemark.sources.csv_bars import as_doubles, read_bars

    (tmp_path / "m1.csv").write_text("date,time,open,high,low,close,volume\n2024.01.02,09:01,1901,1903,1900,1902,120\n2024.01.02,09:00,1810.07,1902,1898,1901,100\n")
    (tmp_path / "m15.csv").write_text("timestamp,open,high,low,close\n2024-01-02 09:15:00,1900,1902,1898,1904\n")
    (tmp_path / "bad.csv").write_text("foo,bar,baz\n1,2,3\n")
    rows = as_doubles(read_bars(spark, str(tmp_path / "m1.csv"))).orderBy("ts").collect()
    assert rows[0].ts == DAY and rows[0].open == 1810.0699462890625 and rows[1].volume == 120.0
    assert read_bars(spark, str(tmp_path / "m15.csv")).first().volume == 0.0
    with pytest.raises(ValueError, match="Unrecognized CSV format"):
        read_bars(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(FileNotFoundError):
        read_bars(spark, str(tmp_path / "none.csv"))


def test_cleaning(spark):
    from tidemark.operators.ingest import clean, clean_statistics

    rows = [("s", DAY, 1.0, 2.0, 0.5, 1.5, 0.0), ("s", DAY, None, 2.0, 0.5, 1.5, 0.0), ("s", DAY, -1.0, 2.0, 0.5, 1.5, 0.0), ("s", DAY, 1.0, 1.0, 1.0, 1.0, 0.0), ("s", dt.datetime(2024, 1, 6), 1.0, 2.0, 0.5, 1.5, 0.0)]
    frame = spark.createDataFrame(rows, BAR)
    assert clean(frame).count() == 1
    assert tuple(clean_statistics(frame).first())[1:6] == (5, 4, 3, 2, 1)


def scored(spark, rows):
    return spark.createDataFrame([("s", DAY + dt.timedelta(minutes=15 * k), k, *r) for k, r in enumerate(rows)], "symbol string, ts timestamp_ntz, i int, label int, pred int, conf double")


def test_simulation(spark):
    from tidemark.operators.evaluate import rounded, simulate, tiers, trades

    run = lambda rows: rounded(simulate(trades(scored(spark, rows), C), C, "symbol")).first()
    won = run([(1, 1, 90.0)] * 10)
    assert (won.total_trades, won.win_rate, won.total_pips_won, won.max_drawdown, won.sharpe_ratio) == (10, 1.0, 1500.0, 0.0, 0.0)
    lost = run([(-1, 1, 90.0)] * 10)
    assert (lost.win_rate, lost.total_pips_lost, lost.max_drawdown) == (0.0, 1000.0, 900.0)
    assert run([(1, 0, 99.0)] * 3 + [(1, 1, 59.9)]) is None
    neutral = run([(0, 2, 70.0), (-1, 2, 70.0)])
    assert (neutral.win_rate, neutral.total_pips_won, neutral.total_pips_lost) == (0.5, 150.0, 0.0)
    counts = {r.tier: r.total_trades for r in tiers(trades(scored(spark, [(1, 1, c) for c in (60.0, 69.9, 70.0, 100.0)]), C), C).collect()}
    assert counts == {1: 2, 2: 1, 3: 1}


def test_cool_down(spark):
    from dataclasses import replace

    from tidemark.operators.signals import cool_down, dna_name, tier, top_reasons, under_daily_limit

    rows = spark.createDataFrame([("s", i) for i in (10, 11, 12, 13, 20, 22, 23)] + [("t", 11)], "symbol string, i int")
    pick = lambda n: sorted((r.symbol, r.i) for r in cool_down(rows, replace(C, cooldown=n)).collect())
    assert pick(2) == [("s", 10), ("s", 12), ("s", 20), ("s", 22), ("t", 11)] and pick(3) == [("s", 10), ("s", 13), ("s", 20), ("s", 23), ("t", 11)]
    one = spark.range(1).select(F.lit(79.9).alias("conf"), F.lit(5).alias("l4_candle_dna"), *[F.lit(v).alias(c) for c, v in {"l4_whale_footprint": 2, "l2_kill_zone": 1, "l3_liquidity_sweep": 0, "l4_volume_climax": 0, "l4_multi_layer_confluence": -3, "l3_bos_direction": 1, "l3_choch_flag": 0, "l3_demand_ob_distance": 5, "l3_supply_ob_distance": 15, "l4_momentum_divergence": 0}.items()])
    row = one.select(tier().alias("t"), dna_name().alias("d"), top_reasons().alias("r")).first()
    assert (row.t, row.d, row.r) == (2, "Breakout", ["Whale footprint detected", "Kill zone active", "Multi-layer confluence"])
    days = spark.createDataFrame([("s", DAY + dt.timedelta(minutes=k), True) for k in range(5)] + [("s", DAY + dt.timedelta(days=1), False)], "symbol string, ts timestamp_ntz, loss boolean")
    assert under_daily_limit(days, C).count() == 4


def test_gap_fill(spark):
    from tidemark.operators.bars import fill_gap, last_complete

    bar = lambda minutes, v: ("s", DAY + dt.timedelta(minutes=minutes), v, v, v, v, 0.0)
    history, live = spark.createDataFrame([bar(k, 1.0) for k in range(50)], BAR), spark.createDataFrame([bar(k, 5.0) for k in range(45, 60)], BAR)
    out = fill_gap(history, live).orderBy("ts").collect()
    assert len(out) == 60 and [r.open for r in out[49:51]] == [1.0, 5.0]
    parents = spark.createDataFrame([bar(k, 1.0) for k in (0, 15, 30)], BAR)
    assert len(last_complete(parents, history, "15 minutes", 10).first().children) == 10


def test_training(spark, sf, tmp_path):
    from tidemark.operators.ingest import fill_zero
    from tidemark.plans import features as P
    from tidemark.plans import training as T

    rows = T.event_training(spark, sf).cache()
    columns = T.prune_correlated(fill_zero(rows).withColumn("l1_twice", F.col("l1_volatility_energy") * 2), [*P.L1, "l1_twice"], 0.95)
    assert "l1_twice" not in columns and "l1_volatility_energy" in columns
    model = T.fit(rows, columns, trees=5, depth=3)
    out = model.predict(rows.drop(columns[0])).select("probs", "pred", "conf").collect()
    assert all(abs(sum(r.probs) - 1) < 1e-6 and len(r.probs) == 3 and r.conf == max(r.probs) * 100 for r in out)
    model.save(str(tmp_path / "m"))
    again = T.Model.load(spark, str(tmp_path / "m"))
    assert again.columns == columns and again.predict(rows).select("pred").collect() == model.predict(rows).select("pred").collect()
    assert model.importance().count() == len(columns)
    kept, old, new = T.champion(model, again, rows, EVENTS)
    assert kept is again and old == new


def test_retraining_keeps_versions(spark, tmp_path):
    from tidemark.plans import training as T

    rows = [("s", DAY + dt.timedelta(hours=k), float(k % 3), k % 3, (0, 1, -1)[k % 3]) for k in range(1500)]
    labelled = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, l1_a double, cls int, label int")
    small = lambda d, c: T.fit(d, c, trees=1, depth=2)
    blind = lambda d, c: T.fit(d.withColumn("l1_a", F.lit(0.0)), c, trees=1, depth=1)
    root, now = str(tmp_path / "models"), dt.datetime(2024, 5, 1, 3, 0)
    assert T.current_version(spark, root) is None
    assert T.retrain(labelled, ["l1_a"], root, C, now, small) == ("20240501-030000", None, None)
    kept, old, new = T.retrain(labelled, ["l1_a"], root, C, now + dt.timedelta(days=7), blind)
    assert kept == "20240501-030000" == T.current_version(spark, root) and new < old
    kept, old, new = T.retrain(labelled, ["l1_a"], root, C, now + dt.timedelta(days=14), small)
    assert kept == "20240515-030000" == T.current_version(spark, root) and new == old
    assert {p.name for p in (tmp_path / "models" / "versions").iterdir()} == {"20240501-030000", "20240508-030000", "20240515-030000"}  # none is overwritten


def test_streaming_bars(spark, sf):
    from tidemark.plans import catalog

    batch = {(r.symbol, r.ts): tuple(r)[2:] for r in catalog.hourly(spark, sf).collect()}
    live = catalog.queries()["stream_bars"](spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()
    assert 0 < len(live) < len(batch) and all(batch[r.symbol, r.ts] == tuple(r)[2:] for r in live)


def test_forming_bars_and_unique_ticks(spark, tmp_path):
    from tidemark.streaming.bars import forming_bars, run_to_end, unique_ticks

    def tick(minute, event, value):
        return ("s", dt.datetime(2024, 1, 2, 9, 0) + dt.timedelta(minutes=minute), event, value)

    schema = "symbol string, ts timestamp, event_id long, value double"
    for k, part in enumerate([[tick(1, 1, 5.0), tick(2, 2, 7.0)], [tick(8, 3, 4.0), tick(8, 3, 4.0), tick(2, 2, 7.0)], [tick(20, 4, 6.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sent = run_to_end(forming_bars(stream, "15 minutes", "1 hour"), "update", str(tmp_path / "a")).collect()
    first = sorted((r.volume, r.open, r.high, r.low, r.close) for r in sent if r.ts.minute == 0)
    assert first == [(2.0, 5.0, 7.0, 5.0, 7.0), (5.0, 5.0, 7.0, 4.0, 4.0)] and len(sent) == 3  # the forming bar came twice
    once = run_to_end(unique_ticks(stream, "1 hour"), "append", str(tmp_path / "b")).collect()
    assert sorted(r.event_id for r in once) == [1, 2, 3, 4]


def test_stages_messages_and_columns(spark, tmp_path):
    from tidemark.operators.ingest import drop_features
    from tidemark.operators.signals import plain_message
    from tidemark.sources.csv_bars import read_stage, write_csv, write_stage

    bars = spark.createDataFrame([("s", DAY, *up(), 1.0), ("t", DAY + dt.timedelta(days=400), *up(), 1.0)], BAR)
    write_stage(bars, str(tmp_path / "one"))
    assert {p.name for p in (tmp_path / "one" / "symbol=s").iterdir()} == {"year=2024"}
    assert read_stage(spark, str(tmp_path / "none"), str(tmp_path / "one")).filter("symbol = 't'").first().open == 1800.0
    with pytest.raises(FileNotFoundError):
        read_stage(spark, str(tmp_path / "none"))
    write_csv(bars.select("symbol", "close"), str(tmp_path / "csv"))
    assert sorted(x for p in (tmp_path / "csv").glob("*.csv") for x in p.read_text().splitlines()) == ["s,1801.0", "symbol,close", "t,1801.0"]
    assert "volume" not in drop_features(bars, "vol").columns
    signal = spark.createDataFrame([("s", DAY, "SELL", 72.4, 2, 2000.0, 2010.0, 1985.0)], "symbol string, ts timestamp_ntz, direction string, conf double, tier int, entry_price double, stop_loss double, take_profit double")
    assert signal.select(plain_message().alias("m")).first().m == "s sell at 2000.00, target 1985.00, stop 2010.00 (72 percent sure, tier 2) @ 2024-01-02 09:00 GMT"


def test_live_loop_and_backtest(spark, sf, tmp_path):
    from dataclasses import replace

    from tidemark.operators.labels import barrier_labels, class_of
    from tidemark.operators.signals import scan
    from tidemark.plans import catalog
    from tidemark.plans import features as P
    from tidemark.plans import training as T
    from tidemark.streaming.live import live_query

    kids = catalog.children(spark, sf).filter("day(ts) <= 7").cache()
    bars = catalog.hourly(spark, sf).filter("day(ts) <= 7")
    made = P.build(bars, kids, EVENTS).cache()
    model = T.fit(barrier_labels(made, EVENTS).withColumn("cls", class_of()), P.L1 + P.L2, trees=3, depth=3)
    small = T.backtest(model, made, EVENTS, "2024-01-03", "2024-01-06")
    assert small["confusion"].count() == 3 and small["tiers"].count() == 3 and "Tiers" in T.report_text(small["simulation"], small["tiers"])
    config = replace(EVENTS, confidence=34.0, cooldown=5, daily_losses=1)
    whole = made.filter("ts < timestamp_ntz '2024-01-07 23:00:00'")  # the last parent is still open
    scored = model.predict(whole)
    want = {(r.symbol, r.ts): r.direction for r in scan(scored, config).collect()}

    def run(name, parts, send):
        at = tmp_path / name
        for part in parts:
            kids.filter(part).coalesce(1).write.mode("append").parquet(str(at / "in"))
        stream = spark.readStream.schema(kids.schema).option("maxFilesPerTrigger", 1).parquet(str(at / "in"))
        live_query(stream, str(at / "store"), str(at / "log"), str(at / "check"), model, config, send, 2000).awaitTermination()
        log = spark.read.parquet(str(at / "log")).collect()
        assert len({(r.symbol, r.ts) for r in log}) == len(log)
        return {(r.symbol, r.ts): r.direction for r in log}

    # cut in the middle of an hour and of cool-downs: the same signals as over the whole history at once
    sent = []
    parts = ["ts < timestamp_ntz '2024-01-04 10:20:00'", "ts >= timestamp_ntz '2024-01-04 10:20:00'"]
    assert run("a", parts, sent.append) == want and len(sent) == len(want) > 9
    assert spark.read.parquet(str(tmp_path / "a" / "store")).count() == kids.count()
    # a replay of the last batch changes neither log nor store, and sends nothing
    (last,) = [p for p in (tmp_path / "a" / "check" / "commits").iterdir() if p.name == "1"]
    last.unlink()
    (last.parent / ".1.crc").unlink(missing_ok=True)
    assert run("a", [], sent.append) == want and len(sent) == len(want)
    assert spark.read.parquet(str(tmp_path / "a" / "store")).count() == kids.count()
    # lost state is an error, not a new start
    import shutil

    shutil.rmtree(tmp_path / "a" / "log-state" / "batch=1")
    with pytest.raises(Exception, match="no state of the batch before"):
        run("a", ["ts < timestamp_ntz '2024-01-03 00:00:00'"], sent.append)


def test_last_value_wins_in_the_live_store(spark, tmp_path):
    """A forming bar that comes again, in the same batch and in a later one, and a replayed batch."""
    from tidemark.streaming.live import latest_rows

    rows = [("s", DAY, 1.0, 0, 0), ("s", DAY, 2.0, 0, 1), ("s", DAY, 3.0, 1, 0), ("s", DAY + dt.timedelta(minutes=1), 9.0, 0, 2), ("t", DAY, 5.0, 1, 2), ("t", DAY, 4.0, 0, 7), (None, DAY, 6.0, 0, 8)]
    seen = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, batch int, place long").repartition(4)
    got = latest_rows(seen, ["symbol", "ts", "close"])
    assert got.columns == ["symbol", "ts", "close"]
    assert {(r.symbol, r.ts): r.close for r in got.collect()} == {("s", DAY): 3.0, ("s", DAY + dt.timedelta(minutes=1)): 9.0, ("t", DAY): 5.0, (None, DAY): 6.0}


def test_daily_limit_of_the_live_loop(spark):
    from dataclasses import replace

    from tidemark.streaming.live import below_limit

    rows = spark.createDataFrame([(s, DAY + dt.timedelta(hours=h)) for s in "ab" for h in range(0, 40, 2)], "symbol string, ts timestamp_ntz")
    lost = spark.createDataFrame([("a", DAY + dt.timedelta(hours=3)), ("a", DAY + dt.timedelta(hours=5)), ("b", DAY + dt.timedelta(hours=5))], "symbol string, ts timestamp_ntz")
    left = {(r.symbol, (r.ts - DAY).total_seconds() / 3600) for r in below_limit(rows, lost, replace(C, daily_losses=2)).collect()}
    assert left == {(s, h) for s in "ab" for h in range(0, 40, 2) if not (s == "a" and 5 < h < 15)}  # DAY begins at nine


def test_live_sources(spark, tmp_path):
    from tidemark.sources import live

    class Fake:
        left = 2

        def connect(self):
            self.left -= 1
            return self.left < 0

        def tick(self, symbol):
            if symbol == "broken":
                raise RuntimeError
            return (1999.5, 2000.0) if symbol == "s" else None

        def rates(self, symbol, minutes, count):
            return [(1704186000.0 + 900 * k, 1.0, 2.0, 0.5, 1.5, 7.0, 0.0, 0.0) for k in range(count)]

    assert live.connected(Fake(), wait=0) and not live.connected(Fake(), tries=2, wait=0)
    bars = live.candles(spark, Fake(), "s", 15, 3)
    assert bars.columns == ["symbol", "ts", "open", "high", "low", "close", "volume"] and bars.first().ts == DAY
    with pytest.raises(ValueError, match="time frame"):
        live.candles(spark, Fake(), "s", 7, 1)
    assert [live.quote(Fake(), x) for x in ("s", "none", "broken")] == [{"bid": 1999.5, "ask": 2000.0}, None, None]
    log = tmp_path / "log.txt"
    live.http_notifier("http://127.0.0.1:9/none", live.file_notifier(str(log)), 0.2)("hello")
    assert log.read_text() == "hello\n" and "(0.0 percent won)" in live.daily_report(0, 0, 0, 0.0)
    signal = spark.createDataFrame([("s", DAY, "BUY", 72.4, 2, 2000.0, 1990.0, 2015.0, 1.5, ["a", "b"], "Trap")], "symbol string, ts timestamp_ntz, direction string, conf double, tier int, entry_price double, stop_loss double, take_profit double, risk_reward double, top_reasons array<string>, candle_dna string")
    live.log_signals(signal, str(tmp_path / "signals"))
    live.log_signals(signal, str(tmp_path / "signals"))
    live.log_as_csv(spark.read.parquet(str(tmp_path / "signals")), str(tmp_path / "csv"))
    (csv,) = (tmp_path / "csv").glob("*.csv")
    assert csv.read_text().splitlines() == ["timestamp,direction,confidence,tier,entry_price,stop_loss,take_profit,risk_reward,candle_dna,top_reasons", "2024-01-02T09:00:00.000,BUY,72.4,2,2000.0,1990.0,2015.0,1.5,Trap,a | b"]
    sent = []
    live.alert(sent.append, "no rates")
    assert sent.pop() == "ALERT: no rates"
    assert live.notify(signal, sent.append) == 1 and "150 pips to gain, 100 at risk (ratio 1.5)" in sent[0] and "because of: a; b; candle type Trap" in sent[0] and sent[0].startswith("2024-01-02 09:00 GMT - s buy")


QUERIES = ["spike_flags", "ingest_clean", "gap_report", "ohlc_4h", "bucket_collect", "m1_m15_join", "l1_nested", "l3_order_blocks", "label_distribution", "fold_bounds", "corr_prune", "class_report", "tier_analysis", "cooldown", "daily_loss_limit", "dedupe_keep_last", "fill_gap", "perf_summary", "feature_summary", "features_all", "csv_m1_scan", "csv_m15_scan", "stage_round_trip", "latest_features", "signal_scan", "stream_bars", "stream_signals"]


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import catalog

    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    frame, sql = catalog.queries()[name](spark, sf), catalog.oracle_sql()[name]
    columns = sorted(frame.columns)
    assert sorted(con.sql(sql).columns) == columns
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, want))
