"""The candle source over a fake terminal."""

import datetime as dt
import json
import time

import numpy as np
import pytest

FIRST = 1704186000  # 2024-01-02 09:00


@pytest.fixture
def fake(spark, tmp_path):
    from tidemark.sources.terminal import CandleSource

    spark.dataSource.register(CandleSource)
    file = tmp_path / "terminal.json"

    def tell(**said):
        file.write_text(json.dumps({"n": 0, "first": FIRST, "fails": 0} | said))

    tell()
    options = {"terminal": "tests.fake_terminal:make", "state": str(file), "symbols": "s,quiet", "minutes": "15", "wait": "0", "start": str(FIRST), "slice": "100"}
    return tell, options, lambda: json.loads(file.read_text()), lambda: len((tmp_path / "closed").read_text())


def run(spark, options, at):
    """What a restarted query adds to its output."""
    stream = spark.readStream.format("candles").options(**options).load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/check").option("path", f"{at}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.symbol, r.ts, r.close) for r in spark.read.schema(stream.schema).parquet(f"{at}/out").collect())


def want(n, quiet=True):
    start = dt.datetime.fromtimestamp(FIRST, dt.timezone.utc).replace(tzinfo=None)
    rows = [("s", start + dt.timedelta(minutes=15 * k), 1.5 + k) for k in range(n - 1)]
    return sorted(rows + [("quiet", t, c) for k, (_, t, c) in enumerate(rows) if k % 2 == 0])


def test_stream_over_failures_and_restarts(spark, fake, tmp_path):
    tell, options, said, closed = fake
    tell(n=301, fails=2)  # the first two connections fail, the third one holds
    assert run(spark, options, tmp_path) == want(301) and said()["failed"] == 2
    tell(n=301)
    assert run(spark, options, tmp_path) == want(301)  # nothing new, nothing again; the forming candle isn't there
    tell(n=1025)  # more than a first request brings, in several slices
    assert run(spark, options, tmp_path) == want(1025)
    tell(n=1100, fails=10**6)  # offline: the query ends cleanly without rows
    assert run(spark, options, tmp_path) == want(1025)
    tell(n=1101)
    assert run(spark, options, tmp_path) == want(1101)
    # a batch that was read but not committed is read again, and replaces itself
    commits = sorted((p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run(spark, options, tmp_path) == want(1101)
    assert closed() >= 8  # every connection that held was closed


def test_a_lost_connection_fails_the_task_and_is_retried(spark, fake, tmp_path):
    from tidemark.sources.terminal import Candles, CandleStreamReader, Offline

    tell, options, _, closed = fake
    tell(n=50, fails=3)
    with pytest.raises(Offline), Candles(options).connection():
        pass
    tell(n=50)
    before = closed() if (tmp_path / "closed").exists() else 0
    with pytest.raises(ZeroDivisionError), Candles(options).connection():
        _ = 1 / 0
    assert closed() == before + 1
    reader = CandleStreamReader(options)
    assert reader.initialOffset() == {"s": FIRST, "quiet": FIRST}
    end = reader.latestOffset()
    assert end["s"] == FIRST + 49 * 900
    spans = reader.partitions({"s": FIRST, "quiet": FIRST}, end)
    replay = [b.to_pylist() for p in spans for b in reader.read(p)]
    assert replay == [b.to_pylist() for p in spans for b in CandleStreamReader(options).read(p)] and sum(map(len, replay)) == 49 + 24
    assert reader.partitions(end, end) == [] and all(p.end - p.start <= 100 * 900 for p in spans)


def test_batch_of_last_candles(spark, fake):
    tell, options, _, _ = fake
    tell(n=40, fails=2)
    got = spark.read.format("candles").options(**options | {"symbols": "s", "count": "10"}).load().orderBy("ts").collect()
    assert [r.open for r in got] == [float(k + 1) for k in range(30, 40)] and got[0].ts == dt.datetime(2024, 1, 2, 16, 30)
    with pytest.raises(Exception, match="time frame"):
        spark.read.format("candles").options(**options | {"minutes": "7"}).load().collect()


def test_live_loop_over_the_source(spark, fake, tmp_path):
    """From the terminal through the loop's store, with a trigger interval, an outage, and a stop."""
    from tidemark.config import EngineConfig
    from tidemark.operators.boosting import Booster, BoostParams, Tree
    from tidemark.sources.terminal import candle_stream
    from tidemark.streaming.live import live_query

    tell, options, _, _ = fake
    tell(n=61)
    trees = [[Tree(np.array([-1] * 3, np.int32), np.zeros(3, np.int32), np.array([k == 1, 0.0, 0.0]) * 9.0) for k in range(3)]]
    always = Booster(["l1_custom_volume"], [np.array([0.0])], trees, BoostParams(depth=1), 1)  # every bar is a sure buy
    rest = {k: v for k, v in options.items() if k not in ("terminal", "symbols")} | {"minutes": "1"}
    children = candle_stream(spark, options["terminal"], ["s"], **rest)
    sent = []
    query = live_query(children, str(tmp_path / "store"), str(tmp_path / "log"), str(tmp_path / "check"), always, EngineConfig(cooldown=2), sent.append, 100, every="1 second")
    try:
        query.processAllAvailable()
        tell(n=61, fails=10**6)
        time.sleep(2)
        assert query.isActive and query.exception() is None  # offline: it waits
        tell(n=121)
        until = time.time() + 60
        while len(sent) < 4 and time.time() < until:
            time.sleep(1)
    finally:
        query.stop()
    log = spark.read.parquet(str(tmp_path / "log")).orderBy("ts").collect()
    start = dt.datetime(2024, 1, 2, 9, 0)
    # eight quarters of an hour, the last one still open; a signal at every other bar
    assert [r.ts for r in log] == [start + dt.timedelta(minutes=30 * k) for k in range(4)] and len(sent) == 4
    assert {r.direction for r in log} == {"BUY"} and spark.read.parquet(str(tmp_path / "store")).count() == 120
