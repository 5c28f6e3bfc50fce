"""Reports by their contents: importance, backtest, text."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import EngineConfig

C = EngineConfig(pip=1.0, tp_pips=3.0, sl_pips=2.0, horizon=10, confidence=40.0)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(2)
    close = 100 + np.cumsum(rng.normal(0, 1, 800))
    start = dt.datetime(2024, 3, 1)
    rows = [("s", start + dt.timedelta(minutes=15 * k), c - 0.2, c + 0.5, c - 0.5, float(c), 1.0, float(c - close[max(0, k - 3)]), float(rng.normal())) for k, c in enumerate(close.tolist())]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, l1_a double, l1_b double").cache()


@pytest.fixture(scope="module")
def model(bars):
    from tidemark.operators.labels import barrier_labels, class_of
    from tidemark.plans import training as T

    return T.fit(barrier_labels(bars, C).withColumn("cls", class_of()), ["l1_a", "l1_b"], trees=5, depth=4)


def test_importance(model):
    rows = model.importance().collect()
    gains = dict(zip(model.columns, model.pipeline.stages[-1].featureImportances.toArray(), strict=True))
    assert [(r.feature, r.gain) for r in rows] == sorted(gains.items(), key=lambda x: -x[1]) and abs(sum(gains.values()) - 1) < 1e-9


def test_backtest_and_its_text(spark, bars, model):
    from tidemark.operators import evaluate as E
    from tidemark.operators.labels import barrier_labels, class_of
    from tidemark.plans import training as T

    made = T.backtest(model, bars, C, "2024-03-03", "2024-03-06")
    # labels look ahead of the window, which holds its last day whole
    scored = model.predict(barrier_labels(bars, C).withColumn("cls", class_of())).filter("ts >= timestamp_ntz '2024-03-03' and ts < timestamp_ntz '2024-03-07'").toPandas()
    assert len(scored) == 4 * 96
    grid = {(r.truth, p): getattr(r, f"pred_{p}") for r in made["confusion"].collect() for p in (0, 1, 2)}
    assert grid == {(t, p): int(((scored.cls == t) & (scored.pred == p)).sum()) for t in (0, 1, 2) for p in (0, 1, 2)}
    report = {r.name: r for r in made["report"].collect()}
    assert report["accuracy"].f1 == pytest.approx((scored.cls == scored.pred).mean()) and report["1"].support == (scored.cls == 1).sum()
    acted = scored[(scored.pred != 0) & (scored.conf >= 40)].sort_values("ts")
    pnl = np.where(acted.label == 0, -1.0, np.where(acted.label == np.where(acted.pred == 1, 1, -1), 3.0, -2.0))
    sim = made["simulation"].first()
    eq = np.cumsum(pnl)
    assert (sim.total_trades, sim.total_pips_won, sim.max_drawdown) == (len(pnl), round(pnl[pnl > 0].sum(), 2), round((np.maximum.accumulate(eq) - eq).max(), 2))
    assert sim.win_rate == round((pnl > 0).mean(), 4)
    tiers = {r.tier: r.total_trades for r in made["tiers"].collect()}
    assert tiers == {n: int(((acted.conf >= lo) & (acted.conf < hi)).sum()) for n, lo, hi in C.tiers}
    text = T.report_text(made["simulation"], made["tiers"].orderBy("tier"), "March").splitlines()
    assert text[:2] == ["March", "====="] and text[3:5] == ["Trading simulation", "------------------"] and text[7:9] == ["Tiers", "-----"] and len(text) == 12
    assert text[5].startswith("symbol=s  total_trades=") and f"max_drawdown={sim.max_drawdown}" in text[5] and [line.split("  ")[0] for line in text[9:]] == ["tier=1", "tier=2", "tier=3"]
    assert made["tiers"].agg(F.sum("total_trades")).first()[0] == sum(tiers.values())
