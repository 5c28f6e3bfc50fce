"""The softmax booster: histograms, growth, early stopping, and log loss against the forest."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.boosting import BoostParams, Booster, Tree

P = BoostParams(rounds=8, depth=2, step=0.5, patience=3, bins=16, least_weight=1.0, gamma=0.0, block_rows=64, refresh=3, fan_in=2)


def made(n, noise=0.0, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)).round(2)
    cls = np.where(np.abs(x[:, 0]) < 0.4, 0, np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1, 2))
    cls = np.where(rng.random(n) < noise, rng.integers(0, 3, n), cls)
    return x, cls


def frame(spark, x, cls):
    return spark.createDataFrame([(*map(float, v), int(c)) for v, c in zip(x, cls, strict=True)], "l1_a double, l1_b double, l1_c double, cls int")


COLUMNS = ["l1_a", "l1_b", "l1_c"]


def test_histograms_and_splits_equal_plain_sums(spark):
    """One level of a growing tree on 500 rows, dealt over several tasks and summed in two steps."""
    from tidemark.operators.boosting import LOSS, _level, binned, quantile_edges, softmax, to_blocks

    x, cls = made(500, 0.2)
    rng = np.random.default_rng(3)
    weight, valid = rng.random(500).round(3) + 0.5, rng.random(500) < 0.3
    rows = spark.createDataFrame([(*map(float, v), int(c), float(w), bool(t)) for v, c, w, t in zip(x, cls, weight, valid, strict=True)], "l1_a double, l1_b double, l1_c double, cls int, weight double, valid boolean").repartition(5).cache()
    edges = quantile_edges(rows.filter("not valid"), COLUMNS, 16)
    assert all(np.all(np.diff(e) > 0) and len(e) <= 15 for e in edges)
    whole = replace(P, subsample=1.1)
    blocks = to_blocks(rows, COLUMNS, edges, whole).repartition(4).cache()
    grown = Tree.empty(2)
    grown.feature[0], grown.bin[0] = 1, 5
    before = [[Tree(np.full(7, -1, np.int32), np.zeros(7, np.int32), np.array([0.3 * k, *[0.0] * 6])) for k in range(3)]]
    got = _level(blocks, before, [grown, Tree.empty(2), grown], 1, np.array([0, 2]), 0, 16, True, whole)
    bins = binned(x, edges)
    prob = softmax(np.tile([0.0, 0.3, 0.6], (500, 1)))
    seen = 0
    for k, tree in enumerate((grown, Tree.empty(2), grown)):
        for node in (0, 1):
            inside = ~valid & ((bins[:, 1] > 5) == node) & (tree.feature[0] >= 0)
            g, h = weight * (prob[:, k] - (cls == k)), weight * 2 * prob[:, k] * (1 - prob[:, k])
            for f in (0, 2):
                r = got[(got.cls == k) & (got.node == node) & (got.feature == f)].iloc[0]
                assert math.isclose(r.g, g[inside].sum(), abs_tol=1e-9) and math.isclose(r.h, h[inside].sum(), abs_tol=1e-9)
                score = lambda a, b: max(abs(a) - P.alpha, 0) ** 2 / (b + P.lam)
                gains = []
                for cut in range(16):
                    left = inside & (bins[:, f] <= cut)
                    right = inside & ~left
                    fits = h[left].sum() >= P.least_weight and h[right].sum() >= P.least_weight
                    gains.append(score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[inside].sum(), h[inside].sum()) if fits else -math.inf)
                if max(gains) > -math.inf:
                    seen += 1
                    assert math.isclose(r.gain, max(gains), rel_tol=1e-9, abs_tol=1e-9) and math.isclose(gains[int(r.bin)], max(gains), rel_tol=1e-9, abs_tol=1e-9)
    assert seen == 8
    root = _level(blocks, before, [Tree.empty(2)] * 3, 0, np.array([0]), 0, 16, False, whole)
    loss = root[root.feature == LOSS].iloc[0]
    own = -np.log(prob[np.arange(500), cls])
    assert math.isclose(loss.gl, (own * weight)[~valid].sum()) and math.isclose(loss.hl, own[valid].sum()) and loss.h == valid.sum()


def test_booster_learns_stops_and_is_kept(spark, tmp_path):
    from tidemark.plans import training as T

    x, cls = made(900)
    train, valid = frame(spark, x[:600], cls[:600]), frame(spark, x[600:], cls[600:])
    good = T.fit_boosted(train, valid, COLUMNS, P)
    assert 3 < good.best_iteration <= 8 and len(good.trees) == good.best_iteration and good.losses[good.best_iteration][1] == min(v for _, v in good.losses) < 0.55
    assert all(b[0] < a[0] for a, b in zip(good.losses, good.losses[1:4], strict=False))
    out = good.predict(valid.drop("l1_c")).collect()  # a missing column counts as 0
    assert all(abs(sum(r.probs) - 1) < 1e-9 and r.conf == max(r.probs) * 100 for r in out) and sum(r.pred == r.cls for r in out) > 0.85 * len(out)
    assert good.importance().first().feature == "l1_a" and math.isclose(good.importance().agg(F.sum("gain")).first()[0], 1.0)
    good.save(str(tmp_path / "m"))
    again = T.load_model(spark, str(tmp_path / "m"))
    assert isinstance(again, Booster) and again.columns == COLUMNS and again.best_iteration == good.best_iteration
    assert sorted(map(repr, again.predict(valid).collect())) == sorted(map(repr, good.predict(valid).collect()))
    # margins written anew after every round give the same trees
    often = T.fit_boosted(train, valid, COLUMNS, replace(P, refresh=1))
    assert np.allclose(often.probabilities(x), good.probabilities(x))
    x, cls = made(200, 1.0)
    lost = T.fit_boosted(frame(spark, x[:120], cls[:120]), frame(spark, x[120:], cls[120:]), COLUMNS, replace(P, rounds=30, step=1.0))
    assert len(lost.losses) < 30 and len(lost.trees) == lost.best_iteration <= len(lost.losses) - P.patience
    none = T.fit_boosted(frame(spark, x[:50], cls[:50]), frame(spark, x[:0], cls[:0]), COLUMNS, replace(P, rounds=2))
    assert none.best_iteration == 2 and none.predict(frame(spark, x[:0], cls[:0])).count() == 0


@pytest.mark.parametrize("noise", [0.15])
def test_booster_beats_the_forest(spark, noise):
    from tidemark.plans import training as T

    x, cls = made(1500, noise, 7)
    train, valid = frame(spark, x[:1000], cls[:1000]).cache(), frame(spark, x[1000:], cls[1000:]).cache()
    booster = T.fit_boosted(train, valid, COLUMNS, replace(P, rounds=20, depth=4, step=0.4, refresh=10))
    forest = T.fit(train, COLUMNS)
    assert T.fold_metrics(booster, valid)[2] < T.fold_metrics(forest, valid)[2]
    assert math.isclose(T.fold_metrics(booster, valid)[2], booster.losses[booster.best_iteration][1], abs_tol=1e-5)


def test_walk_forward_reports_the_best_round(spark, sf):
    from tidemark.plans import catalog

    rows = catalog.queries()["walk_forward"](spark, sf).collect()
    assert rows and all(0 <= r.best_iteration <= 12 and r.log_loss > 0 for r in rows)
