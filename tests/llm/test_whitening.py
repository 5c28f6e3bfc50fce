"""Embedding whitening against NumPy's covariance and eigenvectors."""

import math

import numpy as np
import pytest


def rows_of(vectors):
    return [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)]


def reference(vectors, k=4):
    fine = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.unique(np.array([v for _, v in fine]), axis=0)
    n, total = len(x), x.sum(0)
    centred = x - total / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    out = {}
    for i, v in fine:
        dev = sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total, strict=True))
        out.setdefault(i, []).append((n, dev, ((v - total / n) @ components[:, :k]) / np.sqrt(values[:k]), values[:k] / values.sum()))
    return out


def check(found, vectors, k=4):
    want = reference(vectors, k)
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, []).append(r)
    assert set(by_id) == set(want)
    signs = None
    for i, (n, dev, white, share) in ((i, w[0]) for i, w in want.items()):
        rows = sorted(by_id[i], key=lambda r: r.component)
        assert [r.component for r in rows] == sorted(list(range(1, k + 1)) * len(want[i]))
        got = np.array([r.whitened for r in rows[:: len(want[i])]])
        if signs is None and np.abs(white).min() > 1e-3:
            signs = np.sign(white * got)
        assert all(r.n == n and r.deviation == dev for r in rows)
        assert np.allclose(np.abs(got), np.abs(white), rtol=1e-6, atol=1e-9) and np.allclose([r.explained for r in rows[:: len(want[i])]], share, rtol=1e-9)
        if signs is not None:
            assert np.allclose(got, white * signs, rtol=1e-6, atol=1e-7)
        assert rows[0].identity_error < 1e-8


def test_whitening_matches_numpy(spark):
    from tidemark.llm.whitening import WhitenParams, whiten

    rng = np.random.default_rng(3)
    mix = rng.normal(0, 0.2, (12, 12))
    vectors = rows_of(list(rng.normal(0, 1, (300, 12)) @ mix + rng.normal(0, 1, 12)))
    vectors += [(1000 + i, vectors[0][1]) for i in range(150)] + [(2000, None), (2001, [None] * 12), (2002, [math.nan] + [0.0] * 11), (2003, [math.inf] + [0.0] * 11), (2004, []), (2005, [1.0, 2.0]), (7, vectors[7][1])]
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in vectors], "vec_id long, embedding array<float>, n string, __x double").repartition(40)
    found = whiten(table).collect()
    narrow = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in vectors if v is None or len(v) == 12]
    check(found, narrow)
    assert len(found) == 4 * (300 + 150 + 1)
    again = whiten(table, WhitenParams(fan_in=2)).collect()  # merged through many levels
    assert {(r.vec_id, r.component, r.deviation) for r in again} == {(r.vec_id, r.component, r.deviation) for r in found}


def test_whitening_of_little_and_odd(spark):
    from tidemark.llm.whitening import whiten

    kind = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [None])], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])], kind)).count() == 0  # one vector: no variance
    line = whiten(spark.createDataFrame([(None, [float(i), 2.0 * i, 7.0]) for i in range(9)], kind)).collect()
    assert len(line) == 9 and {r.component for r in line} == {1} and math.isclose(sum(r.whitened**2 for r in line) / 9, 1.0) and math.isclose(line[0].explained, 1.0)
    large = whiten(spark.createDataFrame([(i, [1e9 * i, 1e9 * (i % 3)]) for i in range(60)], kind)).collect()
    assert all(r.deviation is None for r in large if r.vec_id == 0) and max(r.identity_error for r in large) < 1e-8


def test_symmetric_qr():
    from tidemark.llm.whitening import symmetric_eigen

    rng = np.random.default_rng(5)
    repeated = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    cases = [np.eye(1), np.zeros((3, 3)), np.diag([3.0, 1.0, 2.0]), repeated @ np.diag([5.0, 5, 5, 2, 2, 1, 0, 0, 0]) @ repeated.T, np.ones((6, 6))]
    cases += [(lambda a: a @ a.T)(rng.normal(size=(n, n))) for n in (2, 3, 17, 64)]
    for v in cases:
        values, vectors = symmetric_eigen(v)
        size = max(1.0, np.abs(v).max() * len(v))
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * size)
        assert np.allclose(vectors.T @ vectors, np.eye(len(v)), atol=1e-13) and np.allclose(vectors * values @ vectors.T, v, atol=1e-13 * size)


@pytest.mark.parametrize("cut", [1, 50, 399])
def test_moments_merge(cut):
    from tidemark.llm.whitening import Moments

    x = np.random.default_rng(cut).integers(-(10**6), 10**6, (400, 5)) + 10**8
    a, b, whole = Moments.none(5), Moments.none(5), Moments.none(5)
    a.update(x[:cut]), b.update(x[cut:]), whole.update(x)
    a.merge(b)
    assert a.n == 400 and a.total == whole.total == x.sum(0).tolist()
    assert np.allclose(a.covariance(), np.cov(x.T, bias=True), rtol=1e-10) and np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-10)
    a.merge(Moments.none(5))
    assert a.n == 400 and a.total == whole.total
