"""Soft-membership mixing.

A classifier fitted on the labelled table gives every document a posterior over the domains
``good``, ``poor`` and ``toxic``. Document rates r >= 0 are then fitted by projected-gradient
least squares so that the expected tokens of every domain, sum_i r_i n_i p_i, match the targets:
the weights times a budget of tokens. Rates depend on a document's posterior and on the residuals
of the steps alone, so no step writes anything: each one is one aggregate over the posteriors.
The first step comes from a summary of the posteriors of fixed size, on which the largest
budget is found that needs no rate above its bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import attach, coded, numbered, segment_sums, slices, stored, table, texts_of, words_of

DOMAINS = ("good", "poor", "toxic")
#: Word hash buckets of the classifier.
BUCKETS = 1 << 16


@dataclass(frozen=True)
class MixParams:
    """weights: target share of tokens per domain; a domain without weight has no target. budget: tokens of the mix; None takes ``margin`` times the
    largest at which the weights can be met. max_rate: no document is repeated more often; with 1 rows never
    multiply. sample_rows: labelled documents that the classifier is fitted on, at most (those whose ids hash
    lowest; the only bound here). steps, tol: of the gradient fit. cells: of the summary, along each posterior."""

    weights: dict[str, float] = field(default_factory=lambda: {"good": 0.93, "poor": 0.05, "toxic": 0.02})
    budget: float | None = None
    margin: float = 0.99
    max_rate: float = 1.0
    sample_rows: int = 8000
    steps: int = 25
    tol: float = 1e-3
    cells: int = 256


@dataclass(frozen=True)
class Classifier:
    """For each half of the labelled documents the log-odds of words by domain and bucket, and a softmax layer over features made of them."""

    odds: np.ndarray  # halves x domains x BUCKETS
    layer: np.ndarray  # (features + 1) x domains
    mean: np.ndarray
    scale: np.ndarray


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 good, 1 poor, 2 toxic; a null flag counts as 0."""
    return F.when(F.coalesce(F.col(toxic), F.lit(0)) == 1, 2).when(F.coalesce(F.col(quality), F.lit(0)) == 1, 0).otherwise(1)


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word (A-Z lower-cased, punctuation at its ends cut) and the words per text."""
    words, counts = words_of(texts)
    codes, distinct = coded(words)
    bare = pc.ascii_trim(pc.ascii_lower(distinct), ".,;:!?\"'()[]*#$%&|<>")
    of = np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in bare.cast(pa.large_binary()).to_pylist()), np.int64, len(distinct))
    return of[codes] if len(codes) else np.zeros(0, np.int64), counts


def _shape(texts: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Shape features of each text."""
    n = np.maximum(counts, 1)
    count = lambda pattern: np.asarray(pc.count_substring_regex(texts, pattern)).astype(float)
    return np.stack([np.log1p(counts), np.minimum(count(r"[#*$%&|<>]") / n, 2), np.minimum(count(r"!") / n, 2), np.minimum(count(r"[A-Z]") / n, 4), np.minimum(count(r"\n") / n, 1)], 1)


def _features(texts: pa.Array, odds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of each text by each half's log-odds, and the number of words of each text."""
    at, counts = _buckets(texts)
    n = np.sqrt(np.maximum(counts, 1))
    shape = _shape(texts, counts)
    out = []
    for half in odds:
        sums = [segment_sums(row[at], counts) / n for row in half]
        telling = [np.log1p(np.maximum(segment_sums(np.where(row[at] > 1, row[at], 0), counts), 0)) for row in half]
        out.append(np.concatenate([np.stack(sums + telling, 1), shape], 1))
    return out, counts


def _posteriors(features: list[np.ndarray], model: Classifier) -> np.ndarray:
    """The mean of the posteriors that each half's log-odds give."""
    total = 0.0
    for x in features:
        z = np.concatenate([(x - model.mean) / model.scale, np.ones((len(x), 1))], 1) @ model.layer
        z = np.exp(z - z.max(1, keepdims=True))
        total = total + z / z.sum(1, keepdims=True)
    return total / len(features)


def fit_classifier(docs: DataFrame, labels: DataFrame, params: MixParams = MixParams()) -> Classifier:
    """Fit on at most ``sample_rows`` labelled documents; the layer sees each half of them with the other half's log-odds.

    A word's odds compare its count in a domain with what its count in all of them lets expect,
    so unknown words say nothing. Without any labelled document the posterior is even. Labels of
    ids without a document are ignored; an id labelled twice counts by its first row in order of the flags.
    """
    picked = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(domain_of()).alias("domain"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_rows)  # the documented bound
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    train = docs.select("doc_id", F.col("text").alias("__text")).join(F.broadcast(picked), "doc_id").withColumn("half", half)
    train = stored(train, "labelled")
    count_schema = T.StructType([T.StructField("half", T.IntegerType()), T.StructField("domain", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    k = len(DOMAINS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "__text"):
                at, counts = _buckets(texts_of(part))
                own = np.asarray(part.column("half")).astype(np.int64) * k + np.asarray(part.column("domain")).astype(np.int64)
                found, n = np.unique(np.repeat(own, counts) * BUCKETS + at, return_counts=True)
                own = found // BUCKETS
                yield pa.RecordBatch.from_arrays([pa.array(own // k, pa.int32()), pa.array(own % k, pa.int32()), pa.array(found % BUCKETS, pa.int64()), pa.array(n, pa.int64())], names=count_schema.names)

    totals = np.zeros((2, k, BUCKETS))
    # at most halves x domains x BUCKETS rows
    counted = train.mapInArrow(count, count_schema).groupBy("half", "domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
    totals[tuple(np.asarray(counted[c]).astype(np.int64) for c in ("half", "domain", "bucket"))] = np.asarray(counted["n"]).astype(float)
    share = totals.sum(2, keepdims=True) / np.maximum(totals.sum((1, 2), keepdims=True), 1)
    odds = np.log((totals + 1) / (share * totals.sum(1, keepdims=True) + 1))
    feature_schema = T.StructType([T.StructField("domain", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "__text"):
                (first, second), _ = _features(texts_of(part), odds)
                x = np.where(np.asarray(part.column("half"))[:, None] == 0, second, first)
                yield pa.RecordBatch.from_arrays([part.column("domain").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=feature_schema.names)

    rows = train.mapInArrow(features, feature_schema).collect()  # sample_rows at most
    rows = sorted(rows, key=lambda r: (r["domain"], r["x"]))
    n_x = 2 * len(DOMAINS) + 5
    x = np.array([r["x"] for r in rows], float).reshape(-1, n_x)
    y = np.eye(len(DOMAINS))[[r["domain"] for r in rows]].reshape(-1, len(DOMAINS))
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(n_x), np.ones(n_x))
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    layer = np.zeros((n_x + 1, len(DOMAINS)))
    if len(x):
        ridge, step = 1e-3, 1.0 / (0.5 * np.linalg.eigvalsh(z.T @ z / len(z))[-1] + 1e-3)
        ahead, t = layer.copy(), 1.0
        for _ in range(1500):  # accelerated gradient steps of the softmax loss
            s = z @ ahead
            s = np.exp(s - s.max(1, keepdims=True))
            s /= s.sum(1, keepdims=True)
            new = ahead - step * (z.T @ (s - y) / len(z) + ridge * ahead)
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            ahead, layer = new + (before - 1) / t * (new - layer), new
    return Classifier(odds, layer, mean, scale)


FIELDS = [T.StructField("n_tokens", T.LongType()), *[T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS]]


def soft_membership(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (words) and the posterior of every domain; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: halves x domains x BUCKETS

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        x, counts = _features(texts_of(batch), shared.value.odds)
        p = _posteriors(x, shared.value)
        return [pa.array(counts, pa.int64()), *[pa.array(p[:, d], pa.float64()) for d in range(p.shape[1])]]

    return attach(docs, text_col, columns, FIELDS)


def rate_column(moves: list[list[float]], params: MixParams) -> Column:
    """The rate after the given steps: each takes p . move off and projects onto [0, max_rate]."""
    if not moves:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(m) for m in move]) for move in moves])
    p = [F.col(f"p_{d}") for d in DOMAINS]
    shift = lambda m: sum((c * m[k] for k, c in enumerate(p)), F.lit(0.0))
    return F.aggregate(steps, F.lit(1.0), lambda r, m: F.least(F.lit(params.max_rate), F.greatest(F.lit(0.0), r - shift(m))))


def _summary(members: DataFrame, params: MixParams) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and mean posteriors by cell of the posteriors: at most cells + 1 choose 2 rows, whatever the input."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = F.col("n_tokens").cast("double")
    cell = [F.floor(c * (params.cells - 1) + 0.5).alias(f"cell{i}") for i, c in enumerate(p[1:])]
    rows = members.groupBy(*cell).agg(F.sum(n).alias("n"), *[F.sum(n * c).alias(f"t{i}") for i, c in enumerate(p)]).filter("n > 0").orderBy("cell0", "cell1").toArrow()
    tokens = np.asarray(rows["n"]).astype(float)
    return tokens, np.stack([np.asarray(rows[f"t{i}"]).astype(float) for i in range(len(p))], 1) / tokens[:, None]


def _on_summary(tokens: np.ndarray, posterior: np.ndarray, target: np.ndarray, params: MixParams, rounds: int = 100) -> tuple[np.ndarray, float]:
    """One move from rate 1 that meets the target on the summary, and the relative error left.

    The rates nearest to 1 that meet the target have this form; the move minimises the dual of
    that problem, a convex function of as many numbers as there are domains, by damped Newton steps.
    """
    top = params.max_rate
    moment = (posterior * tokens[:, None]).T @ posterior
    ridge = 1e-3 * moment + 1e-12 * np.trace(moment) * np.eye(len(moment))

    def dual(move: np.ndarray) -> float:
        x = 1 - posterior @ move
        return float(tokens @ np.where(x <= 0, 0.0, np.where(x <= top, x * x / 2, top * x - top * top / 2)) + move @ target)

    move = np.zeros(len(target))
    best, value = (move, np.inf), dual(move)
    for _ in range(rounds):
        x = 1 - posterior @ move
        residual = (np.clip(x, 0, top) * tokens) @ posterior - target
        error = float(np.abs(residual).sum() / target.sum())
        if error < best[1]:
            best = move, error
        if error < params.tol / 10:
            break
        inside = (x > 0) & (x < top)
        step = np.linalg.solve((posterior[inside] * tokens[inside, None]).T @ posterior[inside] + ridge, residual)
        size, reached = 1.0, dual(move + step)
        while reached > value - 1e-4 * size * (residual @ step) and size > 1e-6:
            size /= 2
            reached = dual(move + size * step)
        while 1 <= size < 1e6 and (further := dual(move + 2 * size * step)) < reached:
            size, reached = 2 * size, further
        move, value = move + size * step, reached
    return best


def fit_rates(members: DataFrame, params: MixParams = MixParams()) -> list[list[float]]:
    """Projected-gradient steps from rate 1 for everyone, each as a vector over the domains.

    Loss: the squared residual of the domain totals, in the metric of the second moments of the
    documents whose rates can move. Targets: the weights times the budget. Where no budget lets
    soft membership meet the weights, the steps end as close as least squares brings them.
    Without tokens there are no steps.
    """
    named = [i for i, d in enumerate(DOMAINS) if d in params.weights]
    n, p = F.col("n_tokens").cast("double"), [F.col(f"p_{DOMAINS[i]}") for i in named]
    k = len(named)
    weights = np.array([params.weights[DOMAINS[i]] for i in named], float)
    weights /= weights.sum()
    tokens, posterior = _summary(members, params)
    posterior = posterior[:, named]
    if not len(tokens):
        return []

    def over_all(move: np.ndarray) -> list[float]:
        return [float(move[named.index(i)]) if i in named else 0.0 for i in range(len(DOMAINS))]

    totals = tokens @ posterior
    budget = params.budget
    if budget is None:
        most = params.max_rate * float(np.min(totals[weights > 0] / weights[weights > 0]))
        low, high = 0.0, most
        for _ in range(12):
            mid = (low + high) / 2
            low, high = (mid, high) if _on_summary(tokens, posterior, mid * weights, params)[1] < params.tol else (low, mid)
        budget = params.margin * low or most
    target = budget * weights
    moves = [over_all(_on_summary(tokens, posterior, target, params)[0])]
    for _ in range(params.steps):
        rate = rate_column(moves, params)
        inside = F.when((rate > 0) & (rate < params.max_rate), n).otherwise(0.0)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = members.agg(*[F.sum(rate * n * c).alias(f"t{i}") for i, c in enumerate(p)], *[F.sum((inside + 0.02 * n) * p[i] * p[j]).alias(f"m{i}{j}") for i, j in pairs]).first()
        residual = np.array([got[f"t{i}"] for i in range(k)]) - target
        if np.abs(residual).sum() <= params.tol * target.sum():
            break
        moment = np.array([[got[f"m{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)])
        moves.append(over_all(np.linalg.solve(moment + 1e-9 * np.trace(moment) * np.eye(k), residual)))
    return moves


def copies_column(rate: Column, *key: str) -> Column:
    """Whole copies, right on average: the fraction of the rate is decided by the key's hash."""
    drawn = F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < (rate - F.floor(rate)) * F.lit(1 << 20)
    return (F.floor(rate) + drawn.cast("int")).cast("int")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, posterior, rate and copies."""
    params = MixParams()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_classifier(docs, table(spark, sf_dir, "labels"), params)
    members = stored(soft_membership(docs, model).drop("text"), "members")
    rate = rate_column(fit_rates(members, params), params)
    return members.withColumn("rate", rate).withColumn("copies", copies_column(F.col("rate"), "doc_id"))


def mix_documents(docs: DataFrame, labels: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Documents repeated or left out as their rates say (repeated rows of one id), in the input's columns.

    Null and empty texts have no tokens, and the posterior of an empty text; null ids are one key of
    the draw, and so are rows of one id: they stay or go alike. Columns of any name pass through.
    """
    model = fit_classifier(docs, labels, params)
    plain = numbered(docs)
    text, key = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    # one pass of the classifier, its posteriors beside the rows
    members = stored(soft_membership(plain, model, text), "members")
    copies = copies_column(rate_column(fit_rates(members, params), params), key)
    mixed = members.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*[F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns, strict=True)])
