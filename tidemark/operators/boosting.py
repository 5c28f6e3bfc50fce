"""Gradient-boosted trees with one softmax objective over all classes.

Features become bin numbers once, by edges from a quantile sketch, in blocks of rows that are
written to the shared folder. Every level of a round's trees (one for each class) is one pass over
the blocks: tasks add up histograms of gradients and hessians by node and bin, these are summed
feature by feature, and what comes back is the best split of each node and feature. So the driver
sees splits and never rows, and a task holds one block and one set of histograms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.evaluate import prediction
from tidemark.session import drop_path, scratch


@dataclass(frozen=True)
class BoostParams:
    """classes: of the label, from 0. step: of each tree. subsample, columns: shares of rows and of features for a
    round. least_weight: hessian that a child needs. gamma: gain that a split needs. alpha, lam: of the
    leaves' absolute and squared weights. patience: rounds without a better loss on the validation rows.
    refresh: rounds after which margins are written anew. fan_in: partial histograms summed at a time."""

    classes: int = 3
    rounds: int = 1500
    depth: int = 6
    step: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8
    least_weight: float = 5.0
    gamma: float = 1.0
    alpha: float = 0.1
    lam: float = 1.0
    patience: int = 50
    bins: int = 64
    block_rows: int = 8192
    refresh: int = 10
    fan_in: int = 64
    seed: int = 42


@dataclass
class Tree:
    """A binary tree in heap order: feature (-1 where there is no split), last bin of the left child, weight of a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.bin[at]), at)
        return at


BLOCK = "block long, n int, bins binary, cls binary, weight binary, valid binary, margin binary"


def quantile_edges(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Edges between the bins of each column; a value on an edge is in the bin below it."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).approxQuantile([f"c{k}" for k in range(len(columns))], shares, 1 / (4 * bins))
    return [np.unique(np.array(e, float)) for e in found]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of a matrix of values."""
    return np.stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.zeros((len(values), 0), np.uint8)


def to_blocks(rows: DataFrame, columns: list[str], edges: list[np.ndarray], p: BoostParams) -> DataFrame:
    """Blocks of rows ``(columns, cls, weight, valid)``: bin numbers, classes, weights, and margins of 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, p.block_rows):
                b = batch.slice(at, p.block_rows)
                values = np.stack([np.asarray(b.column(k).fill_null(0.0)) for k in range(len(columns))], axis=1)
                cls, weight, valid = (np.asarray(b.column(len(columns) + k)) for k in range(3))
                row = [(part << 32) + made, b.num_rows, binned(np.nan_to_num(values), edges).tobytes(), cls.astype(np.uint8).tobytes(), weight.astype(float).tobytes(), valid.astype(np.uint8).tobytes(), np.zeros((b.num_rows, p.classes)).tobytes()]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["block", "n", "bins", "cls", "weight", "valid", "margin"])

    kept = [F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)]
    return rows.select(*kept, F.col("cls").cast("int"), F.col("weight").cast("double"), F.col("valid").cast("int")).mapInArrow(run, BLOCK)


@dataclass
class Block:
    number: int
    bins: np.ndarray
    cls: np.ndarray
    weight: np.ndarray
    valid: np.ndarray
    margin: np.ndarray

    @classmethod
    def of(cls, row: dict[str, Any], classes: int) -> Block:
        read = lambda c, kind: np.frombuffer(row[c], kind)
        return cls(row["block"], read("bins", np.uint8).reshape(row["n"], -1), read("cls", np.uint8), read("weight", float), read("valid", np.uint8).astype(bool), read("margin", float).reshape(row["n"], classes))


def margins(block: Block, trees: list[list[Tree]], depth: int) -> np.ndarray:
    """A block's margins after some more rounds."""
    out = block.margin.copy()
    for round_ in trees:
        for k, tree in enumerate(round_):
            out[:, k] += tree.value[tree.place(block.bins, depth)]
    return out


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def histograms(block: Block, p: np.ndarray, growing: list[Tree], level: int, used: np.ndarray, drawn: np.ndarray, n_bins: int) -> np.ndarray:
    """Sums of gradients and hessians: (feature, class, node of the level, bin, 2)."""
    first, nodes = 2**level - 1, 2**level
    out = np.zeros((len(used), len(growing), nodes, n_bins, 2))
    rows = np.nonzero(~block.valid & drawn)[0]
    bins, weight = block.bins[rows], block.weight[rows]
    for k, tree in enumerate(growing):
        at = tree.place(bins, level) - first
        here = at >= 0  # others ended in a leaf above
        q = p[rows, k][here]
        g, h = weight[here] * (q - (block.cls[rows][here] == k)), weight[here] * np.maximum(2 * q * (1 - q), 1e-16)
        base = at[here] * n_bins
        for j, f in enumerate(used):
            cell = base + bins[here, f]
            for c, x in enumerate((g, h)):
                out[j, k, :, :, c] = np.bincount(cell, weights=x, minlength=nodes * n_bins).reshape(nodes, n_bins)
    return out


def _score(g: np.ndarray, h: np.ndarray, p: BoostParams) -> np.ndarray:
    return np.maximum(np.abs(g) - p.alpha, 0) ** 2 / (h + p.lam)


def leaf(g: float, h: float, p: BoostParams) -> float:
    return float(-np.sign(g) * max(abs(g) - p.alpha, 0) / (h + p.lam) * p.step)


def best_splits(hist: np.ndarray, p: BoostParams) -> list[tuple[int, int, float, int, float, float, float, float]]:
    """Of one feature's histograms (class, node, bin, 2) the best cut of each class and node, with the sums on its left and of the node."""
    left = hist.cumsum(2)
    total = left[:, :, -1:, :]
    right = total - left
    gain = _score(left[..., 0], left[..., 1], p) + _score(right[..., 0], right[..., 1], p) - _score(total[..., 0], total[..., 1], p)
    gain = np.where((left[..., 1] >= p.least_weight) & (right[..., 1] >= p.least_weight), gain, -np.inf)
    best = gain.argmax(2)
    out = []
    for k in range(hist.shape[0]):
        for node in range(hist.shape[1]):
            b = int(best[k, node])
            out.append((k, node, float(gain[k, node, b]), b, *map(float, (*left[k, node, b], *total[k, node, 0]))))
    return out


SPLITS = "feature int, cls int, node int, gain double, bin int, gl double, hl double, g double, h double"
PARTIAL = "part int, feature int, sums binary"
#: Pseudo feature under which losses are summed.
LOSS = -1


def _level(blocks: DataFrame, since: list[list[Tree]], growing: list[Tree], level: int, used: np.ndarray, number: int, n_bins: int, many: bool, p: BoostParams) -> pd.DataFrame:
    """Best splits by class, node and feature of one level, and at the root also the losses (train and validation sums, then their weights)."""
    shape = (p.classes, 2**level, n_bins, 2)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, loss = np.zeros((len(used), *shape)), np.zeros(4)
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block.of(batch.slice(at, 1).to_pylist()[0], p.classes)
                prob = softmax(margins(block, since, p.depth))
                drawn = np.random.default_rng((p.seed, number, block.number)).random(len(block.cls)) < p.subsample
                held += histograms(block, prob, growing, level, used, drawn, n_bins)
                if not level:
                    own = -np.log(np.maximum(prob[np.arange(len(prob)), block.cls], 1e-15))
                    for c, (rows, w) in enumerate(((~block.valid, block.weight), (block.valid, np.ones(len(own))))):
                        loss[[c, c + 2]] += (own * w)[rows].sum(), w[rows].sum()
        part = TaskContext.get().partitionId() % p.fan_in
        sums = [*[(part, int(f), held[j].tobytes()) for j, f in enumerate(used)], *([(part, LOSS, loss.tobytes())] if not level else [])]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "feature", "sums"), s, strict=True)) for s in sums], schema=pa.schema([("part", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())]))

    def added(group: pa.Table) -> np.ndarray:
        total = np.frombuffer(group["sums"][0].as_py(), float).copy()
        for k in range(1, group.num_rows):
            total += np.frombuffer(group["sums"][k].as_py(), float)
        return total

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([0], pa.int32()), "feature": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([added(group).tobytes()], pa.binary())})

    def split(key: tuple, group: pa.Table) -> pa.Table:
        feature, total = key[0].as_py(), added(group)
        rows = [(0, 0, 0.0, 0, *total.tolist())] if feature == LOSS else best_splits(total.reshape(shape), p)
        names, kinds = ["cls", "node", "gain", "bin", "gl", "hl", "g", "h"], [pa.int32(), pa.int32(), pa.float64(), pa.int32(), *[pa.float64()] * 4]
        columns = {"feature": pa.array([feature] * len(rows), pa.int32())} | {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))}
        return pa.table(columns)

    sums = blocks.mapInArrow(partial, PARTIAL)
    if many:  # more tasks than fan_in: sum in two steps
        sums = sums.groupBy("part", "feature").applyInArrow(merge, PARTIAL)
    return sums.groupBy("feature").applyInArrow(split, SPLITS).toPandas()


@dataclass
class Booster:
    """A fitted model: edges by feature, trees by round and class, gains by feature."""

    columns: list[str]
    edges: list[np.ndarray]
    trees: list[list[Tree]]
    params: BoostParams
    best_iteration: int = 0
    gains: dict[str, float] = field(default_factory=dict)
    losses: list[tuple[float, float]] = field(default_factory=list)

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        block = Block(0, binned(values, self.edges), np.zeros(len(values), np.uint8), np.ones(len(values)), np.zeros(len(values), bool), np.zeros((len(values), self.params.classes)))
        return softmax(margins(block, self.trees, self.params.depth))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``probs``, ``pred`` and ``conf``; missing columns and values count as 0."""
        there = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in self.columns]

        @F.pandas_udf("array<double>")
        def scored(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(list(self.probabilities(rows.to_numpy(float))), dtype=object)

        out = df.withColumn("probs", scored(F.struct(*[x.alias(f"c{k}") for k, x in enumerate(there)])))
        pred, conf = prediction("probs")
        return out.withColumn("pred", pred).withColumn("conf", conf)

    def importance(self) -> DataFrame:
        """``(feature, gain)`` in falling order: gains of all splits, as shares."""
        total = sum(self.gains.values()) or 1.0
        rows = [(c, float(self.gains.get(c, 0.0) / total)) for c in self.columns]
        return SparkSession.getActiveSession().createDataFrame(rows, "feature string, gain double").orderBy(F.col("gain").desc(), "feature")

    def save(self, path: str) -> None:
        trees = [[{"feature": t.feature.tolist(), "bin": t.bin.tolist(), "value": t.value.tolist()} for t in r] for r in self.trees]
        said = {"columns": self.columns, "edges": [e.tolist() for e in self.edges], "trees": trees, "params": asdict(self.params), "best_iteration": self.best_iteration, "gains": self.gains, "losses": self.losses}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/booster")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Booster:
        said = json.loads(spark.read.text(f"{path}/booster").first()[0])
        tree = lambda t: Tree(np.array(t["feature"], np.int32), np.array(t["bin"], np.int32), np.array(t["value"], float))
        return cls(said["columns"], [np.array(e, float) for e in said["edges"]], [[tree(t) for t in r] for r in said["trees"]], BoostParams(**said["params"]), said["best_iteration"], said["gains"], [tuple(x) for x in said["losses"]])


def grow_level(growing: list[Tree], found: pd.DataFrame, level: int, p: BoostParams, gains: dict[int, float]) -> bool:
    """Split the nodes of a level where that gains enough; the others become leaves. Whether any was split."""
    first, any_split = 2**level - 1, False
    # of equal gains the first feature
    rows = found[found["feature"] != LOSS].sort_values(["cls", "node", "gain", "feature"], ascending=[True, True, False, True]).drop_duplicates(["cls", "node"])
    for r in rows.itertuples(index=False):
        tree, at = growing[r.cls], first + r.node
        if level and tree.feature[(at - 1) // 2] < 0:
            continue  # there is no such node
        if r.gain > p.gamma:
            tree.feature[at], tree.bin[at] = r.feature, r.bin
            tree.value[2 * at + 1], tree.value[2 * at + 2] = leaf(r.gl, r.hl, p), leaf(r.g - r.gl, r.h - r.hl, p)
            gains[r.feature] = gains.get(r.feature, 0.0) + r.gain
            any_split = True
        elif not level:
            tree.value[at] = leaf(r.g, r.h, p)
    return any_split


def fit_softmax(rows: DataFrame, columns: list[str], p: BoostParams) -> Booster:
    """Fit on rows ``(columns, cls, weight, valid)``; rows with ``valid`` only tell when to stop.

    Training ends where the validation rows' log loss has got no better for ``patience`` rounds, and
    the trees up to the best round stay; without such rows all rounds are used. Missing values
    count as 0.
    """
    spark = rows.sparkSession
    edges = quantile_edges(rows.filter(~F.col("valid")), columns, p.bins)
    n_bins = max((len(e) for e in edges), default=0) + 1
    path = scratch(spark, "boost")
    to_blocks(rows, columns, edges, p).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(BLOCK).parquet(path)
    many = (blocks.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) >= p.fan_in
    trees: list[list[Tree]] = []
    since: list[list[Tree]] = []
    gained: list[dict[int, float]] = []
    losses: list[tuple[float, float]] = []
    draw = np.random.default_rng(p.seed)
    best = 0

    def heard(found: pd.DataFrame) -> bool:
        """Take down the losses of the trees so far; whether it is time to stop."""
        nonlocal best
        one = found[found["feature"] == LOSS].iloc[0]
        losses.append((one.gl / one.g if one.g else float("nan"), one.hl / one.h if one.h else float("nan")))
        if not one.h or losses[-1][1] < losses[best][1]:
            best = len(losses) - 1
        return bool(one.h) and len(losses) - 1 - best >= p.patience

    for number in range(p.rounds + 1):
        used = np.sort(draw.choice(len(columns), max(1, round(p.columns * len(columns))), replace=False))
        growing, gains = [Tree.empty(p.depth) for _ in range(p.classes)], {}
        for level in range(p.depth):
            found = _level(blocks, since, growing, level, used, number, n_bins, many, p)
            if not level and (heard(found) or number == p.rounds):
                break
            if not grow_level(growing, found, level, p, gains):
                break
        if len(losses) - 1 - best >= p.patience or number == p.rounds:
            break
        trees.append(growing)
        since.append(growing)
        gained.append(gains)
        if len(since) >= p.refresh:
            blocks, path = _refreshed(blocks, path, since, p)
            since = []
    drop_path(spark, path)
    kept = trees[:best]
    total: dict[str, float] = {}
    for gains in gained[:best]:
        for f, g in gains.items():
            total[columns[f]] = total.get(columns[f], 0.0) + g
    return Booster(columns, edges, kept, p, best, total, losses)


def _refreshed(blocks: DataFrame, path: str, since: list[list[Tree]], p: BoostParams) -> tuple[DataFrame, str]:
    """The blocks with the margins of more rounds written into them; the old ones are deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                made = margins(Block.of(one.to_pylist()[0], p.classes), since, p.depth)
                yield one.set_column(one.schema.get_field_index("margin"), "margin", pa.array([made.tobytes()], pa.binary()))

    spark, new = blocks.sparkSession, scratch(blocks.sparkSession, "boost")
    blocks.mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(new)
    drop_path(spark, path)
    return spark.read.schema(BLOCK).parquet(new), new
