"""Scoring of predictions: confusion, reports, trading simulation, tiers, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import EngineConfig
from tidemark.operators.scan import chunk_of


def prediction(probabilities: str | Column = "probs") -> tuple[Column, Column]:
    """Class of the largest probability (the first on ties) and confidence in percent."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    top = F.array_max(p)
    return (F.array_position(p, top) - 1).cast("int"), top * 100


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(rows: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """``(truth, pred_0, ...)``: counts for every class in order, empty cells 0."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(c,) for c in classes], "truth int")
    counts = rows.groupBy(F.col(truth).cast("int").alias("truth")).agg(*[F.count_if(F.col(predicted) == c).alias(f"pred_{c}") for c in classes])
    return grid.join(counts, "truth", "left").na.fill(0)


def class_report(rows: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """``(name, precision, recall, f1, support)`` per class, then accuracy, macro and weighted averages; 0 for empty divisions."""
    spark = rows.sparkSession
    t, p = F.col(truth), F.col(predicted)
    one = rows.agg(F.count("*").alias("n"), F.count_if(t == p).alias("ok"), *[x for c in classes for x in (F.count_if((t == c) & (p == c)).alias(f"tp{c}"), F.count_if(p == c).alias(f"np{c}"), F.count_if(t == c).alias(f"nt{c}"))])
    stats = []
    for c in classes:
        precision, recall = _ratio(F.col(f"tp{c}"), F.col(f"np{c}")), _ratio(F.col(f"tp{c}"), F.col(f"nt{c}"))
        stats.append((precision, recall, _ratio(2 * precision * recall, precision + recall), F.col(f"nt{c}")))
    rec = lambda name, pr, re, f1, n: F.struct(F.lit(name).alias("name"), pr.alias("precision"), re.alias("recall"), f1.alias("f1"), n.cast("long").alias("support"))
    accuracy = _ratio(F.col("ok"), F.col("n"))
    out = [rec(str(c), *s) for c, s in zip(classes, stats, strict=True)] + [rec("accuracy", accuracy, accuracy, accuracy, F.col("n"))]
    out.append(rec("macro avg", *[sum((s[k] for s in stats), F.lit(0.0)) / len(classes) for k in range(3)], F.col("n")))
    out.append(rec("weighted avg", *[_ratio(sum((s[k] * s[3] for s in stats), F.lit(0.0)), F.col("n")) for k in range(3)], F.col("n")))
    return one.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def trades(scored: DataFrame, config: EngineConfig) -> DataFrame:
    """Rows acted on (a direction with enough confidence) with ``pnl`` in pips: a neutral outcome costs 1."""
    acted = scored.filter((F.col("pred") != 0) & (F.col("conf") >= config.confidence) & F.col("label").isNotNull())
    way = F.when(F.col("pred") == 1, 1).otherwise(-1)
    return acted.withColumn("pnl", F.when(F.col("label") == 0, -1.0).when(F.col("label") == way, config.tp_pips).otherwise(-config.sl_pips))


def simulate(acted: DataFrame, config: EngineConfig, *keys: str) -> DataFrame:
    """Trade metrics per key; the drawdown follows the running sum in time order, whose first value is the first peak.

    Each chunk of time gives one record: its sum, the highest and lowest running sum and the worst
    fall. Records of later chunks are put behind earlier ones: a fall goes from the highest sum
    before a chunk to the lowest one inside, or lies inside.
    """
    chunk = [*keys, "__chunk"]
    order = Window.partitionBy(*chunk).orderBy("ts", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    curve = acted.withColumn("__chunk", chunk_of("ts", config.parent_width, config.chunk_bars)).withColumn("eq", F.sum("pnl").over(order))
    curve = curve.withColumn("dd", F.max("eq").over(order) - F.col("eq"))
    won, lost = F.when(F.col("pnl") > 0, F.col("pnl")), F.when((F.col("pnl") < 0) & (F.col("label") != 0), -F.col("pnl"))
    records = curve.groupBy(*chunk).agg(
        F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.coalesce(F.sum(won), F.lit(0.0)).alias("won"), F.coalesce(F.sum(lost), F.lit(0.0)).alias("lost"), F.sum("pnl").alias("total"),
        F.sum(F.col("pnl") * F.col("pnl")).alias("squares"), F.min("pnl").alias("least"), F.max("pnl").alias("most"), F.max("eq").alias("top"), F.min("eq").alias("bottom"), F.max("dd").alias("fall"),
    )
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    records = records.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    records = records.withColumn("peak", F.max(F.col("base") + F.col("top")).over(earlier))
    records = records.withColumn("fall", F.greatest(F.col("fall"), F.col("peak") - F.col("base") - F.col("bottom")))
    one = records.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "wins", "won", "lost", "total", "squares")], F.min("least").alias("least"), F.max("most").alias("most"), F.max("fall").alias("fall"))
    mean = F.col("total") / F.col("n")
    std = F.when(F.col("most") > F.col("least"), F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))).otherwise(0.0)
    return one.select(
        *keys, F.col("n").alias("total_trades"), (F.col("wins") / F.col("n")).alias("win_rate"), F.col("won").alias("total_pips_won"), F.col("lost").alias("total_pips_lost"),
        (F.col("won") / F.greatest(F.col("lost"), F.lit(1e-10))).alias("profit_factor"), F.col("fall").alias("max_drawdown"), F.when(std > 0, mean / std * math.sqrt(config.bars_per_year)).otherwise(0.0).alias("sharpe_ratio"),
    )


METRICS = ["total_trades", "win_rate", "total_pips_won", "total_pips_lost", "profit_factor", "max_drawdown", "sharpe_ratio"]


def rounded(metrics: DataFrame) -> DataFrame:
    """Half-even rounding to the report's digits."""
    digits = {"win_rate": 4, "total_pips_won": 2, "total_pips_lost": 2, "profit_factor": 4, "max_drawdown": 2, "sharpe_ratio": 4}
    return metrics.withColumns({c: F.bround(c, d) for c, d in digits.items() if c in metrics.columns})


def tiers(acted: DataFrame, config: EngineConfig) -> DataFrame:
    """Metrics per confidence tier; a tier without trades has zeros."""
    spark: SparkSession = acted.sparkSession
    tier = F.lit(None).cast("int")
    for number, low, high in config.tiers:
        tier = F.when((F.col("conf") >= low) & (F.col("conf") < high), number).otherwise(tier)
    found = simulate(acted.withColumn("tier", tier).filter("tier is not null"), config, "tier")
    names = spark.createDataFrame([(n,) for n, _, _ in config.tiers], "tier int")
    return names.join(found, "tier", "left").na.fill(0)


def performance(signals: DataFrame) -> DataFrame:
    """Totals of a signal log ``(symbol, ts, result, pips)``: wins, losses, open ones, wins in percent of all, pips, profit factor (infinite without losses)."""
    won, lost = F.coalesce(F.sum(F.when(F.col("pips") > 0, F.col("pips"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("pips") < 0, -F.col("pips"))), F.lit(0.0))
    wins, losses = F.count_if(F.col("result") == "win"), F.count_if(F.col("result") == "loss")
    return signals.groupBy("symbol").agg(
        F.count("*").alias("total"), wins.alias("wins"), losses.alias("losses"), (F.count("*") - wins - losses).alias("open"), (100 * _ratio(wins, F.count("*"))).alias("win_rate"),
        F.coalesce(F.sum("pips"), F.lit(0.0)).alias("pips"), F.when(lost > 0, won / lost).otherwise(float("inf")).alias("profit_factor"),
    )


def equity_curve(signals: DataFrame) -> DataFrame:
    """Running sum of pips per symbol."""
    order = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return signals.select("symbol", "ts", F.sum(F.coalesce("pips", F.lit(0.0))).over(order).alias("equity"))
