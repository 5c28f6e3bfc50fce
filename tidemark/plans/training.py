"""Training: pruning, folds, fitting, walk-forward validation, retraining, and live queries run to their end."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import EVENTS, EngineConfig
from tidemark.operators import evaluate as E
from tidemark.operators.boosting import Booster, BoostParams, fit_softmax
from tidemark.operators.correlation import prune_correlated
from tidemark.operators.ingest import fill_zero
from tidemark.operators.labels import barrier_labels, class_of, class_weights
from tidemark.plans import features as P
from tidemark.session import scratch
from tidemark.sources.csv_bars import exists


def fold_table(df: DataFrame, config: EngineConfig) -> DataFrame:
    """``(fold_start, fold_end)`` of all walk-forward folds: starts advance by whole folds from ``fold_years`` after the first row."""
    one = df.agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    first = F.expr(f"cast(a + interval {config.fold_years} years as timestamp_ntz)")
    n = F.greatest(F.ceil(F.months_between(F.col("z").cast("timestamp"), first.cast("timestamp")) / config.fold_months), F.lit(0)).cast("int") + 1
    starts = one.select("z", first.alias("s"), F.explode(F.sequence(F.lit(0), n)).alias("k")).filter("s is not null")
    at = lambda k: F.expr(f"cast(s + make_interval(0, cast(({k}) * {config.fold_months} as int)) as timestamp_ntz)")
    return starts.select(at("k").alias("fold_start"), at("k + 1").alias("fold_end"), "z").filter("fold_start < z").drop("z")


def fold_bounds(df: DataFrame, config: EngineConfig, step: str = "15 minutes") -> DataFrame:
    """``(fold, val_start, val_end, train_rows, val_rows)`` of the folds with enough rows.

    Training ends one ``step`` before validation starts; a boundary row belongs to both neighbours'
    validation. A row is counted in the fold that its date falls into (months since the first
    start), and once more where it ends the fold before or lies less than a step before its end;
    training rows are the sums of all folds before. So rows are counted by one equi-join.
    """
    folds = fold_table(df, config)
    first = folds.agg(F.min("fold_start").alias("s")).first()["s"]
    empty = df.sparkSession.createDataFrame([], "fold int, val_start timestamp_ntz, val_end timestamp_ntz, train_rows long, val_rows long")
    if first is None:
        return empty
    start = F.lit(first).cast("timestamp_ntz")
    months = (F.year("ts") - F.year(start)) * 12 + F.month("ts") - F.month(start)
    guess = F.floor(months / config.fold_months)
    times = df.groupBy("ts").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.array(guess - 1, guess, guess + 1)))
    numbered = folds.withColumn("k", F.row_number().over(Window.orderBy("fold_start")) - 1)  # as many as the history has quarters
    # rows before the first fold train all of them
    met = times.join(F.broadcast(numbered), "k").filter((F.col("ts") >= F.col("fold_start")) & (F.col("ts") <= F.col("fold_end")))
    late = F.col("ts") > F.expr(f"fold_end - interval {step}")
    rows = met.groupBy("k", "fold_start", "fold_end").agg(F.sum("n").alias("val_rows"), F.sum(F.when(F.col("ts") < F.col("fold_end"), F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(late & (F.col("ts") < F.col("fold_end")), F.col("n")).otherwise(0)).alias("late"))
    before = df.agg(F.count_if(F.col("ts") < start).alias("early"), F.count_if((F.col("ts") < start) & (F.col("ts") > start - F.expr(f"interval {step}"))).alias("near"))
    whole = numbered.join(rows, ["k", "fold_start", "fold_end"], "left").na.fill(0, ["val_rows", "own", "late"])
    past = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    trained = F.coalesce(F.sum("own").over(past), F.lit(0)) + F.col("early") - F.coalesce(F.lag("late").over(Window.orderBy("k")), F.col("near"))
    counted = whole.crossJoin(F.broadcast(before)).withColumn("train_rows", trained)  # one row
    good = counted.filter((F.col("train_rows") >= config.fold_least_train) & (F.col("val_rows") >= config.fold_least_val))
    fold = F.row_number().over(Window.orderBy("fold_start")) - 1
    return good.select(fold.alias("fold"), F.col("fold_start").alias("val_start"), F.col("fold_end").alias("val_end"), "train_rows", "val_rows")


@dataclass
class Model:
    """A fitted pipeline and the columns it was fitted on; saved and loaded together."""

    pipeline: PipelineModel
    columns: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``probs``, ``pred`` and ``conf``; missing columns and values count as 0."""
        for c in self.columns:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(0.0))
        out = self.pipeline.transform(df.na.fill(0, self.columns)).withColumn("probs", vector_to_array("__p"))
        pred, conf = E.prediction("probs")
        return out.withColumn("pred", pred).withColumn("conf", conf).drop("__x", "__p", "__r", "__c")

    def importance(self) -> DataFrame:
        """``(feature, gain)`` in falling order."""
        gains = self.pipeline.stages[-1].featureImportances.toArray()
        rows = [(c, float(v)) for c, v in zip(self.columns, gains, strict=True)]
        return SparkSession.getActiveSession().createDataFrame(rows, "feature string, gain double").orderBy(F.col("gain").desc(), "feature")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(i, c) for i, c in enumerate(self.columns)], "i int, feature string").coalesce(1).write.mode("overwrite").json(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        columns = [r["feature"] for r in spark.read.json(f"{path}/columns").orderBy("i").collect()]
        return cls(PipelineModel.load(f"{path}/pipeline"), columns)


def fit(labelled: DataFrame, columns: list[str], trees: int = 20, depth: int = 6, seed: int = 42) -> Model:
    """A forest over the classes, weighted against their frequency."""
    weights = class_weights(labelled).select("cls", "weight")
    rows = fill_zero(labelled).join(F.broadcast(weights), "cls")  # one row per class
    forest = RandomForestClassifier(featuresCol="__x", labelCol="cls", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c")
    return Model(Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="keep"), forest]).fit(rows), columns)


#: What retraining and validation take: both kinds predict, save and rank features alike.
AnyModel = Model | Booster


def load_model(spark: SparkSession, path: str) -> AnyModel:
    """A saved model of either kind."""
    return Booster.load(spark, path) if exists(spark, f"{path}/booster") else Model.load(spark, path)


def fit_boosted(train: DataFrame, valid: DataFrame, columns: list[str], params: BoostParams = BoostParams()) -> Booster:
    """One softmax model over all classes, weighted against their frequency; it stops where its loss on ``valid`` gets no better, and keeps the trees up to there."""
    weights = class_weights(train).select("cls", "weight")
    kept = lambda df, flag: fill_zero(df).select(*columns, "cls", F.lit(flag).alias("valid"))
    both = kept(train, False).unionByName(kept(valid, True)).join(F.broadcast(weights), "cls", "left").na.fill(1.0, ["weight"])  # one row per class
    rows = both.cache()
    made = fit_softmax(rows, columns, params)
    rows.unpersist()
    return made


def fold_metrics(model: AnyModel, val: DataFrame) -> tuple[float, float, float]:
    """Accuracy, weighted F1 and log loss."""
    scored = model.predict(val).cache()
    report = {r["name"]: r for r in E.class_report(scored, "cls", "pred", [0, 1, 2]).collect()}
    p = F.greatest(F.element_at("probs", F.col("cls") + 1), F.lit(1e-15))
    loss = scored.agg(F.avg(-F.log(p))).first()[0]
    scored.unpersist()
    return round(report["accuracy"]["f1"], 4), round(report["weighted avg"]["f1"], 4), round(loss, 6)


def walk_forward_validation(labelled: DataFrame, columns: list[str], config: EngineConfig, step: str = "15 minutes", threads: int = 2, params: BoostParams = BoostParams()) -> DataFrame:
    """Metrics of every fold and the round that its validation rows chose; folds are independent and are fitted side by side."""
    spark = labelled.sparkSession

    def one(f) -> tuple:
        train = labelled.filter(F.col("ts") <= F.lit(f["val_start"]).cast("timestamp_ntz") - F.expr(f"interval {step}"))
        val = labelled.filter((F.col("ts") >= F.lit(f["val_start"]).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(f["val_end"]).cast("timestamp_ntz")))
        model = fit_boosted(train, val, columns, params)
        return (f["fold"], f["val_start"], f["val_end"], f["train_rows"], f["val_rows"], *fold_metrics(model, val), model.best_iteration)

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(one, fold_bounds(labelled, config, step).collect()))
    return spark.createDataFrame(rows, "fold int, val_start timestamp_ntz, val_end timestamp_ntz, train_rows long, val_rows long, accuracy double, f1 double, log_loss double, best_iteration int")


def champion(old: AnyModel, new: AnyModel, labelled: DataFrame, config: EngineConfig) -> tuple[AnyModel, float, float]:
    """The model of the higher profit factor over the last calendar month, the new one on ties, and both factors."""
    last = labelled.filter(F.col("ts") >= F.expr(f"(timestamp_ntz '{labelled.agg(F.max('ts')).first()[0]}') - interval 1 month"))

    def factor(model: AnyModel) -> float:
        row = E.simulate(E.trades(model.predict(last).withColumn("all", F.lit(1)), config), config, "all").first()
        return row["profit_factor"] if row else 0.0

    a, b = factor(old), factor(new)
    return (new if b >= a else old), a, b


def save_version(model: AnyModel, root: str, name: str) -> None:
    """Save a model as a version of its own; earlier versions stay as backups."""
    model.save(f"{root}/versions/{name}")


def appoint(spark: SparkSession, root: str, name: str, at: str) -> None:
    """Make a saved version the current one from time ``at`` on; appointments are added, never changed."""
    spark.createDataFrame([(at, name)], "at string, name string").coalesce(1).write.mode("append").json(f"{root}/appointed")


def current_version(spark: SparkSession, root: str) -> str | None:
    """The name of the version that was appointed last."""
    if not exists(spark, f"{root}/appointed"):
        return None
    return spark.read.schema("at string, name string").json(f"{root}/appointed").agg(F.max_by("name", F.struct("at", "name"))).first()[0]


def retrain(labelled: DataFrame, columns: list[str], root: str, config: EngineConfig, now: datetime, train: Callable[[DataFrame, list[str]], AnyModel] = fit) -> tuple[str, float | None, float | None]:
    """Train on all but the last month, save the version, appoint it if it does as well as the current one over that month.

    Returns the current version's name afterwards and both profit factors (None without a current model).
    """
    spark = labelled.sparkSession
    name = now.strftime("%Y%m%d-%H%M%S")
    last = labelled.agg(F.max("ts")).first()[0]
    new = train(labelled.filter(F.col("ts") < F.expr(f"(timestamp_ntz '{last}') - interval 1 month")), columns)
    save_version(new, root, name)
    old_name, a, b = current_version(spark, root), None, None
    better = True
    if old_name:
        chosen, a, b = champion(load_model(spark, f"{root}/versions/{old_name}"), new, labelled, config)
        better = chosen is new
    if better:
        appoint(spark, root, name, now.isoformat())
    return (name if better else old_name), a, b


def backtest(model: AnyModel, features: DataFrame, config: EngineConfig, start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
    """Labels, scores and reports of the bars from day ``start`` to day ``end`` (the test split by default): small frames by name."""
    from tidemark.operators.ingest import between_days

    labelled = barrier_labels(features, config).withColumn("cls", class_of())
    scored = model.predict(between_days(labelled, start or config.test[0], end or config.test[1]))
    acted = E.trades(scored, config)
    return {
        "confusion": E.confusion(scored, "cls", "pred", [0, 1, 2]), "report": E.class_report(scored, "cls", "pred", [0, 1, 2]), "simulation": E.rounded(E.simulate(acted, config, "symbol")), "tiers": E.rounded(E.tiers(acted, config)),
    }


def report_text(metrics: DataFrame, tiers: DataFrame, title: str = "Backtest") -> str:
    """A plain-text report of small frames."""
    lines = [title, "=" * len(title)]
    for name, frame in (("Trading simulation", metrics), ("Tiers", tiers)):
        lines += ["", name, "-" * len(name)]
        lines += ["  ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in frame.collect()]
    return "\n".join(lines)


def event_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled test bars with light features, ready to train on."""
    from tidemark.operators.layer1 import layer1
    from tidemark.operators.market import layer2

    bars = layer2(layer1(P.event_bars(spark, sf_dir), P.event_bars(spark, sf_dir, EVENTS.child_width), EVENTS), EVENTS)
    return barrier_labels(bars, EVENTS).withColumn("cls", class_of())


def train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit a forest on the first twenty days, score the rest: one row per bar."""
    rows = event_training(spark, sf_dir).cache()
    columns = prune_correlated(fill_zero(rows), P.L1 + P.L2, EVENTS.correlation)
    model = fit(rows.filter("day(ts) <= 20"), columns)
    rows.unpersist()
    return model.predict(rows.filter("day(ts) > 20")).select("symbol", "ts", "cls", F.col("pred").cast("long").alias("pred"), F.round("conf", 6).alias("conf"))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward over daily bars of order prices, with yearly folds."""
    from dataclasses import replace

    from tidemark.operators.bars import ticks_to_bars

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("symbol", F.lit("all"))
    bars = ticks_to_bars(orders, "1 day", "symbol", "o_orderdate", "o_totalprice", "o_orderkey")
    config = replace(EVENTS, fold_months=24, pip=1000.0, horizon=5)
    bars = bars.withColumns({"l1_volatility_energy": F.col("high") - F.col("low"), "l1_price_velocity": F.col("close") - F.col("open"), "l1_custom_volume": F.col("volume")})
    labelled = barrier_labels(bars, config).withColumn("cls", class_of()).cache()
    out = walk_forward_validation(labelled, ["l1_volatility_energy", "l1_price_velocity", "l1_custom_volume"], config, "1 day", params=BoostParams(rounds=12, depth=3, step=0.2, patience=4, bins=32))
    labelled.unpersist()
    return out


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming bar query over all test ticks: the bars that the watermark closes, an hour behind the last tick."""
    from tidemark.streaming.bars import closed_bars, run_to_end

    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    return run_to_end(closed_bars(ticks, "1 hour", "1 hour"), "append", scratch(spark, "stream-bars")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _as_stream(rows: DataFrame, name: str) -> DataFrame:
    """Rows written by day and read as a stream of one file after the other, in time order."""
    spark, path = rows.sparkSession, f"{scratch(rows.sparkSession, name)}/rows"
    rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful signal query over hourly test bars, run to the end of its input."""
    from tidemark.streaming.bars import run_to_end
    from tidemark.streaming.signals import live_signals, rocksdb

    with rocksdb(spark):
        made = run_to_end(live_signals(_as_stream(P.event_bars(spark, sf_dir), "stream-source"), EVENTS), "append", scratch(spark, "stream-signals"))
    return made.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_choice(scored: DataFrame, config: EngineConfig) -> DataFrame:
    """The bars of a scored history that become signals, chosen by the stateful query over a stream of them."""
    from tidemark.streaming.bars import run_to_end
    from tidemark.streaming.signals import live_scan, rocksdb

    spark = scored.sparkSession
    with rocksdb(spark):
        made = run_to_end(live_scan(_as_stream(scored, "scored-source"), config), "append", scratch(spark, "stream-choice"))
    return made.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
