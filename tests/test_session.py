"""Intermediate tables lie in one folder, which the caller can drop."""

from pathlib import Path

from tidemark.session import clear_scratch, scratch, scratch_root


def files(root):
    path = Path(root.removeprefix("file:"))
    return [p for p in path.rglob("*") if p.is_file()] if path.exists() else []


def test_scratch_is_one_folder(spark, sf):
    from tidemark.plans import catalog

    kept = scratch(spark, "kept")
    spark.range(5).write.parquet(kept)
    assert kept.startswith(scratch_root(spark)) and files(scratch_root(spark))
    assert catalog.queries()["stage_round_trip"](spark, sf).count() > 0
    assert catalog.queries()["stream_scan"](spark, sf).count() > 0
    clear_scratch(spark)
    assert not files(scratch_root(spark))
    assert catalog.queries()["stage_round_trip"](spark, sf).count() > 0  # it is made again when needed
    clear_scratch(spark)


def test_booster_leaves_nothing_behind(spark):
    from test_boosting import COLUMNS, P, frame, made

    from tidemark.plans import training as T

    clear_scratch(spark)
    x, cls = made(200)
    T.fit_boosted(frame(spark, x[:150], cls[:150]), frame(spark, x[150:], cls[150:]), COLUMNS, P)
    assert not files(scratch_root(spark))
