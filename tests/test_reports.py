from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import models, reports, stats


def test_oof_rows(spark):
    rows = [("r", json.dumps({"ids": ["a", "b"], "per_target": {"t": {"score": [0.1, 0.2], "y": [1.0]}}})), ("bad", "{nope"), ("none", None)]
    got = reports.oof_rows(spark.createDataFrame(rows, "run string, j string"), "run", "j").collect()
    assert {tuple(r) for r in got} == {("r", "t", "a", 0.1, 1.0), ("r", "t", "b", 0.2, None)}


def test_picks_and_features(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    got = {r["k"]: r["rule"] for r in reports.picks(df, "k", [("top", None, [F.desc("v")]), ("again", None, [F.desc("v")]), ("low", F.col("v") > 0, [F.col("v")])]).collect()}
    assert got == {"4": "top", "1": "low"}
    cols, groups = ["a", "b", "c"], {"g": ["a", "b"]}
    assert reports.resolve_features("all", ["b"], groups, cols) == ["a", "c"] and reports.resolve_features(["g", "c", "a"], [], groups, cols) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        reports.resolve_features(["x"], [], groups, cols)
    with pytest.raises(TypeError):
        reports.resolve_features(3, [], groups, cols)


def test_consistency(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 1.0), (None, None)], "k string, v double")
    assert reports.unequal_rows(a, a.withColumn("v", F.col("v") + 1e-12)).isEmpty()
    assert reports.unequal_rows(a, a.distinct()).count() == 1


def test_p_values(spark):
    assert models.p_of_correlation(0.5, 30) == pytest.approx(0.00488, abs=1e-4) and models.p_of_correlation(1.0, 9) == 0.0 and models.p_of_correlation(None, 9) is None
    assert models.p_of_f(3.0, 3, 33) == pytest.approx(0.0649, abs=1e-3) and models.p_of_f(None, 3, 9) is None
    df = spark.range(60).select((F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("double").alias("y"), (F.col("id") % 2).cast("string").alias("g"), F.lit(1.0).alias("c"))
    got = {(r["variable"], r["test"]): r for r in stats.audit(df, ["x", "c"], ["g"], "y").collect()}
    assert 0 <= got["x", "pearson"]["p_value"] <= 1 and got["c", "pearson"]["stat"] is None and got["g", "eta_squared"]["flagged"] is False


def test_benchmark_measures_all_cells_in_one_plan(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"), (F.col("id") % 11).cast("double").alias("label"))
    run = lambda matrices: models.benchmark(df, "k", "regression", matrices, {"linear": {}}, "t", folds=2)
    one, two = run({"a": ["x"]}), run({"a": ["x"], "b": ["x", "z"]})
    aggregates = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert aggregates(one) == aggregates(two)
    got = {(r["matrix"], r["eval_set"], r["metric"]): r["value"] for r in two.collect()}
    assert len(got) == 12
    for e in ("oof_global", "train"):
        for r in models.evaluate_family(df, "k", "linear", "regression", ["x", "z"], folds=2)[1].where(F.col("eval_set") == e).collect():
            assert got["b", e, r["metric"]] == pytest.approx(r["value"])
