from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.operators import models
from scriptloom.operators.tree_attribution import Leaf, leaves_of, shapley, tree_contributions


def expected(leaves, x, known):
    """The score of one row if only some features are known."""
    total = 0.0
    for leaf in leaves:
        part = leaf.value
        for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
            part *= float(low < x[f] <= high) if f in known else share
        total += part
    return total


def brute(leaves, x):
    n = len(x)
    out = []
    for f in range(n):
        rest = [j for j in range(n) if j != f]
        out.append(sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (expected(leaves, x, {*s, f}) - expected(leaves, x, set(s))) for k in range(n) for s in combinations(rest, k)))
    return out


def test_against_all_subsets():
    rng = np.random.default_rng(4)
    leaves = []
    for _ in range(30):
        own = sorted(rng.choice(5, rng.integers(0, 5), replace=False).tolist())
        leaves.append(Leaf(own, [float(v) for v in rng.normal(-1, 1, len(own))], [float(v) for v in rng.normal(1, 1, len(own))], [float(v) for v in rng.random(len(own))], float(rng.normal())))
    x = rng.normal(size=(6, 5))
    got = shapley(leaves, x)
    for row, g in zip(x, got):
        assert g[:5] == pytest.approx(brute(leaves, row)) and g.sum() == pytest.approx(expected(leaves, row, set(range(5))))


@pytest.mark.parametrize(("family", "task"), [("random_forest", "classification"), ("random_forest", "regression"), ("boosted_trees", "regression"), ("boosted_trees", "classification")])
def test_contributions_add_up_to_the_score(spark, family, task):
    df = spark.range(300).select("id", (F.col("id") % 13).cast("double").alias("a"), F.when(F.col("id") % 17 > 0, (F.col("id") % 7).cast("double")).alias("b"), F.lit("x").alias("feature"))
    df = df.withColumn("label", ((F.col("a") * 3 + F.coalesce("b", F.lit(0.0)) * 5) % 11 > 5).cast("double"))
    params = {"numTrees": 5} if family == "random_forest" else {"maxIter": 4}
    model = models.build_pipeline(family, task, ["a", "b"], maxDepth=3, **params).fit(df)
    long = tree_contributions(model, df, "id", ["a", "b"], task == "classification")
    assert long.count() == 900
    total = {r["id"]: r["t"] for r in long.groupBy("id").agg(F.sum("contribution").alias("t")).collect()}
    made = model.transform(df)
    if task == "regression":
        want = {r["id"]: r["prediction"] for r in made.collect()}
    elif family == "random_forest":
        want = {r["id"]: float(r["probability"][1]) for r in made.collect()}
    else:
        want = {r["id"]: float(r["rawPrediction"][1]) for r in made.collect()}
    assert all(total[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert tree_contributions(model, df.where("id < 0"), "id", ["a", "b"], task == "classification").count() == 0
    assert leaves_of(model.stages[-1], task == "classification")
