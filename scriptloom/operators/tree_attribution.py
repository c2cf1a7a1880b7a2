"""Exact additive attributions (Shapley values, path-dependent) of tree ensembles fitted with Spark ML.

A tree is a sum over its leaves of value x indicator. For one leaf let P be the features on its path, o_f whether a row meets all
conditions of the path on f, and z_f the share of training rows that went the leaf's way at the splits on f. If only the
features of a set S are known, the leaf contributes value x prod_{S} o x prod_{P - S} z, and the Shapley value of f is

    value x (o_f - z_f) x sum_k k! (|P| - k - 1)! / |P|! x e_k,

e_k being the coefficient of t^k in prod_{j != f} (z_j + o_j t). That product has at most `depth` factors, so a leaf costs a
few array operations for a whole batch of rows. The ensemble goes to the workers as arrays of its leaves, whose size is that of
the model; rows are attributed in Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """Features of the path, the open lower and closed upper bounds on each, the share of rows that went this way, and the value."""

    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]
    value: float


def leaves_of(model: object, classification: bool) -> list[Leaf]:
    """The leaves of a fitted forest, boosted trees or single tree; values are the ensemble's share of the score (for a forest
    classifier the probability of class 1, for boosted classifiers the margin)."""
    trees, weights = (model.trees, list(model.treeWeights)) if hasattr(model, "trees") else ([model], [1.0])
    boosted = "GBT" in type(model).__name__
    scale = 1.0 if boosted else 1.0 / sum(weights)
    out: list[Leaf] = []
    for tree, weight in zip(trees, weights):
        todo = [(tree._call_java("rootNode"), {})]
        while todo:
            node, path = todo.pop()
            if node.subtreeDepth() == 0:
                stats = list(node.impurityStats().stats())
                value = float(node.prediction()) if boosted or not classification else stats[1] / max(sum(stats), 1e-300)
                own = sorted(path)
                out.append(Leaf(own, [path[f][0] for f in own], [path[f][1] for f in own], [path[f][2] for f in own], weight * scale * value))
                continue
            split, left, right = node.split(), node.leftChild(), node.rightChild()
            f, at = split.featureIndex(), float(split.threshold())
            n = float(node.impurityStats().count())
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((left, (low, min(high, at))), (right, (max(low, at), high))):
                todo.append((child, path | {f: (*bounds, share * float(child.impurityStats().count()) / n)}))
    return out


def shapley(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """(rows, features + 1): the contribution of each feature and, last, the score without any known feature."""
    out = np.zeros((len(x), x.shape[1] + 1))
    for leaf in leaves:
        m = len(leaf.features)
        out[:, -1] += leaf.value * np.prod(leaf.share)
        if not m or leaf.value == 0.0:
            continue
        met = np.stack([(x[:, f] > a) & (x[:, f] <= b) for f, a, b in zip(leaf.features, leaf.low, leaf.high)]).astype(float)
        weights = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
        for i, f in enumerate(leaf.features):
            poly = np.zeros((m, len(x)))
            poly[0] = 1.0
            for j in range(m):
                if j != i:
                    grown = poly * leaf.share[j]
                    grown[1:] += poly[:-1] * met[j]
                    poly = grown
            out[:, f] += leaf.value * (met[i] - leaf.share[i]) * np.tensordot(weights, poly, 1)
    return out


def tree_contributions(pipeline: PipelineModel, rows: DataFrame, key: str, features: Sequence[str], classification: bool = True) -> DataFrame:
    """(key, feature, value, contribution) in long form, one row per feature, and one named '' for the base: the contributions of a
    row add up to its score. `pipeline` ends with a tree model over a vector column; missing values are filled by its own steps.
    """
    model = pipeline.stages[-1]
    ready = rows
    for stage in pipeline.stages[:-1]:
        ready = stage.transform(ready)
    held = rows.sparkSession.sparkContext.broadcast(leaves_of(model, classification))
    names = [*features, ""]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["__x"].to_numpy()) if len(pdf) else np.zeros((0, len(features)))
            got = shapley(held.value, x)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(names)), "feature": names * len(pdf), "value": np.hstack([x, np.full((len(x), 1), np.nan)]).ravel(), "contribution": got.ravel()})

    vectors = ready.select(key, vector_to_array(F.col(model.getFeaturesCol())).alias("__x"))
    return vectors.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, feature string, value double, contribution double")
