"""Training, cross-validation, stacking and importance on Spark ML. Families without a Spark counterpart are replaced: boosted
trees by gradient-boosted trees, kernel machines by a linear support vector classifier."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, Imputer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

FAMILIES: dict[str, dict[str, Callable]] = {
    "linear": {"classification": lambda **p: LogisticRegression(**p), "regression": lambda **p: LinearRegression(**p)},
    "random_forest": {"classification": lambda **p: RandomForestClassifier(seed=42, **p), "regression": lambda **p: RandomForestRegressor(seed=42, **p)},
    "boosted_trees": {"classification": lambda **p: GBTClassifier(seed=42, **p), "regression": lambda **p: GBTRegressor(seed=42, **p)},
    "linear_svm": {"classification": lambda **p: LinearSVC(**p)},
}


def build_pipeline(family: str, task: str, features: Sequence[str], weight: str | None = None, **params: object) -> Pipeline:
    """Median imputation, assembling, scaling, estimator. An unknown family or a task it can't do raises KeyError."""
    filled = [f"{c}__filled" for c in features]
    extra = {"weightCol": weight} if weight else {}
    est = FAMILIES[family][task](featuresCol="features", labelCol="label", **extra, **params)
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), est])


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """`df` with `weight`: n / (2 n_class); 1 where only one class occurs."""
    c = df.agg(F.count("*").alias("__n"), F.sum(F.col(label).cast("int")).alias("__pos"))
    pos, neg = F.col("__pos"), F.col("__n") - F.col("__pos")
    w = F.when((pos == 0) | (neg == 0), 1.0).when(F.col(label).cast("int") == 1, F.col("__n") / (2 * pos)).otherwise(F.col("__n") / (2 * neg))
    return df.join(F.broadcast(c)).withColumn("weight", w).drop("__n", "__pos")


def score_of(columns: Sequence[str], task: str) -> Column:
    """Probability of class 1, the sigmoid of a margin, or the prediction."""
    if task == "regression":
        return F.col("prediction")
    if "probability" in columns:
        return vector_to_array("probability")[1]
    return 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))


def fold_of(key: str, n: int, seed: int) -> Column:
    """A fold from 0 by a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(n)).cast("int")


def out_of_fold(df: DataFrame, key: str, pipeline: Pipeline, task: str, folds: int = 5, repeats: int = 1) -> DataFrame:
    """(key, label, score, vote): mean score over the repeats of models trained without the row's fold; vote is the mean hard label, read at one half."""
    out = None
    for r in range(repeats):
        marked = df.withColumn("__fold", fold_of(key, folds, r))
        for f in range(folds):
            model = pipeline.fit(marked.where(F.col("__fold") != f))
            held = model.transform(marked.where(F.col("__fold") == f))
            part = held.select(key, "label", score_of(held.columns, task).alias("score"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.first("label").alias("label"), F.avg("score").alias("score"), (F.avg((F.col("score") >= 0.5).cast("double")) >= 0.5).alias("vote"))


def stack(base: dict[str, DataFrame], key: str, task: str, folds: int = 5) -> DataFrame:
    """Out-of-fold scores of a linear learner on the out-of-fold scores of the base models."""
    wide = None
    for name, df in sorted(base.items()):
        part = df.select(key, F.col("label"), F.col("score").alias(name))
        wide = part if wide is None else wide.join(part.drop("label"), key)
    return out_of_fold(wide, key, build_pipeline("linear", task, sorted(base), regParam=0.0), task, folds)


def importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance, rank): |coefficient| or the forest's own importance."""
    from pyspark.sql import SparkSession

    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else last.coefficients.toArray()
    rows = sorted(((f, abs(float(v))) for f, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    return SparkSession.active().createDataFrame([(f, v, i) for i, (f, v) in enumerate(rows, 1)], "feature string, importance double, rank int")


def permutation_importance(model: PipelineModel, df: DataFrame, key: str, features: Sequence[str], loss: Callable[[DataFrame], DataFrame], task: str, seed: int = 42) -> DataFrame:
    """(feature, drop): how much the loss grows when a column is shuffled. The shuffle pairs rows of two hash orders within
    buckets, so no task sees the whole table."""
    buckets = 64
    from pyspark.sql import Window as W

    order = lambda s: F.row_number().over(W.partitionBy(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets))).orderBy(F.xxhash64(F.col(key), F.lit(s))))
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets)).alias("__b")
    scored = lambda d: (lambda t: t.select("label", score_of(t.columns, task).alias("score")))(model.transform(d))
    out = loss(scored(df)).select(F.lit("").alias("feature"), F.col("loss"))
    for k, f in enumerate(features):
        left = df.withColumn("__r", order(seed + 1)).withColumn("__b", bucket)
        right = df.select(bucket, order(seed + 2 + k).alias("__r"), F.col(f).alias("__new"))
        shuffled = left.join(right, ["__b", "__r"]).withColumn(f, F.col("__new")).drop("__b", "__r", "__new")
        out = out.unionByName(loss(scored(shuffled)).select(F.lit(f).alias("feature"), F.col("loss")))
    base = out.where("feature = ''").select(F.col("loss").alias("__base"))
    return out.where("feature <> ''").join(F.broadcast(base)).select("feature", (F.col("loss") - F.col("__base")).alias("drop"))


def topics(train: DataFrame, rows: DataFrame, key: str, tokens: str, k: int, min_docs: float = 5.0, max_share: float = 0.5, iterations: int = 20, stop_words: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Topic shares (key, shares, entropy, dominant) of `rows` by a model fitted on `train` alone, and (topic, place, term, weight) of the ten strongest terms.

    The vocabulary is every word of three characters or more, but for stop words (None: Spark's English list), in at least
    `min_docs` training rows and at most `max_share` of them. Every iteration draws as many training rows as there are.
    Entropy is divided by ln k; the first of equal shares is dominant. A row without known tokens gets equal shares.
    """
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else list(stop_words)
    words = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(stop))
    prepared = lambda d: d.select(key, F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    counts = CountVectorizer(inputCol="words", outputCol="features", vocabSize=2**31 - 1, minDF=min_docs, maxDF=max_share).fit(prepared(train))
    fitted = cut(counts.transform(prepared(train)).select("features"))
    model = LDA(k=k, maxIter=iterations, seed=42, optimizer="online", subsamplingRate=1.0, learningOffset=1.0, optimizeDocConcentration=False).fit(fitted)
    shares = vector_to_array("topicDistribution")
    got = model.transform(counts.transform(prepared(rows))).select(key, shares.alias("shares"))
    total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)
    even = F.array_repeat(F.lit(1.0 / k), k)
    got = got.withColumn("shares", F.when(total > 0, F.transform("shares", lambda x: x / total)).otherwise(even))
    entropy = -F.aggregate("shares", F.lit(0.0), lambda a, x: a + x * F.log(x + 1e-12)) / math.log(k)
    got = got.withColumn("entropy", entropy).withColumn("dominant", (F.array_position("shares", F.array_max("shares")) - 1).cast("int"))
    terms = model.describeTopics(10).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("p", "t"))
    vocab = F.lit(list(counts.vocabulary))
    return got, terms.select("topic", (F.col("p") + 1).alias("place"), F.get(vocab, F.col("t.termIndices")).alias("term"), F.col("t.termWeights").alias("weight"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def student_cdf(t: float, df: float) -> float:
    """Distribution function of Student's t by the incomplete beta function."""
    x = df / (df + t * t)
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - math.lgamma(0.5) + df / 2 * math.log(x) + 0.5 * math.log1p(-x)) if 0 < x < 1 else 0.0
    a, b = df / 2, 0.5
    if x >= 1:
        i = 1.0
    elif x < (a + 1) / (a + b + 2):
        i = front * _beta_fraction(a, b, x) / a
    else:
        i = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return 1 - i / 2 if t > 0 else i / 2


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def p_of_correlation(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation of n pairs; None where it is undefined."""
    if r is None or n < 3 or math.isnan(r):
        return None
    return 0.0 if abs(r) >= 1 else beta_ratio((n - 2) / 2, 0.5, 1 - r * r)


def p_of_f(f: float | None, k: int, n: int) -> float | None:
    """p-value of an F statistic of k groups and n rows; None where it is undefined."""
    return None if f is None or n <= k or k < 2 else beta_ratio((n - k) / 2, (k - 1) / 2, (n - k) / (n - k + (k - 1) * f))


def grid_search(df: DataFrame, family: str, task: str, features: Sequence[str], grid: dict[str, Sequence], folds: int = 5, parallelism: int = 2) -> tuple[dict, DataFrame]:
    """(best parameters, (params, score) of every point) by cross-validation over folds of `fold`, refitted by the caller.

    The score is the area under the curve, or the negative root mean squared error.
    """
    from itertools import product

    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    pipe = build_pipeline(family, task, features)
    est = pipe.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(est, name), list(values))
    points = builder.build()
    ev = BinaryClassificationEvaluator(labelCol="label") if task == "classification" else RegressionEvaluator(labelCol="label", metricName="rmse")
    fitted = CrossValidator(estimator=pipe, estimatorParamMaps=points, evaluator=ev, foldCol="fold", numFolds=folds, parallelism=parallelism).fit(df)
    sign = 1.0 if task == "classification" else -1.0
    rows = [({p.name: v for p, v in pt.items()}, sign * m) for pt, m in zip(points, fitted.avgMetrics)]
    best = max(rows, key=lambda r: r[1])[0]
    assert len(rows) == len(list(product(*grid.values())))
    return best, df.sparkSession.createDataFrame([(str(sorted(p.items())), float(m)) for p, m in rows], "params string, score double")


#: Families by tier, each with the grid that is searched for it.
TIERS: dict[str, dict[str, dict[str, Sequence]]] = {
    "primary": {"linear": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}, "random_forest": {"numTrees": [50], "maxDepth": [3, 5]}, "boosted_trees": {"maxIter": [20], "maxDepth": [2, 3]}},
    "secondary": {"linear_svm": {"regParam": [0.01, 0.1]}},
}


def grid_size(family: str) -> int:
    """Points of the grid of a family; KeyError for an unknown one."""
    grid = next(t[family] for t in TIERS.values() if family in t) if any(family in t for t in TIERS.values()) else {}[family]
    return math.prod(len(v) for v in grid.values())


def family_metrics(scored: DataFrame, task: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, metric, value) of (group, label, score): auc, f1, log_loss and brier, or rmse, mae and cvrmse; metrics without a value are left out."""
    from . import metrics as m
    from .reports import unpivot

    keys = list(group)
    if task == "regression":
        wide, names = m.regression_metrics(scored, "label", "score", keys), ["rmse", "mae", "cvrmse"]
    else:
        losses, ranked = m.threshold_metrics(scored, "label", "score", keys), m.ranking_metrics(scored, "label", "score", keys)
        wide, names = losses.join(ranked, keys, "left") if keys else losses.join(F.broadcast(ranked)), ["auc", "average_precision", "f1", "log_loss", "brier"]
    return unpivot(wide, keys, names).where(F.col("value").isNotNull())


def family_scores(df: DataFrame, key: str, family: str, task: str, features: Sequence[str], grid: dict[str, Sequence] | None = None, folds: int = 5, repeats: int = 1) -> tuple[DataFrame, DataFrame, dict]:
    """(out-of-fold scores, (label, score) of training, best parameters) of one family on one target (`label`).

    The grid is searched over folds of a hash of the key; the best point is then scored out of fold by other hashes, and fitted
    on all rows for the scores of training.
    """
    df = cut(df.select(key, *features, "label"))
    best: dict = {}
    if grid:
        best = grid_search(df.withColumn("fold", fold_of(key, folds, 100)), family, task, features, grid, folds)[0]
    pipe = build_pipeline(family, task, features, **best)
    oof = cut(out_of_fold(df, key, pipe, task, folds, repeats))
    fitted = pipe.fit(df).transform(df)
    return oof, cut(fitted.select("label", score_of(fitted.columns, task).alias("score"))), best


def evaluate_family(df: DataFrame, key: str, family: str, task: str, features: Sequence[str], grid: dict[str, Sequence] | None = None, folds: int = 5, repeats: int = 1) -> tuple[DataFrame, DataFrame, dict]:
    """(out-of-fold scores, metrics, best parameters) of `family_scores`. Metrics: (family, eval_set in oof_global and train, metric, value)."""
    oof, train, best = family_scores(df, key, family, task, features, grid, folds, repeats)
    scored = _marked(oof, eval_set="oof_global").unionByName(_marked(train, eval_set="train"))
    return oof, family_metrics(scored, task, ["eval_set"]).select(F.lit(family).alias("family"), "eval_set", "metric", "value"), best


def _marked(scores: DataFrame, **marks: str) -> DataFrame:
    return scores.select(*[F.lit(v).alias(k) for k, v in marks.items()], "label", "score")


def benchmark(df: DataFrame, key: str, task: str, matrices: dict[str, Sequence[str]], families: dict[str, dict[str, Sequence]], target: str, tier: str = "primary", folds: int = 5) -> DataFrame:
    """(matrix, family, target, tier, eval_set, metric, value) of every family on every named set of features; `winner` reads it.

    The scores of all cells lie in the checkpoint folder, marked with their cell, so one plan measures them all, whatever their number.
    """
    out = None
    for matrix, features in matrices.items():
        for family, grid in families.items():
            oof, train, _ = family_scores(df, key, family, task, features, grid, folds)
            for eval_set, scores in (("oof_global", oof), ("train", train)):
                part = _marked(scores, matrix=matrix, family=family, eval_set=eval_set)
                out = part if out is None else out.unionByName(part)
    cells = family_metrics(out, task, ["matrix", "family", "eval_set"])
    return cells.select("matrix", "family", F.lit(target).alias("target"), F.lit(tier).alias("tier"), "eval_set", "metric", "value")


def correlated_t(diff: Sequence[float], rope: float, test_share: float = 0.2) -> tuple[float, float, float]:
    """Posterior chances that the first is worse, as good within the rope, and better, from paired fold differences."""
    n = len(diff)
    mean = sum(diff) / n
    var = sum((x - mean) ** 2 for x in diff) / (n - 1)
    scale = math.sqrt(var * (1 / n + test_share / (1 - test_share)))
    if scale == 0:
        return (float(mean < -rope), float(-rope <= mean <= rope), float(mean > rope))
    low, high = student_cdf((-rope - mean) / scale, n - 1), student_cdf((rope - mean) / scale, n - 1)
    return low, high - low, 1 - high


def paired_comparisons(scores: DataFrame, rope: float = 0.01, least: int = 4, sure: float = 0.95) -> DataFrame:
    """(metric, a, b, n, p_worse, p_same, p_better, winner) of all pairs of families from (family, metric, fold, score), higher being better.

    Folds where either score is missing don't count; under `least` of them the chances are null and the winner is 'rope'.
    """
    x = scores.select(F.col("family").alias("a"), "metric", "fold", F.col("score").alias("x"))
    y = scores.select(F.col("family").alias("b"), "metric", "fold", F.col("score").alias("y"))
    pairs = x.join(y, ["metric", "fold"]).where("a < b").select("metric", "a", "b", (F.col("x") - F.col("y")).alias("diff"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = [v for v in pdf["diff"] if v is not None and math.isfinite(v)]
        worse = same = better = None
        winner = "rope"
        if len(d) >= least:
            worse, same, better = correlated_t(d, rope)
            winner = pdf["a"].iloc[0] if better >= sure else pdf["b"].iloc[0] if worse >= sure else "rope"
        return pd.DataFrame([(pdf["metric"].iloc[0], pdf["a"].iloc[0], pdf["b"].iloc[0], len(d), worse, same, better, winner)], columns=["metric", "a", "b", "n", "p_worse", "p_same", "p_better", "winner"]).astype({"p_worse": "float64", "p_same": "float64", "p_better": "float64"})

    return pairs.groupBy("metric", "a", "b").applyInPandas(run, "metric string, a string, b string, n int, p_worse double, p_same double, p_better double, winner string")
