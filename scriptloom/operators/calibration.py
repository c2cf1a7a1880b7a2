"""Calibrated probabilities and conformal sets and intervals."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import order_statistic
from .models import fold_of


def calibrate(train: DataFrame, rows: DataFrame, score: str, label: str, method: str) -> DataFrame:
    """`rows` with `calibrated`: 'sigmoid' (a logistic curve), 'isotonic' (a step curve) or 'none', fitted on `train`."""
    if method == "none":
        return rows.withColumn("calibrated", F.col(score).cast("double"))
    one = VectorAssembler(inputCols=[score], outputCol="__v", handleInvalid="skip")
    fitted = one.transform(train.withColumn("__y", F.col(label).cast("double")))
    if method == "sigmoid":
        model = LogisticRegression(featuresCol="__v", labelCol="__y", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__hard").fit(fitted)
        return model.transform(one.transform(rows)).withColumn("calibrated", vector_to_array("__p")[1]).drop("__v", "__p", "__raw", "__hard")
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="__v", labelCol="__y", predictionCol="calibrated").fit(fitted)
        return model.transform(one.transform(rows)).drop("__v")
    raise ValueError(f"unknown method {method!r}")


def cross_calibrated(df: DataFrame, key: str, score: str, label: str, method: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Rows calibrated by curves fitted on the other folds."""
    marked, out = df.withColumn("fold", fold_of(key, folds, seed)), None
    for f in range(folds if method != "none" else 0):
        part = calibrate(marked.where(F.col("fold") != f), marked.where(F.col("fold") == f), score, label, method)
        out = part if out is None else out.unionByName(part)
    return calibrate(marked, marked, score, label, "none") if out is None else out


def best_method(rows: DataFrame) -> DataFrame:
    """The row of (method, ece, ...) with the least ece; of equals sigmoid before isotonic before none. A handful of rows are sorted."""
    order = F.array_position(F.array(F.lit("sigmoid"), F.lit("isotonic"), F.lit("none")), F.col("method"))
    return rows.orderBy(F.round("ece", 9), order).limit(1)


def class_quantiles(df: DataFrame, p: str, label: str, levels: list[float]) -> DataFrame:
    """(level, q): the conformal quantile of 1 - p(true class)."""
    s = F.when(F.col(label).cast("int") == 1, 1 - F.col(p)).otherwise(F.col(p))
    return order_statistic(df.where(F.col(label).isNotNull()).withColumn("__s", s), "__s", levels)


def class_sets(df: DataFrame, quantiles: DataFrame, p: str) -> DataFrame:
    """`df` for each level with in_0, in_1 (a class is in the set if 1 - its p is within the quantile) and set_size."""
    return df.join(F.broadcast(quantiles)).withColumn("in_0", F.col(p) <= F.col("q")).withColumn("in_1", (1 - F.col(p)) <= F.col("q")).withColumn("set_size", F.col("in_0").cast("int") + F.col("in_1").cast("int"))


def set_coverage(sets: DataFrame, label: str) -> DataFrame:
    """(level, n, coverage, mean_size, share_single, share_both, share_empty)."""
    hit = F.when(F.col(label).cast("int") == 1, F.col("in_1")).otherwise(F.col("in_0"))
    share = lambda k: F.avg((F.col("set_size") == k).cast("double"))
    return sets.where(F.col(label).isNotNull()).groupBy("level").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("coverage"), F.avg("set_size").alias("mean_size"), share(1).alias("share_single"), share(2).alias("share_both"), share(0).alias("share_empty"))


def interval_coverage(df: DataFrame, y: str, p: str, levels: list[float]) -> DataFrame:
    """(level, n, q, coverage, width) of p +/- the conformal quantile of |y - p|."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("__e", F.abs(F.col(y) - F.col(p)))
    q = order_statistic(rows, "__e", levels)
    return rows.join(F.broadcast(q)).groupBy("level").agg(F.count("*").alias("n"), F.max("q").alias("q"), F.avg((F.col("__e") <= F.col("q")).cast("double")).alias("coverage"), F.max(2 * F.col("q")).alias("width"))


def adaptive_quantiles(df: DataFrame, p: str, label: str, levels: list[float]) -> DataFrame:
    """(level, q): the conformal quantile of the probability mass down to the true class, classes taken from the likelier on."""
    high = F.greatest(F.col(p), 1 - F.col(p))
    s = F.when((F.col(p) >= 0.5) == (F.col(label).cast("int") == 1), high).otherwise(1.0)
    return order_statistic(df.where(F.col(label).isNotNull() & F.col(p).isNotNull()).withColumn("__s", s), "__s", levels)


def adaptive_sets(df: DataFrame, quantiles: DataFrame, p: str) -> DataFrame:
    """`df` for each level with in_0, in_1 and set_size: the likelier class always, the other one where the first is not mass enough.

    At one half class 1 is the likelier.
    """
    top = F.col(p) >= 0.5
    both = F.greatest(F.col(p), 1 - F.col(p)) < F.col("q")
    return df.join(F.broadcast(quantiles)).withColumn("in_0", ~top | both).withColumn("in_1", top | both).withColumn("set_size", F.col("in_0").cast("int") + F.col("in_1").cast("int"))


def relative_coverage(df: DataFrame, y: str, p: str, levels: list[float]) -> DataFrame:
    """(level, n, q, coverage, width) of p +/- q p, q the conformal quantile of |y - p| / p; rows with a p of 0 or less don't count.

    `width` is the mean over the rows, as intervals differ.
    """
    rows = df.where(F.col(y).isNotNull() & (F.col(p) > 0)).withColumn("__e", F.abs(F.col(y) - F.col(p)) / F.col(p))
    q = order_statistic(rows, "__e", levels)
    return rows.join(F.broadcast(q)).groupBy("level").agg(F.count("*").alias("n"), F.max("q").alias("q"), F.avg((F.col("__e") <= F.col("q")).cast("double")).alias("coverage"), F.avg(2 * F.col("q") * F.col(p)).alias("width"))


def closest_coverage(coverages: DataFrame, score: str = "score", level: float = 0.9) -> DataFrame:
    """The row (score, coverage) whose coverage at `level` lies closest to it; ties by name."""
    gap = F.round(F.abs(F.col("coverage") - F.lit(level)), 12)
    rows = coverages.where(F.abs(F.col("level") - level) < 1e-9)
    return rows.agg(F.min_by(F.struct(score, "coverage"), F.struct(gap, score)).alias("r")).select("r.*").where(F.col(score).isNotNull())
