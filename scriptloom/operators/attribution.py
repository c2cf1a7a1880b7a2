"""Additive attributions of linear scores: contribution = coefficient x (value - mean of the background)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linear_contributions(rows: DataFrame, background: DataFrame, key: str, coefficients: dict[str, float]) -> DataFrame:
    """(key, feature, value, contribution) in long form; a missing value counts as the mean, so it contributes 0."""
    means = background.agg(*[F.avg(f).alias("__m_" + f) for f in coefficients])
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), (F.lit(float(c)) * (F.coalesce(F.col(f).cast("double"), F.col("__m_" + f)) - F.col("__m_" + f))).alias("contribution")) for f, c in coefficients.items()]
    return rows.join(F.broadcast(means)).select(key, F.inline(F.array(*parts)))


def global_ranking(long: DataFrame) -> DataFrame:
    """(feature, mean_abs, mean, rank): features by mean size of their contributions, ties by name. One row per feature is ranked."""
    g = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("mean_abs", 12)), "feature")))


def top_per_row(long: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, raised, lowered): the k strongest positive and negative contributions of each row as `f=+0.123; g=-0.045`.

    Sorted inside an array of one row's features, so there is one shuffle.
    """
    entry = F.struct((-F.abs("contribution")).alias("o"), F.col("feature").alias("f"), F.col("contribution").alias("c"))

    def picked(sign: int) -> Column:
        some = F.slice(F.array_sort(F.collect_list(F.when(F.col("contribution") * sign > 0, entry))), 1, k)
        return F.array_join(F.transform(some, lambda e: F.concat(e["f"], F.lit("="), F.format_string("%+.3f", e["c"]))), "; ")

    return long.groupBy(key).agg(picked(1).alias("raised"), picked(-1).alias("lowered"))


def leave_out(rows: DataFrame, key: str, coefficients: dict[str, float], group: Sequence[str]) -> DataFrame:
    """(key, score, without, effect): the linear score with and without a group of features set to 0."""
    score = sum((F.lit(float(c)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f, c in coefficients.items()), F.lit(0.0))
    rest = sum((F.lit(float(c)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f, c in coefficients.items() if f not in group), F.lit(0.0))
    return rows.select(key, score.alias("score"), rest.alias("without"), (score - rest).alias("effect"))
