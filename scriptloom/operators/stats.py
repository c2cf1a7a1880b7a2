"""Summaries, group profiles, pivots and associations. Aggregates are partial before every shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import quantiles, running_sums


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null where either side is constant or there are no pairs."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def summary_long(df: DataFrame, metrics: Sequence[tuple[str, Column]]) -> DataFrame:
    """(metric, value): scalar aggregates as rows, in one scan."""
    one = df.agg(*[c.cast("double").alias(f"m{i}") for i, (_, c) in enumerate(metrics)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, (n, _) in enumerate(metrics)])))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max) with exact quantiles and the sample standard deviation."""
    m = lambda i, n: f"__{n}{i}"
    moments = df.agg(*[f(c).alias(m(i, n)) for i, c in enumerate(columns) for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    # all columns as one long table of distinct values with their counts, so that one plan ranks them all
    entry = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
    long = df.select(F.inline(F.array(*[entry(c) for c in columns])))
    q = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"])
    wide = moments.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(m(i, n)).alias(n) if n == "n" else F.col(m(i, n)).cast("double").alias(n) for n in ("n", "mean", "std", "min", "max")]) for i, c in enumerate(columns)])))
    return wide.join(q, "column", "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over [low, high] in even bins from 1; the upper edge belongs to the last. Values outside and nulls don't count."""
    b = F.least(F.floor((value - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return df.where(value.between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def pearson_spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, pearson, spearman) over complete pairs; null for fewer than 3. Ranks are averaged over ties."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    # equal pairs are counted before anything is joined to the ranks, so a value that many rows share is joined once a partner
    counted = pairs.groupBy("x", "y").agg(F.count("*").alias("c"))
    ranks = lambda v: running_sums(counted, v, {"n": F.sum("c")}).select(v, (F.col("before_n") + (F.col("n") + 1) / 2).alias("r" + v))
    joined = counted.join(ranks("x"), "x").join(ranks("y"), "y")
    n = F.col("n")
    sums = joined.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *[F.sum(F.col("c") * F.col(a) * F.col(b)).alias(a + b) for a, b in (("rx", "rx"), ("rx", "ry"), ("ry", "ry"))], *[F.sum(F.col("c") * F.col(a)).alias(a) for a in ("rx", "ry")])
    spearman = F.try_divide(n * F.col("rxry") - F.col("rx") * F.col("ry"), F.sqrt(n * F.col("rxrx") - F.col("rx") * F.col("rx")) * F.sqrt(n * F.col("ryry") - F.col("ry") * F.col("ry")))
    # Pearson's from the rows, whose covariance is updated stably; ranks are half integers, of which sums are exact
    plain = pairs.agg(correlation("x", "y").alias("p"))
    return sums.join(F.broadcast(plain)).select("n", F.when(n >= 3, F.col("p")).alias("pearson"), F.when(n >= 3, spearman).alias("spearman"))


def eta_squared(df: DataFrame, group: str, y: str) -> DataFrame:
    """(n, n_groups, f_stat, eta_squared) of a one-way analysis of variance, from group sums alone."""
    g = df.where(F.col(group).isNotNull() & F.col(y).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"), F.sum(F.col("n") * F.col("m")).alias("s"))
    t = t.withColumn("between", F.col("sq") - F.col("s") * F.col("s") / F.col("n"))
    return t.select("n", F.col("k").alias("n_groups"), F.try_divide(F.try_divide("between", F.col("k") - 1), F.try_divide("within", F.col("n") - F.col("k"))).alias("f_stat"), F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("eta_squared"))


def audit(df: DataFrame, metrics: Sequence[str], groups: Sequence[str], target: str, least: int = 30) -> DataFrame:
    """(variable, test, n, stat, p_value, flagged): Pearson and Spearman of each metric with the target, and eta squared of each group.

    Under `least` rows the statistic is null. A correlation is flagged above 0.30 in size, eta squared above 0.09.
    """
    from .models import p_of_correlation, p_of_f

    @F.pandas_udf("double")
    def p_r(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_of_correlation(a, b) for a, b in zip(r, n)], dtype="float64")

    @F.pandas_udf("double")
    def p_f(f: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else p_of_f(a, b, c) for a, b, c in zip(f, k, n)], dtype="float64")

    parts = []
    for m in metrics:
        r = pearson_spearman(df, m, target)
        for t in ("pearson", "spearman"):
            stat = F.when(F.col("n") >= least, F.col(t))
            parts.append(r.select(F.lit(m).alias("variable"), F.lit(t).alias("test"), "n", stat.alias("stat"), p_r(stat, "n").alias("p_value"), (F.abs(stat) > 0.30).alias("flagged")))
    for g in groups:
        e = eta_squared(df, g, target)
        stat = F.when(F.col("n") >= least, F.col("eta_squared"))
        parts.append(e.select(F.lit(g).alias("variable"), F.lit("eta_squared").alias("test"), "n", stat.alias("stat"), p_f("f_stat", "n_groups", "n").alias("p_value"), (stat > 0.09).alias("flagged")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of `row` by fixed values of `column`, 0 where there are none, with their total."""
    out = df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return out.withColumn("total", sum((F.col(v) for v in values), F.lit(0)))


def pivot_delta(df: DataFrame, keys: Sequence[str], column: str, old: str, new: str, value: str) -> DataFrame:
    """One row per keys with the old and new value side by side, their difference and per cent."""
    wide = df.groupBy(*keys).agg(F.max(F.when(F.col(column) == old, F.col(value))).alias("old"), F.max(F.when(F.col(column) == new, F.col(value))).alias("new"))
    return wide.withColumn("delta", F.col("new") - F.col("old")).withColumn("pct", F.try_divide(100 * F.col("delta"), F.abs(F.col("old"))))


def jaccard_top(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """(n_both, n_any, jaccard) of the keys within rank k of two rankings (key, rank)."""
    x, y = a.where(F.col("rank") <= k).select(key, F.lit(1).alias("x")), b.where(F.col("rank") <= k).select(key, F.lit(1).alias("y"))
    both = x.join(y, key, "full")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_both"), F.count("*").alias("n_any")).withColumn("jaccard", F.try_divide("n_both", "n_any"))
