"""Strata, stratified splits and folds. Ranks within a stratum are made from ranges, so one stratum may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import row_numbers


def strata(df: DataFrame, columns: Sequence[str], least: int, rare: str = "rare|rare") -> DataFrame:
    """`df` with `stratum`, the values joined by |; strata under `least` rows become `rare`. The counts are aggregated, not windowed."""
    named = df.withColumn("__s", F.concat_ws("|", *columns))
    often = named.groupBy("__s").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("__s", F.lit(True).alias("__often"))
    return named.join(often, "__s", "left").withColumn("stratum", F.when(F.col("__often"), F.col("__s")).otherwise(rare)).drop("__s", "__often")


def stratified(df: DataFrame, key: str, stratum: str, order: str, shares: dict[str, float]) -> DataFrame:
    """`df` with `split`: consecutive shares of each stratum in the order of (order, key). The shares must add up to 1.

    The same rows and order column always give the same split; every row gets exactly one.
    """
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    ranked = row_numbers(df, order, key, [stratum])
    upto, out = 0.0, None
    names = list(shares)
    for n in names[:-1]:
        upto += shares[n]
        held = F.col("rn") <= F.round(F.lit(round(upto, 9)) * F.col("n_rows"))
        out = F.when(held, n) if out is None else out.when(held, n)
    return ranked.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1])).drop("rn", "n_rows")


def folds(df: DataFrame, key: str, stratum: str, order: str, n: int) -> DataFrame:
    """`df` with `fold` from 0, dealt in turn within each stratum in the order of (order, key)."""
    return row_numbers(df, order, key, [stratum]).withColumn("fold", ((F.col("rn") - 1) % n).cast("int")).drop("rn", "n_rows")
