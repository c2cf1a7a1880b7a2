"""Ranks, quantiles and running sums over a whole table without one task that holds it.

Values are reduced to one row per distinct value, cut into ranges by approximate quantiles, summed per range, and ranked
within their range; the sums of earlier ranges are added. The result is exact whatever the quantiles are. Groups may be null;
null is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _group(columns: Sequence[str] | None) -> Column:
    """The group columns as one struct: never null itself, and equal to another with nulls in the same places."""
    return F.struct(*[F.col(c) for c in columns or []]) if columns else F.lit(0)


def running_sums(df: DataFrame, value: str, sums: dict[str, Column], group: Sequence[str] | None = None, ranges: int = 64) -> DataFrame:
    """(group, value, each sum, before_<sum>, all_<sum>): one row per distinct non-null value of each group.

    `before_x` is the sum of x over all lesser values of the group, `all_x` over the group. An empty table gives no rows.
    """
    ties = df.where(F.col(value).isNotNull()).groupBy(_group(group).alias("__g"), value).agg(*[c.alias(n) for n, c in sums.items()])
    probes = [i / ranges for i in range(1, ranges)]
    cuts = ties.groupBy("__g").agg(F.percentile_approx(value, probes, F.lit(1000)).alias("__cuts"), *[F.sum(n).alias("all_" + n) for n in sums])
    joined = ties.join(cuts, "__g") if group else ties.join(F.broadcast(cuts.drop("__g")))
    placed = joined.withColumn("__r", F.size(F.filter("__cuts", lambda c: c <= F.col(value)))).drop("__cuts")
    totals = placed.groupBy("__g", "__r").agg(*[F.sum(n).alias("__t_" + n) for n in sums])
    earlier = W.partitionBy("__g").orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__g", "__r", *[F.coalesce(F.sum("__t_" + n).over(earlier), F.lit(0)).alias("__o_" + n) for n in sums])
    within = W.partitionBy("__g", "__r").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(offsets, ["__g", "__r"])
    own = [F.col(f"__g.{c}").alias(c) for c in group or []]
    return out.select(*own, value, *sums, *[(F.coalesce(F.sum(n).over(within), F.lit(0)) + F.col("__o_" + n)).alias("before_" + n) for n in sums], *["all_" + n for n in sums])


def average_ranks(df: DataFrame, value: str, group: Sequence[str] | None = None) -> DataFrame:
    """(group, value, rank): the average rank of each distinct value, from 1."""
    r = running_sums(df, value, {"n": F.count("*")}, group)
    return r.select(*(group or []), value, (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def row_numbers(df: DataFrame, value: str, key: str, group: Sequence[str] | None = None, descending: bool = False, tie_rows: int = 100_000) -> DataFrame:
    """`df` with `rn` from 1 and `n_rows` of the group, in the order of (value, key). Rows with a null value are left out.

    Ties are ranked by the key: in one window where at most `tie_rows` rows share a value, else in ranges of the key as values
    are. Rows that share the key, too, are ranked in any order.
    """
    r = running_sums(df, value, {"__n": F.count("*")}, group)
    before = F.col("all___n") - F.col("before___n") - F.col("__n") if descending else F.col("before___n")
    r = r.select(_group(group).alias("__g"), value, before.alias("__before"), F.col("all___n").alias("n_rows"), F.col("__n").alias("__tied"))
    joined = df.withColumn("__g", _group(group)).join(r, ["__g", value])
    few = joined.where(F.col("__tied") <= tie_rows).withColumn("__r", F.row_number().over(W.partitionBy("__g", value).orderBy(key)))
    large = joined.where(F.col("__tied") > tie_rows)
    places = running_sums(large.select("__g", value, key), key, {"__k": F.count("*")}, ["__g", value]).select("__g", value, key, F.col("before___k").alias("__r0"))
    within = large.join(places, ["__g", value, key]).withColumn("__r", F.col("__r0") + F.row_number().over(W.partitionBy("__g", value, key).orderBy(F.lit(0)))).drop("__r0")
    numbered = few.unionByName(within).withColumn("rn", F.col("__before") + F.col("__r"))
    return numbered.select(*df.columns, "n_rows", "rn")


def quantiles(df: DataFrame, value: str, probs: dict[str, float], group: Sequence[str] | None = None) -> DataFrame:
    """(group, one column per name): exact quantiles with linear interpolation; null values don't count.

    One row per group that has a value; without groups one row, of nulls for an empty table.
    """
    r = running_sums(df, value, {"__n": F.count("*")}, group)
    first, last, n = F.col("before___n"), F.col("before___n") + F.col("__n") - 1, F.col("all___n")
    v = F.col(value).cast("double")
    aggs = []
    for name, q in probs.items():
        at = F.round((n - 1) * F.lit(float(q)), 9)
        low, high = F.floor(at), F.ceil(at)
        aggs += [F.max(F.when((first <= low) & (low <= last), v)).alias(f"__a_{name}"), F.max(F.when((first <= high) & (high <= last), v)).alias(f"__b_{name}"), F.max(at - low).alias(f"__w_{name}")]
    got = r.groupBy(_group(group).alias("__g")).agg(*aggs) if group else r.agg(*aggs)
    own = [F.col(f"__g.{c}").alias(c) for c in group or []]
    return got.select(*own, *[(F.col(f"__a_{m}") + (F.col(f"__b_{m}") - F.col(f"__a_{m}")) * F.col(f"__w_{m}")).alias(m) for m in probs])
