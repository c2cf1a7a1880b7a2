"""Joins, set operations and keep-one rules on keyed tables. Every operator is lazy and says how it breaks ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def left_enrich(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], suffix: str = "_rt") -> DataFrame:
    """LEFT equi-join that attaches `columns`; a column that both sides have gets the suffix on the right. Raises KeyError if the key isn't among the right's columns.

    Null keys match nothing. A key that occurs twice on the right repeats the left row, so the right should hold each key once.
    """
    if key not in right.columns:
        raise KeyError(key)
    clash = set(left.columns) & set(columns) - {key}
    picked = right.select(key, *[F.col(c).alias(c + suffix if c in clash else c) for c in columns if c != key])
    return left.join(picked, key, "left")


def review_violations(review: DataFrame, key: str, decision: str) -> DataFrame:
    """Keys whose decisions aren't exactly one keep and one drop. Words: keep; drop, remove, delete, discard; without regard to case."""
    word = F.lower(F.trim(F.col(decision)))
    kept, dropped = F.count_if(word == "keep"), F.count_if(word.isin("drop", "remove", "delete", "discard"))
    return review.groupBy(key).agg(kept.alias("n_keep"), dropped.alias("n_drop"), F.count("*").alias("n")).where("n_keep <> 1 or n_drop <> 1 or n <> 2")


def drop_reviewed(df: DataFrame, review: DataFrame, keys: list[str], decision: str) -> DataFrame:
    """ANTI join against the reviewed rows to be dropped. An invalid review raises ValueError."""
    if not review_violations(review, keys[0], decision).isEmpty():
        raise ValueError("a reviewed key must have exactly one keep and one drop")
    gone = review.where(F.lower(F.trim(F.col(decision))).isin("drop", "remove", "delete", "discard"))
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def in_split(df: DataFrame, splits: DataFrame, key: str, split: str) -> DataFrame:
    """SEMI join: rows whose key is assigned to a split."""
    return df.join(splits.where(F.col("split") == split).select(key), key, "left_semi")


def split_overlaps(splits: DataFrame, key: str) -> DataFrame:
    """Keys in more than one split; empty where the splits are disjoint."""
    return splits.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def candidates(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """EXCEPT on keys: distinct non-null keys of the left that the right hasn't."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key), key, "left_anti")


def union_keep_first(tables: Sequence[tuple[str, DataFrame]], key: str, tag: str) -> DataFrame:
    """UNION by name of tagged tables; of a key in several, the row of the earliest table is kept. Missing columns are null.

    Within one table keys should be unique; of repeats an arbitrary, but always the same, one is kept.
    """
    out = None
    for i, (name, df) in enumerate(tables):
        part = df.withColumn(tag, F.lit(name)).withColumn("__order", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "__order")]
    first = F.min(F.struct("__order", *rest)).alias("__m")
    return out.groupBy(key).agg(first).select(key, *[F.col(f"__m.{c}").alias(c) for c in rest])


def members_of_repeats(df: DataFrame, key: str) -> DataFrame:
    """All rows whose non-null key occurs more than once. The repeated keys are counted first, so no window holds a hot key."""
    again = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_members")).where("n_members > 1")
    return df.join(again, key)


def compare_rankings(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """FULL OUTER join of two rankings (key, rank) -> (key, rank_a, rank_b, delta); a side that lacks the key is null."""
    return a.select(key, F.col("rank").alias("rank_a")).join(b.select(key, F.col("rank").alias("rank_b")), key, "full").withColumn("delta", F.col("rank_a") - F.col("rank_b"))


def override_where(df: DataFrame, new: DataFrame, key: str, columns: Sequence[str], unless: Column) -> DataFrame:
    """Values of `columns` from `new` where it has the key and `unless` doesn't hold; the old ones elsewhere."""
    picked = new.select(key, F.lit(True).alias("__has"), *[F.col(c).alias("__new_" + c) for c in columns])
    joined = df.join(picked, key, "left")
    take = F.col("__has") & ~F.coalesce(unless, F.lit(False))
    return joined.withColumns({c: F.when(take, F.col("__new_" + c)).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, label, n): rows that survive each predicate and all before it, in one scan. Null counts as false."""
    held, aggs = F.lit(True), [F.count("*").alias("s0")]
    for i, (_, p) in enumerate(steps, 1):
        held = held & F.coalesce(p, F.lit(False))
        aggs.append(F.count_if(held).alias(f"s{i}"))
    labels = ["all", *[n for n, _ in steps]]
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("label"), F.col(f"s{i}").alias("n")) for i, n in enumerate(labels)])
    return df.agg(*aggs).select(F.inline(rows))


def violations(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(rule, n): rows that break each rule, in one scan. A rule that is null is broken."""
    aggs = [F.count_if(~F.coalesce(p, F.lit(False))).alias(f"v{i}") for i, (_, p) in enumerate(rules)]
    return df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").alias("n")) for i, (n, _) in enumerate(rules)])))


def bucket_rare(df: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """`df` with `<column>_bucketed`: values that occur fewer than `least` times become `other`. Nulls stay null."""
    often = df.groupBy(column).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(F.col(column).alias("__v"), F.lit(True).alias("__often"))
    return df.join(often, F.col(column) == F.col("__v"), "left").withColumn(f"{column}_bucketed", F.when(F.col(column).isNull(), F.col(column)).when(F.col("__often"), F.col(column)).otherwise(other)).drop("__v", "__often")


def group_prior(train: DataFrame, rows: DataFrame, by: Sequence[str], target: str, least: int = 10) -> DataFrame:
    """`rows` with `prior`: the mean target of the row's group in `train`; groups under `least` rows and unseen ones get the overall mean."""
    rates = train.groupBy(*by).agg(F.avg(F.col(target).cast("double")).alias("__rate"), F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    overall = train.agg(F.avg(F.col(target).cast("double")).alias("__all"))
    return rows.join(rates, list(by), "left").join(F.broadcast(overall)).withColumn("prior", F.coalesce("__rate", "__all")).drop("__rate", "__all")


def shared_pairs(df: DataFrame, group: Sequence[str], scene: str, member: str) -> DataFrame:
    """(group, a, b, weight): unordered pairs of members (a < b) that share a scene, with the number of scenes shared.

    Pairs are formed within a scene, so their number is bounded by the cast of a scene; repeats of a member in one are counted once.
    """
    here = df.where(F.col(member).isNotNull() & F.col(scene).isNotNull()).select(*group, scene, member).distinct()
    a, b = here.withColumnRenamed(member, "a"), here.withColumnRenamed(member, "b")
    return a.join(b, [*group, scene]).where("a < b").groupBy(*group, "a", "b").agg(F.count("*").alias("weight"))


def best_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], columns: Sequence[str], k: int = 1) -> DataFrame:
    """The first k rows of each group, with their `place`. Spark limits each map task's groups to k rows before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.select(*group, *columns, F.row_number().over(w).alias("place")).where(F.col("place") <= k)
