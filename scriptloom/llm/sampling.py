"""Problem 3: a sample whose category shares follow target proportions, with a floor for small categories.

Divisor-method priorities. Each record gets a random rank in its category and the priority (rank - 0.5) / target; records
within the floor come first; the globally smallest priorities are kept. When a category is exhausted its seats fall to the
next priorities by themselves.

Neither ranking runs in one task. The random order is that of a digest of the key: its first digits split each category into
buckets of equal chance, bucket sizes are counted, and the rank is the size of all earlier buckets plus the rank within its
own bucket. The global cut falls into one of many ranges of priorities, bounded by approximate quantiles of the priorities
themselves, so that each holds about the same number of records however the targets differ; only that range is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def random_rank(df: DataFrame, group: list[str], key: str, seed: int, buckets: int) -> DataFrame:
    """`df` with `rnk`, 1..n in random order within each group. `key` must be unique; the same seed gives the same ranks."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    drawn = df.withColumn("__h", digest).withColumn("__b", F.floor(F.conv(F.substring("__h", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int"))
    sizes = drawn.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).drop("__n")
    ranked = drawn.withColumn("__r", F.row_number().over(W.partitionBy(*group, "__b").orderBy("__h", key)))
    return ranked.join(before, [*group, "__b"]).withColumn("rnk", F.col("__r") + F.coalesce("__before", F.lit(0))).drop("__h", "__b", "__r", "__before")


def priority_ranges(seats: DataFrame, ranges: int) -> DataFrame:
    """`seats` with `__b`, the place of their priority among approximate quantiles; -1 for seats of the floors (priority 0)."""
    probes = [i / ranges for i in range(1, ranges)]
    cuts = seats.where("priority > 0").agg(F.coalesce(F.percentile_approx("priority", probes, F.lit(20 * ranges)), F.array().cast("array<double>")).alias("__cuts"))
    at = F.when(F.col("priority") == 0, -1).otherwise(F.size(F.filter(F.array_distinct("__cuts"), lambda c: c < F.col("priority"))))
    return seats.join(F.broadcast(cuts)).withColumn("__b", at).drop("__cuts")


def normal_label(c: Column) -> Column:
    """A label without regard to case and surrounding white space."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def proportional_sample(
    records: DataFrame, key: str, category: list[str], targets: DataFrame, target: str, floor: str, size: int, seed: int = 42, buckets: int = 1024, ranges: int = 256
) -> tuple[DataFrame, DataFrame]:
    """The sample (key, category, rnk, priority) and a report with one row for each target category.

    `records` holds each key once; a null key or category matches no target and is never drawn. `targets` holds the
    category columns once each, a weight and a floor; both read as 0 where null. Floors are met first, even beyond `size`.
    Equal priorities are kept in the order of the category and the key. The report gives available (the last rank of the
    category), wanted (the greater of the floor and the rounded-up share of `size`), taken (records of the sample), short_by
    and `short`: the sample took fewer than wanted and no record is left to take. A category that got fewer because its
    share was rounded down is not short. No records give an empty sample and a report of zeros. The ranked
    records (key, category, rank, priority) are written to the shared checkpoint folder.
    """
    plan = targets.select(*category, F.coalesce(F.col(target), F.lit(0)).cast("double").alias("__t"), F.coalesce(F.col(floor), F.lit(0)).alias("__f"))
    weights = plan.agg(F.sum("__t").alias("__all"))
    plan = plan.join(F.broadcast(weights))
    pool = records.select(key, *category).where(F.col(key).isNotNull()).join(plan, category)
    ranked = random_rank(pool, category, key, seed, buckets)
    # floors sort before everything else; a category of weight 0 is only drawn for its floor
    ranked = ranked.withColumn("priority", F.when(F.col("rnk") <= F.col("__f"), 0.0).when(F.col("__t") > 0, (F.col("rnk") - 0.5) / F.col("__t")))
    # written once, as quantiles, ranges, sample and report all read it
    seats = cut(ranked.select(key, *category, "rnk", "priority"))
    placed = priority_ranges(seats.where("priority is not null"), ranges)
    steps = placed.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__upto", F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)))
    # whole ranges up to the cut are in; the range that crosses it is ranked and gives the rest
    edge = steps.where((F.col("__upto") > size) & (F.col("__b") >= 0)).agg(F.min("__b").alias("__cut"), F.min_by(F.col("__upto") - F.col("__n"), "__b").alias("__have"))
    marked = placed.join(F.broadcast(edge))
    inside = marked.where("__cut is null or __b < __cut")
    rest = marked.where("__b = __cut").withColumn("__r", F.row_number().over(W.partitionBy("__b").orderBy("priority", *category, key))).where(F.col("__r") <= F.greatest(F.lit(0), F.lit(size) - F.col("__have"))).drop("__r")
    sample = inside.unionByName(rest).select(key, *category, "rnk", "priority")
    available = seats.groupBy(*category).agg(F.max("rnk").alias("available"))
    taken = sample.groupBy(*category).agg(F.count("*").alias("taken"))
    wanted = F.greatest(F.coalesce(F.ceil(F.round(F.try_divide(F.col("__t") * size, F.col("__all")), 9)), F.lit(0)), F.col("__f").cast("long"))
    report = (
        plan.join(taken, category, "left")
        .join(available, category, "left")
        .select(*category, F.coalesce("available", F.lit(0)).alias("available"), wanted.alias("wanted"), F.coalesce("taken", F.lit(0)).alias("taken"))
        .withColumn("short_by", F.greatest(F.lit(0), F.col("wanted") - F.col("available")))
        .withColumn("short", (F.col("taken") < F.col("wanted")) & (F.col("available") < F.col("wanted")))
    )
    return sample, report
