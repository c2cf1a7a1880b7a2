from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from scriptloom.llm.sampling import priority_ranges, proportional_sample, random_rank
from scriptloom.llm.terms import term_frequencies


def test_terms(spark):
    rows = [(1, ["Don’t stop -now", "don't", None]), (2, ["l'été 3x well-known--", "'tis"]), (3, []), (4, None), (5, ["don't"]), (6, ["DON'T ever"])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    got = {r["term"]: tuple(r)[1:] for r in term_frequencies(df, "t", rare_below=2, common_above=0.5).collect()}
    assert got["don't"] == (4, 3, "common") and got["now"] == (1, 1, "rare") and got["l'été"] == (1, 1, "rare")
    assert got["x"] == (1, 1, "rare") and "well-known--" in got and "tis" in got
    assert term_frequencies(df.where("k > 99"), "t").count() == 0


def test_random_rank_is_a_permutation(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("g"))
    got = {}
    for r in random_rank(df, ["g"], "id", 1, 16).collect():
        got.setdefault(r["g"], []).append(r["rnk"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def brute(counts, targets, floors, size):
    """Seats of the divisor method with floors, by picking priorities one by one."""
    cand = []
    for c, n in counts.items():
        for r in range(1, n + 1):
            if r <= floors[c]:
                cand.append((0.0, c, r))
            elif targets[c] > 0:
                cand.append(((r - 0.5) / targets[c], c, r))
    cand.sort()
    floor = sum(p == 0 for p, _, _ in cand)
    return Counter(c for _, c, _ in cand[: max(size, floor)])


def test_sample_against_brute_force(spark):
    rnd = random.Random(3)
    counts = {("a", "x"): 900, ("a", "y"): 40, ("b", "x"): 3, ("b", "y"): 200, ("c", "x"): 0}
    targets = {("a", "x"): 400, ("a", "y"): 301, ("b", "x"): 99, ("b", "y"): 200, ("c", "x"): 0}
    floors = {("a", "x"): 2, ("a", "y"): 2, ("b", "x"): 5, ("b", "y"): 2, ("c", "x"): 1}
    rows, k = [], 0
    for (g, d), n in counts.items():
        for _ in range(n):
            rows.append((f"t{k}", g, d))
            k += 1
    rows += [("n1", None, "x"), ("n2", "zz", "x")]
    rnd.shuffle(rows)
    records = spark.createDataFrame(rows, "id string, g string, d string")
    plan = spark.createDataFrame([(*c, targets[c], floors[c]) for c in targets], "g string, d string, w int, f int")
    for size in (300, 5, 5000):
        sample, report = proportional_sample(records, "id", ["g", "d"], plan, "w", "f", size, buckets=8, ranges=32)
        got = Counter((r["g"], r["d"]) for r in sample.collect())
        assert got == brute(counts, targets, floors, size), size
        rep = {(r["g"], r["d"]): r for r in report.collect()}
        for c in targets:
            assert rep[c]["available"] == counts[c] and rep[c]["wanted"] == max(floors[c], math.ceil(targets[c] * size / 1000)) and rep[c]["taken"] == got.get(c, 0)
            assert rep[c]["short"] == (counts[c] < rep[c]["wanted"])  # whatever the rounding of the seats


def test_empty_pool(spark):
    records = spark.createDataFrame([], "id string, g string, d string")
    plan = spark.createDataFrame([("a", "x", 1000, 2)], "g string, d string, w int, f int")
    sample, report = proportional_sample(records, "id", ["g", "d"], plan, "w", "f", 10)
    assert sample.count() == 0 and [tuple(r)[2:] for r in report.collect()] == [(0, 10, 0, 10, True)]


def test_uneven_targets_fill_no_range(spark):
    """A target of 0.01 beside one of 200: no range of priorities holds more than 2% of the records."""
    records = spark.range(60_000).select(F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("id") % 20 == 0, "small").otherwise("large").alias("g"))
    plan = spark.createDataFrame([("small", 0.01, 1), ("large", 200.0, 1)], "g string, w double, f int")
    seats = random_rank(records.join(plan, "g"), ["g"], "id", 1, 64).withColumn("priority", F.when(F.col("rnk") <= 1, 0.0).otherwise((F.col("rnk") - 0.5) / F.col("w")))
    assert max(r["count"] for r in priority_ranges(seats, 256).groupBy("__b").count().collect()) <= 1200
    sample, report = proportional_sample(records, "id", ["g"], plan, "w", "f", 5000)
    assert {r["g"]: r["taken"] for r in report.collect()} == {"small": 1, "large": 4999} and sample.count() == 5000
    assert "Window" in report.where("short")._jdf.queryExecution().optimizedPlan().toString()
