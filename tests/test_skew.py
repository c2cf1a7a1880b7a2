"""Hot keys, nulls, ties, repeated rows, empty tables and extra columns for the operators that reshape whole tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import attribution, calibration, dedupe, graph, relational, reports, screenplay, sequence, stats
from scriptloom.operators.ranking import row_numbers, running_sums


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows share a key, a third of the values are equal, some are null, and columns clash with inner names."""
    rnd = random.Random(11)
    rows = [(i, "hot" if i % 3 else rnd.choice(["a", "b", None]), 1.0 if i % 3 == 1 else rnd.random() if i % 50 else None, i % 7) for i in range(3000)]
    return spark.createDataFrame(rows + rows[:20], "id long, k string, v double, s int").withColumns({"n": F.lit("x"), "rank": F.lit(0), "rn": F.lit(-1)})


def test_running_sums(hot):
    rows = [(r["k"], r["v"]) for r in hot.collect() if r["v"] is not None]
    got = {(r["k"], r["v"]): r for r in running_sums(hot, "v", {"c": F.count("*")}, ["k"], ranges=8).collect()}
    n = Counter(rows)
    assert {key: r["c"] for key, r in got.items()} == n
    for k in {k for k, _ in rows}:
        values = sorted(v for h, v in n if h == k)
        before = 0
        for v in values:
            assert got[k, v]["before_c"] == before
            before += n[k, v]
        assert got[k, values[0]]["all_c"] == before


def test_groups(hot):
    counts = Counter(r["k"] for r in hot.collect())
    assert {r["k"]: r["total"] for r in stats.pivot_counts(hot, "k", "s", [str(i) for i in range(7)]).select("k", F.col("total")).collect()} == dict(counts)
    often = relational.bucket_rare(hot, "k", 400)
    assert {r["k_bucketed"] for r in often.select("k_bucketed").distinct().collect()} == {None, "hot", "Other"} and often.count() == hot.count()
    assert relational.members_of_repeats(hot, "id").count() == 40
    pairs = relational.shared_pairs(hot.withColumn("m", F.col("s").cast("string")), ["k"], "id", "m")
    assert pairs.count() == 0
    best = relational.best_per_group(hot, ["k"], [F.desc_nulls_last("v"), F.col("id")], ["id", "v"], 2)
    assert best.groupBy("k").count().where("count > 2").count() == 0


def test_sequences(hot):
    seq = sequence.numbered(hot.where("k is not null"), "k", ["id", "n"], "v", block="s")
    per = {r["k"]: (r["m"], r["c"], r["n"]) for r in seq.groupBy("k").agg(F.max("i").alias("m"), F.count_distinct("i").alias("c"), F.max("n").alias("n")).collect()}
    assert all(m + 1 == c == n for m, c, n in per.values())
    plain = sequence.numbered(hot.where("k = 'a'"), "k", ["s", "id", "n"], "v")
    block = sequence.numbered(hot.where("k = 'a'"), "k", ["id", "n"], "v", block="s")
    assert [r["value"] for r in plain.orderBy("i").collect()] == [r["value"] for r in block.orderBy("i").collect()]


def test_sets_and_intervals(hot):
    rows = hot.withColumn("y", (F.col("s") > 3).cast("int"))
    sets = calibration.class_sets(rows.where("v is not null"), calibration.class_quantiles(rows, "v", "y", [0.5, 0.9]), "v")
    cover = {r["level"]: r["coverage"] for r in calibration.set_coverage(sets, "y").collect()}
    assert cover[0.5] >= 0.5 and cover[0.9] >= 0.9
    out = calibration.interval_coverage(rows.withColumn("t", F.col("s").cast("double")), "t", "v", [0.8]).first()
    assert out["coverage"] >= 0.8
    assert calibration.class_quantiles(rows.where("false"), "v", "y", [0.5]).count() == 0


def test_attributions(hot):
    long = attribution.linear_contributions(hot, hot, "id", {"v": 2.0, "s": -1.0})
    total = long.groupBy("feature").agg(F.round(F.sum("contribution"), 6).alias("t")).collect()
    assert all(abs(r["t"]) < 1e-3 for r in total)
    assert attribution.global_ranking(long).count() == 2
    assert attribution.top_per_row(long, "id", 1).count() == 3000


def test_empty_tables(hot, spark):
    none = hot.where("false")
    assert relational.funnel(none, [("p", F.col("v") > 0)]).agg(F.sum("n")).first()[0] == 0
    assert stats.describe(none, ["v"]).first()["q50"] is None
    assert stats.eta_squared(none, "k", "v").first()["eta_squared"] is None
    assert sequence.quartiles(sequence.numbered(none, "k", ["id"], "v"), "k").count() == 0
    assert reports.fold_summary(none, ["k"], "v").count() == 0
    units = spark.createDataFrame([], "f string, sc long, who string, t string")
    assert screenplay.scene_contributions(units, "f", "sc", "who", "t").count() == 0
    assert relational.group_prior(none.withColumn("y", F.lit(1)), hot, ["k"], "y").where("prior is not null").count() == 0


def test_scene_contributions(spark):
    rows = [("f", 1, "A", "xx"), ("f", 1, "B", "y"), ("f", 2, "A", "z"), ("f", 2, None, "q"), ("f", 3, "C", None), ("f", 3, "C", "")]
    got = {r["sc"]: r for r in screenplay.scene_contributions(spark.createDataFrame(rows, "f string, sc long, who string, t string"), "f", "sc", "who", "t").collect()}
    assert set(got) == {1, 2} and (got[1]["lines_without"], got[1]["chars_without"], got[1]["speakers_without"]) == (2, 2, 1)
    assert got[2]["speakers_without"] == 2


def test_keep_one_wide(spark):
    rows = [(i % 3 if i < 300 else i, "b" if i == 5 else "a", i) for i in range(900)] + [(None, "n", 1), (None, "m", 0)]
    df = spark.createDataFrame(rows, "k long, v string, at long").withColumns({"n": F.lit("x"), "__n": F.lit(1)})
    for most in (1000, 0):
        got = {(r["k"], r["v"], r["at"]) for r in dedupe.keep_one_wide(df, ["k"], [F.col("at")], ["k", "v", "at"], most).collect()}
        assert got == {(r["k"], r["v"], r["at"]) for r in dedupe.keep_one(df, ["k"], [F.col("at")], ["k", "v", "at"]).collect()}
        assert len(got) == 604 and (None, "m", 0) in got
    assert dedupe.keep_one_wide(df.where("false"), ["k"], [F.col("at")], ["k", "v"]).count() == 0


def test_heavy_ties(hot):
    """A value in a third of the rows: ranked by ranges of the key, the same as in one window."""
    few, many = ({r["id"]: r["rn"] for r in row_numbers(hot.dropDuplicates(["id"]).drop("rn"), "v", "id", tie_rows=t).collect()} for t in (10**6, 10))
    assert few == many and sorted(many.values()) == list(range(1, len(many) + 1))
    rows = hot.where("v is not null").select(F.col("v").alias("x"), F.col("s").cast("double").alias("y"))
    pdf = rows.toPandas()
    got = stats.pearson_spearman(hot.withColumn("s", F.col("s").cast("double")), "v", "s").first()
    assert got["n"] == len(pdf) and abs(got["pearson"] - pdf["x"].corr(pdf["y"])) < 1e-9 and abs(got["spearman"] - pdf["x"].rank().corr(pdf["y"].rank())) < 1e-9
    flat = stats.pearson_spearman(hot.withColumn("flat", F.lit(1.0)), "flat", "v").first()
    assert flat["pearson"] is None and flat["spearman"] is None


def test_hub_graph(spark):
    """A hub that is linked to everyone: triangles as counted by hand."""
    pairs = [("f", "hub", f"n{i:03d}", 1) for i in range(200)] + [("f", f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(0, 200, 2)]
    nodes = [("f", n, 5) for n in {x for p in pairs for x in p[1:3]}] + [("g", "a", 5)]
    got = {r["g"]: r["clustering"] for r in graph.clustering(spark.createDataFrame(nodes, "g string, m string, n_lines int"), spark.createDataFrame(pairs, "g string, a string, b string, weight int"), "g", "m").collect()}
    assert abs(got["f"] - (200 * 1.0 + 100 / (200 * 199 / 2)) / 201) < 1e-9 and got["g"] is None


def test_ordered_mtld(spark):
    rnd = random.Random(2)
    words = {g: [rnd.choice("abcdefghij") * rnd.randrange(1, 4) for _ in range(n)] for g, n in (("hot", 900), ("b", 60), ("short", 10), ("all", 0))}
    rows = [(g, k, w[k : k + 7]) for g, w in words.items() for k in range(0, len(w), 7)] + [("hot", 5000, None), ("uniq", 1, [f"w{i}" for i in range(80)])]
    rnd.shuffle(rows)
    got = {r["g"]: r["mtld"] for r in sequence.ordered_mtld(spark.createDataFrame(rows, "g string, k int, t array<string>"), "g", ["k"], "t").collect()}
    assert got["short"] is None and got["uniq"] is None
    for g in ("hot", "b"):
        assert abs(got[g] - sequence.mtld(words[g])) < 1e-9
