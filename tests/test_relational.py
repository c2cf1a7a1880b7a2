from __future__ import annotations

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.functions import scalars
from scriptloom.operators import metrics, models, relational, splits, stats
from scriptloom.operators.dedupe import keep_one
from scriptloom.operators.ranking import average_ranks, quantiles, row_numbers


def test_keep_one(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "z"), ("a", 1, "x"), (None, 5, "n"), (None, 4, "m")], "k string, o int, v string")
    assert sorted(map(tuple, keep_one(df, ["k"], [F.col("o")], ["k", "v"]).collect()), key=str) == [("a", "x"), (None, "m")]
    assert keep_one(df.where("false"), ["k"], [F.col("o")], ["k", "v"]).count() == 0


def test_ranks_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("ab"), float(rnd.randrange(20)) if rnd.random() < 0.6 else 7.0) for i in range(500)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    for group in ([], ["g"]):
        got = {(r["g"] if group else None, r["v"]): r["rank"] for r in average_ranks(df, "v", group).collect()}
        for g in {k[0] for k in got}:
            vals = sorted(v for _, h, v in rows if v is not None and (g is None or h == g))
            for v in set(vals):
                assert got[g, v] == vals.index(v) + (vals.count(v) + 1) / 2
    got = {r["id"]: r["rn"] for r in row_numbers(df, "v", "id", descending=True).collect()}
    want = [i for i, _, v in sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[0]))]
    assert [got[i] for i in want] == list(range(1, len(want) + 1))
    assert average_ranks(df.where("false"), "v").count() == 0
    # null is a group like any other
    some = df.withColumn("g", F.when(F.col("g") == "a", F.col("g")))
    assert row_numbers(some, "v", "id", ["g"]).count() == 500 and {r["g"] for r in average_ranks(some, "v", ["g"]).collect()} == {"a", None}


def test_quantiles(spark):
    import numpy as np

    rnd = random.Random(2)
    rows = [(rnd.choice(["a", None]), float(rnd.randrange(30))) for _ in range(301)] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles(df, "v", {"q1": 0.25, "m": 0.5, "top": 1.0}, ["g"]).collect()}
    assert set(got) == {"a", None}
    for g in got:
        v = [x for h, x in rows if h == g and x is not None]
        assert [got[g]["q1"], got[g]["m"], got[g]["top"]] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 1.0])))
    assert quantiles(df.where("false"), "v", {"m": 0.5}).first()["m"] is None


def test_joins_and_sets(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z")], "id string, title string")
    b = spark.createDataFrame([("1", "r", 3), ("9", "s", 4), (None, "t", 5)], "id string, title string, n int")
    got = {r["title"]: (r["title_rt"], r["n"]) for r in relational.left_enrich(a, b, "id", ["title", "n"]).collect()}
    assert got == {"x": ("r", 3), "y": (None, None), "z": (None, None)}
    with pytest.raises(KeyError):
        relational.left_enrich(a, b.drop("id"), "id", ["n"])
    assert [r["id"] for r in relational.candidates(b, a, "id").collect()] == ["9"]
    u = relational.union_keep_first([("a", a.where("id is not null")), ("b", b.where("id is not null"))], "id", "src")
    assert {(r["id"], r["src"]) for r in u.collect()} == {("1", "a"), ("2", "a"), ("9", "b")}
    review = spark.createDataFrame([("1", "x", "KEEP"), ("1", "w", "discard"), ("2", "y", "drop"), ("2", "v", "keep")], "id string, title string, decision string")
    assert [r["title"] for r in relational.drop_reviewed(a, review, ["id", "title"], "decision").orderBy("title").collect()] == ["x", "z"]
    with pytest.raises(ValueError):
        relational.drop_reviewed(a, review.where("title <> 'w'"), ["id", "title"], "decision")


def test_funnel_and_violations(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 0.0)], "id int, v double")
    assert [r["n"] for r in relational.funnel(df, [("has", F.col("v").isNotNull()), ("positive", F.col("v") > 0)]).orderBy("step").collect()] == [3, 2, 1]
    assert [r["n"] for r in relational.violations(df, [("positive", F.col("v") > 0)]).collect()] == [2]


def test_scalars(spark):
    df = spark.createDataFrame([("['A', 'B']", "Film_1999"), ('["Chad D\'Or"]', "No year"), ("", "x_99"), (None, None), ("[]", "a_b_2001"), ("['broken", "")], "l string, m string")
    got = df.select(scalars.list_column(F.col("l")).alias("l"), scalars.title_of(F.col("m")).alias("t"), scalars.year_of(F.col("m")).alias("y")).collect()
    assert [r["l"] for r in got] == [["A", "B"], ["Chad D'Or"], [], [], [], []]
    assert [(r["t"], r["y"]) for r in got] == [("Film", 1999), ("No year", None), ("x_99", None), (None, None), ("a_b", 2001), ("", None)]
    y = spark.createDataFrame([(None,), (1979,), (1980,), (2009,), (2010,), (2020,)], "y int")
    assert [r[0] for r in y.select(scalars.decade_of_five(F.col("y"))).collect()] == [None, "pre_1980s", "1980s", "2000s", "2010s_2020s", "2010s_2020s"]
    assert [r[0] for r in y.select(scalars.decade_of_six(F.col("y"))).collect()] == ["unknown", "pre_1980", "1980s", "2000s", "2010s", "2020s"]
    t = spark.createDataFrame([(None,), (0.0,), (5.0,), (10.0,), (99.0,)], "v double")
    assert [r[0] for r in t.select(scalars.tier(F.col("v"), [10, 50], ["low", "mid", "high"])).collect()] == ["unknown", "unknown", "low", "mid", "high"]
    s = spark.createDataFrame([("f=+0.1; g=-0.2; bad; h=x",)], "s string")
    assert [tuple(p) for p in s.select(scalars.attribution_pairs(F.col("s"))).first()[0]] == [("f", 0.1), ("g", -0.2)]
    assert spark.range(1).select(scalars.amount(F.lit("refer_25K")), scalars.amount(F.lit("1M")), scalars.amount(F.lit("x"))).first()[:] == (25000.0, 1e6, None)
    with pytest.raises(ValueError):
        scalars.money_log(F.lit(1.0), "cube")


def test_splits(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 997, "warm").otherwise("tiny").alias("s"), ((F.col("id") * 37) % 101).alias("h"))
    got = splits.stratified(df, "id", "s", "h", {"train": 0.7, "cal": 0.15, "test": 0.15}).groupBy("s", "split").count().collect()
    n = {(r["s"], r["split"]): r["count"] for r in got}
    assert n["hot", "train"] == 490 and n["hot", "cal"] == 105 and n["hot", "test"] == 105 and sum(n.values()) == 1000
    f = splits.folds(df, "id", "s", "h", 5).groupBy("s", "fold").count().collect()
    hot = [r["count"] for r in f if r["s"] == "hot"]
    assert max(hot) - min(hot) <= 1 and len(hot) == 5
    s = splits.strata(df, ["s"], 5)
    assert s.where("stratum = 'rare|rare'").count() == 3
    with pytest.raises(ValueError):
        splits.stratified(df, "id", "s", "h", {"a": 0.5})


def test_metrics_edges(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, p double")
    assert metrics.ranking_metrics(one, "y", "p").first()["auc"] is None
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (None, 0.3), (1, None)], "y int, p double")
    assert metrics.ranking_metrics(ties, "y", "p").first()["auc"] == pytest.approx(0.875)
    assert metrics.threshold_metrics(one.where("p > 1"), "y", "p").first()["f1"] in (None, 0.0)
    curve = metrics.reliability(one, "y", "p", 10, "equal_width").orderBy("bin").collect()
    assert [r["n"] for r in curve] == [0, 0, 0, 0, 0, 1, 0, 1, 0, 0]
    q = metrics.order_statistic(spark.range(1, 10).select(F.col("id").cast("double").alias("v")), "v", [0.5, 0.99, 0.0])
    assert {r["level"]: r["q"] for r in q.collect()} == {0.5: 5.0, 0.99: 9.0, 0.0: 1.0}
    lift = metrics.lift_by_chunk(spark.range(25).select("id", (F.col("id") % 2).cast("int").alias("y"), (-F.col("id")).cast("double").alias("p")), "y", "p", "id")
    assert [r["n"] for r in lift.orderBy("chunk").collect()] == [2] * 9 + [7]
    with pytest.raises(ValueError):
        metrics.reliability(one, "y", "p", 10, "other")


def test_bootstrap(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("y"), ((F.col("id") * 37) % 101 / 101 * 0.6 + F.col("id") % 2 * 0.3).alias("p"))
    names = ["rmse", "mae", "brier", "log_loss", "f1", "auc"]
    a, b = ({r["metric"]: r for r in metrics.bootstrap_intervals(x, "y", "p", "id", names, 200).collect()} for x in (df, df.repartition(7)))
    assert set(a) == set(names)
    for m in names:
        assert a[m]["low"] == pytest.approx(b[m]["low"]) and a[m]["low"] < a[m]["point"] < a[m]["high"]
    assert a["auc"]["point"] == pytest.approx(metrics.ranking_metrics(df, "y", "p").first()["auc"])
    # the spread is that of a mean of 400 values
    e = [abs(r["p"] - r["y"]) for r in df.collect()]
    sd = (sum(x * x for x in e) / 400 - (sum(e) / 400) ** 2) ** 0.5
    assert (a["mae"]["high"] - a["mae"]["low"]) / (2 * 1.96 * sd / 20) == pytest.approx(1.0, abs=0.25)
    assert metrics.bootstrap_intervals(df.where("id < 0"), "y", "p", "id", names, 20).count() == 0


def test_poisson_counts():
    c = metrics.poisson_counts(np.arange(2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 500, 1)
    assert c.mean() == pytest.approx(1.0, abs=0.01) and c.var() == pytest.approx(1.0, abs=0.02)
    assert abs(np.corrcoef(c[:-1, 0], c[1:, 0])[0, 1]) < 0.1 and abs(np.corrcoef(c[:, 0], c[:, 1])[0, 1]) < 0.1


def test_student_and_pairs(spark):
    assert models.student_cdf(0.0, 5) == pytest.approx(0.5) and models.student_cdf(2.015, 5) == pytest.approx(0.95, abs=1e-3) and models.student_cdf(-12.706, 1) == pytest.approx(0.025, abs=1e-4)
    rows = [("a", "m", i, 0.9 + i / 1000) for i in range(15)] + [("b", "m", i, 0.5) for i in range(15)] + [("c", "m", i, 0.5 if i < 3 else None) for i in range(15)]
    got = {(r["a"], r["b"]): r for r in models.paired_comparisons(spark.createDataFrame(rows, "family string, metric string, fold int, score double")).collect()}
    assert got["a", "b"]["winner"] == "a" and got["a", "c"]["winner"] == "rope" and got["a", "c"]["p_better"] is None or got["a", "c"]["n"] == 3


def test_stats_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), (None, 9.0)], "g string, y double")
    r = stats.eta_squared(df, "g", "y").first()
    assert r["eta_squared"] == pytest.approx(1.0) and r["f_stat"] is None
    assert stats.pearson_spearman(df.withColumn("x", F.col("y")).limit(2), "x", "y").first()["pearson"] is None
    assert [tuple(r) for r in stats.histogram(df, F.col("y"), 0.0, 10.0, 10).orderBy("bin").collect()] == [(2, 2), (3, 1), (10, 1)]


def test_every_list_is_parsed(spark, tmp_path):
    import __spark_entry__ as entry

    def brute(raw):
        raw = (raw or "").strip()
        if not re.fullmatch(r"\[.*\]", raw):
            return []
        try:
            return json.loads(raw.replace("'", '"'))
        except json.JSONDecodeError:
            return [p.strip().strip("'").strip('"') for p in raw.strip("[]").split(",") if p.strip()]

    lists = ["['Drama', 'Romance", "Drama, Thriller", "", None, "[]", "['A', 'B']", '["Sci-Fi, Fantasy", "B"]', "['Chad D'Or', 'X']", " ['A'] "]
    spark.createDataFrame([(i, v, "1999-05-01") for i, v in enumerate(lists)], "id int, genres_list string, release_date string").write.parquet(f"{tmp_path}/ratings.parquet")
    got = {r["id"]: r for r in entry.queries()["list_column_parse_all"](spark, str(tmp_path)).collect()}
    assert {i: r["genres"] for i, r in got.items()} == {i: brute(v) for i, v in enumerate(lists)}
    assert all(r["year"] == 1999 for r in got.values())
    d = "/root/testdata/sf0.1"
    raw = spark.read.parquet(f"{d}/ratings.parquet").select("id", "genres_list").collect()
    rows = entry.queries()["list_column_parse_all"](spark, d).collect()
    assert sorted((r["id"], r["genres"]) for r in rows) == sorted((r["id"], brute(r["genres_list"])) for r in raw)
