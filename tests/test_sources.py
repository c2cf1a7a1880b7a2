from __future__ import annotations

import json
import re
from datetime import datetime, timezone

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from scriptloom.operators import models, reports
from scriptloom.sources import readers, sinks
from scriptloom.streaming.events import first_deliveries, windowed_counts


def test_scripts(spark, tmp_path):
    good, bad = tmp_path / "train.jsonl", tmp_path / "bad.jsonl"
    good.write_text(json.dumps({"movie_name": "Film_1999", "imdb_id": "tt0000001", "script": "<script/>"}) + "\n\n")
    bad.write_text("{nope\n")
    r = readers.read_scripts(spark, {"train": str(good)}).first()
    assert (r["title"], r["year_in_title"], r["origin_split"], r["script_char_len"]) == ("Film", 1999, "train", 9)
    assert "script" not in readers.read_scripts(spark, {"train": str(good)}, with_script=False).columns
    with pytest.raises(Exception):
        readers.read_scripts(spark, {"x": str(bad)}).collect()


def test_ratings_and_unified(spark, tmp_path):
    csv = tmp_path / "r.csv"
    csv.write_text(readers.RATINGS.replace(", ", ",").replace(" long", "").replace(" string", "").replace(" int", "").replace(" double", "") + "\n1,tt0000001,T,T,2001-02-03,,5,10,,,,,,,1.0,Released,\"['A', 'B']\",D,[],[]\n")
    r = readers.read_ratings(spark, str(csv)).first()
    assert r["genres_parsed"] == ["A", "B"] and r["release_year_parsed"] == 2001
    j = tmp_path / "u.jsonl"
    recs = [{"imdb_id": "a", "raw_script": "xx", "scenes": [{"heading": "H", "elements": [{"type": "dialogue", "name": "N", "text": "t"}]}]}, {"imdb_id": "a", "raw_script": "x"}, {"imdb_id": "b", "scenes": None}]
    j.write_text("\n".join(map(json.dumps, recs)))
    best = readers.keep_best_unified(readers.read_unified(spark, str(j)))
    assert {r["imdb_id"]: r["raw_script"] for r in best.collect()} == {"a": "xx", "b": None}
    assert readers.unified_units(best).count() == 2
    assert readers.id_validity(best).first()["valid"] == 0


def test_lookup_and_query(spark, tmp_path):
    rec = tmp_path / "rec.jsonl"
    rec.write_text(json.dumps({"imdb_id": "tt0000001", "budget": 5.0, "revenue": 0}) + "\n")
    spark.dataSource.register(readers.RecordedLookup)
    got = {r["imdb_id"]: (r["budget"], r["revenue"], r["status"]) for r in spark.read.format("recorded_lookup").options(path=str(rec), ids="tt0000001,tt0000002").load().collect()}
    assert got == {"tt0000001": (5.0, None, "ok"), "tt0000002": (None, None, "not_found")}
    assert '"tt0000001"' in readers.value_query(["tt0000001"])
    with pytest.raises(ValueError):
        readers.value_query(['tt1" }'])


def test_cache_and_ledger(spark, tmp_path):
    schema = "k string, v int, at timestamp_ntz"
    assert sinks.read_cache(spark, str(tmp_path / "none"), schema).count() == 0
    cache = spark.createDataFrame([("a", 1, None)], schema)
    asked = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    calls = []

    def fetch(df):
        calls.append(sorted(r["k"] for r in df.collect()))
        return df.select("k", F.lit(2).alias("v"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"))

    got, new = sinks.enrich_cached(asked, cache, fetch, "k", "at")
    assert {r["k"]: r["v"] for r in got.collect()} == {"a": 1, "b": 2} and calls == [["b"]] and new.count() == 2
    got, _ = sinks.enrich_cached(asked, cache, fetch, "k", "at", refresh=True)
    assert {r["k"]: r["v"] for r in got.collect()} == {"a": 2, "b": 2}
    with sinks.run_ledger(spark, str(tmp_path), "one", "r", {"x": 1}) as run:
        run.record("metrics", {"auc": 0.5})
    with pytest.raises(RuntimeError):
        run.record("late", {})
    assert sinks.read_runs(spark, str(tmp_path)).first()["latest"]
    films = spark.createDataFrame([("a", "long text")], "imdb_id string, script string")
    master, _ = sinks.save_artefacts(films, films, str(tmp_path / "out"))
    assert spark.read.parquet(master).columns == ["imdb_id"]


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i // 4}:{10 * (i % 4):02d}:00", "ab"[i % 2], float(i)) for i in range(12)]
    df = spark.createDataFrame(rows + rows[:3], "id long, ts string, kind string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(first_deliveries(stream, "id", "ts"), "ts", "kind", "v", late=None).writeStream.format("memory").queryName("out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in windowed_counts(first_deliveries(df, "id", "ts"), "ts", "kind", "v").collect()}
    got = {tuple(r) for r in spark.sql("select * from out").collect()}
    assert got and got <= batch


def test_cells_of_runs(spark, tmp_path):
    root = str(tmp_path / "ledger")
    train = spark.createDataFrame([(float(i), float(i % 2)) for i in range(20)], "a double, label double")
    for at, name, params, metrics in (
        (1, "m_f", {"matrix": "standalone_x", "family": "f"}, {"t": {"auc": 0.5}, "_ids": {"x": 1.0}}), (2, "m_f", {"matrix": "standalone_x", "family": "f"}, {"t": {"auc": 0.75}}),
        (3, "m_f", {"matrix": "standalone_x", "family": "f", "mode": "smoke"}, {"t": {"auc": 0.99}}), (4, "m_g", {"matrix": "all_five", "family": "g"}, {"t": {"auc": 0.75}}), (5, "stack", {"kind": "stack"}, {"t": {"auc": 1.0}}),
    ):
        with sinks.run_ledger(spark, root, "p", name, params, datetime(2024, 1, at, tzinfo=timezone.utc)) as run:
            run.record("metrics", {"per_target": metrics})
    cells = sinks.read_cells(spark, root, "p")
    assert sorted((r["matrix"], r["family"], r["target"], r["value"]) for r in cells.collect()) == [("all_five", "g", "t", 0.75), ("standalone_x", "f", "t", 0.75)]
    best = reports.winner(cells.withColumn("eval_set", F.lit("oof_global")).withColumn("tier", F.lit("primary")), "t", "auc", minimised=False)
    assert [tuple(r) for r in best.collect()] == [("standalone_x", "f", 0.75)]
    assert reports.winner(cells.withColumn("eval_set", F.lit("x")).withColumn("tier", F.lit("primary")), "t", "auc", minimised=False).count() == 0
    assert [r["at"][:8] for r in sinks.read_runs(spark, root).where("latest and name = 'm_f'").collect()] == ["20240103"]
    with sinks.run_ledger(spark, root, "p", "fit") as run:
        path = run.save_model(models.build_pipeline("linear", "classification", ["a"], maxIter=5).fit(train))
    assert PipelineModel.load(path).transform(train).count() == 20
    with pytest.raises(ZeroDivisionError), sinks.run_ledger(spark, root, "p", "broken"):
        1 / 0
    assert sinks.read_runs(spark, root).where("name = 'broken'").count() == 0


def test_caches_and_skips(spark, tmp_path):
    path = str(tmp_path / "cache")
    sinks.write_cache(spark.range(3), path)
    sinks.write_cache(spark.read.parquet(path).union(spark.range(10, 12)), path)
    assert spark.read.parquet(path).count() == 5
    made = []

    def build():
        made.append(1)
        return spark.range(len(made))

    assert [sinks.unless_there(spark, path + "2", build, again).count() for again in (False, False, True)] == [1, 1, 2]


def test_answers(spark):
    body = json.dumps({"results": {"bindings": [{"imdb": {"value": "tt1"}, "cost": {"value": "5"}, "costUnit": {"value": readers.US_DOLLAR}}, {"imdb": {"value": "tt1"}, "cost": {"value": "9"}, "costUnit": {"value": "eur"}, "revenue": {"value": "x"}, "revenueUnit": {"value": readers.US_DOLLAR}}, {}]}})
    rows = readers.answer_rows(spark.createDataFrame([(body,), ("nope",), (None,)], "b string"), "b")
    assert [tuple(r) for r in readers.largest_per_id(rows).collect()] == [("tt1", 5.0, None)]
    ids = spark.createDataFrame([(f"tt{i:07d}",) for i in range(50)] + [("bad",), (None,)], "imdb_id string")
    texts = [r["query"] for r in readers.value_queries(ids, batch=20).collect()]
    assert sum(t.count('"tt') for t in texts) == 50 and all(readers.value_query(sorted(re.findall(r"tt\d+", t))) == t for t in texts)


def test_galleries_and_gaps(spark):
    df = spark.createDataFrame([("a|b", 1.0, None), ("c", 0.5, "x\ny")], "n string, v double, t string")
    assert reports.markdown_table(df, [F.col("v")], 1) == "| n | v | t |\n|---|---|---|\n| c | 0.500 | x y |\n"
    assert "a\\|b" in reports.markdown_table(df, [F.desc("v")], 1)
    rows = spark.createDataFrame([("f", "rmse", "train", 1.0), ("f", "rmse", "oof", 3.0), ("f", "auc", "train", 0.9)], "family string, metric string, eval_set string, value double")
    assert {r["metric"]: r["gap"] for r in reports.fold_gap(rows, ["family"], ["rmse"]).collect()} == {"rmse": 2.0, "auc": None}
    assert models.grid_size("random_forest") == 2


def test_recorded_answers(spark):
    held = spark.createDataFrame([("a", 5.0, 0.0, None), ("a", 7.0, None, 1.0), (None, 1.0, 1.0, 1.0)], "imdb_id string, budget double, revenue double, vote_average double")
    ids = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "imdb_id string")
    assert sorted(tuple(r) for r in readers.recorded_answers(held, ids).collect()) == [("a", 7.0, None, 1.0, "ok"), ("b", None, None, None, "not_found")]
