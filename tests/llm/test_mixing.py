from __future__ import annotations

import os

import pytest

from pyspark.sql import functions as F

from scriptloom.llm.mixing import TOKENIZERS, count_tokens, mix_sources, tokenizer, whole_copies

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZERS), reason="no tokenizer files")


def test_tokens_round_trip():
    enc = tokenizer(TOKENIZERS)
    for t in ("", "Hello  world,\n\nit's 12 o'clock", "é–ü 你好 <|endoftext|>", " \t x"):
        assert enc.decode(enc.encode_ordinary(t)) == t
    for long in ("some words " * 3_000, "x" * 12_000, "ab 12  \n\n  cd " * 900, "no-blank\n" * 2000, "it 's  the   end " * 700):
        assert count_tokens(long, enc, 1000) == len(enc.encode_ordinary(long)), long[:20]


def test_mix(spark):
    text = {"a": "alpha beta gamma delta", "b": "one two three four", "c": "red green blue pink"}
    rows, k = [], 0
    for s, n in (("a", 600), (" B ", 300), ("c", 60), (None, 40), ("other", 30)):
        for _ in range(n):
            rows.append((k, text.get((s or "a").strip().lower(), text["b"]), s))
            k += 1
    rows += [(9001, None, "a"), (9002, "", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = spark.createDataFrame([("A", 0.4, 2), ("b", 0.3, 2), ("c", 0.3, 3), (None, 0.1, 1)], "source string, target_weight double, max_repeats int")
    mix, report = mix_sources(d, w)
    rep = {r["source"]: r for r in report.collect()}
    assert set(rep) == {"A", "b", "c", None} and [s for s in rep if rep[s]["reachable"] is False] == ["c"]
    kinds = {r["kind"]: r for r in report.where("source is null").collect()}
    assert kinds["unlisted"]["own_docs"] == 30 and kinds["unlisted"]["mixed_tokens"] == 0 and kinds["unnamed"]["own_docs"] == 40
    assert abs(sum(r["actual_share"] for r in report.collect()) - 1) < 1e-9 and rep["A"]["converged"]
    got = mix.collect()
    assert len(got) == len(rows)
    cap = {"a": 2, "b": 2, "c": 3}
    assert all(r["copies"] <= cap.get(r["source"], 3) and r["rate"] >= 0 for r in got)
    total = rep["A"]["total_tokens"]
    assert abs(rep["A"]["mixed_tokens"] / total - 0.4) < 0.05 and abs(rep["b"]["mixed_tokens"] / total - 0.3) < 0.05
    # c can't reach its share and gets all it may have
    assert all(r["copies"] == 3 for r in got if r["source"] == "c")


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    w = spark.createDataFrame([("a", 1.0, 2)], "source string, target_weight double, max_repeats int")
    mix, report = mix_sources(d, w)
    assert mix.count() == 0 and report.first()["own_tokens"] == 0 and report.count() == 3
    mix, report = mix_sources(spark.createDataFrame([(1, "x", "a")], d.schema), w.where("false"))
    assert mix.count() == 1 and report.where("kind = 'listed'").count() == 0


def test_reachable_total_gives_exact_shares(spark):
    rows = [(i, "one two three four five " * (1 + i % 7), ("a", "b", "c")[(i % 10 > 5) + (i % 10 > 8)]) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 2), ("c", 0.5, 3)], "source string, target_weight double, max_repeats int")
    first = {r["source"]: r for r in mix_sources(d, w)[1].collect()}
    assert [s for s in first if first[s]["reachable"] is False] == ["c"]
    _, report = mix_sources(d, w, total=int(first["c"]["reachable_total"]))
    for r in report.where("kind = 'listed'").collect():
        assert r["reachable"] and abs(r["actual_share"] - r["target_weight"]) < 0.01
        assert abs(r["mixed_tokens"] - r["rate_tokens"]) <= 0.01 * r["rate_tokens"]


def test_copies_meet_the_rates(spark):
    """Sizes differ a thousandfold; one source holds most rows."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, "hot").otherwise("small").alias("source"), F.lit("listed").alias("kind"), (1 + F.pow(F.col("id") % 1000, 2) / 500).cast("long").alias("tokens"), F.when(F.col("id") % 9 > 0, 0.37).otherwise(2.61).alias("rate"))
    rows = rows.unionByName(spark.createDataFrame([(None, None, "unnamed", 5, 0.5), (90_001, "none", "listed", 5, 0.0)], "doc_id long, source string, kind string, tokens long, rate double"))
    got = whole_copies(rows)
    assert got.count() == 20_002
    for r in got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("c"), F.sum(F.col("tokens") * F.col("rate")).alias("r")).where("source in ('hot', 'small')").collect():
        assert abs(r["c"] - r["r"]) <= 0.005 * r["r"]
    assert got.where("abs(copies - rate) >= 1").count() == 0
