from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import scalars
from scriptloom.functions import text as tx
from scriptloom.operators import graph, screenplay, sequence, vector
from scriptloom.operators.models import topics


def lines(xml):
    return [(r[3], r[4]) for r in screenplay.read_script(xml) if r[0] == "line"]


def warnings(xml):
    return [r[7] for r in screenplay.read_script(xml) if r[0] == "warning"]


def scene(body):
    return f"<script><scene>{body}</scene></script>"


def test_who_speaks():
    c, dl, a, p = (lambda x: f"<character>{x}</character>"), (lambda x: f"<dialogue>{x}</dialogue>"), "<stage_direction>INT.</stage_direction>", "<parenthetical>beat</parenthetical>"
    assert lines(scene(c("BOB (V.O.) (CONT'D)") + p + dl("a") + dl("b"))) == [("BOB (V.O.)", "a"), ("BOB (V.O.)", "b")]
    assert lines(scene(c("BOB") + a + dl("a"))) == [("BOB", ""), ("", "a")]
    assert lines(scene(c("BOB") + c("EVE") + dl("a"))) == [("BOB", ""), ("EVE", "a")]
    assert lines(scene(c("BOB") + dl("a") + c("2001 FOX") + dl("b") + dl("c"))) == [("BOB", "a"), ("", "b"), ("", "c")]
    assert lines(scene(c("EVE"))) == [("EVE", "")]
    assert lines(scene(c("A &amp; B") + "<x/>" + "<x/>" + dl("ok"))) == [("A & B", "ok")]
    assert warnings(scene(c("A") + "<x/><x/>" + dl("ok"))) == ["unknown element: x"]
    assert warnings(scene(c("BOB") + c("EVE") + dl("a") + a + dl("b"))) == ["character without dialogue: BOB", "dialogue without a speaker"]
    assert warnings(scene(c("ACME Studios") + dl("a")))[0] == "implausible character: ACME Studios"
    for name, ok in (("PICTURES INC", False), ("PRODUCTIONS LLC", False), ("© X", False), ("1999 X", False), ("MOVING PICTURES", True), ("COPYRIGHT CLERK", True), ("MR PRODUCTIONS", True)):
        assert lines(scene(c(name) + dl("a"))) == [(name if ok else "", "a")]


def test_records_speak_as_scripts(spark):
    e = lambda t, x: {"type": t, "text": None if t == "character" else x, "name": x if t == "character" else None}
    scenes_ = [{"heading": " INT. ", "elements": [e("action", "rain"), e("character", "BOB (V.O.)"), e("parenthetical", "low"), e("dialogue", "a"), e("dialogue", "b"), e("transition", "x"), e("action", "wind"), e("dialogue", "c"), None]}, {"heading": None, "elements": None}]
    rows = list(screenplay.read_record(scenes_))
    assert [(r[3], r[4]) for r in rows if r[0] == "line"] == [("BOB", "a"), ("BOB", "b"), ("", "c")]
    assert [(r[5], r[6]) for r in rows if r[0] == "scene"] == [("INT.", "rain wind"), ("", "")]
    assert [r[7] for r in rows if r[0] == "warning"] == ["unknown element: transition", "dialogue without a speaker"]
    assert [r[7] for r in screenplay.read_record(None)] == ["no scenes"]
    kind = "id int, scenes array<struct<heading:string,elements:array<struct<type:string,text:string,name:string>>>>"
    df = spark.createDataFrame([(1, scenes_), (2, None), (3, [])], kind)
    got = {r["id"]: r for r in screenplay.structure(screenplay.parse_records(df, "id", "scenes"), "id").collect()}
    assert got[1]["n_lines"] == 3 and got[1]["n_scenes"] == 2 and got[2]["n_warnings"] == got[3]["n_warnings"] == 1


def test_names_of_features(spark):
    names = {"genre_Comedy": "Genre=Comedy", "topic_05_proportion": "Topic 05 proportion", "embed_pc_12": "Embedding PC 12", "log_n_scenes": "log(n_scenes)", "a_b": "a b", "genre_" + "x" * 300: "Genre=" + "x" * 300}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", scalars.readable_feature(F.col("n")).alias("r")).collect()
    assert {r["n"]: r["r"] for r in got} == names


def test_damaged_scripts(spark):
    for xml, w in ((None, "empty script"), ("", "empty script"), ("<script><scene>", "malformed script"), ("<script></script>", "no scenes")):
        assert warnings(xml) == [w]
    assert warnings("<film><scene><dialogue>x</dialogue></scene></film>")[0] == "unexpected root film"
    df = spark.createDataFrame([(1, None), (2, scene("<character>A</character><dialogue>hi</dialogue>")), (2, scene("<character>A</character>"))], "id long, xml string")
    got = {r["id"]: r for r in screenplay.structure(screenplay.parse_scripts(df, "id", "xml"), "id").collect()}
    assert got[1]["n_scenes"] == 0 and got[1]["n_warnings"] == 1 and got[1]["lines_per_scene"] is None
    assert got[2]["n_lines"] == 2 and got[2]["n_speakers"] == 1


def test_text(spark):
    df = spark.createDataFrame([("Don't stop. well-known THE 3x",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(tx.tokens(F.col("t"))).collect()]
    assert got == [["don't", "stop", "well-known", "the", "x"], None, []]
    w = spark.createDataFrame([("make",), ("table",), ("sky",), ("rhythm",), ("queue",)], "w string")
    assert [r[0] for r in w.select(tx.syllables(F.col("w"))).collect()] == [1, 2, 1, 1, 1]
    assert spark.range(1).select(tx.ensure_terminal_punctuation(F.lit("a")), tx.ensure_terminal_punctuation(F.lit("a!")), tx.truncate(F.lit("abcdef"), 3, "~")).first()[:] == ("a.", "a!", "abc~")
    assert spark.range(1).select(tx.ints_in(F.array(F.lit("scene 3 and scene 1"), F.lit("scene 3")), r"scene (\d+)")).first()[0] == [3, 1]


def test_mtld():
    assert sequence.mtld(["a"] * 49) is None
    assert sequence.mtld(["a"] * 50) == pytest.approx(2.0, abs=0.2)
    assert sequence.mtld([str(i) for i in range(60)]) is None


def series(spark, values):
    return sequence.numbered(spark.createDataFrame([("g", i, i // 10, v) for i, v in enumerate(values)], "g string, t int, b int, v double"), "g", ["t"], "v", block="b")


def test_quartiles(spark):
    import numpy as np

    for n in (1, 3, 4, 5, 10, 13, 101):
        v = [float((i * 7) % 5) for i in range(n)]
        r = sequence.quartiles(series(spark, v), "g").first()
        if n < 4:
            assert r["q1"] is None
        else:
            parts = np.array_split(np.array(v), 4)
            assert [r[f"q{k}"] for k in (1, 2, 3, 4)] == pytest.approx([p.mean() for p in parts])
            assert r["std_range"] == pytest.approx(max(p.std() for p in parts) - min(p.std() for p in parts))


def test_resample_and_arcs(spark):
    import numpy as np

    for n in (1, 2, 3, 20, 55):
        v = [math.sin(i) for i in range(n)]
        got = [r["value"] for r in sequence.resampled(series(spark, v), "g").orderBy("j").collect()]
        want = np.interp(np.linspace(0, n - 1, 20), np.arange(n), v) if n > 1 else [v[0]] * 20
        assert got == pytest.approx(list(want))
    arcs = sequence.arc_similarity(sequence.resampled(series(spark, [float(i) for i in range(30)]), "g"), "g").first()
    assert arcs["rise"] == pytest.approx(1) and arcs["fall"] == pytest.approx(-1)
    assert sequence.arc_similarity(sequence.resampled(series(spark, [1.0] * 30), "g"), "g").first()["rise"] is None


def cast(spark, scenes):
    rows = [("f", i, s) for i, who in enumerate(scenes) for s in who for _ in range(6)]
    df = spark.createDataFrame(rows, "film string, scene int, speaker string")
    nodes = graph.significant(df, "film", "speaker")
    return nodes, graph.edges(df, nodes, "film", "scene", "speaker")


def test_graphs(spark):
    nodes, edges = cast(spark, ["AB", "BC"])
    assert graph.density(nodes, edges, "film").first()["density"] == pytest.approx(2 / 3)
    assert graph.path_measures(nodes, edges, "film", "speaker").first()["max_betweenness"] == pytest.approx(1.0)
    nodes, edges = cast(spark, ["ABCDE"])
    assert graph.density(nodes, edges, "film").first()["density"] == 1.0
    assert graph.clustering(nodes, edges, "film", "speaker").first()["clustering"] == 1.0
    assert graph.node_measures(nodes, "film", "speaker").first()["gini"] == pytest.approx(0)
    nodes, edges = cast(spark, ["ABC", "DEF"])
    p = graph.path_measures(nodes, edges, "film", "speaker").first()
    assert p["n_components"] == 2 and p["diameter"] == 1 and p["modularity"] == pytest.approx(0.5) and p["top1_eigen"] == pytest.approx(3**-0.5)
    nodes, edges = cast(spark, ["A"])
    assert graph.path_measures(nodes, edges, "film", "speaker").count() == 0 and graph.density(nodes, edges, "film").first()["density"] is None


def test_vectors(spark):
    rows = [(i, [float(i), float(i % 3), 1.0], i % 2) for i in range(50)] + [(99, None, 1)]
    df = spark.createDataFrame(rows, "id long, v array<float>, g int")
    pooled = {r["g"]: r for r in vector.mean_pool(df, "g", "v").collect()}
    assert pooled[1]["n"] == 25 and pooled[0]["vector"][0] == pytest.approx(24.0)
    near = vector.nearest(df.where("id in (0, 10)"), df, "id", "v", 2, block=1).collect()
    assert {(r["query"], r["place"]): r["neighbour"] for r in near}[10, 1] in (9, 11) and len(near) == 4
    pcs = vector.pca(df.where("g = 0"), df, "id", "v", 2)
    assert pcs.count() == 50 and len(pcs.first()["pc"]) == 2


def test_topics_know_every_term(spark):
    common = [f"common{i}" for i in range(2100)]
    rows = [(i, common + ["filler"]) for i in range(6)] + [(i, ["rare", "filler"]) for i in range(6, 11)] + [(i, ["the", "filler"]) for i in range(11, 17)]
    df = spark.createDataFrame(rows, "id int, toks array<string>")
    shares, terms = topics(df, df, "id", "toks", 4, iterations=3)
    top = {r["id"]: max(r["shares"]) for r in shares.collect()}
    # a term beyond the 2,000 most frequent counts; stop words and terms of more than half of the rows don't
    assert all(top[i] > 0.3 for i in range(11)) and all(abs(top[i] - 0.25) < 1e-9 for i in range(11, 17))
    assert terms.where("term in ('the', 'filler')").count() == 0


def test_projection_of_all_vectors(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["pca_project"](spark, "/root/testdata/sf0.001").collect()
    assert {len(r["pc"]) for r in rows} == {32}
    # components fitted on all rows centre all rows
    assert all(abs(sum(r["pc"][i] for r in rows)) < 1e-3 * len(rows) for i in range(32))


def test_means_of_runs_are_added_in_order(spark):
    rows = [(f"g{g}", i, 66, round(math.sin(7 * g + i * i), 6)) for g in range(40) for i in range(66)]
    df = spark.createDataFrame(rows, "g string, i long, n long, value double").repartition(8, "value")
    got = {r["g"]: r for r in sequence.quartiles(df, "g").collect()}
    for g in range(40):
        own = [r[3] for r in rows if r[0] == f"g{g}"]
        for k, (a, b) in enumerate(((0, 17), (17, 34), (34, 50), (50, 66)), 1):
            total = 0.0
            for x in own[a:b]:
                total += x
            assert got[f"g{g}"][f"q{k}"] == total / (b - a)


def test_ties_are_rounded_as_by_sql(spark):
    import duckdb

    ratios = [(k, n) for n in (640, 1280, 1920, 2560, 3200) for k in range(1, n) if 2 * 10**6 * k % n == 0 and 10**6 * k % n]
    df = spark.createDataFrame([(k / n,) for k, n in ratios], "x double")
    got = [r[0] for r in df.select(scalars.rounded(F.col("x"), 6)).collect()]
    con = duckdb.connect()
    assert got == [con.execute("select round(?::double, 6)", [k / n]).fetchone()[0] for k, n in ratios]


def test_film_features_joins_written_groups(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["film_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and plan.count("LogicalRDD") == 3
