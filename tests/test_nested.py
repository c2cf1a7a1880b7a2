from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.operators.nested import flat_tables, loads, tree_at, triples, unit_positions


def rows(spark):
    unit = lambda s, t: {"speaker": s, "text": t}
    records = {
        1: {"scenes": [{"scene_number": 1, "stage_direction": "INT.", "scene_description": ["a", "b"], "dialogue_units": [unit("A", "x"), None, ["B", "y"], ["C", None], {"dual": [unit("D", "p"), unit("E", "q")]}]}, None, {"scene_number": "2A", "dialogue_units": unit("F", "z")}]},
        2: {"acts": [{"act": 1, "scenes": [{"dialogue_units": []}, {"dialogue_units": [{"text": "t", "meta": {"revisions": [{"by": "X"}]}}]}]}, {"act": None}, {"scenes": [{"dialogue_units": [{"speaker": "S"}]}]}]},
        3: {"script": {"draft": 1, "scenes": json.dumps([{"dialogue_units": [["A", "b"]]}])}},
        4: {"scenes": None},
        5: {"scenes": [{"beats": {"dialogue_units": [unit("A", "deep")]}}]},
    }
    out = [(k, json.dumps(v, ensure_ascii=k % 2 == 0), f"2021-01-0{k}") for k, v in records.items()]
    out += [(1, json.dumps(records[1]), "2021-02-01"), (1, '{"scenes": [{', "2021-03-01"), (6, None, "2021-01-01"), (7, "", "2021-01-01"), (8, '{"a": NaN}', "2021-01-01"), (9, "12", "2021-01-01"), (None, "{}", "2021-01-01")]
    return spark.createDataFrame(out, "record_id long, payload string, loaded_at string").selectExpr("*", "'clash' as path", "1 as seq")


def test_units(spark):
    got = sorted(tuple(r) for r in unit_positions(rows(spark)).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 1, 4), (1, 1, 5), (1, 2, 1), (2, 2, 1), (2, 3, 1), (3, 1, 1), (5, 1, 1)]


def test_tables(spark):
    t = flat_tables(rows(spark))
    scenes = {(r["record_id"], r["scene_pos"]): r for r in t["scenes"].collect()}
    assert scenes[1, 1]["scene_description"] == "a\nb" and scenes[1, 1]["n_units"] == 5 and scenes[1, 2]["scene_number"] == "2A"
    assert (2, 1) in scenes and scenes[2, 1]["n_units"] == 0
    units = {tuple(r)[:3]: (r["speaker"], r["text"]) for r in t["units"].collect()}
    assert units[1, 1, 2] == ("B", "y") and units[1, 1, 3] == ("C", None) and units[2, 2, 1] == (None, "t") and units[2, 3, 1] == ("S", None)
    records = {r["record_id"]: (r["n_scenes"], r["n_units"]) for r in t["records"].collect()}
    assert records == {1: (2, 6), 2: (3, 2), 3: (1, 1), 4: (0, 0), 5: (1, 1)}


def test_triples_round_trip():
    payload = json.dumps({"a": 1, "scenes": [{"x": "y", "dialogue_units": [{"speaker": "S", "text": "T", "meta": {"page": 3}}]}]})
    got = [(p, v, s, u) for p, v, s, u in triples(payload)]
    assert ("$.a", "1", 0, 0) in got and ("$.scenes[].dialogue_units[].meta.page", "3", 1, 1) in got
    assert triples("nope") is None and triples(None) is None and triples("[1,]") is None and triples("{} x") is None


def test_empty(spark):
    assert unit_positions(rows(spark).where("record_id > 99")).count() == 0


def test_odd_values(spark):
    payloads = [(1, '{"scenes": [{"dialogue_units": [{"speaker": "\\ud800x", "text": "\\ud83d\\ude00"}]}]}'), (2, '{"n": ' + "9" * 5000 + "}"), (3, "[" * 900 + "]" * 900), (4, "[" * 90_000 + "]" * 90_000), (5, '{"scenes": [1, "x", [], {"dialogue_units": "just text"}]}')]
    df = spark.createDataFrame([(k, p, "2021-01-01") for k, p in payloads], "record_id long, payload string, loaded_at string")
    t = flat_tables(df)
    assert [(r["speaker"], r["text"]) for r in t["units"].orderBy("record_id").collect()] == [("\ufffdx", "\U0001f600"), (None, "just text")]
    assert t["scenes"].where("record_id = 5").count() == 4
    assert t["records"].where("record_id = 2").count() == 1


def test_depth_has_no_bound(spark):
    deep = '{"scenes": [{"x": ' + "[" * 50_000 + '{"dialogue_units": ' + "[" * 50_000 + '["A", "b"]' + "]" * 50_000 + "}" + "]" * 50_000 + ', "dialogue_units": ["last"]}]}'
    df = spark.createDataFrame([(1, deep, "2021-01-01"), (2, '{"scenes": [{"scenes": [{"dialogue_units": ["in"]}], "dialogue_units": [["out"], ["out"]]}]}', "2021-01-01")], "record_id long, payload string, loaded_at string")
    assert sorted(tuple(r) for r in unit_positions(df).collect()) == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (2, 1, 2), (2, 2, 1)]
    assert loads("[" * 100_000 + "]" * 99_999) is None


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["scenes", "dialogue_units", "speaker", "text", "k"]), x, max_size=3), max_leaves=12)


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, str | bool) else json.dumps(value)


@settings(max_examples=300, deadline=None)
@given(JSON, st.booleans(), st.integers(0, 60))
def test_reads_what_json_reads(value, indent, cut):
    text = json.dumps(value, indent=1 if indent else None)
    assert loads(text) == (plain(value) if isinstance(value, dict | list) else None)
    assert (triples(text) is None) == (not isinstance(value, dict | list))
    if isinstance(value, dict | list):
        assert tree_at(text, 0) == (loads(text), len(text))
    part = text[:cut]
    try:
        ok = isinstance(json.loads(part), dict | list)
    except ValueError:
        ok = False
    assert (triples(part) is not None) == ok == (loads(part) is not None)


def test_own_field_of_a_unit_counts(spark):
    payload = json.dumps({"scenes": [{"dialogue_units": [{"meta": {"text": "zz", "speaker": "Z"}, "text": "own"}]}]})
    units = flat_tables(spark.createDataFrame([(1, payload, "2021-01-01")], "record_id long, payload string, loaded_at string"))["units"]
    assert [(r["speaker"], r["text"]) for r in units.collect()] == [("Z", "own")]
