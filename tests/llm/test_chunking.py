from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptloom.llm.chunking import lay_out, rebuild, split_oversized
from scriptloom.llm.scenes import dialogue_text, once, speech_lengths


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", min_size=0, max_size=1500), st.sampled_from([(100, 10), (60, 20), (40, 0)]))
def test_pieces_cover_and_keep_the_limit(text, sizes):
    limit, overlap = sizes
    pieces = lay_out(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, _ in pieces:
        assert b - a <= limit
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
        assert b - c <= overlap + overlap // 3 + 1
    # pieces without their overlaps give the text again
    whole, at = "", 0
    for a, b, _ in pieces:
        whole += text[max(a, at) : b]
        at = b
    assert whole == text


def test_prefers_strong_boundaries():
    text = "\n".join("This is a line of speech, not too long." for _ in range(60))
    pieces = lay_out(text, 1200, 120)
    assert len(pieces) == -(-(len(text) - 120) // (1200 - 120))
    assert all(s == 4 for _, _, s in pieces)
    assert all(text[a - 1] == "\n" for a, _, _ in pieces[1:])


def test_without_any_boundary():
    assert [b - a for a, b, _ in lay_out("x" * 5000, 1200, 120)][0] <= 1200
    assert len(lay_out("x" * 5000, 1200, 120)) == 5


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "word " * 500), (4, "word " * 500), (None, "word " * 500), (5, "é" * 1201)]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("piece", F.lit("clash"))
    out = split_oversized(df, ["k"], "t").collect()
    n = {}
    for r in out:
        n[r["k"]] = n.get(r["k"], 0) + 1
        assert len(r["piece"]) <= 1200 and len(r["piece"]) == r["end_pos"] - r["start_pos"]
    assert n == {2: 1, 3: 1, 4: 6, None: 3, 5: 2}


def test_dialogue(spark):
    rows = [(1, [("A", "x"), ("B", None), (None, ""), ("C", "y")], "2021-01-01"), (1, [("A", "x"), ("B", None), (None, ""), ("C", "y")], "2021-01-02"), (2, None, "2021-01-01"), (3, [], "2021-01-01")]
    df = spark.createDataFrame(rows, "scene_id long, dialogue_units array<struct<speaker:string,text:string>>, loaded_at string")
    got = {r[0]: r[1] for r in once(df.select("scene_id", "loaded_at", dialogue_text().alias("t")), "t").collect()}
    assert got == {1: "x\ny", 2: "", 3: ""}


def test_breaks_inside_a_speech(spark):
    one = ("é" * 30 + " ") * 20
    rows = [(1, [("A", one + "\n\n" + one), ("B", None), ("B", one)]), (2, [("A", one + "\n" + one)])]
    df = spark.createDataFrame(rows, "k long, dialogue_units array<struct<speaker:string,text:string>>").select("k", dialogue_text().alias("t"), speech_lengths().alias("n"))
    cuts = lambda limit: {(r["k"], r["end_pos"], r["boundary"]) for r in split_oversized(df, ["k"], "t", limit, 120, "n").where("piece_no < n_pieces").collect()}
    got = cuts(700)
    assert (1, 622, "paragraph") in got and not any(b == "speech" for *_, b in got)
    assert (1, 1243, "speech") in cuts(1300)


def test_never_cuts_a_character():
    for text in ("x" + "e\u0301" * 1000, "👩\u200d👩\u200d👧" * 400, "a\r\n" * 900):
        for a, b, _ in lay_out(text, 1200, 120):
            assert a == 0 or text[a] not in "\u0301\u200d\n"
            assert b - a <= 1200 and (b == len(text) or text[b] not in "\u0301\u200d\n")
    # one character longer than the limit has to be cut
    long = "e" + "\u0301" * 3000
    assert all(b - a <= 1200 for a, b, _ in lay_out(long, 1200, 120)) and lay_out(long, 1200, 120)[-1][1] == len(long)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", min_size=0, max_size=900), st.integers(20, 100), st.integers(0, 49))
def test_awkward_sizes_keep_boundaries_and_end(text, limit, share):
    overlap = limit * share // 100
    if overlap >= limit // 2:
        return
    pieces = lay_out(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - a <= limit and abs(b - c - overlap) <= overlap // 3
    if "     " not in text and all(len(w) < limit // 10 for w in text.split()):
        assert all(s > 0 for _, _, s in pieces)


def test_rebuilt(spark):
    texts = {1: "", 2: "short", 3: "A word here. " * 300, 4: "x" * 4000, 5: "é\n" * 900}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    got = {r["k"]: r for r in rebuild(split_oversized(df, ["k"], "t"), ["k"], 1200, 120).collect()}
    for k, t in texts.items():
        assert got[k]["n_chars"] == len(t) and got[k]["digest"] == hashlib.md5(t.encode()).hexdigest()
        assert got[k]["in_order"] and got[k]["within_limit"] and got[k]["overlaps_kept"] and got[k]["was_cut"] == (len(t) > 1200)
    broken = split_oversized(df, ["k"], "t").where("k <> 3 or piece_no <> 2")
    assert {r["k"]: r["in_order"] for r in rebuild(broken, ["k"], 1200, 120).collect()}[3] is False
