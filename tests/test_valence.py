from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import valence as va

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1}


def scaled(s):
    return s / math.sqrt(s * s + 15)


@pytest.mark.parametrize(
    ("text", "total"),
    [
        ("a good day", 1.9), ("very good", 1.9 + 0.293), ("barely good", 1.9 - 0.293), ("not good", 1.9 * -0.74), ("isn't good", 1.9 * -0.74), ("a GOOD day", 1.9 + 0.733), ("GOOD DAY", 1.9), ("good!!", 1.9 + 2 * 0.292),
        ("bad!!!!!!", -2.5 - 4 * 0.292), ("good??", 1.9 + 0.36), ("good?????", 1.9 + 0.96), ("good but bad", 0.5 * 1.9 - 1.5 * 2.5), ("so very good", 1.9 + 0.293 + 0.95 * 0.293), ("nothing here!!", 0.0), ("", 0.0), ("very bad", -2.5 - 0.293),
    ],
)
def test_rules(text, total):
    assert va.valence(text, LEXICON) == pytest.approx(scaled(total))


def test_lexicons(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("good\t1.9\tx\nGood\t5\nbad\t-2.5\nodd\tnope\n'quoted\t1\n")
    (tmp_path / "e.tsv").write_text("good\tjoy\t1\nbad\tjoy\t0\nbad\tfear\t1\n")
    assert va.read_valence(spark, str(tmp_path / "v.tsv")) == {"good": 1.9, "bad": -2.5, "'quoted": 1.0}
    emotions = va.read_emotions(spark, str(tmp_path / "e.tsv"))
    assert emotions == {"joy": ("good",), "fear": ("bad",)}
    df = spark.createDataFrame([(["the", "good", "bad", "x"],), (["the"],), (None,)], "t array<string>")
    got = [tuple(r) for r in df.select(*va.emotion_shares(F.col("t"), emotions, ("the",))).collect()]
    assert got == [(pytest.approx(1 / 3), pytest.approx(1 / 3)), (None, None), (None, None)]
    with pytest.raises(ValueError):
        va.with_valence(df, "t", {str(i): 1.0 for i in range(va.MOST_WORDS + 1)})


def test_frame(spark):
    df = spark.createDataFrame([(1, "not good"), (2, None), (3, "x" * 50_000), (1, "not good")], "id int, t string").withColumn("valence", F.lit("clash"))
    got = [r["valence"] for r in va.with_valence(df, "t", LEXICON).orderBy("id").collect()]
    assert got == [pytest.approx(scaled(1.9 * -0.74))] * 2 + [None, 0.0] and va.with_valence(df.where("id > 9"), "t", LEXICON).count() == 0
