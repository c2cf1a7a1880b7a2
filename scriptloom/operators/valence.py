"""Valence of lines by a lexicon and rules, and shares of emotions by a lexicon. Lexicons are tables that a user brings
(`read_valence`, `read_emotions`); the small ones in `functions/text.py` stand in where there is none.

The rules are those published for social-media text by Hutto and Gilbert (2014): words of degree before a word raise or lower
it, a negation turns it round, capitals among small letters and exclamation marks stress it, and what follows a "but" counts
more than what precedes it. The sum s becomes s / sqrt(s^2 + 15), between -1 and 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the published rules: steps of degree, capitals, negation and punctuation, and the scale of the sum.
DEGREE, CAPITALS, NEGATION, EXCLAMATION, QUESTION, QUESTIONS, SCALE = 0.293, 0.733, -0.74, 0.292, 0.18, 0.96, 15
# Words of degree and of negation.
MORE = frozenset("absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely fully greatly highly hugely incredibly intensely more most particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably unusually utterly very".split())
LESS = frozenset("almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split())
NOT = frozenset("aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither never none nope nor not nothing nowhere oughtnt shant shouldnt wasnt werent without wont wouldnt rarely seldom despite".split())

MOST_WORDS = 200_000
"""Words of a lexicon that is sent to the workers; a larger one raises ValueError."""

_WORD = re.compile(r"[^\W_][\w'’\-]*")


def read_valence(spark: SparkSession, path: str) -> dict[str, float]:
    """Word -> valence from lines of word, tab, number (further columns are ignored). Of repeated words the first line counts."""
    rows = spark.read.option("sep", "\t").option("quote", "").csv(path).select(F.lower(F.trim("_c0")).alias("w"), F.col("_c1").try_cast("double").alias("v")).where("w <> '' and v is not null")
    return _bounded({r["w"]: r["v"] for r in reversed(rows.limit(MOST_WORDS + 1).collect())})


def read_emotions(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """Emotion -> words from lines of word, tab, emotion, tab, 1 or 0."""
    rows = spark.read.option("sep", "\t").option("quote", "").csv(path).where("trim(_c2) = '1'").select(F.lower(F.trim("_c0")).alias("w"), F.lower(F.trim("_c1")).alias("e")).distinct()
    out: dict[str, list[str]] = {}
    for r in _bounded(rows.orderBy("e", "w").limit(MOST_WORDS + 1).collect()):
        out.setdefault(r["e"], []).append(r["w"])
    return {e: tuple(ws) for e, ws in out.items()}


def _bounded(lexicon):  # noqa: ANN001, ANN202
    if len(lexicon) > MOST_WORDS:
        raise ValueError(f"a lexicon of more than {MOST_WORDS} words")
    return lexicon


def valence(text: str, lexicon: dict[str, float]) -> float:
    """The valence of one line, 0 without any word of the lexicon."""
    raw = _WORD.findall(text)
    words = [w.lower().replace("’", "'") for w in raw]
    mixed = any(w.isupper() for w in raw) and not all(w.isupper() for w in raw)
    found = []
    for i, w in enumerate(words):
        v = lexicon.get(w, 0.0)
        if not v:
            found.append(0.0)
            continue
        sign = math.copysign(1.0, v)
        if mixed and raw[i].isupper() and len(raw[i]) > 1:
            v += sign * CAPITALS
        for back, share in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i >= back:
                before = words[i - back]
                if before in MORE or before in LESS:
                    step = DEGREE + (CAPITALS if mixed and raw[i - back].isupper() and len(before) > 1 else 0.0)
                    v += sign * share * (step if before in MORE else -step)
                bare = before.replace("'", "")
                if bare in NOT or bare.endswith("nt") and before.endswith("n't"):
                    v *= NEGATION
        found.append(v)
    if "but" in words:
        k = words.index("but")
        found = [v * (0.5 if i < k else 1.5 if i > k else 1.0) for i, v in enumerate(found)]
    total = sum(found)
    asked = text.count("?")
    stress = EXCLAMATION * min(text.count("!"), 4) + (0.0 if asked < 2 else QUESTION * asked if asked <= 3 else QUESTIONS)
    if total:
        total += math.copysign(stress, total)
    return total / math.sqrt(total * total + SCALE)


def with_valence(df: DataFrame, text: str, lexicon: dict[str, float], name: str = "valence") -> DataFrame:
    """`df` with the valence of a text column; null for null, in Arrow batches with the lexicon as a broadcast of checked size."""
    held = df.sparkSession.sparkContext.broadcast(_bounded(lexicon))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else valence(t, held.value) for t in s], dtype="float64")

    return df.withColumn(name, F.when(F.col(text).isNotNull(), run(F.col(text))))


def emotion_shares(tokens: Column, emotions: dict[str, tuple[str, ...]], stop_words: tuple[str, ...]) -> list[Column]:
    """One column per emotion: the share of an array of tokens, without stop words, that its words make up; null for no tokens."""
    kept = F.filter(tokens, lambda w: ~w.isin(*stop_words))

    def share(words: tuple[str, ...]) -> Column:
        return F.try_divide(F.size(F.filter(kept, lambda w: w.isin(*words))), F.size(kept))

    return [share(ws).alias(e) for e, ws in sorted(emotions.items())]
