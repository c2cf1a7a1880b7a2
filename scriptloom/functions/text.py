"""Text functions as Column builders. Tokens are regular-expression tokens: letters, then letters, apostrophes or hyphens.

A null text gives null from the scalar builders; the aggregates below leave such rows out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z][A-Za-z'\-]*"

# First and second person words.
FIRST_PERSON = ("i", "me", "my", "mine", "myself")
SECOND_PERSON = ("you", "your", "yours", "yourself", "yourselves", "thou", "thee", "thy", "thine", "thyself")

# Defaults of parameters: stop words, and small lexicons of emotions and valence that stand in where no file is given (`read_lexicon`).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "its", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "with", "you")
EMOTIONS = {
    "anger": ("angry", "fight", "hate", "kill", "rage"),
    "anticipation": ("await", "hope", "ready", "soon", "wait"),
    "disgust": ("dirty", "filthy", "foul", "rotten", "sick"),
    "fear": ("afraid", "dark", "fear", "scared", "storm"),
    "joy": ("bright", "funny", "golden", "happy", "playful"),
    "sadness": ("broken", "cold", "cry", "grim", "lost"),
    "surprise": ("sudden", "strange", "wonder"),
    "trust": ("friend", "gentle", "honest", "loyal", "promise"),
}
#: A small valence lexicon, one number a word.
VALENCE = {"good": 1.9, "love": 3.2, "bright": 1.5, "funny": 1.9, "gentle": 1.6, "golden": 1.2, "promise": 1.3, "playful": 1.9, "bad": -2.5, "broken": -2.1, "bitter": -1.8, "cold": -0.8, "grim": -2.2, "lost": -1.3, "strange": -0.8, "weary": -1.1, "hate": -2.7, "kill": -3.7}


def tokens(text: Column) -> Column:
    """Lower-case word tokens in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def sentence_count(text: Column) -> Column:
    """Pieces between ends of sentences that hold anything but white space."""
    return F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != ""))


def ensure_terminal_punctuation(text: Column) -> Column:
    """The text, with a full stop where it ends without . ! or ?"""
    return F.when(text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))


def syllables(word: Column) -> Column:
    """Groups of vowels, without a silent final e (but counting the one of -le); at least one."""
    stem = F.when(word.rlike("[^l]e$"), F.lit(1)).otherwise(F.lit(0))
    return F.greatest(F.lit(1), F.regexp_count(word, F.lit("[aeiouy]+")) - F.when((stem == 1) & word.rlike("[^aeiouy]e$"), 1).otherwise(0))


def count_of(text: Column, mark: str) -> Column:
    """Occurrences of a one-character mark."""
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def truncate(text: Column, limit: int, marker: str = "...[truncated]") -> Column:
    """The text, cut to `limit` characters with a marker where it is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def ints_in(texts: Column, pattern: str) -> Column:
    """Distinct integers captured by the first group of `pattern` in an array of texts, in order of first appearance."""
    found = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def speaker_name(raw: Column) -> Column:
    """A speaker without one trailing parenthetical; the name as it is where nothing else would be left."""
    bare = F.trim(F.regexp_replace(raw, r"\s*\([^)]*\)\s*$", ""))
    return F.when(bare == "", F.trim(raw)).otherwise(bare)


# What no character is called.
NOT_A_NAME = (
    r"[©®™]",
    r"^\d{4}\b",
    r"(?i)\bSTUDIOS\b",
    r"(?i)\bPICTURES\s+INC\b",
    r"(?i)\bPRODUCTIONS\s+LLC\b",
)


def plausible_name(name: Column) -> Column:
    """Whether a speaker line may name a character: not empty, no copyright marks, years or studios."""
    out = name.isNotNull() & (name != "")
    for pattern in NOT_A_NAME:
        out = out & ~name.rlike(pattern)
    return out


def action_text(direction: Column, description: Column) -> Column:
    """Heading and description of a scene, trimmed and joined by a blank; '' where there is neither."""
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws(" ", part(direction), part(description))


def scene_heading(direction: Column, description: Column, units: Column, longest: int = 80) -> Column:
    """One line that names a scene: its heading, else its description, else the first speech with its speaker; '' without any."""
    named = F.when(direction != "", direction).when(description != "", description).otherwise(F.lit(""))
    named = F.trim(F.translate(named, "\n", " "))
    first = F.get(units, F.lit(0))
    spoken = F.concat(F.coalesce(first["speaker"], F.lit("")), F.lit(": "), F.substring(F.coalesce(first["text"], F.lit("")), 1, 60))
    return F.substring(F.when(named != "", named).when(F.size(units) > 0, spoken).otherwise(F.lit("")), 1, longest)


def chunk(text: Column, n: int, tail: bool = False) -> Column:
    """The first (or last) `n` characters on one line, with line breaks shown as ⏎; '' for null."""
    part = F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text) if tail else F.substring(text, 1, n)
    return F.trim(F.replace(F.coalesce(part, F.lit("")), F.lit("\n"), F.lit(" ⏎ ")))


def lookup(word: Column, table: dict[str, float]) -> Column:
    """The number of a word in a small fixed table; null if it isn't there."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*entries), word)
