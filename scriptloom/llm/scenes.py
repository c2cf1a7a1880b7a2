"""What the problems on scenes share: each delivered scene once, and its dialogue as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import keep_one_wide


def dialogue_text(units: str = "dialogue_units") -> Column:
    """The unit texts in order, joined by a line break; null and empty texts are left out. Null units give ''."""
    kept = F.filter(F.col(units), lambda u: u["text"].isNotNull() & (u["text"] != ""))
    return F.coalesce(F.array_join(F.transform(kept, lambda u: u["text"]), "\n"), F.lit(""))


def speech_lengths(units: str = "dialogue_units") -> Column:
    """Characters of each unit that `dialogue_text` joins."""
    kept = F.filter(F.col(units), lambda u: u["text"].isNotNull() & (u["text"] != ""))
    return F.coalesce(F.transform(kept, lambda u: F.length(u["text"])), F.array().cast("array<int>"))


def once(scenes: DataFrame, *columns: str) -> DataFrame:
    """Each scene_id once, as first delivered. Only scenes delivered more than once are shuffled with their texts."""
    return keep_one_wide(scenes, ["scene_id"], [F.col("loaded_at")], ["scene_id", *columns])
