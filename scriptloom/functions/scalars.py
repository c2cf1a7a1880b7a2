"""Scalar derivations as Column builders. Null in, null out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MOVIE_NAME = r"^(.+)_(\d{4})$"
IMDB_ID = r"^tt\d{7,8}$"


def positive(c: Column) -> Column:
    """The value where it is above zero; zero, negative and null are missing."""
    return F.when(c > 0, c)


def first_positive(columns: Sequence[str]) -> Column:
    """The first of the columns that is above zero."""
    return F.coalesce(*[positive(F.col(c)) for c in columns])


def money_log(c: Column, transform: str = "log1p") -> Column:
    """`log1p` or `log10` (of at least 1)."""
    if transform == "log1p":
        return F.log1p(c)
    if transform == "log10":
        return F.log10(F.greatest(c, F.lit(1.0)))
    raise ValueError(f"unknown transform {transform!r}")


def title_of(movie_name: Column) -> Column:
    """The title in Title_YYYY; the whole name where it has no year."""
    return F.when(movie_name.rlike(MOVIE_NAME), F.regexp_extract(movie_name, MOVIE_NAME, 1)).otherwise(movie_name)


def year_of(movie_name: Column) -> Column:
    """The year in Title_YYYY."""
    return F.when(movie_name.rlike(MOVIE_NAME), F.regexp_extract(movie_name, MOVIE_NAME, 2).cast("int"))


def year_in_text(date: Column) -> Column:
    """The year of a date in one of several notations (ISO, day first with dots or slashes, a year alone); null if there is none."""
    iso = F.regexp_extract(date, r"^\s*(\d{4})(?:\D|$)", 1)
    last = F.regexp_extract(date, r"(?:^|\D)(\d{4})\s*$", 1)
    found = F.when(iso != "", iso).otherwise(last)
    return F.when(found != "", found.cast("int"))


def list_column(raw: Column) -> Column:
    """A stringified list as an array: JSON after quotes are made double, else split at commas. Anything else is an empty array."""
    body = F.regexp_replace(raw, r"^\s*\[|\]\s*$", "")
    parts = F.filter(F.transform(F.split(body, ","), lambda x: F.regexp_replace(x, r"^[\s'\"]+|[\s'\"]+$", "")), lambda x: x != "")
    strict = F.from_json(F.translate(raw, "'", '"'), "array<string>")
    listed = raw.rlike(r"^\s*\[.*\]\s*$")
    return F.when(listed, F.coalesce(F.when(F.translate(raw, "'", '"').rlike(r'^\s*\[\s*("[^"]*"\s*(,\s*"[^"]*"\s*)*)?\]\s*$'), strict), parts)).otherwise(F.array().cast("array<string>"))


def primary_of(items: Column, default: str = "Unknown") -> Column:
    """The first item, or a default for an empty or null array."""
    return F.coalesce(F.get(items, F.lit(0)), F.lit(default))


def decade_of_five(year: Column) -> Column:
    """pre_1980s, 1980s, 1990s, 2000s, 2010s_2020s."""
    return F.when(year < 1980, "pre_1980s").when(year < 1990, "1980s").when(year < 2000, "1990s").when(year < 2010, "2000s").when(year.isNotNull(), "2010s_2020s")


def decade_of_six(year: Column) -> Column:
    """pre_1980, 1980s, 1990s, 2000s, 2010s, 2020s; unknown for null."""
    return F.when(year.isNull(), "unknown").when(year < 1980, "pre_1980").when(year < 1990, "1980s").when(year < 2000, "1990s").when(year < 2010, "2000s").when(year < 2020, "2010s").otherwise("2020s")


def tier(value: Column, steps: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first step the value lies below, the last label beyond; unknown for null and values of 0 or less."""
    out = F.when(value.isNull() | (value <= 0), "unknown")
    for s, l in zip(steps, labels):
        out = out.when(value < s, l)
    return out.otherwise(labels[len(steps)])


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def signed(c: Column, digits: int = 3) -> Column:
    """A number with its sign and a fixed number of digits."""
    return F.format_string(f"%+.{digits}f", c)


def amount(name: Column) -> Column:
    """25K and 1M as numbers; null for other text."""
    number = F.regexp_extract(name, r"([0-9]+(?:\.[0-9]+)?)([KM])$", 1)
    unit = F.regexp_extract(name, r"([0-9]+(?:\.[0-9]+)?)([KM])$", 2)
    return F.when(number != "", number.cast("double") * F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(F.lit(1.0)))


def one_hot(c: Column, vocabulary: Sequence[str], prefix: str) -> list[Column]:
    """A column for each word of a fixed vocabulary, so that every subset gets the same columns."""
    return [F.when(c == v, 1.0).otherwise(0.0).alias(f"{prefix}{v}") for v in vocabulary]


def readable_feature(name: Column) -> Column:
    """A feature name for reports: a genre as Genre=X, topics and embedding components by number, logarithms as log(x)."""
    rest = lambda n: F.substring(name, F.lit(n), F.length(name))
    return (
        F.when(name.startswith("genre_"), F.concat(F.lit("Genre="), rest(7)))
        .when(name.rlike(r"^topic_\d+_proportion$"), F.concat(F.lit("Topic "), F.regexp_extract(name, r"^topic_(\d+)_", 1), F.lit(" proportion")))
        .when(name.startswith("embed_pc_"), F.concat(F.lit("Embedding PC "), rest(10)))
        .when(name.startswith("log_"), F.concat(F.lit("log("), rest(5), F.lit(")")))
        .otherwise(F.translate(name, "_", " "))
    )


def quality_flag(n_scenes: Column, dialogue_chars: Column, few_scenes: int = 20, many_chars: int = 10_000) -> Column:
    """Whether a script lost its scene boundaries: hardly any scenes, but the speech of a whole film. Null counts as no."""
    return F.coalesce((n_scenes < few_scenes) & (dialogue_chars > many_chars), F.lit(False))


def attribution_pairs(text: Column) -> Column:
    """`f=+0.1; g=-0.2` as an array of (name, value); damaged parts are left out."""
    parts = F.transform(F.split(text, ";"), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("name"), F.substring_index(p, "=", -1).try_cast("double").alias("value")))
    return F.filter(parts, lambda p: p["value"].isNotNull() & (p["name"] != ""))


def rounded(x: Column, digits: int) -> Column:
    """`x` rounded as SQL rounds doubles: half away from zero of what the product with a power of ten comes to as a double."""
    return F.round(x * 10.0**digits) / 10.0**digits
