"""Keep-one-per-key operators. Each is a single shuffle with a map-side partial aggregate, so a hot key costs one row per map task.

Where rows are wide and few keys repeat, `keep_one_wide` finds the repeated keys on the keys alone, and only their rows are
sorted and shuffled; all others stay where they were read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def keep_one(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The row that comes first by `order` for each key, of the given columns.

    Ties on `order` are broken by the values of `columns`, so the result is the same in every run. Rows with a null key
    are grouped together like any other key. An empty input gives an empty output.
    """
    rest = [c for c in columns if c not in keys]
    first = F.min(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])).alias("__m")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__m.{c}").alias(c) for c in rest])


#: Repeated keys up to this number are sent to every worker (some tens of MB); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def split_repeated(df: DataFrame, keys: list[str], most: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """The rows whose key occurs once, and the rows whose key repeats; null keys are equal to each other.

    The repeated keys are counted on the key columns alone and written to the shared checkpoint folder; their number is checked
    before they are broadcast.
    """
    repeated = cut(df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    side = F.broadcast(repeated) if repeated.count() <= most else repeated
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(side, on, "left_anti"), df.join(side, on, "left_semi")


def keep_one_wide(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], most: int = MOST_BROADCAST) -> DataFrame:
    """As `keep_one`, for wide rows of which few share a key."""
    once, again = split_repeated(df, keys, most)
    return once.select(*keys, *[c for c in columns if c not in keys]).unionByName(keep_one(again, keys, order, columns))
