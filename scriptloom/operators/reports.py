"""Reports over results of runs: lifts over a floor, fold summaries, long metrics, picks by rules, per-film layers, consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lift_over_floor(rows: DataFrame, floor: DataFrame, keys: Sequence[str], metric: str, minimised: Sequence[str], band: tuple[float, float]) -> DataFrame:
    """INNER lookup join: lift of each row's `value` over the floor's, signed so that more is better, and whether it lies in the band."""
    joined = rows.join(floor.select(*keys, F.col("value").alias("floor")), list(keys))
    lift = F.when(F.col(metric).isin(*minimised), F.col("floor") - F.col("value")).otherwise(F.col("value") - F.col("floor"))
    return joined.withColumn("lift", lift).withColumn("in_band", F.col("lift").between(*band))


def fold_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, std) over folds with the sample standard deviation; nulls and NaN don't count."""
    v = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value): one row per metric column."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def oof_rows(runs: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, target, id, score, y) from run records whose JSON holds parallel arrays per target.

    Arrays of different lengths are padded with nulls; records that aren't valid JSON give no rows.
    """
    schema = "struct<ids:array<string>,per_target:map<string,struct<score:array<double>,y:array<double>>>>"
    got = runs.select(key, F.from_json(payload, schema).alias("r")).select(key, F.col("r.ids").alias("id"), F.explode("r.per_target").alias("target", "t"))
    return got.select(key, "target", F.inline(F.arrays_zip("id", F.col("t.score").alias("score"), F.col("t.y").alias("y"))))


def picks(df: DataFrame, key: str, rules: Sequence[tuple[str, Column | None, Sequence[Column]]]) -> DataFrame:
    """(rule, key): the first row by order for each (name, filter, order); a key picked twice stays with its first rule. Each pick is a limit 1."""
    out = None
    for i, (name, where, order) in enumerate(rules):
        rows = df if where is None else df.where(where)
        one = rows.orderBy(*order).limit(1).select(F.lit(i).alias("__i"), F.lit(name).alias("rule"), key)
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min_by("rule", "__i").alias("rule")).select("rule", key)


def best_by_direction(rows: DataFrame, keys: Sequence[str], metric: str, value: str, minimised: Sequence[str], tie: Column) -> DataFrame:
    """The best row of each group, lower being better for `minimised` metrics; equal values by `tie`."""
    signed = F.when(F.col(metric).isin(*minimised), F.col(value)).otherwise(-F.col(value))
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(signed, tie)).alias("b")).select(*keys, "b.*")


def percent_errors(a: DataFrame, b: DataFrame, key: str, metrics: Sequence[str], n: int | None = None, seed: int = 42) -> DataFrame:
    """(key, metric, pct): |b - a| * 100 / max(a, 1) of all keys both sides have, or of a seeded sample of n of them (a spot check)."""
    both = a.select(key, *[F.col(m).alias("a_" + m) for m in metrics]).join(b.select(key, *[F.col(m).alias("b_" + m) for m in metrics]), key)
    some = both if n is None else both.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return some.select(key, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), (F.abs(F.col("b_" + m) - F.col("a_" + m)) * 100 / F.greatest(F.col("a_" + m), F.lit(1))).alias("pct")) for m in metrics])))


def unequal_rows(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """Rows that one of two tables has more often than the other, doubles rounded; empty where they agree."""
    rounded = lambda d: d.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])
    x, y = rounded(a), rounded(b.select(*a.columns))
    return x.exceptAll(y).unionByName(y.exceptAll(x))


def resolve_features(wanted: str | Sequence[str], exclude: Sequence[str], groups: dict[str, Sequence[str]], columns: Sequence[str]) -> list[str]:
    """Columns named by a group, a list of groups and columns, or 'all', without the excluded ones, each once. Unknown names raise ValueError, other types TypeError."""
    if not isinstance(wanted, str | list | tuple):
        raise TypeError(type(wanted))
    names = list(columns) if wanted == "all" else []
    for w in [] if wanted == "all" else [wanted] if isinstance(wanted, str) else wanted:
        if w in groups:
            names += groups[w]
        elif w in columns:
            names.append(w)
        else:
            raise ValueError(w)
    return [n for n in dict.fromkeys(names) if n not in exclude]


def layered_report(films: DataFrame, scores: DataFrame, sets: DataFrame, attributions: DataFrame, key: str) -> DataFrame:
    """One row per film with its score, a map level -> (in_0, in_1) and its strongest attributions: one plan for all films.

    Films that a layer lacks have nulls there.
    """
    levels = sets.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", F.struct("in_0", "in_1").alias("v"))))).alias("sets"))
    return films.join(scores, key, "left").join(levels, key, "left").join(attributions, key, "left")


def numbered_places(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows with their place (a top-k report): the limit comes first, so only k rows are numbered."""
    return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(W.orderBy(*order)))


def winner(cells: DataFrame, target: str, metric: str, minimised: bool, simple: str = "standalone", evaluated: str = "oof_global", tier: str = "primary") -> DataFrame:
    """The best cell (matrix, family, value) of a long table of benchmark metrics (target, metric, eval_set, tier, matrix, family, value).

    Equal values go to a matrix whose name begins with `simple`, then by name. Null and NaN values don't count; no row without any.
    """
    rows = cells.where((F.col("target") == target) & (F.col("metric") == metric) & (F.col("eval_set") == evaluated) & (F.col("tier") == tier) & F.col("value").isNotNull() & ~F.isnan("value"))
    signed = F.col("value") if minimised else -F.col("value")
    order = F.struct(signed, (~F.col("matrix").startswith(simple)).alias("s"), "matrix", "family")
    return rows.agg(F.min_by(F.struct("matrix", "family", "value"), order).alias("b")).select("b.*").where("matrix is not null")


def fold_gap(rows: DataFrame, keys: Sequence[str], minimised: Sequence[str] = ()) -> DataFrame:
    """(keys, metric, train, oof, gap) of a long table (keys, metric, eval_set in train and oof, value): how much better training
    looks than held-out folds, positive where it does."""
    wide = rows.groupBy(*keys, "metric").agg(*[F.avg(F.when(F.col("eval_set") == e, F.col("value"))).alias(e) for e in ("train", "oof")])
    gap = F.when(F.col("metric").isin(*minimised), F.col("oof") - F.col("train")).otherwise(F.col("train") - F.col("oof"))
    return wide.withColumn("gap", gap)


def markdown_table(df: DataFrame, order: Sequence[Column], k: int = 20, digits: int = 3) -> str:
    """The first k rows as a Markdown table (a top-k report: only k rows come to the driver). Nulls are empty, bars in texts escaped."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.orderBy(*order).limit(k).collect()]) + "\n"
