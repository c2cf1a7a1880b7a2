"""Ordered analytics: quartiles and shape of trajectories, lexical diversity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import correlation

#: Shapes of a trajectory over 0..1.
ARCS = ("rise", "fall", "fall_rise", "rise_fall", "rise_fall_rise", "fall_rise_fall")


def series_aggregates(df: DataFrame, group: str, value: str, mean: Column | None = None) -> DataFrame:
    """(group, n, mean, std, range, share_zero): population standard deviation; null values don't count. `mean` is an aggregate to take for the plain one."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), (F.avg(v) if mean is None else mean).alias("mean"), F.stddev_pop(v).alias("std"), (F.max(v) - F.min(v)).alias("range"), F.avg((v == 0).cast("double")).alias("share_zero"))


def numbered(df: DataFrame, group: str, order: list[str], value: str, block: str | None = None) -> DataFrame:
    """(group, i, n, value): places from 0 in the order of the columns.

    With `block`, a column that rises with the order (a scene, a day), rows are numbered within blocks and the sizes of the
    earlier blocks are added, so a group that holds a third of all rows isn't one window.
    """
    rows = df.where(F.col(value).isNotNull())
    if block is None:
        w = W.partitionBy(group).orderBy(*order)
        return rows.select(group, (F.row_number().over(w) - 1).alias("i"), F.count("*").over(W.partitionBy(group)).alias("n"), F.col(value).alias("value"))
    sizes = rows.groupBy(group, block).agg(F.count("*").alias("__n"))
    w = W.partitionBy(group).orderBy(block)
    sizes = sizes.select(group, block, F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(group)).alias("n"))
    within = rows.select(group, block, F.col(value).alias("value"), F.row_number().over(W.partitionBy(group, block).orderBy(*order)).alias("__r"))
    return within.join(sizes, [group, block]).select(group, (F.col("__r") + F.col("__before") - 1).alias("i"), "n", "value")


def quartiles(seq: DataFrame, group: str) -> DataFrame:
    """(group, q1..q4, std_range) of `numbered` rows: means of four runs, of which the first n % 4 are one longer, and the range of their population standard deviations. Null under four rows.

    Each run is added up in its order, in a running window that streams through the sorted run, so that the last digit of a mean
    depends neither on partitions nor on the order in which tasks end.
    """
    size, rest = F.floor(F.col("n") / 4), F.col("n") % 4
    long_rows = rest * (size + 1)
    q = F.when(F.col("i") < long_rows, F.floor(F.col("i") / (size + 1))).otherwise(rest + F.floor(F.try_divide(F.col("i") - long_rows, size)))
    so_far = W.partitionBy(group, "q").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    added = seq.where("n >= 4").select(group, q.alias("q"), "i", "value").withColumn("__sum", F.sum("value").over(so_far))
    per = added.groupBy(group, "q").agg((F.max_by("__sum", "i") / F.count("*")).alias("m"), F.stddev_pop("value").alias("s"))
    wide = per.groupBy(group).agg(*[F.max(F.when(F.col("q") == k, F.col("m"))).alias(f"q{k + 1}") for k in range(4)], (F.max("s") - F.min("s")).alias("std_range"))
    return seq.select(group).distinct().join(wide, group, "left")


def resampled(seq: DataFrame, group: str, length: int = 20) -> DataFrame:
    """(group, j, value) of `numbered` rows: linear interpolation to `length` points; a single row is constant.

    Each row contributes to the grid points on either side of it, so nothing but one aggregate is needed.
    """
    step = (F.col("n") - 1) / F.lit(length - 1)
    grid = F.sequence(F.lit(0), F.lit(length - 1))
    near = F.filter(grid, lambda j: (F.abs(j * step - F.col("i")) < 1) | (F.col("n") == 1))
    parts = seq.select(group, F.explode(near).alias("j"), "i", "n", "value")
    weight = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(1 - F.abs(F.col("j") * step - F.col("i")))
    return parts.groupBy(group, "j").agg(F.sum(weight * F.col("value")).alias("value"))


def arc_similarity(grid: DataFrame, group: str, length: int = 20) -> DataFrame:
    """(group, each arc): cosine of the standardised trajectory with six analytic shapes; null for constant trajectories."""
    x = F.col("j") / F.lit(float(length - 1))
    up, once, twice = x, F.cos(2 * F.pi() * x), F.cos(4 * F.pi() * x)
    shapes = {"rise": up, "fall": -up, "fall_rise": once, "rise_fall": -once, "rise_fall_rise": -twice, "fall_rise_fall": twice}
    shaped = grid.select(group, "value", *[s.alias(n) for n, s in shapes.items()])
    # the correlation is the cosine of the centred vectors
    return shaped.groupBy(group).agg(*[F.when(F.stddev_pop("value") > 1e-12, correlation("value", n)).alias(n) for n in ARCS])


def _mtld_pass(tokens: list[str], threshold: float) -> float | None:
    factors, seen, n = 0.0, set(), 0
    for t in tokens:
        n += 1
        seen.add(t)
        if len(seen) / n <= threshold:
            factors, seen, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(seen) / n) / (1 - threshold)
    return len(tokens) / factors if factors else None


def mtld(tokens: list[str], threshold: float = 0.72, least: int = 50) -> float | None:
    """Mean of a forward and a backward pass; None under `least` tokens, and where no word recurs."""
    if len(tokens) < least:
        return None
    there, back = _mtld_pass(tokens, threshold), _mtld_pass(tokens[::-1], threshold)
    return None if there is None or back is None else (there + back) / 2


def with_mtld(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, mtld) of an array column of tokens, in Arrow batches; null for null arrays and short ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "mtld": [mtld(list(t)) if t is not None else None for t in pdf[tokens]]}).astype({"mtld": "float64"})

    return df.select(key, tokens).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, mtld double")


class _Factors:
    """Factors of one pass over tokens that come one after the other."""

    def __init__(self, threshold: float):
        self.threshold, self.total, self.factors, self.seen, self.n = threshold, 0, 0.0, set(), 0

    def add(self, tokens: list[str]) -> None:
        for t in tokens:
            self.n += 1
            self.total += 1
            self.seen.add(t)
            if len(self.seen) / self.n <= self.threshold:
                self.factors, self.seen, self.n = self.factors + 1, set(), 0

    def value(self) -> float | None:
        f = self.factors + ((1 - len(self.seen) / self.n) / (1 - self.threshold) if self.n else 0.0)
        return self.total / f if f else None


def ordered_mtld(df: DataFrame, group: str, order: list[str], tokens: str, threshold: float = 0.72, least: int = 50) -> DataFrame:
    """(group, mtld) over the tokens of all rows of a group in order; null as in `mtld`. Rows with null tokens add none.

    A pass depends on every token before, so a group is read by one task; but it streams through it, sorted, in Arrow batches,
    so memory holds the words of one factor, whatever the size of the group. The backward pass reads the rows the other way.
    """
    kind = df.schema[group].dataType.simpleString()

    def one_way(backward: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, state = None, None
            for pdf in batches:
                out = []
                for g, t in zip(pdf[group], pdf[tokens]):
                    if state is None or g != own:
                        if state is not None:
                            out.append((own, state.total, state.value()))
                        own, state = g, _Factors(threshold)
                    if t is not None:
                        state.add(list(t)[::-1] if backward else list(t))
                yield pd.DataFrame(out, columns=[group, "n", "v"]).astype({"n": "int64", "v": "float64"})
            if state is not None:
                yield pd.DataFrame([(own, state.total, state.value())], columns=[group, "n", "v"]).astype({"n": "int64", "v": "float64"})

        by = [F.desc(c) if backward else F.asc(c) for c in order]
        rows = df.where(F.col(group).isNotNull()).select(group, *order, tokens).repartition(group).sortWithinPartitions(group, *by)
        return rows.select(group, tokens).mapInPandas(run, f"{group} {kind}, n long, v double")

    there, back = one_way(False), one_way(True).select(group, F.col("v").alias("w"))
    both = there.join(back, group)
    return both.select(group, F.when((F.col("n") >= least) & ~F.isnan("v") & ~F.isnan("w"), (F.col("v") + F.col("w")) / 2).alias("mtld"))
