"""Metrics of predictions, as DataFrames of one row per group. Rows with a null label or score don't count.

Undefined values (a single class, nothing retrieved, an empty group) are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import quantiles, row_numbers, running_sums

EPS = 1e-7


def _clip(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def regression_metrics(df: DataFrame, y: str, p: str, group: list[str] | None = None) -> DataFrame:
    """n, mse, rmse, mae, cvrmse (over the mean of |y|) and cvrmse_mean (over |mean of y|)."""
    e = F.col(p) - F.col(y)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    out = rows.groupBy(*(group or [])).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(F.col(y))).alias("__a"), F.abs(F.avg(y)).alias("__m"))
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("cvrmse", F.try_divide("rmse", "__a")).withColumn("cvrmse_mean", F.try_divide("rmse", "__m")).drop("__a", "__m")


def threshold_metrics(df: DataFrame, y: str, p: str, group: list[str] | None = None, at: float = 0.5) -> DataFrame:
    """n, n_pos, log_loss, brier, precision, recall and f1 at a threshold; f1 is 0 where nothing is found."""
    t, hit = F.col(y).cast("int"), F.col(p) >= at
    q = _clip(F.col(p))
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    out = rows.groupBy(*(group or [])).agg(
        F.count("*").alias("n"),
        F.sum(t).alias("n_pos"),
        (-F.avg(F.when(t == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("log_loss"),
        F.avg(F.pow(F.col(p) - t, 2)).alias("brier"),
        F.sum((hit & (t == 1)).cast("int")).alias("__tp"),
        F.sum(hit.cast("int")).alias("__found"),
    )
    return out.select(
        *(group or []), "n", "n_pos", "log_loss", "brier", F.try_divide("__tp", "__found").alias("precision"), F.try_divide("__tp", "n_pos").alias("recall"), F.coalesce(F.try_divide(2 * F.col("__tp"), F.col("__found") + F.col("n_pos")), F.lit(0.0)).alias("f1")
    )


def ranking_metrics(df: DataFrame, y: str, p: str, group: list[str] | None = None) -> DataFrame:
    """auc (ties count half) and average precision (by distinct thresholds). No task holds more than a range of scores."""
    group = group or []
    t = F.col(y).cast("int")
    r = running_sums(df.where(F.col(y).isNotNull()), p, {"pos": F.sum(t), "neg": F.sum(1 - t)}, group)
    above_pos, above_neg = F.col("all_pos") - F.col("before_pos"), F.col("all_neg") - F.col("before_neg")
    return r.groupBy(*group).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)), F.max(F.col("all_pos") * F.col("all_neg"))).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * above_pos / (above_pos + above_neg)), F.max("all_pos")).alias("average_precision"),
    )


def reliability(df: DataFrame, y: str, p: str, n_bins: int = 10, strategy: str = "equal_size") -> DataFrame:
    """(bin, n, mean_p, mean_y) for every bin from 0; empty bins have n 0 and null means.

    `equal_width` cuts [0, 1] evenly; `equal_size` at the quantiles, with 0 and 1 as outer edges. Bins are closed on the left.
    Edges that fall together leave empty bins.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    if strategy == "equal_width":
        placed = rows.withColumn("bin", F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int"))
    elif strategy == "equal_size":
        cuts = quantiles(rows, p, {f"e{i}": i / n_bins for i in range(1, n_bins)})
        edges = cuts.select(F.array(*cuts.columns).alias("__edges"))
        placed = rows.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("__edges", lambda e: e <= F.col(p))))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    found = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    every = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").na.fill(0, ["n"])


def calibration_error(curve: DataFrame) -> DataFrame:
    """ece and mce of a reliability curve."""
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return curve.where("n > 0").agg(F.try_divide(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def top_k(df: DataFrame, y: str, p: str, key: str, ks: list[int]) -> DataFrame:
    """(k, precision, recall, lift) of the k best scores; ties by key. k = 0 has no precision.

    The best rows are found by a top-k of every task, of which the largest k are merged.
    """
    rows = df.where(F.col(p).isNotNull()).select(F.col(y).cast("int").alias("__y"), F.col(p).alias("__p"), F.col(key).alias("__k"))
    base = rows.agg(F.sum("__y").alias("__pos"), F.avg("__y").alias("__base"))
    sizes = df.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    best = rows.orderBy(F.desc("__p"), "__k").limit(max([*ks, 1]))
    top = best.select("__y", F.row_number().over(W.orderBy(F.desc("__p"), "__k")).alias("rn"))
    hits = F.broadcast(sizes).join(top, F.col("rn") <= F.col("k"), "left").groupBy("k").agg(F.avg("__y").alias("precision"), F.sum("__y").alias("__hits"))
    return hits.join(F.broadcast(base)).select("k", "precision", (F.coalesce("__hits", F.lit(0)) / F.greatest("__pos", F.lit(1))).alias("recall"), (F.col("precision") / F.greatest("__base", F.lit(1e-9))).alias("lift"))


def lift_by_chunk(df: DataFrame, y: str, p: str, key: str, chunks: int = 10) -> DataFrame:
    """(chunk, n, mean_score, hit_rate, lift): chunks of n // chunks by falling score, the last takes the remainder."""
    ranked = row_numbers(df, p, key, descending=True)
    size = F.greatest(F.floor(F.col("n_rows") / chunks), F.lit(1))
    placed = ranked.withColumn("chunk", (F.least(F.floor((F.col("rn") - 1) / size), F.lit(chunks - 1)) + 1).cast("int"))
    base = ranked.agg(F.avg(F.col(y).cast("double")).alias("__base"))
    out = placed.groupBy("chunk").agg(F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("hit_rate"))
    return out.join(F.broadcast(base)).select("chunk", "n", "mean_score", "hit_rate", F.try_divide("hit_rate", "__base").alias("lift"))


def order_statistic(df: DataFrame, value: str, levels: list[float], group: list[str] | None = None) -> DataFrame:
    """(group, level, q): the k-th least value, k = ceil((n + 1) * level) held within 1..n."""
    group = group or []
    r = running_sums(df, value, {"n": F.count("*")}, group)
    wanted = df.sparkSession.createDataFrame([(float(x),) for x in levels], "level double")
    k = F.greatest(F.lit(1), F.least(F.col("all_n"), F.ceil(F.round((F.col("all_n") + 1) * F.col("level"), 9))))
    return r.join(F.broadcast(wanted), (F.col("before_n") < k) & (k <= F.col("before_n") + F.col("n"))).select(*group, "level", F.col(value).alias("q"))


#: Sums of each metric that the bootstrap knows, by (label, score), and how they make the metric.
_SUMS: dict[str, tuple[Callable[[np.ndarray, np.ndarray], list[np.ndarray]], Callable[..., np.ndarray]]] = {
    "rmse": (lambda y, p: [(p - y) ** 2, np.ones(len(y))], lambda e, n: np.sqrt(e / n)),
    "mae": (lambda y, p: [np.abs(p - y), np.ones(len(y))], lambda e, n: e / n),
    "brier": (lambda y, p: [(p - y) ** 2, np.ones(len(y))], lambda e, n: e / n),
    "log_loss": (lambda y, p: [-np.log(np.where(y > 0.5, np.clip(p, EPS, 1 - EPS), 1 - np.clip(p, EPS, 1 - EPS))), np.ones(len(y))], lambda e, n: e / n),
    "f1": (lambda y, p: [(y > 0.5) * (p >= 0.5), (p >= 0.5) * 1.0, (y > 0.5) * 1.0, np.ones(len(y))], lambda tp, found, pos, n: np.where(n > 0, 2 * tp / np.maximum(found + pos, 1e-300), np.nan)),
}


def poisson_counts(keys: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """(rows, n_boot) of Poisson(1) counts, each a function of its row's key, the resample and the seed alone."""
    with np.errstate(over="ignore"):
        x = (keys[:, None] ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + np.arange(1, n_boot + 1, dtype=np.uint64)[None] * np.uint64(0xD1342543DE82EF95)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        u = ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))
    return np.searchsorted(steps, u.ravel(), "right").reshape(u.shape).astype(np.float64)


def bootstrap_intervals(df: DataFrame, y: str, p: str, key: str, metrics: list[str], n_boot: int = 1000, seed: int = 42, alpha: float = 0.05, auc_bins: int = 1000) -> DataFrame:
    """(metric, point, low, high) of rmse, mae, brier, log_loss, f1 and auc by Poisson resampling: each row stands in each resample
    as often as a count drawn from its key says.

    Rows meet nothing but their own batch: each task adds up the sums of every resample, a table of n_boot rows whose size does
    not depend on the data, and these are added up. The AUC is that of scores cut at `auc_bins` approximate quantiles, ties
    and rows of one bin counting half; it is exact where there are no more different scores than bins. Resamples without a
    metric (no rows, one class) don't count; a metric without any has no row. Rows with a null label or score don't count.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"), F.xxhash64(F.col(key)).alias("h"))
    plain = [m for m in metrics if m != "auc"]
    width = {m: len(_SUMS[m][0](np.zeros(1), np.zeros(1))) for m in plain}
    cuts = np.zeros(0)
    if "auc" in metrics:
        distinct = rows.select("p").distinct().orderBy("p").limit(auc_bins + 1).collect()
        probes = [r["p"] for r in distinct] if len(distinct) <= auc_bins else rows.agg(F.percentile_approx("p", [i / auc_bins for i in range(1, auc_bins)], F.lit(20 * auc_bins))).first()[0]
        cuts = np.unique(np.array(probes or [], dtype=np.float64))
    n_bins = len(cuts) + 1 if "auc" in metrics else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_boot + 1, sum(width.values()) + 2 * n_bins))
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                yy, pp, h = (pdf[c].to_numpy()[a : a + 2000] for c in ("y", "p", "h"))
                weight = np.hstack([np.ones((len(yy), 1)), poisson_counts(h.astype(np.int64).view(np.uint64), n_boot, seed)])
                parts = [np.asarray(x, dtype=np.float64) for m in plain for x in _SUMS[m][0](yy, pp)]
                if parts:
                    total[:, : len(parts)] += weight.T @ np.stack(parts, axis=1)
                if n_bins:
                    at = np.searchsorted(cuts, pp, "right")
                    for k, own in enumerate((yy > 0.5, yy <= 0.5)):
                        order = np.argsort(at[own], kind="stable")
                        bins, first = np.unique(at[own][order], return_index=True)
                        if len(bins):
                            total[:, len(parts) + k * n_bins + bins] += np.add.reduceat(weight[own][order], first, axis=0).T
        yield pd.DataFrame({"b": np.arange(n_boot + 1), "s": list(total)})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, s, at = [], np.stack(pdf["s"].to_numpy()) if len(pdf) else np.zeros((0, sum(width.values()) + 2 * n_bins)), 0
            with np.errstate(divide="ignore", invalid="ignore"):
                for m in plain:
                    out.append(pd.DataFrame({"b": pdf["b"], "metric": m, "v": _SUMS[m][1](*s[:, at : at + width[m]].T)}))
                    at += width[m]
                if n_bins:
                    pos, neg = s[:, at : at + n_bins], s[:, at + n_bins :]
                    below = np.cumsum(neg, axis=1) - neg
                    out.append(pd.DataFrame({"b": pdf["b"], "metric": "auc", "v": (pos * (below + neg / 2)).sum(axis=1) / (pos.sum(axis=1) * neg.sum(axis=1))}))
            yield pd.concat(out) if out else pd.DataFrame({"b": [], "metric": [], "v": []})

    # a row of sums for each resample and task, added up as vectors
    parts = rows.mapInPandas(run, "b int, s array<double>").select("b", array_to_vector("s").alias("s"))
    sums = parts.groupBy("b").agg(vector_to_array(Summarizer.sum(F.col("s"))).alias("s"))
    values = sums.mapInPandas(fold, "b int, metric string, v double").where(F.col("v").isNotNull() & ~F.isnan("v"))
    drawn = F.when(F.col("b") > 0, F.col("v"))
    return values.groupBy("metric").agg(F.max(F.when(F.col("b") == 0, F.col("v"))).alias("point"), F.percentile(drawn, alpha / 2).alias("low"), F.percentile(drawn, 1 - alpha / 2).alias("high"))
