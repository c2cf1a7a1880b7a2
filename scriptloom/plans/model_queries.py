"""Metrics, calibration, conformal sets, models and attributions over the films."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import attribution, calibration, metrics, models
from ..operators.tree_attribution import tree_contributions
from ..session import cut, table
from .base import FILMS_SQL, SCORED_SQL, films, scored_films
from .registry import Registry

query = Registry()


def _r(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"with {SCORED_SQL} select genre, count(*) as n, round(avg((guess - target) ** 2), 4) as mse, round(avg(abs(guess - target)), 4) as mae, round(sqrt(avg((guess - target) ** 2)), 4) as rmse, round(sqrt(avg((guess - target) ** 2)) / avg(abs(target)), 4) as cvrmse, round(sqrt(avg((guess - target) ** 2)) / abs(avg(target)), 4) as cvrmse_mean from scored group by 1")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a numeric guess by genre."""
    return _r(metrics.regression_metrics(scored_films(spark, d), "target", "guess", ["genre"]), 4, "mse", "mae", "rmse", "cvrmse", "cvrmse_mean")


@query(
    f"""with {SCORED_SQL}, s as (select *, least(greatest(p, 1e-7), 1 - 1e-7) as q, (p >= 0.5)::int as h from scored)
select genre, count(*) as n, sum(y)::bigint as n_pos, round(-avg(case when y = 1 then ln(q) else ln(1 - q) end), 6) as log_loss, round(avg((p - y) ** 2), 6) as brier, round(sum(h * y) / nullif(sum(h), 0), 6) as precision, round(sum(h * y) / nullif(sum(y), 0), 6) as recall,
round(coalesce(2.0 * sum(h * y) / nullif(sum(h) + sum(y), 0), 0.0), 6) as f1 from s group by 1"""
)
def log_loss_f1(spark: SparkSession, d: str) -> DataFrame:
    """Losses and hits of a probability by genre."""
    return _r(metrics.threshold_metrics(scored_films(spark, d), "y", "p", ["genre"]), 6, "log_loss", "brier", "precision", "recall", "f1")


@query(
    f"""with {SCORED_SQL}, r as (select genre, y, rank() over (partition by genre order by p) + (count(*) over (partition by genre, p) - 1) / 2.0 as r from scored), g as (select genre, sum(case when y = 1 then r end) as s, sum(y) as np, count(*) - sum(y) as nn from r group by 1)
select genre, round((s - np * (np + 1) / 2.0) / nullif(np * nn, 0), 6) as auc from g"""
)
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve by genre, ties half."""
    return _r(metrics.ranking_metrics(scored_films(spark, d), "y", "p", ["genre"]), 6, "auc").select("genre", "auc")


@query(
    f"""with {SCORED_SQL}, t as (select p, sum(y) as pos, count(*) as n from scored group by 1), c as (select p, pos, sum(pos) over (order by p desc) as cp, sum(n) over (order by p desc) as cn from t), a as (select sum(pos) as np from t)
select round(sum(pos * cp / cn) / max(np), 6) as average_precision from c, a"""
)
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision over distinct thresholds."""
    return _r(metrics.ranking_metrics(scored_films(spark, d), "y", "p"), 6, "average_precision").select("average_precision")


_BINS = ", e as (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from scored), b as (select y, p, len(list_filter(e, lambda x: x <= p)) as bin from scored, e), m as (select bin, count(*) as n, avg(p) as mp, avg(y) as my from b group by 1)"


@query(f"with {SCORED_SQL}{_BINS} select g.bin::int as bin, coalesce(n, 0) as n, round(mp, 6) as mean_p, round(my, 6) as mean_y from (select unnest(range(10)) as bin) g left join m using (bin)")
def reliability_curve(spark: SparkSession, d: str) -> DataFrame:
    """Ten bins of equal size."""
    return _r(metrics.reliability(scored_films(spark, d), "y", "p"), 6, "mean_p", "mean_y")


@query(f"with {SCORED_SQL}{_BINS} select round(sum(n * abs(mp - my)) / sum(n), 6) as ece, round(max(abs(mp - my)), 6) as mce from m")
def ece_mce(spark: SparkSession, d: str) -> DataFrame:
    """Expected and largest calibration error."""
    return _r(metrics.calibration_error(metrics.reliability(scored_films(spark, d), "y", "p")), 6, "ece", "mce")


@query(
    f"""with {SCORED_SQL}, r as (select y, row_number() over (order by p desc, imdb_id) as rn from scored), t as (select sum(y) as np, avg(y) as b from r)
select k::int as k, round(avg(case when rn <= k then y end), 6) as precision, round(coalesce(sum(case when rn <= k then y end), 0) / greatest(max(np), 1), 6) as recall, round(avg(case when rn <= k then y end) / greatest(max(b), 1e-9), 6) as lift from r, t, (select unnest([0, 5, 20, 100]) as k) group by 1"""
)
def precision_recall_lift_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and lift of the best scores."""
    return _r(metrics.top_k(scored_films(spark, d), "y", "p", "imdb_id", [0, 5, 20, 100]), 6, "precision", "recall", "lift")


@query(
    f"""with {SCORED_SQL}, r as (select y, p, row_number() over (order by p desc, imdb_id) as rn, count(*) over () as n from scored), c as (select y, p, (least((rn - 1) // greatest(n // 10, 1), 9) + 1)::int as chunk from r), b as (select avg(y) as b from scored)
select chunk, count(*) as n, round(avg(p), 6) as mean_score, round(avg(y), 6) as hit_rate, round(avg(y) / nullif(max(b), 0), 6) as lift from c, b group by 1"""
)
def lift_by_decile(spark: SparkSession, d: str) -> DataFrame:
    """Lift of ten chunks, the last with the remainder."""
    return _r(metrics.lift_by_chunk(scored_films(spark, d), "y", "p", "imdb_id"), 6, "mean_score", "hit_rate", "lift")


@query()
def bootstrap_rmse(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the errors of a guess from 2,000 Poisson resamples."""
    return metrics.bootstrap_intervals(scored_films(spark, d), "target", "guess", "imdb_id", ["rmse", "mae"], 2000)


@query()
def bootstrap_scores(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of AUC, F1, log loss and Brier score of a probability from 1,000 Poisson resamples."""
    return metrics.bootstrap_intervals(scored_films(spark, d), "y", "p", "imdb_id", ["auc", "f1", "log_loss", "brier"])


@query(
    f"""with {SCORED_SQL}, r as (select y, p, avg(rn) over (partition by p) as rk from (select y, p, row_number() over (order by p) as rn from scored)), q as (select y, least(greatest(p, 1e-7), 1 - 1e-7) as q, p, (p >= 0.5)::int as h from scored)
select 'auc' as metric, round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) as point from r union all
select 'f1', round(2.0 * sum(h * y) / (sum(h) + sum(y)), 6) from q union all select 'log_loss', round(-avg(case when y = 1 then ln(q) else ln(1 - q) end), 6) from q union all select 'brier', round(avg((p - y) ** 2), 6) from q"""
)
def bootstrap_points(spark: SparkSession, d: str) -> DataFrame:
    """The point values beside those intervals."""
    out = metrics.bootstrap_intervals(scored_films(spark, d), "y", "p", "imdb_id", ["auc", "f1", "log_loss", "brier"], 10)
    return _r(out.select("metric", "point"), 6, "point")


_LAC = ", s as (select case when y = 1 then 1 - p else p end as s from scored), o as (select s, row_number() over (order by s) as rn, count(*) over () as n from s), lv as (select unnest([0.8, 0.9, 0.95]) as level), q as (select level, max(case when rn = greatest(1, least(n, ceil(round((n + 1) * level, 9)))) then s end) as q from o, lv group by 1)"


@query(f"with {SCORED_SQL}{_LAC} select level::double as level, round(q, 6) as q from q")
def lac_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Conformal quantiles of a binary score."""
    return _r(calibration.class_quantiles(scored_films(spark, d), "p", "y", [0.8, 0.9, 0.95]), 6, "q")


@query(
    f"""with {SCORED_SQL}{_LAC}, t as (select level, y, p <= q as i0, (1 - p) <= q as i1 from scored, q)
select level::double as level, count(*) as n, round(avg((case when y = 1 then i1 else i0 end)::int), 6) as coverage, round(avg(i0::int + i1::int), 6) as mean_size, round(avg((i0::int + i1::int = 1)::int), 6) as share_single, round(avg((i0::int + i1::int = 2)::int), 6) as share_both, round(avg((i0::int + i1::int = 0)::int), 6) as share_empty from t group by 1"""
)
def lac_sets(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and size of the conformal sets."""
    s = scored_films(spark, d)
    out = calibration.set_coverage(calibration.class_sets(s, calibration.class_quantiles(s, "p", "y", [0.8, 0.9, 0.95]), "p"), "y")
    return _r(out, 6, "coverage", "mean_size", "share_single", "share_both", "share_empty")


@query(
    f"""with {SCORED_SQL}, s as (select round(abs(target - guess), 6) as s from scored), o as (select s, row_number() over (order by s) as rn, count(*) over () as n from s), lv as (select unnest([0.8, 0.9]) as level), q as (select level, max(case when rn = ceil(round((n + 1) * level, 9)) then s end) as q from o, lv group by 1)
select level::double as level, (select count(*) from s) as n, round(q, 5) as q, round((select avg((s <= q.q)::int) from s), 4) as coverage, round(2 * q, 5) as width from q"""
)
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Conformal intervals of a numeric guess."""
    s = scored_films(spark, d).withColumn("guess", F.col("guess")).select("target", (F.col("target") + F.round(F.abs(F.col("target") - F.col("guess")), 6)).alias("guess"))
    out = calibration.interval_coverage(s.withColumn("e", F.round(F.col("guess") - F.col("target"), 6)).select(F.lit(0.0).alias("zero"), "e"), "zero", "e", [0.8, 0.9])
    return out.select("level", "n", F.round("q", 5).alias("q"), F.round("coverage", 4).alias("coverage"), F.round("width", 5).alias("width"))


_APS = ", s as (select case when (p >= 0.5) = (y = 1) then greatest(p, 1 - p) else 1.0 end as s from scored), o as (select s, row_number() over (order by s) as rn, count(*) over () as n from s), lv as (select unnest([0.5, 0.8, 0.9]) as level), q as (select level, max(case when rn = greatest(1, least(n, ceil(round((n + 1) * level, 9)))) then s end) as q from o, lv group by 1)"


@query(
    f"""with {SCORED_SQL}{_APS}, t as (select level, y, p < 0.5 or greatest(p, 1 - p) < q as i0, p >= 0.5 or greatest(p, 1 - p) < q as i1 from scored, q)
select level::double as level, count(*) as n, round(avg((case when y = 1 then i1 else i0 end)::int), 6) as coverage, round(avg(i0::int + i1::int), 6) as mean_size, round(avg((i0::int + i1::int = 1)::int), 6) as share_single, round(avg((i0::int + i1::int = 2)::int), 6) as share_both, round(avg((i0::int + i1::int = 0)::int), 6) as share_empty from t group by 1"""
)
def adaptive_sets(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and size of the adaptive conformal sets."""
    s = scored_films(spark, d)
    out = calibration.set_coverage(calibration.adaptive_sets(s, calibration.adaptive_quantiles(s, "p", "y", [0.5, 0.8, 0.9]), "p"), "y")
    return _r(out, 6, "coverage", "mean_size", "share_single", "share_both", "share_empty")


_REL = ", b as (select exp(target) as t, exp(guess) as g from scored), s as (select round(abs(t - g) / g, 9) as s, g from b), o as (select s, row_number() over (order by s) as rn, count(*) over () as n from s), lv as (select unnest([0.8, 0.9]) as level), q as (select level, max(case when rn = greatest(1, least(n, ceil(round((n + 1) * level, 9)))) then s end) as q from o, lv group by 1)"


@query(f"with {SCORED_SQL}{_REL} select level::double as level, (select count(*) from s) as n, round(q, 5) as q, round((select avg((s <= q.q + 1e-9)::int) from s), 4) as coverage, round(2 * q * (select avg(g) from s), 4) as width from q")
def relative_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Conformal intervals whose width follows the guess, for a target above zero."""
    s = scored_films(spark, d).select(F.exp("target").alias("t"), F.exp("guess").alias("g"))
    out = calibration.relative_coverage(s, "t", "g", [0.8, 0.9])
    return out.select("level", "n", F.round("q", 5).alias("q"), F.round("coverage", 4).alias("coverage"), F.round("width", 4).alias("width"))


@query(
    f"""with {SCORED_SQL}, s as (select y, p, case when y = 1 then 1 - p else p end as lac, case when (p >= 0.5) = (y = 1) then greatest(p, 1 - p) else 1.0 end as aps from scored),
k as (select greatest(1, least(count(*), ceil(round((count(*) + 1) * 0.9, 9))))::bigint as k from s), q as (select (select list_sort(list(lac))[(select k from k)] from s) as ql, (select list_sort(list(aps))[(select k from k)] from s) as qa),
c as (select 'aps' as score, avg((case when y = 1 then p >= 0.5 or greatest(p, 1 - p) < qa else p < 0.5 or greatest(p, 1 - p) < qa end)::int) as coverage from s, q union all select 'lac', avg((lac <= ql)::int) from s, q)
select score, round(coverage, 6) as coverage from c order by round(abs(coverage - 0.9), 12), score limit 1"""
)
def conformal_choice(spark: SparkSession, d: str) -> DataFrame:
    """The score whose coverage at 0.9 is nearest to it."""
    s = scored_films(spark, d)
    sets = {"lac": calibration.class_sets(s, calibration.class_quantiles(s, "p", "y", [0.9]), "p"), "aps": calibration.adaptive_sets(s, calibration.adaptive_quantiles(s, "p", "y", [0.9]), "p")}
    parts = [calibration.set_coverage(x, "y").select(F.lit(n).alias("score"), "level", "coverage") for n, x in sets.items()]
    return _r(calibration.closest_coverage(parts[0].unionByName(parts[1])), 6, "coverage")


@query(
    f"""with {SCORED_SQL}, l as (select imdb_id, y, p, round(-case when y = 1 then ln(greatest(p, 1e-7)) else ln(greatest(1 - p, 1e-7)) end, 6) as loss from scored)
select 'most_correct' as side, imdb_id, loss from (select * from l where y = 1 order by loss, imdb_id limit 15) union all select 'most_wrong', imdb_id, loss from (select * from l order by loss desc, imdb_id limit 15)"""
)
def error_gallery(spark: SparkSession, d: str) -> DataFrame:
    """The best predicted positives and the worst predicted rows (a top-k report)."""
    s = scored_films(spark, d)
    l = s.select("imdb_id", "y", F.round(-F.when(F.col("y") == 1, F.log(F.greatest("p", F.lit(1e-7)))).otherwise(F.log(F.greatest(1 - F.col("p"), F.lit(1e-7)))), 6).alias("loss"))
    good = l.where("y = 1").orderBy("loss", "imdb_id").limit(15).select(F.lit("most_correct").alias("side"), "imdb_id", "loss")
    return good.unionByName(l.orderBy(F.desc("loss"), "imdb_id").limit(15).select(F.lit("most_wrong").alias("side"), "imdb_id", "loss"))


@query(
    f"""with {SCORED_SQL} select genre, count(*) as n, round(avg(abs(p - y)), 6) as mean_error, round(avg(((p >= 0.5)::int = y)::int), 6) as accuracy from scored group by 1 having count(*) >= 5"""
)
def error_by_genre(spark: SparkSession, d: str) -> DataFrame:
    """Errors by genre with at least five films."""
    s = scored_films(spark, d)
    return s.groupBy("genre").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mean_error"), F.round(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")), 6).alias("accuracy")).where("n >= 5")


_COEF = {"vote_average": 0.5, "runtime": 0.01, "popularity": -0.02}
_LIN = f"""with {FILMS_SQL}, m as (select avg(vote_average) as a, avg(runtime) as b, avg(popularity) as c from films),
l as (select imdb_id, 'vote_average' as feature, 0.5 * (coalesce(vote_average, a) - a) as contribution from films, m union all select imdb_id, 'runtime', 0.01 * (coalesce(runtime, b) - b) from films, m union all select imdb_id, 'popularity', -0.02 * (coalesce(popularity, c) - c) from films, m)"""


def _linear(spark: SparkSession, d: str) -> DataFrame:
    f = films(spark, d, *_COEF)
    return attribution.linear_contributions(f, f, "imdb_id", _COEF)


@query(_LIN + " select imdb_id, feature, round(contribution, 5) as contribution from l")
def linear_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Contributions of three features to a linear score."""
    return _linear(spark, d).select("imdb_id", "feature", F.round("contribution", 5).alias("contribution"))


@query(_LIN + ", g as (select feature, avg(abs(contribution)) as a, avg(contribution) as m from l group by 1) select feature, round(a, 6) as mean_abs, (row_number() over (order by a desc, feature))::int as rank from g")
def global_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Features by mean contribution."""
    return attribution.global_ranking(_linear(spark, d)).select("feature", F.round("mean_abs", 6).alias("mean_abs"), "rank")


@query()
def per_row_topk(spark: SparkSession, d: str) -> DataFrame:
    """The strongest contributions of each film."""
    return attribution.top_per_row(_linear(spark, d), "imdb_id", 2)


@query(f"with {FILMS_SQL} select imdb_id, round(0.5 * coalesce(vote_average, 0) + 0.01 * coalesce(runtime, 0) - 0.02 * coalesce(popularity, 0), 5) as score, round(0.01 * coalesce(runtime, 0) - 0.02 * coalesce(popularity, 0), 5) as without from films")
def leave_one_group_out(spark: SparkSession, d: str) -> DataFrame:
    """Scores with and without a group of features."""
    out = attribution.leave_out(films(spark, d, *_COEF), "imdb_id", _COEF, ["vote_average"])
    return out.select("imdb_id", F.round("score", 5).alias("score"), F.round("without", 5).alias("without"))


@query(
    f"""with {SCORED_SQL}, g as (select auc from (select (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as auc from (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from scored))), b as (select avg((p - y) ** 2) as v from scored)
select 'auc' as id, round(auc, 6) as metric, 0.55::double as threshold, auc < 0.55 as fired from g union all select 'brier', round(v, 6), 0.25::double, v > 0.25 from b"""
)
def escalation_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Threshold checks on metrics."""
    s = scored_films(spark, d)
    a = metrics.ranking_metrics(s, "y", "p").select(F.lit("auc").alias("id"), F.col("auc").alias("metric"), F.lit(0.55).alias("threshold"), (F.col("auc") < 0.55).alias("fired"))
    b = metrics.threshold_metrics(s, "y", "p").select(F.lit("brier").alias("id"), F.col("brier").alias("metric"), F.lit(0.25).alias("threshold"), (F.col("brier") > 0.25).alias("fired"))
    return _r(a.unionByName(b), 6, "metric")


@query(
    f"""with {FILMS_SQL} select imdb_id, round(ln(1 + case when budget > 0 then budget end), 4) as log_budget, round(ln(1 + case when runtime > 0 then runtime end), 4) as log_runtime, release_year_parsed as year,
(coalesce(primary_genre, '') = 'Drama')::int::double as genre_Drama, (coalesce(primary_genre, '') = 'Comedy')::int::double as genre_Comedy, (coalesce(primary_genre, '') = 'Action')::int::double as genre_Action from films"""
)
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Logs, year and one-hot genres of a fixed vocabulary."""
    f = films(spark, d, "budget", "runtime", "release_year_parsed", "primary_genre")
    log = lambda c: F.round(scalars.money_log(scalars.positive(F.col(c))), 4)
    return f.select("imdb_id", log("budget").alias("log_budget"), log("runtime").alias("log_runtime"), F.col("release_year_parsed").alias("year"), *scalars.one_hot(F.coalesce("primary_genre", F.lit("")), ["Drama", "Comedy", "Action"], "genre_"))


_FEATURES = ["vote_average", "runtime", "popularity", "budget"]


def _training(spark: SparkSession, d: str) -> DataFrame:
    f = films(spark, d, *_FEATURES, "revenue").where("budget > 0 and revenue > 0")
    return cut(f.select("imdb_id", *[F.col(c).cast("double") for c in _FEATURES], (F.col("revenue") > 2 * F.col("budget")).cast("double").alias("label")))


@query()
def logistic_oof(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of a logistic model with balanced weights."""
    rows = models.balanced_weight(_training(spark, d), "label")
    return models.out_of_fold(rows, "imdb_id", models.build_pipeline("linear", "classification", _FEATURES, "weight", maxIter=20), "classification", folds=3)


@query()
def stacking(spark: SparkSession, d: str) -> DataFrame:
    """A linear learner on the out-of-fold scores of two families."""
    rows = _training(spark, d)
    base = {n: models.out_of_fold(rows, "imdb_id", models.build_pipeline(n, "classification", _FEATURES, **p), "classification", folds=2) for n, p in (("linear", {"maxIter": 10}), ("random_forest", {"numTrees": 10}))}
    return models.stack(base, "imdb_id", "classification", folds=2)


@query()
def rf_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importance of the features in a random forest."""
    model = models.build_pipeline("random_forest", "classification", _FEATURES, numTrees=20).fit(_training(spark, d))
    return models.importance(model, _FEATURES)


@query()
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """Loss of each feature when it is shuffled."""
    rows = _training(spark, d)
    model = models.build_pipeline("linear", "classification", _FEATURES, maxIter=10).fit(rows)
    loss = lambda s: metrics.threshold_metrics(s, "label", "score").select(F.col("log_loss").alias("loss"))
    return models.permutation_importance(model, rows, "imdb_id", _FEATURES, loss, "classification")


@query()
def platt_isotonic(spark: SparkSession, d: str) -> DataFrame:
    """Calibration error of three methods, each fitted on the other folds."""
    s, out = cut(scored_films(spark, d)), None
    for m in ("none", "sigmoid", "isotonic"):
        c = calibration.cross_calibrated(s, "imdb_id", "p", "y", m, folds=3)
        part = metrics.calibration_error(metrics.reliability(c, "y", "calibrated")).select(F.lit(m).alias("method"), "ece", "mce")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def paired_rope(spark: SparkSession, d: str) -> DataFrame:
    """Bayesian comparison of three scores over ten folds of the films."""
    s = scored_films(spark, d).withColumn("fold", models.fold_of("imdb_id", 10, 0))
    parts = None
    for name, e in (("given", F.col("p")), ("flat", F.lit(0.5)), ("sharp", F.round(F.pow("p", 2), 6))):
        m = metrics.threshold_metrics(s.withColumn("e", e), "y", "e", ["fold"]).select(F.lit(name).alias("family"), F.lit("brier").alias("metric"), "fold", (-F.col("brier")).alias("score"))
        parts = m if parts is None else parts.unionByName(m)
    return models.paired_comparisons(parts)


@query()
def tree_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Exact contributions of the features to the score of a random forest, for every film."""
    rows = _training(spark, d)
    model = models.build_pipeline("random_forest", "classification", _FEATURES, numTrees=20, maxDepth=4).fit(rows)
    return tree_contributions(model, rows, "imdb_id", _FEATURES)


@query(f"with {FILMS_SQL} select imdb_id, 0 as off from films where budget > 0 and revenue > 0")
def tree_attribution_adds_up(spark: SparkSession, d: str) -> DataFrame:
    """For every film how far the contributions are from the score, in millionths."""
    rows = _training(spark, d)
    model = models.build_pipeline("random_forest", "classification", _FEATURES, numTrees=20, maxDepth=4).fit(rows)
    total = tree_contributions(model, rows, "imdb_id", _FEATURES).groupBy("imdb_id").agg(F.sum("contribution").alias("t"))
    score = model.transform(rows).select("imdb_id", models.score_of(["probability"], "classification").alias("s"))
    return total.join(score, "imdb_id").select("imdb_id", F.round(F.abs(F.col("t") - F.col("s")) * 1e6).cast("int").alias("off"))
