"""Reports over the films and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, calibration, metrics, models, reports, stats
from ..session import cut, table
from ..sources import readers
from .base import FILMS_SQL, SCORED_SQL, films, scored_films
from .model_queries import _COEF, _training
from .registry import Registry

query = Registry()

_LIFT = f"""with {SCORED_SQL}, m as (select genre, 'brier' as metric, avg((p - y) ** 2) as value from scored group by 1 union all select genre, 'accuracy', avg(((p >= 0.5)::int = y)::int) from scored group by 1),
f as (select genre, 'brier' as metric, 0.25 as floor from scored group by 1 union all select genre, 'accuracy', 0.5 from scored group by 1)"""


@query(_LIFT + " select genre, metric, round(case when metric = 'brier' then floor - value else value - floor end, 6) as lift, round(case when metric = 'brier' then floor - value else value - floor end, 9) between -0.05 and 0.05 as in_band from m join f using (genre, metric)")
def lift_over_floor(spark: SparkSession, d: str) -> DataFrame:
    """Lift of two metrics of each genre over a floor of fixed values."""
    s = scored_films(spark, d)
    m = s.groupBy("genre").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))
    rows = reports.unpivot(m, ["genre"], ["brier", "accuracy"])
    floor = rows.select("genre", "metric", F.when(F.col("metric") == "brier", 0.25).otherwise(0.5).alias("value"))
    out = reports.lift_over_floor(rows, floor, ["genre", "metric"], "metric", ["brier"], (-1.0, 1.0))
    return out.select("genre", "metric", F.round("lift", 6).alias("lift"), F.round("lift", 9).between(-0.05, 0.05).alias("in_band"))


@query(f"with {SCORED_SQL}, x as (select genre, (substr(imdb_id, 4)::bigint % 5) as fold, avg((p - y) ** 2) as v from scored group by 1, 2) select genre, count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std from x group by 1")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of a loss over five folds, by genre."""
    s = scored_films(spark, d).withColumn("fold", F.substring("imdb_id", 4, 20).cast("long") % 5)
    per = s.groupBy("genre", "fold").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("v"))
    out = reports.fold_summary(per, ["genre"], "v")
    return out.select("genre", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    f"""with {SCORED_SQL}, a as (select 0 as i, 'surest' as rule, imdb_id from (select * from scored order by p desc, imdb_id limit 1) union all select 1, 'least sure', imdb_id from (select * from scored order by abs(p - 0.5), imdb_id limit 1)
union all select 2, 'best missed', imdb_id from (select * from scored where y = 1 order by p, imdb_id limit 1)) select arg_min(rule, i) as rule, imdb_id from a group by imdb_id"""
)
def example_picks(spark: SparkSession, d: str) -> DataFrame:
    """One example per rule (a top-1 report)."""
    s = scored_films(spark, d)
    return reports.picks(s, "imdb_id", [("surest", None, [F.desc("p"), F.col("imdb_id")]), ("least sure", None, [F.abs(F.col("p") - 0.5), F.col("imdb_id")]), ("best missed", F.col("y") == 1, [F.col("p"), F.col("imdb_id")])])


@query(
    f"""with {FILMS_SQL}, g as (select release_year_parsed as y, lower(trim(primary_genre)) as genre, avg(vote_average) as v, count(*) as n from films where vote_average is not null group by 1, 2)
select genre, arg_min(y, struct_pack(a := -v, b := y)) as year, round(max(v), 6) as v from g where genre is not null and y is not null group by 1"""
)
def best_by_direction(spark: SparkSession, d: str) -> DataFrame:
    """The year of each genre with the best mean rating; ties to the earlier."""
    f = films(spark, d, "release_year_parsed", "primary_genre", "vote_average").where("vote_average is not null and primary_genre is not null and release_year_parsed is not null")
    g = f.groupBy(F.col("release_year_parsed").alias("year"), F.lower(F.trim("primary_genre")).alias("genre")).agg(F.avg("vote_average").alias("v")).withColumn("metric", F.lit("rating"))
    return reports.best_by_direction(g, ["genre"], "metric", "v", ["rmse"], F.col("year")).select("genre", "year", F.round("v", 6).alias("v"))


@query(f"with {FILMS_SQL} select 'train' as run, 'rating' as target, imdb_id as id, vote_average as score, imdb_rating as y from films")
def oof_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays of run records as rows; a record per film is written as JSON and read again."""
    f = films(spark, d, "vote_average", "imdb_rating")
    one = F.struct(F.array("vote_average").alias("score"), F.array("imdb_rating").alias("y"))
    rec = F.to_json(F.struct(F.array("imdb_id").alias("ids"), F.create_map(F.lit("rating"), one).alias("per_target")))
    return reports.oof_rows(f.select(F.lit("train").alias("run"), rec.alias("j")), "run", "j")


@query(
    f"""with {FILMS_SQL}, p as (select runtime as x, vote_average as y, lower(trim(primary_genre)) as g from films where vote_average is not null), q as (select * from p where x is not null),
r as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from q),
m as (select avg(y) as gm, count(*) as n from p where g is not null), gg as (select g, count(*) as c, avg(y) as a from p where g is not null group by 1), b as (select sum(c * (a - gm) * (a - gm)) as ssb from gg, m), w as (select sum((y - a) * (y - a)) as ssw from p join gg using (g))
select 'runtime' as variable, 'pearson' as test, count(*) as n, round(corr(x, y), 6) as stat, abs(corr(x, y)) > 0.3 as flagged from r union all select 'runtime', 'spearman', count(*), round(corr(rx, ry), 6), abs(corr(rx, ry)) > 0.3 from r
union all select 'g', 'eta_squared', n, round(ssb / (ssb + ssw), 6), ssb / (ssb + ssw) > 0.09 from m, b, w"""
)
def audit_table(spark: SparkSession, d: str) -> DataFrame:
    """Association of ratings with runtime and genre, with flags."""
    f = films(spark, d, "runtime", "vote_average", "primary_genre").withColumn("g", F.lower(F.trim("primary_genre")))
    return stats.audit(f, ["runtime"], ["g"], "vote_average").select("variable", "test", "n", F.round("stat", 6).alias("stat"), "flagged")


@query()
def audit_p_values(spark: SparkSession, d: str) -> DataFrame:
    """The same with p-values."""
    f = films(spark, d, "runtime", "popularity", "vote_average", "primary_genre").withColumn("g", F.lower(F.trim("primary_genre")))
    return stats.audit(f, ["runtime", "popularity"], ["g"], "vote_average")


@query()
def layered_report(spark: SparkSession, d: str) -> DataFrame:
    """Score, conformal sets and attributions of every film in one plan."""
    s = scored_films(spark, d)
    sets = calibration.class_sets(s, calibration.class_quantiles(s, "p", "y", [0.8, 0.9]), "p").select("imdb_id", "level", "in_0", "in_1")
    f = films(spark, d, "title", *_COEF)
    top = attribution.top_per_row(attribution.linear_contributions(f, f, "imdb_id", _COEF), "imdb_id", 2)
    return reports.layered_report(f.select("imdb_id", F.coalesce("title", "imdb_id").alias("title")), s.select("imdb_id", "p"), sets, top, "imdb_id")


@query(f"with {SCORED_SQL} select (2 * count(*))::bigint as n_rows, 0::bigint as n_unequal from scored")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    """Conformal sets of all films at once against those of each genre by itself: rows, and rows that differ."""
    s = scored_films(spark, d)
    q = calibration.class_quantiles(s, "p", "y", [0.8, 0.9])
    keep = lambda x: calibration.class_sets(x, q, "p").select("imdb_id", "level", "in_0", "in_1", "set_size")
    by_part = keep(s.where("genre = 'drama'")).unionByName(keep(s.where("genre <> 'drama'")))
    every = keep(s)
    return reports.unequal_rows(every, by_part).agg(F.count("*").alias("n_unequal")).join(F.broadcast(every.agg(F.count("*").alias("n_rows")))).select("n_rows", "n_unequal")


@query()
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a small grid of a linear model over three folds."""
    rows = _training(spark, d).withColumn("fold", models.fold_of("imdb_id", 3, 0))
    return models.grid_search(rows, "linear", "classification", ["vote_average", "runtime"], {"regParam": [0.0, 0.1], "maxIter": [10]}, folds=3)[1]


@query()
def best_calibration(spark: SparkSession, d: str) -> DataFrame:
    """The calibration method with the least error."""
    s, out = cut(scored_films(spark, d)), None
    for m in ("none", "sigmoid"):
        part = metrics.calibration_error(metrics.reliability(calibration.cross_calibrated(s, "imdb_id", "p", "y", m, folds=2), "y", "calibrated")).select(F.lit(m).alias("method"), "ece", "mce")
        out = part if out is None else out.unionByName(part)
    return calibration.best_method(out)


@query(
    """with a as (select l_suppkey as k, count(*)::double as n, sum(l_quantity) as q from lineitem where l_linenumber = 1 group by 1), b as (select l_suppkey as k, count(*)::double as n, sum(l_quantity) as q from lineitem where l_linenumber = 2 group by 1)
select k, 'n' as metric, round(abs(b.n - a.n) * 100 / greatest(a.n, 1), 4) as pct from a join b using (k) union all select k, 'q', round(abs(b.q - a.q) * 100 / greatest(a.q, 1), 4) from a join b using (k)"""
)
def percent_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of one version of a table against another, for all keys both have."""
    li = table(spark, d, "lineitem")
    version = lambda n: li.where(F.col("l_linenumber") == n).groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    return reports.percent_errors(version(1), version(2), "k", ["n", "q"]).select("k", "metric", F.round("pct", 4).alias("pct"))


_CELLS = f"""with {SCORED_SQL}, b as (select genre as family, avg((p - y) ** 2) as v from scored group by 1), cells as (select family, m as matrix, round(v, 1) as value from b, (values ('all_five'), ('standalone_x')) as t(m))"""


@query(_CELLS + " select matrix, family, value from cells order by value, matrix not like 'standalone%', matrix, family limit 1")
def benchmark_winner(spark: SparkSession, d: str) -> DataFrame:
    """The best cell by rounded errors of genres, with ties that the rule has to settle."""
    b = scored_films(spark, d).groupBy(F.col("genre").alias("family")).agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 1).alias("value"))
    cells = b.select("family", "value", F.explode(F.array(F.lit("all_five"), F.lit("standalone_x"))).alias("matrix"), F.lit("brier").alias("metric"), F.lit("t").alias("target"), F.lit("oof_global").alias("eval_set"), F.lit("primary").alias("tier"))
    return reports.winner(cells, "t", "brier", minimised=True)


@query(f"with {SCORED_SQL} select genre, 'brier' as metric, round(avg(case when y = 1 then (p - y) ** 2 end), 6) as train, round(avg(case when y = 0 then (p - y) ** 2 end), 6) as oof, round(avg(case when y = 0 then (p - y) ** 2 end) - avg(case when y = 1 then (p - y) ** 2 end), 6) as gap from scored group by 1")
def train_oof_gap(spark: SparkSession, d: str) -> DataFrame:
    """The gap between two sets of errors of each genre."""
    rows = scored_films(spark, d).select("genre", F.lit("brier").alias("metric"), F.when(F.col("y") == 1, "train").otherwise("oof").alias("eval_set"), F.pow(F.col("p") - F.col("y"), 2).alias("value"))
    return reports.fold_gap(rows, ["genre"], ["brier"]).select("genre", "metric", *[F.round(c, 6).alias(c) for c in ("train", "oof", "gap")])


@query()
def benchmark_cells(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of two families on two sets of features, searched, scored out of fold and on training rows."""
    families = {"linear": {"regParam": [0.0, 0.1]}, "random_forest": {"numTrees": [10], "maxDepth": [3]}}
    return models.benchmark(_training(spark, d), "imdb_id", "classification", {"standalone_money": ["budget", "runtime"], "all": ["budget", "runtime", "vote_average", "popularity"]}, families, "label", folds=3)


@query(
    """with r as (select imdb_id, budget, revenue, id % 3 as k from ratings) select imdb_id, max(case when k <> 1 then budget end) as budget, max(case when k <> 2 then revenue end) as revenue from r where imdb_id is not null group by 1"""
)
def lookup_answers(spark: SparkSession, d: str) -> DataFrame:
    """Remote answers in JSON, written from the ratings with some amounts in another currency, read again: the largest amount of each id."""
    r = table(spark, d, "ratings")
    value = lambda c: F.when(c.isNotNull(), F.struct(c.cast("string").alias("value")))
    unit = lambda k: F.struct(F.when(F.col("id") % 3 == k, "http://www.wikidata.org/entity/Q4916").otherwise(readers.US_DOLLAR).alias("value"))
    binding = F.struct(value(F.col("imdb_id")).alias("imdb"), value(F.col("budget")).alias("cost"), unit(1).alias("costUnit"), value(F.col("revenue")).alias("revenue"), unit(2).alias("revenueUnit"))
    answers = r.select(F.to_json(F.struct(F.struct(F.array(binding).alias("bindings")).alias("results"))).alias("body"))
    return readers.largest_per_id(readers.answer_rows(answers, "body"))
