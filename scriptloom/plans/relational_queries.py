"""Joins, set operations, derivations, groups, ranks and splits over the film, rating and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import relational, stats
from ..operators.dedupe import keep_one
from ..operators.ranking import average_ranks, quantiles
from ..session import table
from ..sources.readers import derive_ratings, id_validity
from .base import FILMS_SQL, films
from .registry import Registry

query = Registry()

_MATCHED = "select f.imdb_id, f.vote_average, r.vote_average as vote_average_rt, r.meta_score as meta_score_rt from films f left join best r using (imdb_id)"
_BEST = "best as (select * from (select *, row_number() over (partition by imdb_id order by coalesce(vote_count, -1) desc, id) as __n from ratings where imdb_id is not null) where __n = 1)"


def _best_ratings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ratings").where("imdb_id is not null").select("imdb_id", "id", "vote_count", "vote_average", "meta_score", "title", "budget")
    return keep_one(rows, ["imdb_id"], [-F.coalesce("vote_count", F.lit(-1)), F.col("id")], rows.columns)


@query(f"with {_BEST} select imdb_id, id, vote_count from best")
def dedupe_keep_max(spark: SparkSession, d: str) -> DataFrame:
    """Ratings: the row with most votes per id."""
    return _best_ratings(spark, d).select("imdb_id", "id", "vote_count")


@query("select * from (select text, doc_id, source from (select *, row_number() over (partition by text order by length(coalesce(source, '')) desc, doc_id) as __n from documents where text <> '') where __n = 1)")
def dedupe_keep_longest(spark: SparkSession, d: str) -> DataFrame:
    """Documents: of equal texts the row with the longest source name."""
    rows = table(spark, d, "documents").where("text <> ''").select("text", "doc_id", "source")
    return keep_one(rows, ["text"], [-F.length(F.coalesce("source", F.lit(""))), F.col("doc_id")], rows.columns)


@query(f"with {FILMS_SQL}, {_BEST} {_MATCHED}")
def left_join_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Films with the columns of their best rating row."""
    joined = relational.left_enrich(films(spark, d, "vote_average"), _best_ratings(spark, d), "imdb_id", ["vote_average", "meta_score"])
    return joined.withColumnRenamed("meta_score", "meta_score_rt")


@query(
    f"""with {FILMS_SQL}, {_BEST}, m as (select f.*, r.id as rid from films f left join best r using (imdb_id)),
flags as (select rid is not null as a, coalesce(budget > 0 and revenue > 0, false) as b, coalesce(effective_rating > 0, false) as c, coalesce(release_year_parsed between 1900 and 2025, false) as dd, coalesce(release_year_parsed >= 1980, false) as e from m)
select 0 as step, 'all' as label, count(*) as n from flags union all select 1, 'matched', count_if(a)::bigint from flags union all select 2, 'money', count_if(a and b)::bigint from flags
union all select 3, 'rated', count_if(a and b and c)::bigint from flags union all select 4, 'year', count_if(a and b and c and dd)::bigint from flags union all select 5, 'recent', count_if(a and b and c and dd and e)::bigint from flags"""
)
def filter_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Survivors of the corpus filters, in one scan of the joined table."""
    f = films(spark, d, "budget", "revenue", "effective_rating", "release_year_parsed").join(_best_ratings(spark, d).select("imdb_id", "id"), "imdb_id", "left")
    y = F.col("release_year_parsed")
    return relational.funnel(f, [("matched", F.col("id").isNotNull()), ("money", (F.col("budget") > 0) & (F.col("revenue") > 0)), ("rated", F.col("effective_rating") > 0), ("year", y.between(1900, 2025)), ("recent", y >= 1980)])


@query(
    f"""with {FILMS_SQL} select 'unique id' as rule, 0::bigint as n union all select 'title', count_if(not coalesce(title <> '', false))::bigint from films
union all select 'rating range', count_if(not coalesce(vote_average between 0 and 10, false))::bigint from films union all select 'finite log', count_if(not coalesce(isfinite(log_budget), false))::bigint from films"""
)
def validate_films(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the hard checks on films."""
    f = films(spark, d, "title", "vote_average", "log_budget")
    finite = ~F.isnan("log_budget") & (F.abs(F.col("log_budget")) < float("inf"))
    return relational.violations(f, [("unique id", F.col("imdb_id").isNotNull()), ("title", F.col("title") != ""), ("rating range", F.col("vote_average").between(0, 10)), ("finite log", finite)])


@query(
    f"""with {FILMS_SQL}, odd as (select imdb_id, movie_name from films where revenue < budget and revenue > 0), kept as (select imdb_id, movie_name from films where not coalesce(revenue < budget and revenue > 0, false))
select imdb_id, movie_name from kept"""
)
def reviewed_drop_anti(spark: SparkSession, d: str) -> DataFrame:
    """ANTI join against a review table; here every film that lost money is reviewed as dropped in favour of a twin."""
    f = films(spark, d, "movie_name", "budget", "revenue")
    bad = f.where("revenue < budget and revenue > 0")
    review = bad.select("imdb_id", "movie_name", F.lit("Drop").alias("decision")).unionByName(bad.select("imdb_id", F.concat("movie_name", F.lit("*")).alias("movie_name"), F.lit("keep").alias("decision")))
    return relational.drop_reviewed(f.select("imdb_id", "movie_name"), review, ["imdb_id", "movie_name"], "decision")


@query(f"with {FILMS_SQL} select imdb_id, title from films where imdb_id in (select imdb_id from split_assignments where split = 'train')")
def split_semi(spark: SparkSession, d: str) -> DataFrame:
    """Films of the training split."""
    return relational.in_split(films(spark, d, "title"), table(spark, d, "split_assignments"), "imdb_id", "train")


@query("select count(*) as n from (select imdb_id from split_assignments group by 1 having count(distinct split) > 1)")
def split_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Number of ids in more than one split."""
    return relational.split_overlaps(table(spark, d, "split_assignments"), "imdb_id").agg(F.count("*").alias("n"))


@query("select distinct imdb_id from ratings where imdb_id is not null and imdb_id not in (select imdb_id from films_joined where imdb_id is not null)")
def candidate_except(spark: SparkSession, d: str) -> DataFrame:
    """Rated ids that no film has."""
    return relational.candidates(table(spark, d, "ratings"), table(spark, d, "films_joined"), "imdb_id")


@query(
    f"""with {FILMS_SQL}, {_BEST} select imdb_id, title, budget, 'films' as origin from films
union all select imdb_id, title, budget, 'ratings' from best where imdb_id not in (select imdb_id from films)"""
)
def union_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Films, and ratings of other films, by name; films come first."""
    return relational.union_keep_first([("films", films(spark, d, "title", "budget")), ("ratings", _best_ratings(spark, d).select("imdb_id", "title", "budget"))], "imdb_id", "origin").select("imdb_id", "title", "budget", "origin")


@query("select id, r.imdb_id, n_members from ratings r join (select imdb_id, count(*) as n_members from ratings where imdb_id is not null group by 1 having count(*) > 1) using (imdb_id)")
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    """All rating rows of repeated ids."""
    return relational.members_of_repeats(table(spark, d, "ratings").select("id", "imdb_id"), "imdb_id")


@query(
    """with a as (select source, rank() over (order by count(*) desc) as rank_a from documents where source is not null group by 1),
b as (select source, rank() over (order by sum(length(text)) desc) as rank_b from documents where source is not null and text is not null group by 1)
select source, rank_a::int as rank_a, rank_b::int as rank_b, (rank_a - rank_b)::int as delta from a full join b using (source)"""
)
def rank_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Sources ranked by documents and by characters. The windows hold a row per source."""
    from pyspark.sql import Window as W

    rows = table(spark, d, "documents").where("source is not null")
    rank = lambda df, c: df.select("source", F.rank().over(W.orderBy(F.desc(c))).alias("rank"))
    a = rank(rows.groupBy("source").agg(F.count("*").alias("n")), "n")
    b = rank(rows.where("text is not null").groupBy("source").agg(F.sum(F.length("text")).alias("c")), "c")
    return relational.compare_rankings(a, b, "source")


@query(
    f"""with {FILMS_SQL}, {_BEST} select f.imdb_id, case when b.imdb_id is not null and not coalesce(f.status = 'Released', false) then b.budget else f.budget end as budget,
case when b.imdb_id is not null and not coalesce(f.status = 'Released', false) then b.vote_average else f.vote_average end as vote_average from films f left join best b using (imdb_id)"""
)
def conditional_override(spark: SparkSession, d: str) -> DataFrame:
    """Money and rating taken from ratings, except for released films."""
    out = relational.override_where(films(spark, d, "budget", "vote_average", "status"), _best_ratings(spark, d), "imdb_id", ["budget", "vote_average"], F.col("status") == "Released")
    return out.select("imdb_id", "budget", "vote_average")


@query(
    f"""with {FILMS_SQL} select imdb_id, coalesce(case when meta_score > 0 then meta_score end, case when imdb_rating > 0 then imdb_rating end, case when vote_average > 0 then vote_average end) as rating,
round(ln(1 + case when budget > 0 then budget end), 4) as log_budget, round(log10(greatest(revenue, 1.0)), 4) as log10_revenue from films"""
)
def priority_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """First positive rating, and logs of money."""
    return films(spark, d, "meta_score", "imdb_rating", "vote_average", "budget", "revenue").select(
        "imdb_id", scalars.first_positive(["meta_score", "imdb_rating", "vote_average"]).alias("rating"), F.round(scalars.money_log(scalars.positive(F.col("budget"))), 4).alias("log_budget"), F.round(scalars.money_log(F.col("revenue"), "log10"), 4).alias("log10_revenue")
    )


@query(
    f"""with {FILMS_SQL} select imdb_id, round(ln(revenue) - ln(budget), 4) as log_roi, revenue > budget as roi_gt_1, revenue > 2 * budget as roi_gt_2 from films where budget > 0 and revenue > 0"""
)
def log_targets(spark: SparkSession, d: str) -> DataFrame:
    """Log ratio of revenue to budget, and whether it exceeds one and two."""
    f = films(spark, d, "budget", "revenue").where("budget > 0 and revenue > 0")
    return f.select("imdb_id", F.round(F.log("revenue") - F.log("budget"), 4).alias("log_roi"), (F.col("revenue") > F.col("budget")).alias("roi_gt_1"), (F.col("revenue") > 2 * F.col("budget")).alias("roi_gt_2"))


@query(
    r"""select id, list_transform(list_filter(list_transform(string_split(regexp_replace(coalesce(genres_list, ''), '^\s*\[|\]\s*$', '', 'g'), ','), lambda x: regexp_replace(x, '^[\s''"]+|[\s''"]+$', '', 'g')), lambda x: x <> ''), lambda x: x) as genres,
case when regexp_matches(release_date, '^\s*\d{4}(\D|$)') then regexp_extract(release_date, '^\s*(\d{4})', 1)::int when regexp_matches(release_date, '(^|\D)\d{4}\s*$') then regexp_extract(release_date, '(\d{4})\s*$', 1)::int end as year
from ratings where genres_list is null or regexp_matches(genres_list, '^\s*\[[^"]*\]\s*$')"""
)
def list_column_parse(spark: SparkSession, d: str) -> DataFrame:
    """Stringified lists and dates in several notations, parsed; rows whose list has no double quotes."""
    rows = table(spark, d, "ratings").where(r"genres_list is null or genres_list rlike '^\\s*\\[[^\"]*\\]\\s*$'")
    from ..functions.scalars import list_column, year_in_text

    return rows.select("id", list_column(F.col("genres_list")).alias("genres"), year_in_text(F.col("release_date")).alias("year"))


@query()
def list_column_parse_all(spark: SparkSession, d: str) -> DataFrame:
    """Stringified lists and dates of every rating row, with damaged and double-quoted lists."""
    return table(spark, d, "ratings").select("id", scalars.list_column(F.col("genres_list")).alias("genres"), scalars.year_in_text(F.col("release_date")).alias("year"))


@query("select id, coalesce(release_year, case when regexp_matches(release_date, '^\\s*\\d{4}(\\D|$)') then regexp_extract(release_date, '^\\s*(\\d{4})', 1)::int when regexp_matches(release_date, '(^|\\D)\\d{4}\\s*$') then regexp_extract(release_date, '(\\d{4})\\s*$', 1)::int end) as release_year_parsed from ratings")
def ratings_years(spark: SparkSession, d: str) -> DataFrame:
    """The year of every rating row."""
    return derive_ratings(table(spark, d, "ratings")).select("id", "release_year_parsed")


@query("select count(*) as total, count_if(regexp_matches(imdb_id, '^tt\\d{7,8}$'))::bigint as valid, (count(*) - count_if(regexp_matches(imdb_id, '^tt\\d{7,8}$')))::bigint as invalid, count(distinct case when regexp_matches(imdb_id, '^tt\\d{7,8}$') then imdb_id end) as distinct_valid from ratings")
def id_validity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Valid and invalid ids of the ratings."""
    return id_validity(table(spark, d, "ratings"))


@query(
    f"""with {FILMS_SQL}, g as (select imdb_id, lower(trim(primary_genre)) as genre from films), n as (select genre, count(*) as n from g group by 1)
select imdb_id, genre, case when genre is null then null when n.n >= 30 then genre else 'Other' end as genre_bucketed from g left join n using (genre)"""
)
def genre_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Rare genres folded into Other."""
    return relational.bucket_rare(films(spark, d, "primary_genre").select("imdb_id", F.lower(F.trim("primary_genre")).alias("genre")), "genre", 30)


@query(
    f"""with {FILMS_SQL}, g as (select unnest(genres_parsed) as genre from films) select genre, count(*) as n from g where genre is not null group by 1"""
)
def genre_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of every genre in the list column."""
    return films(spark, d, "genres_parsed").select(F.explode("genres_parsed").alias("genre")).where("genre is not null").groupBy("genre").agg(F.count("*").alias("n"))


_DEC5 = "case when release_year_parsed < 1980 then 'pre_1980s' when release_year_parsed < 1990 then '1980s' when release_year_parsed < 2000 then '1990s' when release_year_parsed < 2010 then '2000s' when release_year_parsed is not null then '2010s_2020s' end"
_DEC6 = "case when release_year_parsed is null then 'unknown' when release_year_parsed < 1980 then 'pre_1980' when release_year_parsed < 1990 then '1980s' when release_year_parsed < 2000 then '1990s' when release_year_parsed < 2010 then '2000s' when release_year_parsed < 2020 then '2010s' else '2020s' end"


@query(f"with {FILMS_SQL} select {_DEC5} as decade, count(*) as n, round(median(case when budget > 0 then budget / 1e6 end), 2) as median_budget_m, round(avg(vote_average), 4) as mean_rating from films group by 1")
def decade_profile(spark: SparkSession, d: str) -> DataFrame:
    """Films, median budget and mean rating by decade."""
    f = films(spark, d, "release_year_parsed", "budget", "vote_average").withColumn("decade", scalars.decade_of_five(F.col("release_year_parsed")))
    f = f.withColumn("decade", F.coalesce("decade", F.lit(""))).withColumn("m", scalars.positive(F.col("budget")) / 1e6)
    out = f.groupBy("decade").agg(F.count("*").alias("n"), F.round(F.avg("vote_average"), 4).alias("mean_rating")).join(quantiles(f, "m", {"median_budget_m": 0.5}, ["decade"]), "decade", "left")
    return out.select(F.nullif("decade", F.lit("")).alias("decade"), "n", F.round("median_budget_m", 2).alias("median_budget_m"), "mean_rating")


@query(f"with {FILMS_SQL} select lower(trim(primary_genre)) as genre, count(*) as n, round(median(revenue / budget), 4) as median_ratio from films where budget > 0 and revenue > 0 group by 1 having count(*) >= 5")
def group_profile(spark: SparkSession, d: str) -> DataFrame:
    """Median ratio of revenue to budget by genre, of genres with at least five films."""
    f = films(spark, d, "primary_genre", "budget", "revenue").where("budget > 0 and revenue > 0")
    f = f.select(F.coalesce(F.lower(F.trim("primary_genre")), F.lit("")).alias("genre"), (F.col("revenue") / F.col("budget")).alias("ratio"))
    out = f.groupBy("genre").agg(F.count("*").alias("n")).where("n >= 5").join(quantiles(f, "ratio", {"median_ratio": 0.5}, ["genre"]), "genre")
    return out.select(F.nullif("genre", F.lit("")).alias("genre"), "n", F.round("median_ratio", 4).alias("median_ratio"))


@query(
    f"""with {FILMS_SQL} select {_DEC6} as decade, case when budget is null or budget <= 0 then 'unknown' when budget < 1e7 then 'under_10m' when budget < 5e7 then 'under_50m' when budget < 1.5e8 then 'under_150m' else 'over_150m' end as budget_tier,
count(*) as n, round(avg(vote_average), 4) as mean_rating from films group by 1, 2"""
)
def tier_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Films by the six decades and tiers of budget."""
    f = films(spark, d, "release_year_parsed", "budget", "vote_average")
    tier = scalars.tier(F.col("budget"), [1e7, 5e7, 1.5e8], ["under_10m", "under_50m", "under_150m", "over_150m"])
    return f.groupBy(scalars.decade_of_six(F.col("release_year_parsed")).alias("decade"), tier.alias("budget_tier")).agg(F.count("*").alias("n"), F.round(F.avg("vote_average"), 4).alias("mean_rating"))


@query(
    """select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())"""
)
def grouping_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Several cuts of one table in one scan."""
    df = table(spark, d, "lineitem")
    return df.groupingSets([[df.l_returnflag, df.l_linestatus], [df.l_returnflag], []], df.l_returnflag, df.l_linestatus).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("select stratum, count_if(split = 'train')::bigint as train, count_if(split = 'cal')::bigint as cal, count_if(split = 'test')::bigint as test, count(*) as total from split_assignments group by 1")
def pivot_split_diag(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each stratum by split."""
    return stats.pivot_counts(table(spark, d, "split_assignments"), "stratum", "split", ["train", "cal", "test"])


@query(
    f"""with {FILMS_SQL}, s as (select split, lower(trim(primary_genre)) as genre, vote_average as v from films join split_assignments using (imdb_id)), m as (select split, genre, avg(v) as v from s group by 1, 2),
w as (select genre, max(case when split = 'train' then v end) as o, max(case when split = 'test' then v end) as nw from m group by 1)
select genre, round(o, 4) as old, round(nw, 4) as new, round(nw - o, 4) as delta from w"""
)
def pivot_delta(spark: SparkSession, d: str) -> DataFrame:
    """Mean rating of each genre in train and test, and the difference."""
    f = films(spark, d, "primary_genre", "vote_average").join(table(spark, d, "split_assignments"), "imdb_id")
    m = f.groupBy("split", F.lower(F.trim("primary_genre")).alias("genre")).agg(F.avg("vote_average").alias("v"))
    out = stats.pivot_delta(m, ["genre"], "split", "train", "test", "v")
    return out.select("genre", F.round("old", 4).alias("old"), F.round("new", 4).alias("new"), F.round("delta", 4).alias("delta"))


@query(
    f"""with {FILMS_SQL} select 'n' as metric, count(*)::double as value from films union all select 'n_money', count_if(budget > 0 and revenue > 0)::double from films
union all select 'mean_runtime', round(avg(case when runtime > 0 then runtime end), 4) from films union all select 'n_directors', count(distinct director)::double from films union all select 'max_votes', max(vote_count)::double from films"""
)
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Scalar metrics of the films as rows."""
    f = films(spark, d, "budget", "revenue", "runtime", "director", "vote_count")
    return stats.summary_long(f, [("n", F.count("*")), ("n_money", F.count_if((F.col("budget") > 0) & (F.col("revenue") > 0))), ("mean_runtime", F.round(F.avg(scalars.positive(F.col("runtime"))), 4)), ("n_directors", F.count_distinct("director")), ("max_votes", F.max("vote_count"))])


@query(
    f"""with {FILMS_SQL} select 'runtime' as "column", count(runtime) as n, round(avg(runtime), 4) as mean, round(stddev_samp(runtime), 4) as std, min(runtime) as min, round(quantile_cont(runtime, 0.25), 4) as q25, round(quantile_cont(runtime, 0.5), 4) as q50, round(quantile_cont(runtime, 0.75), 4) as q75, max(runtime) as max from films
union all select 'vote_average', count(vote_average), round(avg(vote_average), 4), round(stddev_samp(vote_average), 4), min(vote_average), round(quantile_cont(vote_average, 0.25), 4), round(quantile_cont(vote_average, 0.5), 4), round(quantile_cont(vote_average, 0.75), 4), max(vote_average) from films"""
)
def describe_columns(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles and moments of two columns."""
    out = stats.describe(films(spark, d, "runtime", "vote_average"), ["runtime", "vote_average"])
    return out.select("column", "n", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@query(
    f"""with {FILMS_SQL}, v as (select log10(greatest(budget, 1.0)) as x from films where budget > 0) select least(floor((x - 3) / 0.3)::int + 1, 20) as bin, count(*) as n from v where x between 3 and 9 group by 1"""
)
def histogram_money(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of the logarithm of budgets."""
    return stats.histogram(films(spark, d, "budget").where("budget > 0"), F.log10(F.greatest("budget", F.lit(1.0))), 3.0, 9.0, 20)


@query(
    f"""with {FILMS_SQL}, p as (select runtime as x, vote_average as y from films where runtime is not null and vote_average is not null),
r as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from p)
select count(*) as n, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from r"""
)
def pearson_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of runtime and rating."""
    return stats.pearson_spearman(films(spark, d, "runtime", "vote_average"), "runtime", "vote_average").select("n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query(
    f"""with {FILMS_SQL}, p as (select lower(trim(primary_genre)) as g, vote_average as y from films where primary_genre is not null and vote_average is not null), m as (select avg(y) as gm, count(*) as n from p),
g as (select g, count(*) as c, avg(y) as a from p group by 1), b as (select sum(c * (a - gm) * (a - gm)) as ssb, count(*) as k from g, m), w as (select sum((y - a) * (y - a)) as ssw from p join g using (g))
select n, k as n_groups, round((ssb / (k - 1)) / (ssw / (n - k)), 4) as f_stat, round(ssb / (ssb + ssw), 6) as eta_squared from m, b, w"""
)
def eta_squared(spark: SparkSession, d: str) -> DataFrame:
    """How much of the variance of ratings lies between genres."""
    f = films(spark, d, "primary_genre", "vote_average").withColumn("g", F.lower(F.trim("primary_genre")))
    return stats.eta_squared(f, "g", "vote_average").select("n", "n_groups", F.round("f_stat", 4).alias("f_stat"), F.round("eta_squared", 6).alias("eta_squared"))


@query(
    f"""with {FILMS_SQL}, a as (select imdb_id, row_number() over (order by popularity desc, imdb_id) as r from films where popularity is not null), b as (select imdb_id, row_number() over (order by vote_count desc, imdb_id) as r from films where vote_count is not null),
x as (select imdb_id from a where r <= 50), y as (select imdb_id from b where r <= 50), i as (select count(*) as n from x where imdb_id in (select imdb_id from y))
select n as n_both, 100 - n as n_any, round(n / (100.0 - n), 6) as jaccard from i"""
)
def jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the 50 most popular and the 50 most voted films."""
    f = films(spark, d, "popularity", "vote_count")
    from pyspark.sql import Window as W

    # a limit first: each task keeps 50 rows, and only those are ranked
    top = lambda c: f.where(F.col(c).isNotNull()).orderBy(F.desc(c), "imdb_id").limit(50).select("imdb_id", F.row_number().over(W.orderBy(F.desc(c), "imdb_id")).alias("rank"))
    return stats.jaccard_top(top("popularity"), top("vote_count"), "imdb_id", 50).withColumn("jaccard", F.round("jaccard", 6))


@query(
    f"""with {FILMS_SQL}, s as (select imdb_id, lower(trim(primary_genre)) as genre, (revenue > budget)::int as y, split from films join split_assignments using (imdb_id) where budget > 0 and revenue > 0),
r as (select genre, avg(y) as a, count(*) as n from s where split = 'train' group by 1 having count(*) >= 10), t as (select avg(y) as a from s where split = 'train')
select imdb_id, round(coalesce(r.a, t.a), 6) as prior from s left join r on s.genre = r.genre, t where split = 'test'"""
)
def group_prior(spark: SparkSession, d: str) -> DataFrame:
    """Target-mean encoding of the genre, learned on the training split."""
    f = films(spark, d, "primary_genre", "budget", "revenue").where("budget > 0 and revenue > 0").join(table(spark, d, "split_assignments"), "imdb_id")
    f = f.select("imdb_id", "split", F.lower(F.trim("primary_genre")).alias("genre"), (F.col("revenue") > F.col("budget")).cast("int").alias("y"))
    return relational.group_prior(f.where("split = 'train'"), f.where("split = 'test'"), ["genre"], "y").select("imdb_id", F.round("prior", 6).alias("prior"))


@query(
    """with here as (select distinct l_orderkey as o, l_suppkey as s from lineitem) select a.s as a, b.s as b, count(*) as weight from here a join here b on a.o = b.o and a.s < b.s group by 1, 2"""
)
def self_pair_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of suppliers that share orders."""
    rows = table(spark, d, "lineitem").select(F.lit(0).alias("g"), "l_orderkey", "l_suppkey")
    return relational.shared_pairs(rows, ["g"], "l_orderkey", "l_suppkey").drop("g")


@query(
    f"""with {FILMS_SQL}, g as (select imdb_id, {_DEC5} as dec, coalesce(lower(trim(primary_genre)), 'none') as genre from films where release_year_parsed is not null), s as (select imdb_id, genre || '|' || dec as stratum from g),
n as (select stratum, count(*) as n from s group by 1) select imdb_id, case when n < 5 then 'rare|rare' else stratum end as stratum from s join n using (stratum)"""
)
def strata_rare(spark: SparkSession, d: str) -> DataFrame:
    """Strata of genre and decade; rare ones together."""
    from ..operators.splits import strata

    f = films(spark, d, "primary_genre", "release_year_parsed").where("release_year_parsed is not null")
    f = f.select("imdb_id", F.coalesce(F.lower(F.trim("primary_genre")), F.lit("none")).alias("genre"), scalars.decade_of_five(F.col("release_year_parsed")).alias("decade"))
    return strata(f, ["genre", "decade"], 5).select("imdb_id", "stratum")


@query(
    """with o as (select o_orderkey, o_orderpriority as s, (o_orderkey * 7919) % 10007 as h from orders), r as (select *, row_number() over (partition by s order by h, o_orderkey) as rn, count(*) over (partition by s) as n from o)
select o_orderkey, case when rn <= round(0.7 * n) then 'train' when rn <= round(0.85 * n) then 'cal' else 'test' end as split from r"""
)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """70/15/15 within each stratum, by a fixed order of the keys."""
    from ..operators.splits import stratified

    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", ((F.col("o_orderkey") * 7919) % 10007).alias("h"))
    return stratified(o, "o_orderkey", "o_orderpriority", "h", {"train": 0.7, "cal": 0.15, "test": 0.15}).select("o_orderkey", "split")


@query(
    """with o as (select o_orderkey, o_orderstatus as s, (o_orderkey * 7919) % 10007 as h from orders), r as (select *, row_number() over (partition by s order by h, o_orderkey) as rn from o) select o_orderkey, ((rn - 1) % 5)::int as fold from r"""
)
def fold_assign(spark: SparkSession, d: str) -> DataFrame:
    """Five stratified folds."""
    from ..operators.splits import folds

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", ((F.col("o_orderkey") * 7919) % 10007).alias("h"))
    return folds(o, "o_orderkey", "o_orderstatus", "h", 5).select("o_orderkey", "fold")


@query("with m as (select count(*) as n, sum((revenue > budget)::int) as pos from films_joined where budget > 0 and revenue > 0) select pos::bigint as pos, (n - pos)::bigint as neg, round(n / (2.0 * pos), 6) as w_pos, round(n / (2.0 * (n - pos)), 6) as w_neg from m")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Balanced weights of a binary target."""
    from ..operators.models import balanced_weight

    f = table(spark, d, "films_joined").where("budget > 0 and revenue > 0").select((F.col("revenue") > F.col("budget")).cast("int").alias("label"))
    w = balanced_weight(f, "label")
    return w.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.round(F.max(F.when(F.col("label") == 1, F.col("weight"))), 6).alias("w_pos"), F.round(F.max(F.when(F.col("label") == 0, F.col("weight"))), 6).alias("w_neg"))


@query(
    f"""with {FILMS_SQL}, r as (select imdb_id, rank() over (order by popularity) + (count(*) over (partition by popularity) - 1) / 2.0 as rank from films where popularity is not null) select imdb_id, rank from r"""
)
def average_rank(spark: SparkSession, d: str) -> DataFrame:
    """Average ranks without a global window."""
    f = films(spark, d, "popularity").where("popularity is not null")
    return f.join(average_ranks(f, "popularity"), "popularity").select("imdb_id", "rank")


@query(f"""with {FILMS_SQL}, r as (select *, row_number() over (partition by lower(trim(primary_genre)) order by popularity desc nulls last, imdb_id) as place from films) select lower(trim(primary_genre)) as genre, imdb_id, popularity, place::int as place from r where place <= 3""")
def top_per_genre(spark: SparkSession, d: str) -> DataFrame:
    """The three most popular films of each genre."""
    f = films(spark, d, "primary_genre", "popularity").withColumn("genre", F.lower(F.trim("primary_genre")))
    return relational.best_per_group(f, ["genre"], [F.desc_nulls_last("popularity"), F.col("imdb_id")], ["imdb_id", "popularity"], 3)
