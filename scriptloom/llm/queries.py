"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import abuse, chunking, leakage, mixing, names, sampling, scenes, terms


def _speakers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scenes").select("imdb_id", F.explode("dialogue_units").alias("u")).select("imdb_id", F.col("u.speaker").alias("speaker"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = names.linked_pairs(names.resolve_names(_speakers(spark, d), "imdb_id", "speaker"))
    return pairs.select(F.col("film").alias("imdb_id"), "speaker_a", "speaker_b")


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the entity it belongs to."""
    return names.resolve_names(_speakers(spark, d), "imdb_id", "speaker").withColumnRenamed("film", "imdb_id")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scenes").select("scene_id", "loaded_at", scenes.dialogue_text().alias("dialogue"), scenes.speech_lengths().alias("lengths"))
    return chunking.split_oversized(scenes.once(rows, "dialogue", "lengths"), ["scene_id"], "dialogue", limit=1200, overlap=120, lengths="lengths")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all scenes."""
    return _pieces(spark, d)


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each scene put together again from its pieces, without their overlaps, and whether the pieces keep order, limit and overlap."""
    return chunking.rebuild(_pieces(spark, d), ["scene_id"], limit=1200, overlap=120)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 1 and n_pieces > 1").select("scene_id")


def _decade(year: str) -> Column:
    y = F.col(year)
    return F.when(y < 1980, "pre_1980s").when(y < 1990, "1980s").when(y < 2000, "1990s").when(y < 2010, "2000s").otherwise("2010s_2020s")


def _films(spark: SparkSession, d: str) -> DataFrame:
    """Each film once, with its normal genre and decade. Of several deliveries with a valid year, the least genre and year count."""
    rows = table(spark, d, "films_joined").where("imdb_id is not null and release_year_parsed between 1900 and 2025")
    rows = rows.select("imdb_id", sampling.normal_label(F.col("primary_genre_bucketed")).alias("genre"), F.col("release_year_parsed").alias("year"))
    return rows.groupBy("imdb_id").agg(F.min("genre").alias("genre"), F.min("year").alias("year")).select("imdb_id", "genre", _decade("year").alias("decade"))


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = table(spark, d, "sample_targets")
    size = int(targets.agg(F.max("sample_size")).first()[0] or 0)
    plan = targets.select(sampling.normal_label(F.col("genre_label")).alias("genre"), sampling.normal_label(F.col("decade_label")).alias("decade"), "genre_label", "decade_label", "target_permille", "min_films")
    sample, report = sampling.proportional_sample(_films(spark, d), "imdb_id", ["genre", "decade"], plan, "target_permille", "min_films", size)
    return sample, report, plan


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0]


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Every target cell with what it has, wants and got."""
    _, report, plan = _sample(spark, d)
    return report.join(plan.select("genre", "decade", "genre_label", "decade_label"), ["genre", "decade"]).select("genre_label", "decade_label", "available", "wanted", "taken", "short_by", "short")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_report(spark, d).where("short").select("genre_label", "decade_label")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scenes").select("scene_id", "loaded_at", F.transform("dialogue_units", lambda u: u["text"]).alias("texts"))
    return terms.term_frequencies(scenes.once(rows, "texts"), "texts")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """All terms with their counts and marks."""
    return _terms(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark <> 'useful'").select("term", "mark")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked item with the number of documents that hold it and the largest share held."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.round(F.max("held"), 6).alias("max_held"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights"))[1]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The listed sources whose every document the fit leaves at its cap without reaching their share."""
    return p7_report(spark, d).where("kind = 'listed' and not reachable").select("source")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    taken, stand_for = abuse.labelled_sample(documents, table(spark, d, "review_labels"))
    return abuse.score_documents(documents, abuse.fit(taken, stand_for), "source")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score."""
    return _scored(spark, d).select("doc_id", "score", "abusive")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per source."""
    return abuse.rates_by_source(_scored(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("abusive").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_entities, p2_found, p2_pieces, p2_rebuilt, p3_found, p3_sample, p3_report, p4_found, p4_terms, p6_found, p6_items, p7_found, p7_mix, p7_report, p8_found, p8_scores, p8_rates,
    )
}

_ONCE = "select scene_id, min_by(dialogue_units, loaded_at) as dialogue_units from scenes group by scene_id"

_TERMS = rf"""
with once as ({_ONCE}),
units as (select scene_id, unnest(dialogue_units) as u from once),
words as (select scene_id, lower(unnest(regexp_extract_all(replace(u.text, '’', ''''), '\p{{L}}[\p{{L}}''\-]*'))) as term from units where u.text is not null),
counted as (select term, count(*) as n_occurrences, count(distinct scene_id) as n_records from words group by term),
total as (select count(distinct scene_id) as n from words)
select term, n_occurrences, n_records, case when n_records < 3 then 'rare' when n_records > 0.25 * n then 'common' else 'useful' end as mark from counted, total
"""

_CELLS = r"""
with films as (select imdb_id, min(lower(regexp_replace(primary_genre_bucketed, '^\s+|\s+$', '', 'g'))) as genre, min(release_year_parsed) as y
  from films_joined where imdb_id is not null and release_year_parsed between 1900 and 2025 group by imdb_id),
cells as (select genre, case when y < 1980 then 'pre_1980s' when y < 1990 then '1980s' when y < 2000 then '1990s' when y < 2010 then '2000s' else '2010s_2020s' end as decade, count(*) as n
  from films group by all)
select genre_label, decade_label from sample_targets left join cells on genre = lower(trim(genre_label)) and decade = lower(trim(decade_label))
where coalesce(n, 0) < greatest(min_films, ceil(target_permille * sample_size / 1000.0))
"""

_REPORT = r"""
with films as (select imdb_id, min(lower(regexp_replace(primary_genre_bucketed, '^\s+|\s+$', '', 'g'))) as genre, min(release_year_parsed) as y
  from films_joined where imdb_id is not null and release_year_parsed between 1900 and 2025 group by imdb_id),
cells as (select genre, case when y < 1980 then 'pre_1980s' when y < 1990 then '1980s' when y < 2000 then '1990s' when y < 2010 then '2000s' else '2010s_2020s' end as decade, count(*) as n
  from films group by all),
plan as (select *, lower(trim(genre_label)) as genre, lower(trim(decade_label)) as decade, sum(target_permille) over () as whole from sample_targets),
seats as (select genre, decade, r, sample_size, case when r <= min_films then 0e0 when target_permille > 0 then (r - 5e-1) / target_permille end as p from plan join cells using (genre, decade), unnest(range(1, n + 1)) as u(r)),
chosen as (select genre, decade, count(*) as taken from (select *, row_number() over (order by p, genre, decade, r) as place from seats where p is not null) where p = 0 or place <= sample_size group by all),
report as (select genre_label, decade_label, coalesce(n, 0) as available, greatest(ceil(round(target_permille * sample_size / whole::double, 9))::bigint, min_films) as wanted, coalesce(taken, 0) as taken from plan left join cells using (genre, decade) left join chosen using (genre, decade))
select *, greatest(0, wanted - available) as short_by, available < wanted as short from report
"""

_SAMPLE = r"""
with films as (select imdb_id, min(lower(regexp_replace(primary_genre_bucketed, '^\s+|\s+$', '', 'g'))) as genre, min(release_year_parsed) as y
  from films_joined where imdb_id is not null and release_year_parsed between 1900 and 2025 group by imdb_id),
cells as (select imdb_id, genre, case when y < 1980 then 'pre_1980s' when y < 1990 then '1980s' when y < 2000 then '1990s' when y < 2010 then '2000s' else '2010s_2020s' end as decade from films),
plan as (select *, lower(trim(genre_label)) as genre, lower(trim(decade_label)) as decade from sample_targets),
ranked as (select imdb_id, genre, decade, target_permille, min_films, sample_size, row_number() over (partition by genre, decade order by md5(imdb_id || ':42'), imdb_id) as rnk from cells join plan using (genre, decade)),
seats as (select *, case when rnk <= min_films then 0e0 when target_permille > 0 then (rnk - 5e-1) / target_permille::double end as priority from ranked)
select imdb_id, genre, decade, rnk, priority from (select *, row_number() over (order by priority, genre, decade, imdb_id) as place from seats where priority is not null) where priority = 0 or place <= sample_size
"""

#: What `p2_rebuilt` must give: the text of each scene, whatever the pieces are.
_REBUILT = rf"""
with once as ({_ONCE}),
texts as (select scene_id, coalesce(array_to_string(list_transform(list_filter(dialogue_units, lambda x: x.text is not null and x.text <> ''), lambda x: x.text), chr(10)), '') as t from once)
select scene_id, length(t) as n_chars, md5(t) as digest, true as in_order, true as within_limit, true as overlaps_kept, length(t) > 1200 as was_cut from texts
"""

ORACLE_SQL: dict[str, str] = {
    "p2_rebuilt": _REBUILT,
    "p3_sample": _SAMPLE,
    "p3_report": _REPORT,
    "p2_found": rf"""
with once as ({_ONCE})
select scene_id from once
where length(array_to_string(list_transform(list_filter(dialogue_units, lambda x: x.text is not null and x.text <> ''), lambda x: x.text), chr(10))) > 1200
""",
    "p3_found": _CELLS,
    "p4_terms": _TERMS,
    "p4_found": f"select term, mark from ({_TERMS}) where mark <> 'useful'",
    "p7_found": r"""
with named as (select lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) as name, sum(length(text)) as n from documents group by all),
everything as (select sum(n) as n from named)
select w.source from source_weights w left join named d on d.name = lower(trim(w.source)), everything e
where w.target_weight * e.n > w.max_repeats * coalesce(d.n, 0)
""",
}
