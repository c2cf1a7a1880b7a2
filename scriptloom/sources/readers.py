"""File sources with explicit schemas, and a pluggable source for remote look-ups."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import IMDB_ID, list_column, title_of, year_in_text, year_of

SCRIPTS = "movie_name string, imdb_id string, script string, summary string"
RATINGS = (
    "id long, imdb_id string, title string, original_title string, release_date string, release_year int, vote_average double, vote_count long, "
    "imdb_rating double, averagerating double, meta_score double, budget double, revenue double, runtime double, popularity double, status string, "
    "genres_list string, director string, production_companies string, production_countries string"
)
UNIFIED = (
    "imdb_id string, source string, raw_script string, parse_quality struct<elements_by_type:struct<dialogue:int>>, "
    "scenes array<struct<heading:string,elements:array<struct<type:string,text:string,name:string>>>>"
)
FINANCIALS = "imdb_id string, source string, title string, budget double, revenue double, vote_average double, vote_count long, release_year int, runtime double"


def read_scripts(spark: SparkSession, paths: dict[str, str], with_script: bool = True) -> DataFrame:
    """JSON lines of scripts, one path per split, with origin_split, title and year_in_title. A malformed line fails the read; blank lines are skipped."""
    out = None
    for split, path in paths.items():
        part = spark.read.schema(SCRIPTS).option("mode", "FAILFAST").json(path).withColumn("origin_split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("title", title_of(F.col("movie_name"))).withColumn("year_in_title", year_of(F.col("movie_name")))
    return out.withColumn("script_char_len", F.length("script")) if with_script else out.drop("script")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """CSV of ratings with a header; the list column becomes an array and the year is taken from the date where it is missing."""
    return derive_ratings(spark.read.schema(RATINGS).option("header", True).option("escape", '"').option("multiLine", True).csv(path))


def derive_ratings(df: DataFrame) -> DataFrame:
    """`genres_parsed` and `release_year_parsed` of ratings rows."""
    return df.withColumn("genres_parsed", list_column(F.col("genres_list"))).withColumn("release_year_parsed", F.coalesce(F.col("release_year"), year_in_text(F.col("release_date"))))


def read_unified(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of nested script records."""
    return spark.read.schema(UNIFIED).json(path)


def read_financials(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines projected to nine scalar columns; the scan parses no others."""
    return spark.read.schema(FINANCIALS).json(path)


def unified_units(records: DataFrame) -> DataFrame:
    """(imdb_id, scene_no, at, type, name, text) of nested script records; records without scenes keep one row of nulls."""
    scenes = records.select("imdb_id", F.posexplode_outer("scenes").alias("s", "scene"))
    return scenes.select("imdb_id", (F.col("s") + 1).alias("scene_no"), F.posexplode_outer("scene.elements").alias("at", "e")).select("imdb_id", "scene_no", "at", "e.type", "e.name", "e.text")


def keep_best_unified(records: DataFrame) -> DataFrame:
    """One record per id: the longest raw script, then the most dialogue, then the least raw text."""
    order = F.struct(-F.coalesce(F.length("raw_script"), F.lit(0)), -F.coalesce(F.col("parse_quality.elements_by_type.dialogue"), F.lit(0)), F.col("raw_script"))
    return records.where("imdb_id is not null").groupBy("imdb_id").agg(F.min_by(F.struct(*[c for c in records.columns if c != "imdb_id"]), order).alias("r")).select("imdb_id", "r.*")


def id_validity(df: DataFrame, column: str = "imdb_id") -> DataFrame:
    """(total, valid, invalid, distinct_valid); a null id is invalid."""
    ok = F.coalesce(F.col(column).rlike(IMDB_ID), F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.count_distinct(F.when(ok, F.col(column))).alias("distinct_valid"))


def value_query(ids: Sequence[str]) -> str:
    """SPARQL text that asks for cost and revenue with their units of a batch of ids. Ids that aren't well-formed raise ValueError."""
    import re

    if bad := [i for i in ids if not re.fullmatch(IMDB_ID, i)]:
        raise ValueError(bad)
    values = " ".join(f'"{i}"' for i in ids)
    return (
        "SELECT ?imdb ?cost ?costUnit ?revenue ?revenueUnit WHERE {\n"
        f"  VALUES ?imdb {{ {values} }}\n"
        "  ?film wdt:P345 ?imdb .\n"
        "  OPTIONAL { ?film p:P2130/psv:P2130 [ wikibase:quantityAmount ?cost ; wikibase:quantityUnit ?costUnit ] }\n"
        "  OPTIONAL { ?film p:P2142/psv:P2142 [ wikibase:quantityAmount ?revenue ; wikibase:quantityUnit ?revenueUnit ] }\n"
        "}"
    )


# Fixed value: the unit of amounts that count.
US_DOLLAR = "http://www.wikidata.org/entity/Q4917"
#: A SPARQL answer in JSON, as far as it is read.
_VALUE = "struct<value:string>"
ANSWER = f"struct<results:struct<bindings:array<struct<imdb:{_VALUE},cost:{_VALUE},costUnit:{_VALUE},revenue:{_VALUE},revenueUnit:{_VALUE}>>>>"


def answer_rows(answers: DataFrame, body: str, unit: str = US_DOLLAR) -> DataFrame:
    """(imdb_id, budget, revenue): one row per binding of SPARQL answers in JSON. Amounts in another unit than `unit` and texts that
    are no numbers are null; answers that aren't valid JSON give no rows."""
    b = answers.select(F.explode(F.from_json(body, ANSWER)["results"]["bindings"]).alias("b"))
    amount = lambda n: F.when(F.col(f"b.{n}Unit.value") == unit, F.col(f"b.{n}.value").try_cast("double"))
    return b.select(F.col("b.imdb.value").alias("imdb_id"), amount("cost").alias("budget"), amount("revenue").alias("revenue"))


def largest_per_id(rows: DataFrame) -> DataFrame:
    """One row per id with the largest budget and revenue of its statements; null ids are left out."""
    return rows.where("imdb_id is not null").groupBy("imdb_id").agg(F.max("budget").alias("budget"), F.max("revenue").alias("revenue"))


def value_queries(ids: DataFrame, key: str = "imdb_id", batch: int = 200) -> DataFrame:
    """(batch, query): SPARQL texts for all well-formed ids, each of about `batch` of them, for a client to send; ids are spread by hash."""
    good = ids.select(key).where(F.col(key).rlike(IMDB_ID)).distinct()
    n = F.greatest(F.lit(1), F.ceil(F.col("__n") / batch))
    placed = good.join(F.broadcast(good.agg(F.count("*").alias("__n")))).withColumn("batch", F.pmod(F.xxhash64(key), n).cast("int"))
    head, tail = value_query([]).split("{  }")
    quoted = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda i: F.concat(F.lit('"'), i, F.lit('"'))), " ")
    return placed.groupBy("batch").agg(F.concat(F.lit(head + "{ "), quoted, F.lit(" }" + tail)).alias("query"))


def recorded_answers(recording: DataFrame, ids: DataFrame, key: str = "imdb_id") -> DataFrame:
    """(key, budget, revenue, vote_average, status) of the requested ids from a recording of look-ups: a join, so neither side is held by
    one machine. Zeros are missing; ids without a recorded answer get the status not_found, null ids none."""
    asked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    held = recording.groupBy(key).agg(*[F.max(F.col(c).cast("double")).alias(c) for c in ("budget", "revenue", "vote_average")]).withColumn("__there", F.lit(True))
    some = lambda c: F.when(F.col(c) != 0, F.col(c)).alias(c)
    return asked.join(held, key, "left").select(key, some("budget"), some("revenue"), some("vote_average"), F.when(F.col("__there"), "ok").otherwise("not_found").alias("status"))


class RecordedLookup(DataSource):
    """`spark.read.format("recorded_lookup")`: look-ups answered from a recorded JSON-lines table, for use where the network is absent.

    Options: path (of the recording), ids (comma-separated), parts. A live client takes the place of `answer`.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_lookup"

    def schema(self) -> str:
        return "imdb_id string, budget double, revenue double, vote_average double, status string"

    def reader(self, schema: object) -> DataSourceReader:
        return _LookupReader(self.options)


class _Ids(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class _LookupReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.ids = [i for i in options.get("ids", "").split(",") if i]
        self.parts = int(options.get("parts", "4"))

    def partitions(self) -> list[InputPartition]:
        return [_Ids(self.ids[k :: self.parts]) for k in range(min(self.parts, max(1, len(self.ids))))]

    def read(self, partition: _Ids) -> Iterator[tuple]:
        with open(self.path) as f:
            held = {r["imdb_id"]: r for r in map(json.loads, filter(str.strip, f))}
        for i in partition.ids:
            r = held.get(i)
            zero = lambda k: (r.get(k) or None) if r else None
            yield i, zero("budget"), zero("revenue"), zero("vote_average"), "ok" if r else "not_found"
