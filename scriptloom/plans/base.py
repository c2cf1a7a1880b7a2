"""Tables the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.dedupe import keep_one, keep_one_wide
from ..session import table


def films(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each film once, as first delivered; null ids are left out."""
    cols = ["imdb_id", *columns]
    rows = table(spark, d, "films_joined").where("imdb_id is not null")
    return keep_one(rows.select(*dict.fromkeys([*cols, "loaded_at"])), ["imdb_id"], [F.col("loaded_at")], cols)


def scenes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each scene once, as first delivered."""
    cols = ["scene_id", *columns]
    keep = keep_one_wide if "dialogue_units" in columns else keep_one
    return keep(table(spark, d, "scenes").where("scene_id is not null").select(*dict.fromkeys([*cols, "loaded_at"])), ["scene_id"], [F.col("loaded_at")], cols)


def units(spark: SparkSession, d: str) -> DataFrame:
    """(imdb_id, scene_id, unit_no, speaker, text) of the dialogue units of each scene once; null units are left out."""
    rows = scenes(spark, d, "imdb_id", "dialogue_units").select("imdb_id", "scene_id", F.posexplode("dialogue_units").alias("at", "u"))
    return rows.select("imdb_id", "scene_id", (F.col("at") + 1).alias("unit_no"), "u.speaker", "u.text")


def scored_films(spark: SparkSession, d: str) -> DataFrame:
    """(imdb_id, genre, y, p, target, guess): a binary label, a probability, a numeric target and a guess at it, from the film table.

    They are stand-ins for predictions, derived by fixed formulas so that SQL can derive them, too.
    """
    rows = films(spark, d, "primary_genre", "vote_average", "budget", "revenue", "runtime").where("budget > 0 and revenue > 0 and vote_average > 0 and runtime > 0")
    g = F.lower(F.trim("primary_genre"))
    return rows.select(
        "imdb_id",
        F.coalesce(g, F.lit("none")).alias("genre"),
        (F.col("revenue") > F.col("budget")).cast("int").alias("y"),
        F.round(scalars.sigmoid((F.col("vote_average") - 5.5) / 2 + (F.col("runtime") - 110) / 100), 3).alias("p"),
        F.round(F.log("revenue") - F.log("budget"), 6).alias("target"),
        F.round((F.col("vote_average") - 5.5) / 3, 6).alias("guess"),
    )


#: The same tables in SQL, as common table expressions.
FILMS_SQL = "films as (select * from (select *, row_number() over (partition by imdb_id order by loaded_at) as __n from films_joined where imdb_id is not null) where __n = 1)"
SCENES_SQL = "once as (select * from (select *, row_number() over (partition by scene_id order by loaded_at) as __n from scenes where scene_id is not null) where __n = 1)"
UNITS_SQL = f"{SCENES_SQL}, units as (select imdb_id, scene_id, generate_subscripts(dialogue_units, 1) as unit_no, unnest(dialogue_units).speaker as speaker, unnest(dialogue_units).text as text from once)"
SCORED_SQL = f"""{FILMS_SQL}, scored as (select imdb_id, coalesce(lower(trim(primary_genre)), 'none') as genre, case when revenue > budget then 1 else 0 end as y,
  round(1 / (1 + exp(-((vote_average - 5.5) / 2 + (runtime - 110) / 100))), 3) as p, round(ln(revenue) - ln(budget), 6) as target, round((vote_average - 5.5) / 3, 6) as guess
  from films where budget > 0 and revenue > 0 and vote_average > 0 and runtime > 0)"""
