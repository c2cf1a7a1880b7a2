"""Queries on nested script records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import nested
from ..session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.unit_positions(table(spark, d, "script_records"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "script_records"))["records"]


def p5_scenes(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "script_records"))["scenes"]


def p5_units(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "script_records"))["units"]


QUERIES = {f.__name__: f for f in (p5_found, p5_records, p5_scenes, p5_units)}
ORACLE_SQL: dict[str, str] = {}
