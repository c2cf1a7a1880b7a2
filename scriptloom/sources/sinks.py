"""Sinks: Parquet artefacts, an incremental cache, and a ledger of runs.

All paths go through Hadoop's file systems, so they may lie on any shared store that the cluster knows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import keep_one


def save_artefacts(films: DataFrame, parsed: DataFrame, folder: str, heavy: tuple[str, ...] = ("script", "summary")) -> tuple[str, str]:
    """Write the master table without its heavy columns, and the parsed scripts as nested Parquet. Overwrites."""
    films.drop(*heavy).write.mode("overwrite").parquet(f"{folder}/films")
    parsed.write.mode("overwrite").parquet(f"{folder}/parsed")
    return f"{folder}/films", f"{folder}/parsed"


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache, or an empty frame of its schema where there is none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def enrich_cached(requested: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame], key: str, stamp: str, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of the requested keys, new cache). Only keys the cache lacks are fetched, all with `refresh`; the newest row of a key counts.

    Failures a fetch reports as rows are cached like successes.
    """
    asked = requested.select(key).where(F.col(key).isNotNull()).distinct()
    missing = asked if refresh else asked.join(cache.select(key), key, "left_anti")
    grown = cache.unionByName(fetch(missing))
    newest = keep_one(grown.withColumn("__age", -F.coalesce(F.unix_micros(F.col(stamp).cast("timestamp")), F.lit(0))), [key], [F.col("__age")], grown.columns)
    return newest.join(asked, key, "left_semi"), newest


def write_cache(cache: DataFrame, path: str) -> None:
    """Replace the cache. The rows are written beside it and moved, so that a frame that reads the old cache can be written and a lost
    job leaves the old one."""
    spark = cache.sparkSession
    cache.write.mode("overwrite").parquet(path + ".new")
    fs, old = _fs(spark, path)
    fs.delete(old, True)
    fs.rename(_fs(spark, path + ".new")[1], old)


def _fs(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file; replaces one that is there."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def unless_there(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The Parquet table at `path`; built and written where it is missing, or with `rebuild`."""
    if rebuild or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Run:
    """One run of the ledger."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.open = spark, folder, True

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("the run is closed")

    def record(self, name: str, values: dict) -> None:
        """Write a manifest; raises RuntimeError after the run is closed."""
        self._check()
        write_text(self.spark, f"{self.folder}/{name}.json", json.dumps(values, sort_keys=True))

    def save_model(self, model: object, name: str = "model") -> str:
        """Write a fitted Spark ML model into the run; `PipelineModel.load` and the like read it."""
        self._check()
        model.write().overwrite().save(f"{self.folder}/{name}")
        return f"{self.folder}/{name}"


@contextmanager
def run_ledger(spark: SparkSession, root: str, phase: str, name: str, params: dict | None = None, now: datetime | None = None) -> Iterator[Run]:
    """A run directory <phase>/<time>_<name> with manifests, and a line of the ledger when the run ends well.

    Each run writes its line as a file of its own, so runs that end at once don't meet.
    """
    at = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S")
    folder = f"{root}/{phase}/{at}_{name}"
    run = Run(spark, folder)
    run.record("params", params or {})
    try:
        yield run
        write_text(spark, f"{root}/runs/{phase}_{at}_{name}.json", json.dumps({"phase": phase, "name": name, "at": at, "folder": folder}))
    finally:
        run.open = False


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The ledger as a table, the last run of each (phase, name) marked, newest first."""
    runs = spark.read.schema("phase string, name string, at string, folder string").json(f"{root}/runs")
    last = runs.groupBy("phase", "name").agg(F.max("at").alias("__last"))
    return runs.join(last, ["phase", "name"]).withColumn("latest", F.col("at") == F.col("__last")).drop("__last").orderBy(F.desc("at"), "phase", "name")


def read_manifests(spark: SparkSession, root: str, phase: str, name: str) -> DataFrame:
    """(folder, body): a manifest of every run of a phase that has it, as JSON text."""
    whole = spark.read.option("wholetext", True).text(f"{root}/{phase}/*/{name}.json")
    return whole.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("folder"), F.col("value").alias("body"))


def read_cells(spark: SparkSession, root: str, phase: str) -> DataFrame:
    """(folder, matrix, family, target, metric, value): the metrics of the last run of each cell, without trial runs and runs that
    name no cell. Entries whose name begins with an underscore are no targets."""
    params = read_manifests(spark, root, phase, "params").select("folder", F.from_json("body", "matrix string, family string, mode string").alias("p")).select("folder", "p.*")
    cells = params.where("matrix is not null and family is not null and coalesce(mode, '') <> 'smoke'")
    got = read_manifests(spark, root, phase, "metrics").select("folder", F.from_json("body", "per_target map<string,map<string,double>>").alias("m")).select("folder", F.explode("m.per_target").alias("target", "values"))
    rows = cells.drop("mode").join(got, "folder").where(~F.col("target").startswith("_"))
    last = rows.groupBy("matrix", "family").agg(F.max("folder").alias("folder"))
    return rows.join(last, ["matrix", "family", "folder"]).select("folder", "matrix", "family", "target", F.explode("values").alias("metric", "value"))
