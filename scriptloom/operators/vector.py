"""Pooling, projection and nearest neighbours of float vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, vector): element-wise mean in double precision; null vectors don't count. Lengths within a group must agree."""
    rows = df.where(F.col(vector).isNotNull()).select(group, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(F.col("__v"))).alias("vector"))


def pca(train: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, pc): scores of `rows` on k components fitted on `train` alone. Vectors are centred; each component's largest weight is positive."""
    as_vector = lambda d: d.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    scaler = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(as_vector(train))
    model = PCA(k=k, inputCol="c", outputCol="pc").fit(scaler.transform(as_vector(train)))
    weights = model.pc.toArray()
    signs = np.sign(weights[np.abs(weights).argmax(axis=0), np.arange(k)])
    scored = model.transform(scaler.transform(as_vector(rows))).select(key, vector_to_array("pc").alias("pc"))
    return scored.select(key, F.transform("pc", lambda x, i: x * F.get(F.lit([float(s) for s in signs]), i)).alias("pc"))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 2000) -> DataFrame:
    """(query, neighbour, distance, place): the k nearest rows by Euclidean distance of a stated query set, without the row itself.

    Queries are sent to the workers in blocks of a fixed size; every task keeps its k best per query, and the best of those are
    ranked. Ties are broken by the neighbour's key. Null vectors have no neighbours and are none.
    """
    q = queries.where(F.col(vector).isNotNull()).select(key, vector).orderBy(key)
    spark, out, batch = rows.sparkSession, None, []

    def part(items: list) -> DataFrame:
        ids, vecs = np.array([r[0] for r in items]), np.array([r[1] for r in items], dtype=np.float64)
        held = spark.sparkContext.broadcast((ids, vecs))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qi, qv = held.value
            best_d = np.full((len(qi), 0), np.inf)
            best_i = np.full((len(qi), 0), -1, dtype=np.int64)
            for pdf in batches:
                x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                own = pdf[key].to_numpy()
                d = np.sqrt(np.maximum((qv**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * qv @ x.T, 0))
                d[qi[:, None] == own[None]] = np.inf
                d, i = np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(own, (len(qi), len(own)))])
                order = np.lexsort((i, np.round(d, 9)), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            ok = np.isfinite(best_d)
            yield pd.DataFrame({"query": np.repeat(qi, best_d.shape[1])[ok.ravel()], "neighbour": best_i[ok], "distance": best_d[ok]})

        return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, "query long, neighbour long, distance double")

    for r in q.toLocalIterator():
        batch.append((r[0], r[1]))
        if len(batch) == block:
            out = part(batch) if out is None else out.unionByName(part(batch))
            batch = []
    if batch or out is None:
        out = part(batch) if out is None else out.unionByName(part(batch))
    best = F.slice(F.array_sort(F.collect_list(F.struct(F.round("distance", 9).alias("distance"), "neighbour"))), 1, k)
    return out.groupBy("query").agg(best.alias("b")).select("query", F.posexplode("b").alias("p", "b")).select("query", "b.neighbour", "b.distance", (F.col("p") + 1).alias("place"))
