"""Co-occurrence graphs, one per group (a film). Density, shares, Gini and clustering are plain DataFrame plans; path and
spectral measures run per graph, on graphs whose vertices are the cast with a minimum of lines."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import shared_pairs


def significant(df: DataFrame, group: str, member: str, least: int = 5) -> DataFrame:
    """(group, member, n_lines) of members with at least `least` rows; null and empty members don't count."""
    return df.where(F.col(member).isNotNull() & (F.col(member) != "")).groupBy(group, member).agg(F.count("*").alias("n_lines")).where(F.col("n_lines") >= least)


def edges(df: DataFrame, nodes: DataFrame, group: str, scene: str, member: str) -> DataFrame:
    """(group, a, b, weight) between significant members."""
    return shared_pairs(df.select(group, scene, member).distinct().join(nodes.select(group, member), [group, member], "left_semi"), [group], scene, member)


def node_measures(nodes: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n_nodes, gini, top1_share, top3_share, n_leads): leads have at least the lines of the member at rank ceil(0.1 n)."""
    w = W.partitionBy(group)
    r = nodes.withColumn("up", F.row_number().over(w.orderBy("n_lines", member))).withColumn("down", F.row_number().over(w.orderBy(F.desc("n_lines"), member))).withColumn("n", F.count("*").over(w))
    r = r.withColumn("bar", F.max(F.when(F.col("down") == F.ceil(F.col("n") * 0.1), F.col("n_lines"))).over(w))
    total = F.sum("n_lines")
    return r.groupBy(group).agg(
        F.count("*").alias("n_nodes"),
        ((2 * F.sum(F.col("up") * F.col("n_lines")) - (F.count("*") + 1) * total) / (F.count("*") * total)).alias("gini"),
        (F.max("n_lines") / total).alias("top1_share"),
        (F.sum(F.when(F.col("down") <= 3, F.col("n_lines"))) / total).alias("top3_share"),
        F.count_if(F.col("n_lines") >= F.col("bar")).alias("n_leads"),
    )


def density(nodes: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """(group, n_nodes, n_edges, density, mean_weight); density is null under two nodes."""
    n = nodes.groupBy(group).agg(F.count("*").alias("n_nodes"))
    e = pairs.groupBy(group).agg(F.count("*").alias("n_edges"), F.avg("weight").alias("mean_weight"))
    return n.join(e, group, "left").na.fill(0, ["n_edges"]).withColumn("density", F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)))


def clustering(nodes: DataFrame, pairs: DataFrame, group: str, member: str) -> DataFrame:
    """(group, clustering): mean local coefficient without weights, 0 for nodes of degree below 2; null under three nodes."""
    ends = pairs.select(group, F.col("a").alias("u")).union(pairs.select(group, F.col("b")))
    degree = ends.groupBy(group, "u").agg(F.count("*").alias("d"))
    # every edge points to its end of higher degree, so no node has more than sqrt(2 m) edges going out, a hub least of all
    d = lambda n: degree.select(group, F.col("u").alias(n), F.col("d").alias("d" + n))
    up = pairs.select(group, "a", "b").join(d("a"), [group, "a"]).join(d("b"), [group, "b"])
    rises = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = up.select(group, F.when(rises, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(rises, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = out.join(out.select(group, "x", F.col("y").alias("z")), [group, "x"]).where("y < z")
    triangles = wedges.join(pairs.select(group, F.col("a").alias("y"), F.col("b").alias("z")), [group, "y", "z"])
    closed = triangles.select(group, F.explode(F.array("x", "y", "z")).alias("u")).groupBy(group, "u").agg(F.count("*").alias("t"))
    local = nodes.select(group, F.col(member).alias("u")).join(degree, [group, "u"], "left").join(closed, [group, "u"], "left")
    c = F.coalesce(F.try_divide(2.0 * F.coalesce("t", F.lit(0)), F.col("d") * (F.col("d") - 1)), F.lit(0.0))
    return local.groupBy(group).agg(F.when(F.count("*") >= 3, F.avg(c)).alias("clustering"))


def _neighbours(names: list[str], pairs: list[tuple[str, str, float]]) -> dict[str, dict[str, float]]:
    g: dict[str, dict[str, float]] = {x: {} for x in names}
    for a, b, w in pairs:
        if a in g and b in g:
            g[a][b] = g[b][a] = float(w)
    return g


def components(g: dict) -> list[list[str]]:
    left, out = set(g), []
    for s in sorted(g):
        if s in left:
            reached, todo = {s}, [s]
            while todo:
                for v in g[todo.pop()]:
                    if v not in reached:
                        reached.add(v)
                        todo.append(v)
            left -= reached
            out.append(sorted(reached))
    return out


def _distances(g: dict, s: str) -> dict[str, int]:
    at, todo = {s: 0}, deque([s])
    while todo:
        u = todo.popleft()
        for v in g[u]:
            if v not in at:
                at[v] = at[u] + 1
                todo.append(v)
    return at


def max_betweenness(g: dict) -> float:
    """Largest normalised betweenness, without weights; 0 under three nodes."""
    n = len(g)
    if n < 3:
        return 0.0
    total = dict.fromkeys(g, 0.0)
    for s in g:
        order, parents, paths, dist, todo = [], {v: [] for v in g}, dict.fromkeys(g, 0.0), {s: 0}, deque([s])
        paths[s] = 1.0
        while todo:
            u = todo.popleft()
            order.append(u)
            for v in g[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    todo.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
                    parents[v].append(u)
        share = dict.fromkeys(g, 0.0)
        for v in reversed(order):
            for u in parents[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                total[v] += share[v]
    return max(total.values()) / ((n - 1) * (n - 2))


def diameter(g: dict) -> float:
    """Longest shortest path in the largest component (of equals the first by name); 0 for one node."""
    big = max(components(g), key=len)
    return float(max(max(_distances(g, s).values()) for s in big))


def modularity(g: dict) -> float | None:
    """Weighted modularity of communities merged greedily by the unweighted gain; None without edges. Equal gains go by name."""
    m2 = sum(len(v) for v in g.values())
    if not m2:
        return None
    names = sorted(g)
    part = {u: [u] for u in names}
    degree = {u: len(g[u]) / m2 for u in names}
    between = {u: {v: 1 / m2 for v in g[u]} for u in names}
    while True:
        gain, u, v = max(((2 * (e - degree[a] * degree[b]), a, b) for a in between for b, e in between[a].items() if a < b), key=lambda x: (round(x[0], 12), [-ord(c) for c in x[1] + x[2]]), default=(0.0, "", ""))
        if gain <= 1e-12:
            break
        part[u] += part.pop(v)
        degree[u] += degree.pop(v)
        for w, e in between.pop(v).items():
            if w != u:
                between[u][w] = between[w][u] = between[u].get(w, 0.0) + e
            between[w].pop(v, None)
    weight = sum(x for u in g for x in g[u].values())
    strength = {u: sum(g[u].values()) for u in g}
    return sum(sum(g[u].get(v, 0.0) for u in p for v in p) / weight - (sum(strength[u] for u in p) / weight) ** 2 for p in part.values())


def eigen_centrality(g: dict, who: str, rounds: int = 1000, tol: float = 1e-6) -> float:
    """Eigenvector centrality of one node within its component, without weights; 1 for a lone node."""
    own = next(c for c in components(g) if who in c)
    if len(own) == 1:
        return 1.0
    at = {u: i for i, u in enumerate(own)}
    ends = np.array([(at[u], at[v]) for u in own for v in g[u]], dtype=np.int64)
    x = np.full(len(own), len(own) ** -0.5)
    for _ in range(rounds):
        y = x + np.bincount(ends[:, 0], weights=x[ends[:, 1]], minlength=len(own))
        y /= np.linalg.norm(y)
        if np.abs(y - x).sum() < len(own) * tol:
            x = y
            break
        x = y
    return float(x[at[who]])


def path_measures(nodes: DataFrame, pairs: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n_components, diameter, max_betweenness, modularity, top1_eigen) of each graph with at least two nodes.

    One task holds one graph: the significant cast of a film, never its lines.
    """
    row = nodes.select(group, F.col(member).alias("a"), F.lit("").alias("b"), F.col("n_lines").cast("double").alias("w")).union(pairs.select(group, "a", "b", F.col("weight").cast("double")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["b"] == ""].sort_values(["w", "a"], ascending=[False, True])
        names = own["a"].tolist()
        if len(names) < 2:
            return pd.DataFrame(columns=[group, "n_components", "diameter", "max_betweenness", "modularity", "top1_eigen"])
        g = _neighbours(names, list(pdf[pdf["b"] != ""][["a", "b", "w"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(pdf[group].iloc[0], len(components(g)), diameter(g), max_betweenness(g), modularity(g), eigen_centrality(g, names[0]))], columns=[group, "n_components", "diameter", "max_betweenness", "modularity", "top1_eigen"])

    kind = nodes.schema[group].dataType.simpleString()
    return row.groupBy(group).applyInPandas(run, f"{group} {kind}, n_components int, diameter double, max_betweenness double, modularity double, top1_eigen double")
