"""Type hierarchies from column clusters: dendrograms, cuts and layered trees.

Two tables are as near as the column clusters they share. The dendrogram of one type's tables
needs all their distances in one place, so each type is one group of at most
``clustering.MAX_ITEMS`` tables; larger ones raise an error. What follows from the merges (edges,
leaves below a node, common ancestors, attributes) is relational.

Dendrogram nodes are the names of tables and, for merge k of a type, ``#k``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.operators import clustering as C, lattice


def table_distances(tabs: np.ndarray, clusters: np.ndarray) -> tuple[list, np.ndarray]:
    """The tables, and 1 - m / (columns of both + m) with m shared clusters; 1 without any. A
    row is a column with its table and cluster."""
    names, at = np.unique(tabs, return_inverse=True)
    _, ct = np.unique(clusters, return_inverse=True)
    inside = np.zeros((len(names), ct.max() + 1 if len(ct) else 0))
    inside[at, ct] = 1
    shared, sizes = inside @ inside.T, np.bincount(at, minlength=len(names))
    total = sizes[:, None] + sizes[None, :] + shared
    dist = 1 - shared / total
    np.fill_diagonal(dist, 0)
    return list(names), dist


def cut_at(merges: list, n: int, height: float) -> np.ndarray:
    """Cluster numbers when all merges up to ``height`` are made."""
    return C.labels_at(merges, n, n - sum(1 for m in merges if m[2] <= height))


def best_cut(merges: list, dist: np.ndarray, steps: int = 20) -> tuple[float, float, np.ndarray]:
    """(height, silhouette, labels) of the best of ``steps`` equidistant heights inside the
    dendrogram; the first of equals."""
    n = len(dist)
    top = max((m[2] for m in merges), default=0.0)
    best = (0.0, -np.inf, np.arange(n))
    for h in np.linspace(0, top, steps + 2)[1:-1]:
        labels = cut_at(merges, n, h)
        score = round(C.silhouette(dist, labels), 9)
        if score > best[1]:
            best = (float(h), score, labels)
    return best


def layers(merges: list, dist: np.ndarray, delta: float = 0.1, steps: int = 20) -> list[np.ndarray]:
    """The best cut, and then each higher cut with a silhouette within ``delta`` of it and fewer
    clusters than the one before."""
    height, score, labels = best_cut(merges, dist, steps)
    out = [labels]
    top = max((m[2] for m in merges), default=0.0)
    for h in np.linspace(0, top, steps + 2)[1:-1]:
        if h <= height:
            continue
        now = cut_at(merges, len(dist), h)
        if abs(C.silhouette(dist, now) - score) < delta and now.max() < out[-1].max():
            out.append(now)
    return out


def layered_edges(names: list, cuts: list[np.ndarray]) -> list[tuple[str, str, int]]:
    """(parent, child, layer): tables hang on the bottom clusters of more than one table, each
    cluster on the smallest one of a higher layer that holds it."""
    edges, below = [], []
    for k, labels in enumerate(cuts):
        now = []
        for c in range(labels.max() + 1):
            inside = frozenset(np.flatnonzero(labels == c))
            if len(inside) > 1:
                now.append((inside, f"L{k}:{names[min(inside)]}"))
        for inside, node in now:
            if k == 0:
                edges += [(node, str(names[i]), k) for i in sorted(inside)]
            else:
                edges += [(node, b, k) for bi, b in below if bi < inside]
        kept = [(bi, b) for bi, b in below if not any(bi < inside for inside, _ in now)]
        # a cluster that stays as it is keeps its node
        below = kept + [(i, n) for i, n in now if not any(i == bi for bi, _ in kept)]
    return edges


def _groups(members: DataFrame, run, schema: str) -> DataFrame:
    def checked(pdf: pd.DataFrame) -> pd.DataFrame:
        tables = pdf["tab"].nunique()
        if tables > C.MAX_ITEMS:
            raise ValueError(f"a type of {tables} tables; a dendrogram takes {C.MAX_ITEMS} at most")
        return run(pdf)

    rows = members.select("grp", F.col("tab").cast("string").alias("tab"), F.col("cluster").cast("string").alias("cluster"))
    return rows.groupBy("grp").applyInPandas(checked, schema)


def dendrograms(members: DataFrame) -> DataFrame:
    """(grp, step, left, right, height, size): complete linkage of the tables of each group, of
    rows (grp, tab, cluster), one for each column."""
    kind = dict(members.dtypes)["grp"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, dist = table_distances(pdf["tab"].to_numpy(), pdf["cluster"].to_numpy())
        node = lambda i: names[i] if i < len(names) else f"#{i - len(names)}"
        rows = [(pdf["grp"].iloc[0], k, node(a), node(b), round(h, 9), s) for k, (a, b, h, s) in enumerate(C.linkage(dist, "complete"))]
        return pd.DataFrame(rows, columns=["grp", "step", "left", "right", "height", "size"])

    return _groups(members, run, f"grp {kind}, step int, left string, right string, height double, size int")


def hierarchies(members: DataFrame, delta: float = 0.1) -> DataFrame:
    """(grp, parent, child, layer): the layered tree of each group."""
    kind = dict(members.dtypes)["grp"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, dist = table_distances(pdf["tab"].to_numpy(), pdf["cluster"].to_numpy())
        merges = C.linkage(dist, "complete")
        rows = [(pdf["grp"].iloc[0], *e) for e in layered_edges(names, layers(merges, dist, delta))]
        return pd.DataFrame(rows, columns=["grp", "parent", "child", "layer"])

    return _groups(members, run, f"grp {kind}, parent string, child string, layer int")


def best_cuts(members: DataFrame) -> DataFrame:
    """(grp, tab, cluster, height, silhouette): the best cut of each group's dendrogram."""
    kind = dict(members.dtypes)["grp"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, dist = table_distances(pdf["tab"].to_numpy(), pdf["cluster"].to_numpy())
        height, score, labels = best_cut(C.linkage(dist, "complete"), dist)
        out = pd.DataFrame({"grp": pdf["grp"].iloc[0], "tab": names, "cluster": labels})
        return out.assign(height=round(height, 9), silhouette=score if np.isfinite(score) else None)

    return _groups(members, run, f"grp {kind}, tab string, cluster int, height double, silhouette double")


def dendrogram_edges(merges: DataFrame) -> DataFrame:
    """(parent, child) of merges of one or several groups; nodes of groups are told apart."""
    name = lambda c: F.when(F.col(c).startswith("#"), F.concat("grp", F.col(c))).otherwise(F.col(c))
    parent = F.concat("grp", F.lit("#"), "step")
    return merges.select(parent.alias("parent"), F.explode(F.array(name("left"), name("right"))).alias("child"))


def leaves_below(edges: DataFrame) -> DataFrame:
    """(node, leaf): the leaves under each inner node."""
    inner = edges.select(F.col("parent").alias("node")).distinct()
    return lattice.closure(edges).join(inner, "node", "left_anti").select(F.col("ancestor").alias("node"), F.col("node").alias("leaf"))


def common_ancestors(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, node): the lowest node above all leaves of each cluster (cluster, leaf)."""
    under = leaves_below(edges)
    sizes = under.groupBy("node").agg(F.count("*").alias("size"))
    wanted = clusters.groupBy("cluster").agg(F.countDistinct("leaf").alias("n"))
    hits = clusters.distinct().join(under, "leaf").groupBy("cluster", "node").agg(F.count("*").alias("k")).join(wanted, "cluster").where("k = n")
    return hits.join(sizes, "node").groupBy("cluster").agg(F.min_by("node", F.struct("size", "node")).alias("node"))


def simplified(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(parent, child): the hierarchy of the ``kept`` nodes (node) alone, each below the nearest
    kept one; of several nearest all."""
    names = kept.select("node").distinct()
    pairs = lattice.closure(edges).join(names, "node", "left_semi").join(names.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
    longer = pairs.alias("x").join(pairs.alias("y"), F.col("x.node") == F.col("y.ancestor")).select(F.col("x.ancestor").alias("ancestor"), F.col("y.node").alias("node"))
    direct = pairs.join(longer.distinct(), ["ancestor", "node"], "left_anti")
    return direct.select(F.col("ancestor").alias("parent"), F.col("node").alias("child"))


def node_attributes(edges: DataFrame, columns: DataFrame, subjects: DataFrame) -> DataFrame:
    """(node, cluster, n): how many columns of each cluster the tables at and below a node have,
    of columns (tab, col, cluster) without the subject columns (tab, col)."""
    rest = columns.join(subjects, ["tab", "col"], "left_anti")
    at = rest.select(F.col("tab").alias("node"), "cluster")
    below = rest.join(lattice.closure(edges), F.col("tab") == F.col("node")).select(F.col("ancestor").alias("node"), "cluster")
    return at.unionByName(below).groupBy("node", "cluster").agg(F.count("*").alias("n"))
