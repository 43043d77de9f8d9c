"""Weighted type graphs: merging paths, pruning edges, degrees, supports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def edges_of_paths(paths: DataFrame, path: str) -> DataFrame:
    """(parent, child, weight) of arrays of names from the root down."""
    steps = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(path) - 1, F.lit(1))),
        lambda i: F.struct(
            F.try_element_at(path, i.cast("int")).alias("parent"), F.try_element_at(path, (i + 1).cast("int")).alias("child")
        ),
    )
    pairs = paths.where(F.size(path) > 1).select(F.inline(steps))
    return pairs.groupBy("parent", "child").agg(F.count("*").alias("weight"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("parent = child")


def weaker_inverses(edges: DataFrame) -> DataFrame:
    """Edges whose reversed edge is strictly heavier."""
    back = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"), F.col("weight").alias("other"))
    return edges.join(back, ["parent", "child"]).where("weight < other").drop("other")


def nucleus(edges: DataFrame, share: float) -> DataFrame:
    """Outgoing edges of each parent, heaviest first, until their weights pass ``share`` of
    its total; edges as light as the one that passes it are dropped with those below."""
    order = W.partitionBy("parent").orderBy(F.desc("weight"), "child").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("parent")
    part = edges.withColumn("cum", F.sum("weight").over(order) / F.sum("weight").over(whole))
    cutoff = F.max(F.when(F.col("cum") > share, F.col("weight"))).over(whole)
    return part.withColumn("cut", cutoff).where(F.col("cut").isNull() | (F.col("weight") > F.col("cut"))).select("parent", "child", "weight")


def post_process(edges: DataFrame, root: str = "Thing") -> DataFrame:
    """Edges without self-loops and weaker inverses, and ``root`` above nodes without parent."""
    bad = self_loops(edges).unionByName(weaker_inverses(edges)).select("parent", "child")
    kept = edges.join(bad, ["parent", "child"], "left_anti")
    tops = kept.select(F.col("parent").alias("child")).distinct().join(kept.select("child"), "child", "left_anti")
    added = tops.where(F.col("child") != root).select(F.lit(root).alias("parent"), "child", F.lit(1).cast("long").alias("weight"))
    return kept.unionByName(added)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree); roots have no in-degree, leaves no out-degree."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("parent").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("child").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.select("e.*").groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def shared_cluster_distance(members: DataFrame) -> DataFrame:
    """(t_i, t_j, dist) for tables that share a column cluster: 1 - m / (|i| + |j| + m) with m
    shared clusters, of rows (tab, col, cluster). Pairs without a shared cluster have 1."""
    sizes = members.groupBy("tab").agg(F.count("*").alias("size"))
    links = members.select("tab", "cluster").distinct()
    pairs = (
        links.alias("a")
        .join(links.alias("b"), F.col("a.cluster") == F.col("b.cluster"))
        .where("a.tab < b.tab")
        .groupBy(F.col("a.tab").alias("t_i"), F.col("b.tab").alias("t_j"))
        .agg(F.count("*").alias("m"))
    )
    si = sizes.select(F.col("tab").alias("t_i"), F.col("size").alias("size_i"))
    sj = sizes.select(F.col("tab").alias("t_j"), F.col("size").alias("size_j"))
    dist = 1 - F.col("m") / (F.col("size_i") + F.col("size_j") + F.col("m"))
    return pairs.join(si, "t_i").join(sj, "t_j").select("t_i", "t_j", F.round(dist, 6).alias("dist"))
