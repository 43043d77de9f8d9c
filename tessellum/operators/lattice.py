"""Operators on directed graphs of types in which a node may have several parents.

Edges are rows (parent, child). Closures grow by joining what was new with the edges, so the
number of rounds is the depth; every round is written, and no graph comes to the driver. A
hierarchy in which each node has one parent is better served by ``forest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.sources.scratch import cut, drop


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node): every pair joined by a way down, cycles included."""
    step = edges.select("parent", "child").where("parent is not null and child is not null").distinct()
    all_pairs = cut(step.select(F.col("parent").alias("ancestor"), F.col("child").alias("node")), "closure")
    fresh = all_pairs
    while True:
        longer = fresh.join(step, F.col("node") == F.col("parent")).select("ancestor", F.col("child").alias("node")).distinct()
        new = cut(longer.join(all_pairs, ["ancestor", "node"], "left_anti"), "closure-new")
        if not new.take(1):
            return all_pairs
        all_pairs, fresh = cut(all_pairs.unionByName(new), "closure"), new


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges both ends of which are in ``kept`` (node)."""
    names = kept.select("node").distinct()
    low = edges.join(names.withColumnRenamed("node", "child"), "child", "left_semi")
    return low.join(names.withColumnRenamed("node", "parent"), "parent", "left_semi").select(edges.columns)


def with_ancestors(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(node): the nodes of ``kept`` and all above them."""
    up = closure(edges).join(kept.select("node").distinct(), "node", "left_semi")
    return kept.select("node").unionByName(up.select(F.col("ancestor").alias("node"))).distinct()


def below(edges: DataFrame, root: str) -> DataFrame:
    """The edges of the hierarchy that hangs on ``root``."""
    down = closure(edges).where(F.col("ancestor") == root).select("node")
    return induced(edges, down.unionByName(down.sparkSession.createDataFrame([(root,)], "node string")))


def simple_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, path): every path without a repeated node from the nodes of ``starts``
    (node); their number is that of the ways, which is the result asked for."""
    step = edges.select("parent", "child").distinct()
    now = cut(starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path")), "paths")
    out = now
    while True:
        longer = now.join(step, F.col("node") == F.col("parent")).where(~F.array_contains("path", F.col("child")))
        now = cut(longer.select("start", F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path")), "paths")
        if not now.take(1):
            return out
        out = out.unionByName(now)


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest way down to a leaf, so a node stands above all its children;
    nodes on or above a cycle have none and get null."""
    step = edges.select("parent", "child").where("parent <> child").distinct()
    nodes = step.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    left = cut(step, "levels-edges")
    done = cut(nodes.join(step.select(F.col("parent").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("level")), "levels")
    parts, n = [done], 0
    while done.take(1):
        # the edges down to what is done go; parents without further edges are done next
        n += 1
        open_edges = cut(left.join(done.select(F.col("node").alias("child")), "child", "left_anti"), "levels-edges")
        gone = left.select("parent").distinct().join(open_edges.select("parent"), "parent", "left_anti")
        done = cut(gone.select(F.col("parent").alias("node"), F.lit(n).alias("level")), "levels")
        drop(left)
        left = open_edges
        parts.append(done)
    known = parts[0]
    for p in parts[1:]:
        known = known.unionByName(p)
    return nodes.join(known, "node", "left")


def root_branches(edges: DataFrame) -> DataFrame:
    """(node, branch): the child of a root under which a node hangs; several if it has several."""
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    tops = edges.join(roots.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("branch")).distinct()
    under = closure(edges).join(tops, F.col("ancestor") == F.col("branch")).select("node", "branch")
    return tops.select(F.col("branch").alias("node"), "branch").unionByName(under)


def specific(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (node, item) of ``members`` whose item is at none of the node's descendants, of
    which ``pairs`` is the closure: the most specific places of each item."""
    inside = members.select("node", "item").distinct()
    covered = pairs.join(inside, "node").select(F.col("ancestor").alias("node"), "item").distinct()
    return inside.join(covered, ["node", "item"], "left_anti")


def most_specific(members: DataFrame, pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """(item, node): the one most specific node of an item, else, where there are several, the
    deepest node above all of them (of ``tops`` (node, depth)); null where there is none."""
    leaf = cut(specific(members, pairs), "specific")
    counts = leaf.groupBy("item").agg(F.count("*").alias("n"), F.min("node").alias("only"))
    selves = tops.select(F.col("node").alias("ancestor"), "node")
    above = leaf.join(pairs.select("ancestor", "node").unionByName(selves).distinct(), "node")
    shared = above.groupBy("item", "ancestor").agg(F.countDistinct("node").alias("k")).join(counts, "item").where("k = n")
    deepest = shared.join(tops.select(F.col("node").alias("ancestor"), "depth"), "ancestor").groupBy("item").agg(
        F.max_by("ancestor", F.struct("depth", "ancestor")).alias("common")
    )
    return counts.join(deepest, "item", "left").select("item", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("common")).alias("node"))


def covering(members: DataFrame) -> DataFrame:
    """(node): the nodes that have every item there is."""
    have = members.select("node", "item").distinct()
    total = have.select("item").distinct().agg(F.count("*").alias("total"))  # one row
    return have.groupBy("node").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where("n = total").select("node")


def topmost(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(label, node): of the nodes of each label those with the fewest parents."""
    parents = edges.groupBy(F.col("child").alias("node")).agg(F.countDistinct("parent").alias("in_degree"))
    counted = nodes.join(parents, "node", "left").fillna(0, ["in_degree"])
    best = counted.groupBy(label).agg(F.min("in_degree").alias("in_degree"))
    return counted.join(best, [label, "in_degree"]).select(label, "node", "in_degree")


def regrouped(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """(table_group, cluster, members): clusters (cluster, table_name, member) split by the
    group of the member's table (table_name, table_group)."""
    both = clusters.join(groups, "table_name")
    return both.groupBy("table_group", "cluster").agg(F.array_sort(F.collect_set("member")).alias("members"))


def pruned(edges: DataFrame, bad: DataFrame, root: str, weight: Column | None = None) -> DataFrame:
    """``edges`` without those in ``bad``, and ``root`` above the nodes that then have no parent;
    nodes without any edge are gone."""
    kept = edges.join(bad.select("parent", "child").distinct(), ["parent", "child"], "left_anti")
    tops = kept.select(F.col("parent").alias("child")).distinct().join(kept.select("child"), "child", "left_anti")
    extra = tops.where(F.col("child") != root).select(F.lit(root).alias("parent"), "child", (weight if weight is not None else F.lit(1).cast("long")).alias("weight"))
    return kept.select("parent", "child", "weight").unionByName(extra)


def merge_paths(records: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of records (id, path): weighted edges (parent, child, weight) of paths
    without names longer than ``longest``, and (node, records, n) with the records of a node,
    which counts once for each path. A path with one name below its top adds nothing else."""
    names = records.select("id", F.filter("path", lambda p: F.length(p) <= longest).alias("path")).where(F.size("path") > 1)
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("parent"), F.get("path", i + 1).alias("child"))
    )
    edges = names.select(F.inline(pairs)).groupBy("parent", "child").agg(F.count("*").alias("weight"))
    nodes = names.select("id", F.explode("path").alias("node")).groupBy("node").agg(F.countDistinct("id").alias("records"), F.count("*").alias("n"))
    return edges, nodes
