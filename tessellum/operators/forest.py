"""Hierarchies from parent-child links.

``intervals`` turns links into a forest with Euler-tour positions:

1. Peeling: nodes without children are taken away, round by round, until nothing or only
   cycles are left. Each round touches just the leaves of that round and their parents.
   Chains deeper than ``peel_rounds`` are settled by pointer doubling on what remains, in
   ``log2`` of its size.
2. Euler tour: a node has an enter and an exit element; each element knows its successor.
   Nodes on a cycle lose their upward link and head trees of their own, marked as endless.
3. List ranking by pointer doubling gives every element its distance to the tour's end, the
   sum of steps down and up (the depth) and the tour's last element (the root), in ``log2`` of
   the longest tour. Positions follow by subtraction.

A node's descendants are the nodes whose enter position lies within its interval. ``ancestry``
joins them as equals, through the aligned blocks of positions that make up an interval, so
that no join compares all nodes of a tree with each other; blocks have a largest size, so one
huge tree is many join keys.

Defined results: a link with a null end, or from a name to itself, is none; a name is a node
though it has no link; of several parents the most frequent is kept, the alphabetically first
of equals; repeated links only count for that choice. Trees are told apart by ``src``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessellum.sources.scratch import cut, drop

CYCLE = "#cycle"
#: Largest block of tour positions, as a power of two, and thereby rows of one join key.
BLOCK_LEVEL = 12


def clean_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows (src, child, parent): each child with one parent."""
    names = links.select("src", F.explode(F.array("child", "parent")).alias("node")).where("node is not null")
    nodes = names.distinct()
    counted = links.where("child is not null and parent is not null and child <> parent")
    counted = counted.groupBy("src", "child", "parent").count()
    edges = counted.groupBy("src", "child").agg(F.min_by("parent", F.struct(-F.col("count"), "parent")).alias("parent"))
    return nodes, edges


def cycle_nodes(edges: DataFrame, peel_rounds: int = 12) -> DataFrame:
    """(src, node) of the nodes on cycles, of edges with one parent for each child."""
    kids = edges.groupBy("src", F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    # left: the nodes still there, with parent and number of children still there
    left = cut(
        edges.select("src", F.col("child").alias("node"), "parent").join(kids, ["src", "node"], "left").fillna(0, ["kids"]),
        "peel",
    )
    for _ in range(peel_rounds):
        if not left.where("kids = 0").take(1):
            break
        gone = left.where("kids = 0").groupBy("src", F.col("parent").alias("node")).agg(F.count("*").alias("gone"))
        following = cut(
            left.where("kids > 0")
            .join(gone, ["src", "node"], "left")
            .select("src", "node", "parent", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids")),
            "peel",
        )
        drop(left)
        left = following
    else:
        # what remains is cycles and deep chains: double pointers until only cycles still go up
        size = left.count()
        jump = cut(left.select("src", "node", F.col("parent").alias("up")), "jump")
        for _ in range(max(1, math.ceil(math.log2(size + 1))) + 1):
            after = jump.select("src", F.col("node").alias("up"), F.col("up").alias("further"))
            following = cut(jump.join(after, ["src", "up"]).select("src", "node", F.col("further").alias("up")), "jump")
            drop(jump)
            jump = following
        # after as many steps as there are nodes every pointer that has not run out is on a
        # cycle, and steps along a cycle only permute its nodes: the ends are the cycle nodes
        ring = cut(jump.select("src", F.col("up").alias("node")).distinct(), "ring")
        drop(left)
        drop(jump)
        return ring
    return left.select("src", "node")


def intervals(links: DataFrame, peel_rounds: int = 12) -> DataFrame:
    """(src, node, parent, root, depth, enter, leave, endless) of rows (src, child, parent).

    ``root`` heads the node's tree; where ``endless``, the way up never ends, and ``root`` is
    the cycle's node it runs into.
    """
    nodes, edges = clean_links(links)
    edges = cut(edges, "edges")
    rings = cycle_nodes(edges, peel_rounds).withColumn("ring", F.lit(True))
    ringed = edges.join(rings, [edges.src == rings.src, edges.child == rings.node], "left").select(
        edges.src, "child", "parent", F.coalesce("ring", F.lit(False)).alias("ring")
    )
    tree = cut(
        nodes.join(ringed.withColumnRenamed("child", "node"), ["src", "node"], "left").select(
            "src",
            "node",
            F.when(~F.coalesce("ring", F.lit(False)), F.col("parent")).alias("up"),
            "parent",
            F.coalesce("ring", F.lit(False)).alias("ring"),
        ),
        "tree",
    )
    # siblings in a row: a parent with very many children is ordered by range, not in one task
    child = _siblings(tree.where("up is not null").select("src", "up", "node"))
    # successors: enter(v) -> enter(first child) or exit(v); exit(v) -> enter(next sibling) or exit(parent)
    first = child.where("before is null").select("src", F.col("up").alias("node"), F.col("node").alias("first"))
    enter = tree.join(first, ["src", "node"], "left").select(
        "src",
        "node",
        F.lit(True).alias("is_enter"),
        F.coalesce("first", "node").alias("to"),
        F.col("first").isNotNull().alias("to_enter"),
        F.lit(1).alias("step"),
    )
    leave = tree.join(child.select("src", "node", "after"), ["src", "node"], "left").select(
        "src",
        "node",
        F.lit(False).alias("is_enter"),
        F.coalesce("after", "up").alias("to"),
        F.col("after").isNotNull().alias("to_enter"),
        F.lit(-1).alias("step"),
    )
    ranked = _rank(enter.unionByName(leave))
    # the tour of a root has twice as many elements as its tree has nodes
    ins = ranked.where("is_enter").select("src", "node", F.col("last").alias("root"), "dist", "total")
    outs = ranked.where("not is_enter").select("src", "node", F.col("dist").alias("out_dist"))
    roots = ins.where("node = root").select("src", "root", F.col("dist").alias("length"))
    ring_roots = tree.where("ring").select("src", F.col("node").alias("root"), F.lit(True).alias("endless"))
    return (
        tree.select("src", "node", "parent")
        .join(ins, ["src", "node"])
        .join(outs, ["src", "node"])
        .join(roots, ["src", "root"])
        .join(ring_roots, ["src", "root"], "left")
        .select(
            "src",
            "node",
            "parent",
            "root",
            (-F.col("total")).cast("int").alias("depth"),
            (F.col("length") - F.col("dist")).alias("enter"),
            (F.col("length") - F.col("out_dist")).alias("leave"),
            F.coalesce("endless", F.lit(False)).alias("endless"),
        )
    )


def _siblings(child: DataFrame) -> DataFrame:
    """``child`` (src, up, node) with the sibling ``before`` and ``after`` in name order.

    Siblings are dealt to hashed slots and chained inside each slot, the slots' ends are
    chained in slot order: the children of one parent never sit in one task.
    """
    slots = 256
    at = child.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(slots)))
    inside = W.partitionBy("src", "up", "slot").orderBy("node")
    at = at.withColumns({"before": F.lag("node").over(inside), "after": F.lead("node").over(inside)})
    ends = at.groupBy("src", "up", "slot").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    across = W.partitionBy("src", "up").orderBy("slot")
    ends = ends.select(
        "src", "up", "slot", F.lag("high").over(across).alias("prev_high"), F.lead("low").over(across).alias("next_low")
    )
    return at.join(ends, ["src", "up", "slot"]).select(
        "src",
        "up",
        "node",
        F.coalesce("before", "prev_high").alias("before"),
        F.coalesce("after", "next_low").alias("after"),
    )


def _rank(elements: DataFrame) -> DataFrame:
    """List ranking: each element (src, node, is_enter) with ``last`` (the root, whose exit
    ends the list), ``dist`` (elements up to and with the end) and ``total`` (sum of steps
    from the element on). ``to`` null marks the last element."""
    now = cut(
        elements.select(
            "src",
            "node",
            "is_enter",
            "to",
            "to_enter",
            F.when(F.col("to").isNull(), F.col("node")).alias("last"),
            F.lit(1).cast("long").alias("dist"),
            F.col("step").cast("long").alias("total"),
        ),
        "rank",
    )
    while now.where("to is not null").take(1):
        ahead = now.select(
            "src",
            F.col("node").alias("to"),
            F.col("is_enter").alias("to_enter"),
            F.struct("to", "to_enter", "last", "dist", "total").alias("a"),
        )
        done = now.where("to is null")
        moved = now.where("to is not null").join(ahead, ["src", "to", "to_enter"]).select(
            "src",
            "node",
            "is_enter",
            F.col("a.to").alias("to"),
            F.col("a.to_enter").alias("to_enter"),
            F.col("a.last").alias("last"),
            (F.col("dist") + F.col("a.dist")).alias("dist"),
            (F.col("total") + F.col("a.total")).alias("total"),
        )
        following = cut(done.unionByName(moved), "rank")
        drop(now)
        now = following
    return now


def depths(links: DataFrame) -> DataFrame:
    """(src, node, root, depth); root ``#cycle`` and depth -1 where the way up never ends."""
    return intervals(links).select(
        "src",
        "node",
        F.when(F.col("endless"), CYCLE).otherwise(F.col("root")).alias("root"),
        F.when(F.col("endless"), -1).otherwise(F.col("depth")).cast("int").alias("depth"),
    )


def ancestry(tours: DataFrame) -> DataFrame:
    """(src, root, ancestor, ancestor_depth, node, depth) of every pair in ``tours`` (the
    result of ``intervals``), without nodes whose way up never ends."""
    fine = tours.where("not endless")
    # an interval is cut into aligned blocks of positions, the largest that fit
    blocks = fine.where("leave - enter > 1").select(
        "src",
        "root",
        F.col("node").alias("ancestor"),
        F.col("depth").alias("ancestor_depth"),
        F.explode(_cover(F.col("enter") + 1, F.col("leave"))).alias("block"),
    )
    blocks = blocks.select("*", "block.*").drop("block")
    points = fine.select(
        "src",
        "root",
        "node",
        "depth",
        F.explode(F.sequence(F.lit(0), F.lit(BLOCK_LEVEL))).alias("level"),
        "enter",
    ).withColumn("at", F.expr("shiftright(enter, level)"))
    return blocks.join(points, ["src", "root", "level", "at"]).select(
        "src", "root", "ancestor", "ancestor_depth", "node", "depth"
    )


def _range(low: Column, high: Column) -> Column:
    """Array of the whole numbers [low, high)."""
    return F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))


def _at_level(ats: Column, level: int) -> Column:
    return F.transform(ats, lambda x: F.struct(F.lit(level).alias("level"), x.alias("at")))


def _cover(start: Column, end: Column) -> Column:
    """Array of (level, at): the largest aligned blocks that exactly cover [start, end). A
    level gives what lies beside the blocks of the next level, or all where that has none."""
    parts = []
    for level in range(BLOCK_LEVEL + 1):
        size = 1 << level
        low, high = F.ceil(start / size).cast("long"), F.floor(end / size).cast("long")
        ats = _range(low, high)
        if level < BLOCK_LEVEL:
            low_next = F.ceil(start / (size * 2)).cast("long") * 2
            high_next = F.floor(end / (size * 2)).cast("long") * 2
            beside = F.concat(_range(low, low_next), _range(high_next, high))
            ats = F.when(low_next < high_next, beside).otherwise(ats)
        parts.append(_at_level(ats, level))
    return F.concat(*parts)


def paths(tours: DataFrame) -> DataFrame:
    """(src, node, root, depth, path) with the names from the root down, joined by `` > ``."""
    up = ancestry(tours).groupBy("src", "node").agg(
        F.array_sort(F.collect_list(F.struct("ancestor_depth", "ancestor"))).alias("up")
    )
    return (
        tours.where("not endless")
        .join(up, ["src", "node"], "left")
        .select(
            "src",
            "node",
            "root",
            "depth",
            F.array_join(
                F.concat(F.coalesce(F.col("up.ancestor"), F.array().cast("array<string>")), F.array("node")), " > "
            ).alias("path"),
        )
    )
