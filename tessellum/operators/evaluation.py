"""Scores of clusters, labels and hierarchies against a ground truth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessellum.operators import lattice, relational as R, vectors as V


def label_lists(df: DataFrame, item: str, label: str) -> DataFrame:
    """(item, labels): the labels of each item as one sorted list."""
    return df.groupBy(item).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def list_purity(clusters: DataFrame, labels: DataFrame, item: str) -> DataFrame:
    """(item, cluster, labels, majority, wrong) of clusters (item, cluster) and lists of labels:
    a cluster's majority is its most frequent list, wrong are items that share no label with it."""
    rows = clusters.join(labels, item)
    best = R.majority(rows, ["cluster"], "labels").select("cluster", F.col("labels").alias("majority"))
    return rows.join(best, "cluster").withColumn("wrong", ~F.arrays_overlap("labels", "majority"))


def purity(judged: DataFrame, total: DataFrame) -> DataFrame:
    """(purity): 1 - wrong / total; ``total`` (n) is one row."""
    return judged.agg(F.sum(F.col("wrong").cast("long")).alias("w")).crossJoin(total).select(F.round(1 - F.col("w") / F.col("n"), 6).alias("purity"))


def layer_purity(rows: DataFrame) -> DataFrame:
    """(layer, purity) of rows (layer, cluster, label)."""
    best = R.majority(rows, ["layer", "cluster"], "label").groupBy("layer").agg(F.sum("freq").alias("hit"))
    return best.join(rows.groupBy("layer").agg(F.count("*").alias("n")), "layer").select("layer", F.round(F.col("hit") / F.col("n"), 6).alias("purity"))


def node_labels(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(node, label, freq, purity): the most frequent labels (all of equals) of the items
    (node, label) at and below each node; copies of an item's row count."""
    pairs = lattice.closure(edges)
    own = items.select(F.col("node").alias("ancestor"), "label")
    under = items.join(pairs, "node").select("ancestor", "label")
    every = own.unionByName(under).withColumnRenamed("ancestor", "node")
    top = R.majority(every, ["node"], "label", ties=True)
    return top.join(every.groupBy("node").agg(F.count("*").alias("n")), "node").select("node", "label", "freq", F.round(F.col("freq") / F.col("n"), 6).alias("purity"))


def path_scores(paths: DataFrame, truth: DataFrame) -> DataFrame:
    """(path_id, score) of inferred paths (path_id, path) against paths of the truth (truth_id,
    path): the largest share of a path's names that one true path has; 0 if the truth has no way
    from its first to its last name."""
    names = paths.select("path_id", F.size("path").alias("len"), F.get("path", F.lit(0)).alias("top"), F.element_at("path", -1).alias("end"), F.explode(F.array_distinct("path")).alias("node"))
    gt = truth.select("truth_id", F.explode(F.array_distinct("path")).alias("node"))
    hits = names.join(gt, "node").groupBy("path_id", "truth_id").agg(
        F.count("*").alias("hit"), F.max((F.col("node") == F.col("top")).cast("int")).alias("has_top"), F.max((F.col("node") == F.col("end")).cast("int")).alias("has_end")
    )
    reached = hits.where("has_top = 1 and has_end = 1").select("path_id").distinct()
    best = hits.groupBy("path_id").agg(F.max("hit").alias("hit")).join(reached, "path_id")
    sizes = paths.select("path_id", F.size("path").alias("len"))
    return sizes.join(best, "path_id", "left").select("path_id", F.round(F.coalesce("hit", F.lit(0)) / F.col("len"), 6).alias("score"))


def consistent_shares(paths: DataFrame, labels: DataFrame, closed: DataFrame) -> DataFrame:
    """(path_id, share): the share of the names of a path (path_id, path) that agree with its
    ends: a name shares a label (node, label) with an end, or one of its labels lies, by the
    closure (ancestor, node) of the truth, between labels of the ends."""
    ends = paths.select("path_id", F.get("path", F.lit(0)).alias("top"), F.element_at("path", -1).alias("end"), F.size("path").alias("len"), F.explode("path").alias("node"))
    own = ends.join(labels, "node").select("path_id", "len", "node", "top", "end", "label")
    sides = [
        ends.select("path_id", F.col(c).alias("node")).distinct().join(labels, "node").select("path_id", F.col("label").alias(f"{c}_label")) for c in ("top", "end")
    ]
    shared = own.join(sides[0].withColumnRenamed("top_label", "label").unionByName(sides[1].withColumnRenamed("end_label", "label")), ["path_id", "label"])
    up = closed.select(F.col("ancestor").alias("top_label"), F.col("node").alias("label"))
    down = closed.select(F.col("ancestor").alias("label"), F.col("node").alias("end_label"))
    between = own.join(sides[0], "path_id").join(up, ["top_label", "label"]).join(sides[1], "path_id").join(down, ["label", "end_label"])
    good = shared.select("path_id", "node").unionByName(between.select("path_id", "node")).distinct().groupBy("path_id").agg(F.count("*").alias("good"))
    sizes = paths.select("path_id", F.size(F.array_distinct("path")).alias("len"))
    return sizes.join(good, "path_id", "left").select("path_id", F.round(F.coalesce("good", F.lit(0)) / F.col("len"), 6).alias("share"))


def _log_factorials(n: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(x + 1) for x in n.ravel()]).reshape(n.shape)


@F.pandas_udf(DoubleType())
def _expected(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    """The part of the expected mutual information of one row sum and one column sum."""
    out = []
    for x, y, total in zip(a.astype(int), b.astype(int), n.astype(int)):
        k = np.arange(max(1, x + y - total), min(x, y) + 1, dtype=float)
        fixed = math.lgamma(x + 1) + math.lgamma(y + 1) + math.lgamma(total - x + 1) + math.lgamma(total - y + 1) - math.lgamma(total + 1)
        p = np.exp(fixed - _log_factorials(k) - _log_factorials(x - k) - _log_factorials(y - k) - _log_factorials(total - x - y + k))
        out.append(float((k / total * np.log(total * k / (x * y)) * p).sum()))
    return pd.Series(out)


def adjusted_mutual_information(cells: DataFrame) -> DataFrame:
    """(ami) of a contingency table (t, p, n): sums of equal size share one term, so the work
    grows with the different sizes, not with the pairs of classes."""
    rows = cells.groupBy("t").agg(F.sum("n").alias("a")).groupBy("a").agg(F.count("*").alias("na"))
    cols = cells.groupBy("p").agg(F.sum("n").alias("b")).groupBy("b").agg(F.count("*").alias("nb"))
    total = cells.agg(F.sum("n").alias("total"))
    terms = rows.crossJoin(cols).crossJoin(total)  # different sizes only: under the root of twice the items each
    expected = terms.agg(F.sum(F.col("na") * F.col("nb") * _expected(F.col("a").cast("double"), F.col("b").cast("double"), F.col("total").cast("double"))).alias("emi"))
    n = F.col("total").cast("double")
    ha = rows.crossJoin(total).agg((-F.sum(F.col("na") * F.col("a") / n * F.log(F.col("a") / n))).alias("ha"))
    hb = cols.crossJoin(total).agg((-F.sum(F.col("nb") * F.col("b") / n * F.log(F.col("b") / n))).alias("hb"))
    hj = cells.crossJoin(total).agg((-F.sum(F.col("n") / n * F.log(F.col("n") / n))).alias("hj"))
    one = expected.crossJoin(ha).crossJoin(hb).crossJoin(hj)  # four single rows
    mi = F.col("ha") + F.col("hb") - F.col("hj")
    return one.select(F.round(F.coalesce(F.try_divide(mi - F.col("emi"), (F.col("ha") + F.col("hb")) / 2 - F.col("emi")), F.lit(1.0)), 6).alias("ami"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        at = row & places.get(w, 0)
        row = ((row + at) | (row - at)) & full
    return len(a) - bin(row).count("1")


@F.pandas_udf(DoubleType())
def _rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        n = lcs(x, y)
        out.append(2 * n / (len(x) + len(y)) if x or y else 0.0)
    return pd.Series(out)


def rouge_l(a: Column, b: Column) -> Column:
    """F1 of the longest common subsequence of two arrays of words; 0 for empty ones."""
    return _rouge_l(a, b)


def top_level(rows: DataFrame) -> DataFrame:
    """(rand, purity) of rows (cluster, label)."""
    cells = V.contingency(rows, "label", "cluster")
    best = R.majority(rows, ["cluster"], "label").agg(F.sum("freq").alias("hit"))
    n = rows.agg(F.count("*").alias("n"))
    return V.pair_scores(cells).select("rand").crossJoin(best).crossJoin(n).select("rand", F.round(F.col("hit") / F.col("n"), 6).alias("purity"))


def precision_recall(result: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """(p, rec, f1) of two sets of keys; 0 where a set is empty."""
    r, g = result.select(*key).distinct(), truth.select(*key).distinct()
    hit = r.join(g, key, "left_semi").agg(F.count("*").alias("h"))
    one = hit.crossJoin(r.agg(F.count("*").alias("r"))).crossJoin(g.agg(F.count("*").alias("g")))  # single rows
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return one.select(share(F.col("h"), F.col("r")).alias("p"), share(F.col("h"), F.col("g")).alias("rec"), share(2.0 * F.col("h"), F.col("r") + F.col("g")).alias("f1"))
