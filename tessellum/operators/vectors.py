"""Distances, neighbours and mean vectors. Pair operators take blocks of a stated query set
against all rows; all pairs of a set are only formed where the result is about pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v * v))


def normalized(v: Column) -> Column:
    """The vector with length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def weighted_sum(df: DataFrame, group: str, vector: str, weight: str) -> DataFrame:
    """(group, dim, value): the sum of the group's vectors by weight."""
    each = df.select(group, weight, F.posexplode(vector).alias("dim", "x"))
    return each.groupBy(group, "dim").agg(F.sum(F.col("x").cast("double") * F.col(weight)).alias("value"))


def simple_matching(a: Column, b: Column) -> Column:
    """Share of the places at which two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.try_divide(F.aggregate(same, F.lit(0), lambda s, x: s + x), F.size(a))


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, value): mean of the group's vectors, one row for each dimension."""
    each = df.select(group, F.posexplode(vector).alias("dim", "x"))
    return each.groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, rank, neighbour, dist): exact k nearest rows of each query. Each task keeps its
    own best k of a query before anything is shuffled."""
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("qv"))
    r = rows.select(F.col(key).alias("neighbour"), F.col(vector).alias("rv"))
    pairs = r.join(q, F.col("query") != F.col("neighbour")).select(
        "query", "neighbour", F.round(euclidean(F.col("qv"), F.col("rv")), 6).alias("dist")
    )
    slots = pairs.withColumn("slot", F.pmod(F.xxhash64("neighbour"), F.lit(16)))
    local = W.partitionBy("query", "slot").orderBy("dist", "neighbour")
    best = slots.withColumn("r", F.row_number().over(local)).where(F.col("r") <= k)
    final = W.partitionBy("query").orderBy("dist", "neighbour")
    return best.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "dist")


def contingency(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def pair_scores(cells: DataFrame) -> DataFrame:
    """Rand index, adjusted Rand index, Fowlkes-Mallows and normalized mutual information of a
    contingency table (t, p, n): from its sums, without forming pairs."""
    pairs = lambda c: c * (c - 1) / 2.0
    n = F.col("n").cast("double")
    rows = cells.groupBy("t").agg(F.sum("n").cast("double").alias("a"))
    cols = cells.groupBy("p").agg(F.sum("n").cast("double").alias("b"))
    total = cells.agg(F.sum("n").cast("double").alias("N"), F.sum(pairs(n)).alias("both"))
    ra = rows.agg(F.sum(pairs(F.col("a"))).alias("ra"), F.sum(F.col("a") * F.log("a")).alias("ha"))
    rb = cols.agg(F.sum(pairs(F.col("b"))).alias("rb"), F.sum(F.col("b") * F.log("b")).alias("hb"))
    hj = cells.agg(F.sum(n * F.log(n)).alias("hj"))
    one = total.crossJoin(ra).crossJoin(rb).crossJoin(hj)  # four single rows
    all_pairs = pairs(F.col("N"))
    expected = F.col("ra") * F.col("rb") / all_pairs
    ha = F.log("N") - F.col("ha") / F.col("N")
    hb = F.log("N") - F.col("hb") / F.col("N")
    mi = F.log("N") + (F.col("hj") - F.col("ha") - F.col("hb")) / F.col("N")
    return one.select(
        F.round(F.try_divide(all_pairs + 2 * F.col("both") - F.col("ra") - F.col("rb"), all_pairs), 6).alias("rand"),
        F.round((F.col("both") - expected) / ((F.col("ra") + F.col("rb")) / 2 - expected), 6).alias("adjusted_rand"),
        F.round(F.col("both") / F.sqrt(F.col("ra") * F.col("rb")), 6).alias("fowlkes_mallows"),
        F.round(mi, 6).alias("mutual_information"),
        F.round(mi / ((ha + hb) / 2), 6).alias("normalized_mi"),
    )


def wrong_pairs(cells: DataFrame, pred: str, truth: str) -> DataFrame:
    """(shared, cl_i, gt_i, cl_j, gt_j, pairs) of a contingency table (pred, truth, n): pairs of
    classes of which all items share the cluster but not the label, or the label but not the
    cluster. The pairs of items are the products of the classes and are not formed."""
    i = cells.select(F.col(pred).alias("cl_i"), F.col(truth).alias("gt_i"), F.col("n").alias("n_i"))
    j = cells.select(F.col(pred).alias("cl_j"), F.col(truth).alias("gt_j"), F.col("n").alias("n_j"))
    same_cluster = i.join(j, (F.col("cl_i") == F.col("cl_j")) & (F.col("gt_i") < F.col("gt_j")))
    same_label = i.join(j, (F.col("gt_i") == F.col("gt_j")) & (F.col("cl_i") < F.col("cl_j")))
    both = same_cluster.withColumn("shared", F.lit("cluster")).unionByName(same_label.withColumn("shared", F.lit("label")))
    return both.select("shared", "cl_i", "gt_i", "cl_j", "gt_j", (F.col("n_i") * F.col("n_j")).alias("pairs"))
