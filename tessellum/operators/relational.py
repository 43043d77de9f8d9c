"""Table-level operators: label sets, majority votes, overlap, sampling, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessellum.sources.scratch import cut


def hash_order(key: Column, seed: str) -> Column:
    """A reproducible random order: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample_ratio(df: DataFrame, key: str, ratio: float, seed: str) -> DataFrame:
    """At least one row, else round(n * ratio) rows in hash order.

    Rows are counted by the first four hex digits of their hash; whole buckets are taken until
    the one that holds the last row wanted, and only that bucket's rows are ranked.
    """
    keyed = df.withColumn("__h", hash_order(F.col(key), seed)).withColumn("__b", F.left("__h", F.lit(4)))
    counts = keyed.groupBy("__b").agg(F.count("*").alias("__n"))  # at most 65,536 rows
    before = F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    total = F.sum("__n").over(W.partitionBy())
    want = F.greatest(F.lit(1), F.round(total * ratio)).cast("long")
    edges = counts.select("__b", (want - before).alias("__want"), "__n").where("__want > 0")
    full = keyed.join(edges.where("__want >= __n").select("__b"), "__b", "left_semi")
    last = keyed.join(edges.where("__want < __n"), "__b")
    rank = F.row_number().over(W.partitionBy("__b").orderBy("__h", key))
    last = last.withColumn("__r", rank).where("__r <= __want")
    return full.select(df.columns).unionByName(last.select(df.columns))


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """Up to ``n`` rows of each group in hash order. Groups are first thinned in slots, so a
    group that holds most rows is not ranked in one task."""
    h = hash_order(F.col(key), seed)
    slotted = df.withColumns({"__h": h, "__s": F.pmod(F.xxhash64(key), F.lit(64))})
    part = W.partitionBy(group, "__s").orderBy("__h", key)
    thin = slotted.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= n)
    whole = W.partitionBy(group).orderBy("__h", key)
    return thin.withColumn("__r", F.row_number().over(whole)).where(F.col("__r") <= n).drop("__h", "__s", "__r")


def label_sets(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def majority(df: DataFrame, group: list[str], label: str, ties: bool = False) -> DataFrame:
    """The most frequent label of each group (alphabetically first of equals, or all)."""
    counts = df.groupBy(*group, label).agg(F.count("*").alias("freq"))
    if not ties:
        best = counts.groupBy(*group).agg(F.min_by(F.struct(label, "freq"), F.struct(-F.col("freq"), F.col(label))).alias("b"))
        return best.select(*group, F.col(f"b.{label}").alias(label), F.col("b.freq").alias("freq"))
    top = counts.groupBy(*group).agg(F.max("freq").alias("freq"))
    return counts.join(top, [*group, "freq"])


def overlap(df: DataFrame, key: str, group: str, attr: str) -> DataFrame:
    """(key, group, shared, whole, overlap): share of the group's attributes a key has."""
    pairs = cut(df.select(key, group, attr).where(f"{attr} is not null").distinct(), "overlap")  # feeds two branches
    own = pairs.groupBy(key, group).agg(F.count("*").alias("shared"))
    whole = pairs.select(group, attr).distinct().groupBy(group).agg(F.count("*").alias("whole"))
    return own.join(whole, group).select(key, group, "shared", "whole", (F.col("shared") / F.col("whole")).alias("overlap"))


def overlap_variants(overlaps: DataFrame, thresholds: list[float]) -> DataFrame:
    """A row for each threshold: keys retained, and the average, least and largest overlap."""
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    hit = F.col("overlap") >= F.col("threshold")
    return (
        overlaps.select("overlap", "shared", levels)
        .groupBy("threshold")
        .agg(
            F.sum(hit.cast("long")).alias("n_tables"),
            F.coalesce(F.round(F.avg(F.when(hit, F.col("overlap"))), 6), F.lit(0.0)).alias("avg_overlap"),
            F.coalesce(F.round(F.min(F.when(hit, F.col("overlap"))), 6), F.lit(0.0)).alias("min_overlap"),
            F.coalesce(F.round(F.max(F.when(hit, F.col("overlap"))), 6), F.lit(0.0)).alias("max_overlap"),
        )
    )


def profile(df: DataFrame, group: list[str], cell: str) -> DataFrame:
    """Counts, lengths and emptiness of the cells of each column."""
    n = F.length(cell)
    return df.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.max(n).alias("max_len"),
        F.min(n).alias("min_len"),
        F.round(F.avg(n), 6).alias("avg_len"),
        F.round(F.stddev_samp(n), 6).alias("std_len"),
        F.countDistinct(cell).alias("n_distinct"),
    )


def entropy(df: DataFrame, group: str, value: str) -> DataFrame:
    """Shannon entropy in bits, from value counts: sum over values, never over rows."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    return counts.groupBy(group).agg(
        F.round(F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c"), 6).alias("entropy")
    )


def tfidf(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Mean TF-IDF of each document over the vocabulary (words of two or more characters,
    smooth idf, rows normalized)."""
    words = df.select(doc, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]{2,})"), F.lit(1))).alias("w"))
    tf = cut(words.groupBy(doc, "w").agg(F.count("*").alias("tf")), "tf")  # feeds three branches
    idf = tf.groupBy("w").agg(F.count("*").alias("df"))
    size = df.select(F.count("*").alias("n"))
    vocab = idf.select(F.count("*").alias("v"))
    weighted = tf.join(idf, "w").crossJoin(F.broadcast(size)).withColumn(
        "x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    )
    out = weighted.groupBy(doc).agg((F.sum("x") / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("s"))
    return out.crossJoin(F.broadcast(vocab)).select(doc, F.round(F.col("s") / F.col("v"), 8).alias("avg_tfidf"))
