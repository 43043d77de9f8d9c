"""Reproducible samples of values, tokens and rows, and the texts made of them.

Random choices are orders of md5 hashes of a seed and a key, so they don't depend on how data
lie. A weighted choice without replacement orders by -ln(u) / w with u from the hash: the
smallest of these are a sample in which weights act as in successive draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.operators import ordering


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the hash of seed and key."""
    h = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), F.lit(8)), 16, 10).cast("double")
    return (h + 1) / F.lit(4294967298.0)


def draw(key: Column, weight: Column, seed: str) -> Column:
    """The smaller, the earlier a key is drawn; keys without weight come last."""
    return F.when(weight > 0, F.round(-F.log(uniform(key, seed)) / weight, 9)).otherwise(F.lit(float("inf")))


def weighted(df: DataFrame, group: list[str], key: str, weight: str, n: int, seed: str) -> DataFrame:
    """Up to ``n`` rows of each group, drawn by weight without replacement."""
    drawn = df.withColumn("__d", draw(F.concat_ws("|", *group, key), F.col(weight).cast("double"), seed))
    return ordering.top_per_group(drawn, group, ["__d", key], n).drop("__d")


def roulette(df: DataFrame, group: str, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """Up to ``n`` rows of each group: by weight, or all alike where the weights sum to zero or
    fewer than ``n`` are above it."""
    sums = df.groupBy(group).agg(F.sum(weight).alias("__sum"), F.sum((F.col(weight) > 0).cast("int")).alias("__above"))
    alike = (F.col("__sum") == 0) | (F.col("__above") < n)
    fair = df.join(sums, group).withColumn("__w", F.when(alike, 1.0).otherwise(F.col(weight).cast("double")))
    return weighted(fair, [group], key, "__w", n, seed).select(df.columns)


def cell_tfidf(cells: DataFrame, column: str, cell_id: str, text: str) -> DataFrame:
    """(column, cell_id, tfidf): mean TF-IDF of each cell over the words of its column: words of
    two or more characters, smooth idf, cells normalized."""
    words = cells.select(column, cell_id, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]{2,})"), F.lit(1))).alias("w"))
    tf = words.groupBy(column, cell_id, "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy(column, "w").agg(F.count("*").alias("df"))
    sizes = cells.groupBy(column).agg(F.count("*").alias("n")).join(df.groupBy(column).agg(F.count("*").alias("v")), column)
    x = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    scored = tf.join(df, [column, "w"]).join(sizes, column).withColumn("x", x)
    mean = F.sum("x") / F.sqrt(F.sum(F.col("x") * F.col("x"))) / F.first("v")
    out = scored.groupBy(column, cell_id).agg(F.round(mean, 9).alias("tfidf"))
    return cells.select(column, cell_id).join(out, [column, cell_id], "left").fillna(0.0, ["tfidf"])


def tokens(cells: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """``keys``, ``order``, ``at`` and ``token``: the words of each cell, in lower case."""
    return cells.select(*keys, *order, F.posexplode(F.split(F.lower(text), " ")).alias("at", "token")).where("token <> ''")


def first_seen(toks: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, token, n, first): how often and where a token first occurs in its group."""
    return toks.groupBy(group, "token").agg(F.count("*").alias("n"), F.min(F.struct(*order, "at")).alias("first"))


def distinct_head(seen: DataFrame, group: str, most: int) -> DataFrame:
    """The first ``most`` different tokens of each group, with their place from 0."""
    head = ordering.top_per_group(seen, [group], ["first"], most)
    return ordering.group_rank(head, group, ["first"], "place").select(group, "token", "place")


def frequent_tokens(seen: DataFrame, group: str, most: int) -> DataFrame:
    """The ``most`` most frequent tokens of each group, as a text in the order first seen."""
    top = ordering.top_per_group(seen, [group], [F.desc("n"), "first"], most)
    return as_text(top, group, "first", "token")


def as_text(df: DataFrame, group: str, order: str, col: str, sep: str = " ") -> DataFrame:
    """(group, text) of few rows for each group, joined in order."""
    lists = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("v")))).alias("l"))
    return lists.select(group, F.array_join("l.v", sep).alias("text"))


def column_idf(toks: DataFrame, table: str, column: str) -> DataFrame:
    """(table, token, idf): log10 of the number of different tokens of the column; of several
    columns the last one counts, as in the reference."""
    sizes = toks.groupBy(table, column).agg(F.round(F.log10(F.countDistinct("token")), 9).alias("idf"))
    return toks.select(table, column, "token").distinct().join(sizes, [table, column]).groupBy(table, "token").agg(F.max_by("idf", column).alias("idf"))


def pair_ratios(pairs: DataFrame) -> DataFrame:
    """(a, b, ratio) of rows (a, b): count(a, b) / (count(a) * count(b))."""
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    na = both.groupBy("a").agg(F.sum("n").alias("na"))
    nb = both.groupBy("b").agg(F.sum("n").alias("nb"))
    return both.join(na, "a").join(nb, "b").select("a", "b", F.round(F.col("n") / (F.col("na") * F.col("nb")), 12).alias("ratio"))


def blanked(cells: DataFrame, group: str, row: str, value: str, share: float, seed: str) -> DataFrame:
    """``cells`` with the values of ceil(rows * share) hash-picked rows of each group blank."""
    rows = cells.select(group, row).distinct().withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), group, row)))
    ranked = ordering.group_rank(rows, group, ["__h", row], "__r", "__n")
    hit = ranked.select(group, row, (F.col("__r") < F.ceil(F.col("__n") * share)).alias("__hit"))
    return cells.join(hit, [group, row]).withColumn(value, F.when(F.col("__hit"), "").otherwise(F.col(value))).drop("__hit")


def padded(values: Column, length: int) -> Column:
    """An array tiled up to, or cut to, ``length``; an empty one stays empty."""
    times = F.ceil(F.lit(length) / F.greatest(F.size(values), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(values, times)), 1, length)


def with_replacement(df: DataFrame, group: str, place: str, size: str, seed: str, most: int = 10) -> DataFrame:
    """min(``most``, n - 1) picks from each group of n rows, with replacement: each pick is a
    hashed place, so the same row may come again. ``df`` has the places from 0 and the sizes."""
    groups = df.groupBy(group).agg(F.max(size).alias("__n"))
    picks = groups.select(group, "__n", F.explode(F.when(F.col("__n") > 1, F.sequence(F.lit(1), F.least(F.lit(most), (F.col("__n") - 1).cast("int"))))).alias("pick"))
    at = F.floor(uniform(F.concat_ws("|", group, "pick"), seed) * F.col("__n")).cast("long")
    return picks.withColumn(place, at).join(df.drop(size), [group, place]).drop("__n")


def random_pairs(n: int, count: int, seed: str, spark) -> DataFrame:
    """``count`` pairs (i, j) of different places below ``n``, by hash."""
    ids = spark.range(count)
    i = F.floor(uniform(F.col("id"), f"{seed}i") * n).cast("long")
    j = F.floor(uniform(F.col("id"), f"{seed}j") * (n - 1)).cast("long")
    return ids.select(i.alias("i"), (j + (j >= i).cast("long")).alias("j")) if n > 1 else ids.where("id < 0").select(F.col("id").alias("i"), F.col("id").alias("j"))
