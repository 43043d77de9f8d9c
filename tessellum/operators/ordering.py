"""Ranks and heads that no single task has to order.

A window without partitions puts all rows in one task, one over a hot group puts that group in
one. Here rows are sorted by ranges over all tasks, numbered within their range, and shifted by
the sizes of the ranges before. Ties get different ranks in an order that depends on how rows
lie, so keys should be unique where it matters. Null keys come first. The input is read twice,
once to find the ranges: costly expressions are better written before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessellum.session import tasks
from tessellum.sources.scratch import cut

_LOW = (1 << 33) - 1


def global_rank(df: DataFrame, keys: list[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of ``keys``."""
    placed = df.repartitionByRange(tasks(df.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = cut(placed.withColumn("__id", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count("*").alias("__n"))  # a row for each range
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    ranked = placed.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(starts), "__part")
    return ranked.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(_LOW)).select(*df.columns, name)


def group_rank(df: DataFrame, group: str, keys: list[str | Column], name: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of ``keys`` within its group, and
    with the group's rows as ``size``."""
    ranked = global_rank(df, [F.col(group), *keys], "__rank")
    groups = ranked.groupBy(F.col(group).alias("__group")).agg(F.min("__rank").alias("__first"), F.count("*").alias("__size"))
    out = ranked.join(groups, F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col("__rank") - F.col("__first"))
    if size:
        out = out.withColumn(size, F.col("__size"))
    return out.select(*df.columns, name, *([size] if size else []))


def top_per_group(df: DataFrame, group: list[str], keys: list[str | Column], n: int, slots: int = 64) -> DataFrame:
    """The first ``n`` rows of each group in the order of ``keys``. Groups are first thinned in
    slots, so a group that holds most rows is not ordered in one task."""
    slotted = df.withColumn("__s", F.pmod(F.xxhash64(*df.columns), F.lit(slots)))
    thin = slotted.withColumn("__r", F.row_number().over(W.partitionBy(*group, "__s").orderBy(*keys))).where(F.col("__r") <= n)
    return thin.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*keys))).where(F.col("__r") <= n).drop("__s", "__r")


def every_nth(df: DataFrame, keys: list[str | Column], most: int) -> DataFrame:
    """Every nth row in the order of ``keys``, with the smallest n that leaves at most ``most``."""
    total = df.agg(F.count("*").alias("__total"))  # one row
    ranked = global_rank(df, keys, "__at").crossJoin(F.broadcast(total))
    return ranked.where(F.col("__at") % F.ceil(F.col("__total") / most) == 0).select(df.columns)


def lowest_share(df: DataFrame, keys: list[str | Column], share: float) -> DataFrame:
    """The first floor(n * share) rows in the order of ``keys``."""
    total = df.agg(F.floor(F.count("*") * share).alias("__most"))  # one row
    return global_rank(df, keys, "__at").crossJoin(F.broadcast(total)).where("__at < __most").select(df.columns)
