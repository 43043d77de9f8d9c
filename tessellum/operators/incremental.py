"""Inference round by round, until more rows no longer change the picture."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.operators.relational import hash_order
from tessellum.sources.scratch import cut


def entropy(counts: DataFrame, n: str = "n") -> float:
    """Entropy in bits of the distribution that ``counts`` gives; 0 for none."""
    row = counts.agg(F.sum(n).alias("t"), F.sum(F.col(n) * F.log2(n)).alias("h")).first()
    return math.log2(row.t) - row.h / row.t if row.t else 0.0


def run(rows: DataFrame, key: str, rounds: int, process: Callable[[DataFrame], DataFrame], update: Callable[[DataFrame, DataFrame], DataFrame], settled: Callable[[DataFrame, DataFrame], bool]) -> tuple[DataFrame, int]:
    """(state, rounds used): rows are dealt to rounds by hash, ``process`` turns those of a round
    into a state, ``update`` merges it into the state so far, and the loop ends when ``settled``
    says that two states in a row are alike. Without rows the state is that of no rows."""
    bucket = F.pmod(F.conv(F.left(hash_order(F.col(key), "round"), F.lit(8)), 16, 10).cast("long"), F.lit(rounds))
    dealt = cut(rows.withColumn("__round", bucket), "dealt")
    state: DataFrame | None = None
    for k in range(rounds):
        new = process(dealt.where(F.col("__round") == k).drop("__round"))
        following = cut(new if state is None else update(state, new), "state")
        if state is not None and settled(state, following):
            return following, k + 1
        state = following
    return state, rounds


def until_settled(df: DataFrame, key: str, value: str, rounds: int = 10, eps: float = 0.05) -> DataFrame:
    """(value, n, rounds): counts of the values seen until their entropy changed by less than ``eps``."""
    process = lambda part: part.groupBy(value).agg(F.count("*").alias("n"))
    update = lambda a, b: a.unionByName(b).groupBy(value).agg(F.sum("n").alias("n"))
    state, used = run(df.select(key, value), key, rounds, process, update, lambda a, b: abs(entropy(a) - entropy(b)) < eps)
    return state.withColumn("rounds", F.lit(used))
