"""Vectors of columns without a trained network, and losses on given vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.operators import vectors as V


def hashed_vector(words: Column, dims: int = 64) -> Column:
    """The words of a text hashed to signed places of a vector of length 1; empty ones give zeros."""
    at = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dims)).alias("k"), F.when(F.pmod(F.xxhash64(w, F.lit("s")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.aggregate(F.filter(at, lambda x: x["k"] == k), F.lit(0.0), lambda acc, x: acc + x["s"]))
    return V.normalized(raw)


def contrastive_loss(pairs: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(loss, n) of rows (id, a, b), the two views of each: the mean of -log of the softmax of
    a row's own pair over its similarities to all views ``b``. The pairs of a batch are its input."""
    x, y = pairs.select("id", "a"), pairs.select(F.col("id").alias("jd"), "b")
    sims = x.join(y, F.lit(True)).select("id", "jd", (V.cosine(F.col("a"), F.col("b")) / temperature).alias("s"))
    top = sims.groupBy("id").agg(F.max("s").alias("m"), F.max(F.when(F.col("id") == F.col("jd"), F.col("s"))).alias("own"))
    each = sims.join(top, "id").groupBy("id", "m", "own").agg(F.sum(F.exp(F.col("s") - F.col("m"))).alias("z"))
    return each.agg(F.avg(F.col("m") + F.log("z") - F.col("own")).alias("loss"), F.count("*").alias("n"))
