"""Distances between pairs of vectors, and vectors with noise of a stated scale."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.operators import ordering, sampling, vectors as V
from tessellum.sources.scratch import cut

#: Rows up to which all pairs are formed, and pairs that are drawn beyond it (the sample is the feature).
EXACT_ROWS, SAMPLED_PAIRS = 2000, 50_000


def pair_distances(df: DataFrame, key: str, vector: str, other: str | None = None, seed: str = "d") -> DataFrame:
    """(i, j, dist[, dist2]) of all pairs i < j of up to ``EXACT_ROWS`` vectors, else of
    ``SAMPLED_PAIRS`` hashed pairs; ``dist2`` is that of a second vector of the same rows."""
    n = df.count()
    cols = [F.col(vector).alias("v"), *([F.col(other).alias("w")] if other else [])]
    if n <= EXACT_ROWS:
        rows = df.select(F.col(key).alias("k"), *cols)
        both = rows.alias("a").join(rows.alias("b"), F.col("a.k") < F.col("b.k"))
    else:
        rows = cut(ordering.global_rank(df.select(F.col(key).alias("k"), *cols), ["k"], "at"), "placed")
        pairs = sampling.random_pairs(n, SAMPLED_PAIRS, seed, df.sparkSession)
        a = rows.alias("a")
        both = pairs.join(a, F.col("i") == F.col("a.at")).join(rows.alias("b"), F.col("j") == F.col("b.at"))
    out = [F.col("a.k").alias("i"), F.col("b.k").alias("j"), F.round(V.euclidean(F.col("a.v"), F.col("b.v")), 9).alias("dist")]
    if other:
        out.append(F.round(V.euclidean(F.col("a.w"), F.col("b.w")), 9).alias("dist2"))
    return both.select(*out)


def gaussian(key: Column, seed: str) -> Column:
    """A standard normal number from hashes of the key (Box-Muller)."""
    u1, u2 = sampling.uniform(key, f"{seed}1"), sampling.uniform(key, f"{seed}2")
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def with_noise(df: DataFrame, key: str, vector: str, sigma: float, seed: str, normalize: bool = False, out: str = "noisy") -> DataFrame:
    """``df`` with the vector plus noise of standard deviation ``sigma`` in each dimension."""
    moved = F.transform(vector, lambda x, i: x.cast("double") + sigma * gaussian(F.concat_ws("|", key, i), seed))
    return df.withColumn(out, V.normalized(moved) if normalize else moved)


def noise_scale(ratio: float, typical: float, dims: int) -> float:
    """The deviation at which the noise moves pairs by ``ratio`` of the typical distance."""
    return ratio * typical / math.sqrt(2 * dims)
