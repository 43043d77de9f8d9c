"""Hierarchical clustering of the items of one group at a time.

The groups are types or tables' columns, whose size is bounded by ``max_items`` and checked:
linkage needs all distances of a group in one place. A larger group raises an error instead
of being cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITEMS = 4000


def linkage(dist: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) of a distance matrix, lowest first, by chains of
    nearest neighbours, in time of the matrix's size. ``method`` is ``ward`` (of Euclidean
    distances) or ``complete``; of equal distances the neighbour with the smallest place."""
    n = len(dist)
    d = np.array(dist, dtype=float) ** (2 if method == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    sizes, chain, found = np.ones(n), [], []
    alive = np.ones(n, dtype=bool)
    while len(found) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            i = chain[-1]
            j = int(np.argmin(d[i]))
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        i, j = min(i, j), max(i, j)
        height, si, sj = d[i, j], sizes[i], sizes[j]
        if method == "ward":
            new = ((si + sizes) * d[i] + (sj + sizes) * d[j] - sizes * height) / (si + sj + sizes)
        else:
            new = np.maximum(d[i], d[j])
        new[~alive] = np.inf
        new[i] = new[j] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        alive[j], sizes[i] = False, si + sj
        found.append((float(np.sqrt(height) if method == "ward" else height), i, j, int(si + sj)))
    # chains find merges in another order: by height, with the numbers of the clusters merged
    ids, out = list(range(n)), []
    for height, i, j, size in sorted(found, key=lambda m: m[0]):
        out.append((*sorted((ids[i], ids[j])), height, size))
        ids[i] = n + len(out) - 1
    return out


def labels_at(merges: list[tuple[int, int, float, int]], n: int, clusters: int) -> np.ndarray:
    """Cluster numbers when ``clusters`` clusters are left, by first member."""
    parent = list(range(2 * n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, (a, b, _, _) in enumerate(merges[: max(0, n - clusters)]):
        parent[find(a)] = parent[find(b)] = n + step
    numbers: dict[int, int] = {}
    return np.array([numbers.setdefault(find(i), len(numbers)) for i in range(n)])


def silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; items alone in their cluster count 0."""
    k = labels.max() + 1
    if k < 2 or k >= len(labels):
        return 0.0
    one = np.eye(k)[labels]
    sums, counts = dist @ one, one.sum(axis=0)
    own = counts[labels]
    a = sums[np.arange(len(labels)), labels] / np.maximum(own - 1, 1)
    means = np.where(one > 0, np.inf, sums / counts)
    b = means.min(axis=1)
    s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def ward_by_group(df: DataFrame, group: str, key: str, vector: str, least: int, most: int) -> DataFrame:
    """(group, key, cluster, clusters, silhouette): of the numbers of clusters in [least, most)
    the one with the best silhouette; later ones win ties."""
    schema = f"{group} {dict(df.dtypes)[group]}, {key} {dict(df.dtypes)[key]}, cluster int, clusters int, silhouette double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_ITEMS:
            raise ValueError(f"a group of {len(pdf)} items; linkage takes {MAX_ITEMS} at most")
        pdf = pdf.sort_values(key)
        x = np.stack([np.asarray(v, dtype=float) for v in pdf[vector]])
        dist = _distances(x)
        merges = linkage(dist, "ward")
        best, labels, count = -2.0, np.zeros(len(x), dtype=int), 1
        for k in range(max(2, least), min(most, len(x))):
            now = labels_at(merges, len(x), k)
            s = round(silhouette(dist, now), 9)
            if s >= best:
                best, labels, count = s, now, k
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": labels, "clusters": count, "silhouette": round(max(best, -1.0), 6)})

    return df.select(group, key, vector).groupBy(group).applyInPandas(run, schema)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of each connected component, by alternating large-
    and small-star steps, whose number grows with the logarithm of the size."""
    from tessellum.sources.scratch import cut, drop

    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "star")
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).distinct()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.where("u <> v"), "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = cut(small.where("u <> v").distinct(), "star")
        changed = following.exceptAll(now).take(1) or now.exceptAll(following).take(1)
        drop(now)
        drop(large)
        now = following
        if not changed:
            break
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )


def sinkhorn(scores: DataFrame, rounds: int) -> DataFrame:
    """(r, c, x): scores with columns, then rows, scaled to sum 1, as many times as asked."""
    from tessellum.sources.scratch import cut

    now = scores
    for _ in range(rounds):
        now = now.join(now.groupBy("c").agg(F.sum("x").alias("t")), "c").select("r", "c", (F.col("x") / F.col("t")).alias("x"))
        now = cut(now.join(now.groupBy("r").agg(F.sum("x").alias("t")), "r").select("r", "c", (F.col("x") / F.col("t")).alias("x")), "sinkhorn")
    return now


def silhouette_of(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(silhouette, n): the mean silhouette of labelled vectors, exactly: each row's distances
    are summed by label while they are formed. Rows alone in their label count 0."""
    from tessellum.operators.vectors import euclidean

    rows = df.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).alias("v"))
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"))
    pairs = rows.alias("a").join(rows.alias("b"), F.col("a.k") != F.col("b.k"))
    sums = pairs.groupBy(F.col("a.k").alias("k"), F.col("a.l").alias("own"), F.col("b.l").alias("l")).agg(
        F.sum(F.round(euclidean(F.col("a.v"), F.col("b.v")), 9)).alias("t")
    )
    mine = F.col("own") == F.col("l")
    each = sums.join(sizes, "l").groupBy("k").agg(
        F.max(F.when(mine, F.try_divide("t", F.col("n") - 1))).alias("a"), F.min(F.when(~mine, F.col("t") / F.col("n"))).alias("b")
    )
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return each.agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))


def near_pairs(rows: DataFrame, eps: float, pivots: int = 3) -> DataFrame:
    """(i, j, d) of all rows (k, v) within ``eps`` of each other, both ways. By the triangle
    inequality such rows lie at most ``eps`` apart in their distances to a pivot, so only rows of
    the same and neighbouring steps of the distances to a few pivots are compared."""
    from tessellum.operators.vectors import euclidean

    marks = [list(map(float, r.v)) for r in rows.orderBy("k").limit(pivots).collect()]
    steps = [F.floor(euclidean(F.col("v"), F.array(*[F.lit(x) for x in m])) / eps).cast("long") for m in marks] or [F.lit(0).cast("long")]
    placed = rows.withColumn("cell", F.array(*steps))
    around = placed.select(F.col("k").alias("i"), F.col("v").alias("x"), "cell")
    for n in range(len(steps)):
        moved = [F.array(*[F.get("cell", F.lit(m)) + (by if m == n else 0) for m in range(len(steps))]) for by in (-1, 0, 1)]
        shifted = F.explode(F.array(*moved))
        around = around.select("i", "x", shifted.alias("cell"))
    both = around.join(placed.select(F.col("k").alias("j"), F.col("v").alias("y"), "cell"), "cell").where("i <> j")
    return both.select("i", "j", F.round(euclidean(F.col("x"), F.col("y")), 9).alias("d")).where(F.col("d") <= eps)


def dbscan(df: DataFrame, key: str, vector: str, eps: float, least: int) -> DataFrame:
    """(key, cluster): clusters of rows with at least ``least`` rows (themselves among them)
    within ``eps``, named by their smallest such row; a row near one joins the nearest, others
    are noise and get null."""
    from tessellum.sources.scratch import cut

    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    near = near_pairs(rows, eps)
    near = cut(near, "near")
    core = cut(near.groupBy(F.col("i").alias("k")).agg((F.count("*") + 1).alias("n")).where(F.col("n") >= least).select("k"), "core")
    if least <= 1:
        core = rows.select("k")
    links = near.join(core.withColumnRenamed("k", "i"), "i", "left_semi").join(core.withColumnRenamed("k", "j"), "j", "left_semi")
    selves = core.select(F.col("k").alias("i"), F.col("k").alias("j"))
    parts = cut(components(links.select("i", "j").unionByName(selves), "i", "j"), "dbscan")
    border = near.join(parts.select(F.col("node").alias("j"), "component"), "j").join(core.withColumnRenamed("k", "i"), "i", "left_anti")
    border = border.groupBy("i").agg(F.min_by("component", F.struct("d", "j")).alias("component")).select(F.col("i").alias("node"), "component")
    found = parts.unionByName(border)
    return rows.select("k").join(found, F.col("k") == F.col("node"), "left").select(F.col("k").alias(key), F.col("component").alias("cluster"))


def _ml(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def kmeans(df: DataFrame, vector: str, sizes: range, seed: int = 1, bisecting: bool = False) -> tuple[int, DataFrame]:
    """(k, ``df`` with ``cluster``) for the number of clusters with the best silhouette; of
    equals the larger. ``bisecting`` splits clusters step by step, in place of a feature tree."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = _ml(df, vector)
    best: tuple[float, int, DataFrame] | None = None
    for k in sizes:
        model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, predictionCol="cluster").fit(rows)
        out = model.transform(rows)
        score = ClusteringEvaluator(predictionCol="cluster").evaluate(out) if out.select("cluster").distinct().count() > 1 else -1.0
        if best is None or score >= best[0]:
            best = (score, k, out)
    return best[1], best[2].drop("features")


def mixture(df: DataFrame, vector: str, sizes: range, seed: int = 1) -> tuple[int, DataFrame]:
    """(k, ``df`` with ``cluster``) of the Gaussian mixture, with full covariances, with the
    lowest Bayesian information criterion."""
    from pyspark.ml.clustering import GaussianMixture

    rows = _ml(df, vector)
    n, dims = rows.count(), len(rows.first()["features"])
    best: tuple[float, int, DataFrame] | None = None
    for k in sizes:
        model = GaussianMixture(k=k, seed=seed, predictionCol="cluster", probabilityCol="p").fit(rows)
        free = k - 1 + k * dims + k * dims * (dims + 1) / 2
        bic = free * float(np.log(n)) - 2 * model.summary.logLikelihood
        if best is None or bic < best[0]:
            best = (bic, k, model.transform(rows))
    return best[1], best[2].drop("features", "p")


def optics(dist: np.ndarray, least: int, xi: float = 0.05) -> np.ndarray:
    """Clusters of a distance matrix by reachability, -1 for noise: rows are visited nearest
    first; a cluster begins where the reachability falls, and ends where it rises, by ``xi``."""
    n = len(dist)
    core = np.sort(dist, axis=1)[:, min(least, n) - 1]
    reach, done, order = np.full(n, np.inf), np.zeros(n, dtype=bool), []
    for _ in range(n):
        at = int(np.argmin(np.where(done, np.inf, np.where(np.isinf(reach), 1e300, reach))))
        done[at] = True
        order.append(at)
        reach = np.where(done, reach, np.minimum(reach, np.maximum(core[at], dist[at])))
    plot, labels, number = reach[order], np.full(n, -1), -1
    inside = False
    for k in range(n):
        following = plot[k + 1] if k + 1 < n else np.inf
        if not inside and following <= plot[k] * (1 - xi):
            number, inside = number + 1, True
        elif inside and following * (1 - xi) >= plot[k]:
            labels[order[k]] = number
            inside = False
            continue
        if inside:
            labels[order[k]] = number
    return labels


def optics_by_group(df: DataFrame, group: str, key: str, vector: str, least: int, xi: float = 0.05) -> DataFrame:
    """(group, key, cluster) by ``optics`` in each group of at most ``MAX_ITEMS`` rows; larger
    ones are an error."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_ITEMS:
            raise ValueError(f"a group of {len(pdf)} items; clusters by reachability take {MAX_ITEMS} at most")
        pdf = pdf.sort_values(key)
        x = np.stack([np.asarray(v, dtype=float) for v in pdf[vector]])
        dist = _distances(x)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": optics(dist, least, xi)})

    return df.select(group, key, vector).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster int")


def _distances(x: np.ndarray) -> np.ndarray:
    sq = (x**2).sum(axis=1)
    return np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))


METHODS = ("ward", "kmeans", "bisecting", "mixture", "dbscan")


def cluster(df: DataFrame, key: str, vector: str, method: str, sizes: range = range(2, 6), **options) -> DataFrame:
    """(key, cluster) by the method named."""
    if method in ("kmeans", "bisecting"):
        return kmeans(df, vector, sizes, bisecting=method == "bisecting")[1].select(key, "cluster")
    if method == "mixture":
        return mixture(df, vector, sizes)[1].select(key, "cluster")
    if method == "dbscan":
        return dbscan(df, key, vector, **options)
    if method == "ward":
        return ward_by_group(df.withColumn("__all", F.lit(1)), "__all", key, vector, sizes.start, sizes.stop).select(key, "cluster")
    raise ValueError(f"no clustering method {method}; there are {', '.join(METHODS)}")
