"""Queries of vector operators, noise, prototypes and the matching of columns by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessellum.operators import clustering, noise as N, vectors as V
from tessellum.plans.base import Plans, unit_vectors
from tessellum.sources.scratch import cut
from tessellum.sources.tables import table

PLANS = Plans()
QUERIES, SQL, query = PLANS.queries, PLANS.sql, PLANS.query

_D = "round(list_distance(a.embedding::double[], b.embedding::double[]), 9)"
_PAIRS = f"pr as (select a.vec_id i, b.vec_id j, {_D} dist from embeddings a join embeddings b on a.vec_id < b.vec_id)"
SIGMA = N.noise_scale(0.2, 1.4, 64)


def _u(key: str, seed: str) -> str:
    return f"((cast('0x' || substr(md5('{seed}|' || {key}), 1, 8) as bigint) + 1) / 4294967298.0::double)"


_KEY = "vec_id || '|' || i"
_NOISY = f"""ns as (select vec_id, embedding, list_transform(range(len(embedding)), lambda i: embedding[i + 1]::double + {SIGMA!r} * sqrt(-2 * ln({_u(_KEY, 'n1')})) * cos(2 * pi() * {_u(_KEY, 'n2')})) noisy from embeddings)"""
_BOTH = f"{_NOISY}, bp as (select {_D} dist, round(list_distance(a.noisy, b.noisy), 9) dist2 from ns a join ns b on a.vec_id < b.vec_id)"


def _noisy(s: SparkSession, d: str) -> DataFrame:
    return cut(N.with_noise(table(s, d, "embeddings"), "vec_id", "embedding", SIGMA, "n"), "noisy")


def _both(s: SparkSession, d: str) -> DataFrame:
    return N.pair_distances(_noisy(s, d), "vec_id", "embedding", "noisy")


@query(f"with {_PAIRS} select round(median(dist), 6) med from pr")
def v_med(s, d):
    """Exact on up to 2,000 vectors, from 50,000 hashed pairs beyond."""
    return N.pair_distances(table(s, d, "embeddings"), "vec_id", "embedding").agg(F.round(F.median("dist"), 6).alias("med"))


@query(f"with {_NOISY} select vec_id, i dim, round(noisy[i + 1], 5) + 0.0 value from ns, range(64) t(i)")
def v_noise(s, d):
    return _noisy(s, d).select("vec_id", F.posexplode("noisy").alias("p", "x")).select("vec_id", F.col("p").cast("long").alias("dim"), (F.round("x", 5) + 0.0).alias("value"))


_QS = "[0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]"


def _quantiles(x: str) -> str:
    return f"unnest(list_transform(quantile_cont({x}, {_QS}), lambda v: round(v, 6)))"


@query(f"with {_BOTH} select unnest({_QS}::double[]) q, {_quantiles('dist')} clean, {_quantiles('dist2')} noisy, {_quantiles('abs(dist2 - dist)')} abs_change from bp")
def v_pct(s, d):
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    at = F.array(*[F.lit(q) for q in qs])
    p = _both(s, d).agg(F.percentile("dist", at).alias("c"), F.percentile("dist2", at).alias("n"), F.percentile(F.abs(F.col("dist2") - F.col("dist")), at).alias("a"))
    rows = p.select(F.inline(F.arrays_zip(at.alias("q"), F.col("c").alias("c"), F.col("n").alias("n"), F.col("a").alias("a"))))
    return rows.toDF("q", "c", "n", "a").select("q", F.round("c", 6).alias("clean"), F.round("n", 6).alias("noisy"), F.round("a", 6).alias("abs_change"))


@query(f"with {_NOISY}, df as (select vec_id, list_transform(range(len(noisy)), lambda i: noisy[i + 1] - embedding[i + 1]::double) z from ns) select round(sqrt(avg(power(list_distance(a.z, b.z), 2))), 6) rms, {round(SIGMA * 128 ** 0.5, 6)!r}::double target from df a join df b on a.vec_id < b.vec_id")
def v_rms(s, d):
    z = F.zip_with("noisy", "embedding", lambda x, y: x - y.cast("double"))
    moved = cut(_noisy(s, d).select("vec_id", z.alias("z")), "moves")
    pairs = N.pair_distances(moved, "vec_id", "z")
    return pairs.agg(F.round(F.sqrt(F.avg(F.col("dist") * F.col("dist"))), 6).alias("rms"), F.lit(round(SIGMA * 128**0.5, 6)).alias("target"))


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the rank of ``col``, ties at the mean of their places: from counts of values,
    of which only the running sum needs an order."""
    from tessellum.operators import ordering

    counts = ordering.global_rank(df.groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("__n")), ["__v"], "__at")
    parts = counts.withColumn("__block", F.floor(F.col("__at") / 4096))
    inner = F.sum("__n").over(W.partitionBy("__block").orderBy("__at").rowsBetween(W.unboundedPreceding, -1))
    blocks = parts.groupBy("__block").agg(F.sum("__n").alias("__bn"))  # a row for 4,096 values
    starts = blocks.select("__block", F.coalesce(F.sum("__bn").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    ranks = parts.withColumn("__in", F.coalesce(inner, F.lit(0))).join(starts, "__block")
    ranks = ranks.select("__v", (F.col("__start") + F.col("__in") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(col) == F.col("__v")).drop("__v")


@query(f"""with {_BOTH}, r as (select dist, dist2, rank() over (order by dist) + (count(*) over (partition by dist) - 1) / 2.0 r1, rank() over (order by dist2) + (count(*) over (partition by dist2) - 1) / 2.0 r2 from bp)
    select round(corr(dist, dist2), 6) pearson, round(corr(r1, r2), 6) spearman from r""")
def v_corr(s, d):
    pairs = cut(_both(s, d), "pairs")
    ranked = average_ranks(average_ranks(pairs, "dist", "r1"), "dist2", "r2")
    return ranked.agg(F.round(F.corr("dist", "dist2"), 6).alias("pearson"), F.round(F.corr("r1", "r2"), 6).alias("spearman"))


@query("select label::int label, i::int dim, round(sum(embedding[i + 1]::double * ((vec_id % 7) + 1) / 28), 5) \"value\" from embeddings, range(64) t(i) group by 1, 2")
def v_wsum(s, d):
    e = table(s, d, "embeddings").withColumn("w", ((F.col("vec_id") % 7) + 1) / 28)
    return V.weighted_sum(e, "label", "embedding", "w").withColumn("value", F.round("value", 5))


@query("select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 4) was, round(embedding[1]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) first from embeddings")
def v_norm(s, d):
    e = table(s, d, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", F.round(F.sqrt(V.dot(v, v)), 4).alias("was"), F.round(V.normalized(v)[0], 6).alias("first"))


@query(f"with {_PAIRS} select count(*) pairs, round(sum(dist), 3) total, round(max(dist), 6) largest from pr")
def v_pdist(s, d):
    return N.pair_distances(table(s, d, "embeddings"), "vec_id", "embedding").agg(
        F.count("*").alias("pairs"), F.round(F.sum("dist"), 3).alias("total"), F.round(F.max("dist"), 6).alias("largest")
    )


_SIGNS = "sg as (select label, list_transform(range(64), lambda i: cast(avg_x[i + 1] > 0 as int)) bits from (select label, list(x order by i) avg_x from (select label, i, round(avg(embedding[i + 1]::double), 9) x from embeddings, range(64) t(i) group by 1, 2) group by 1))"


@query(f"with {_SIGNS} select a.label i, b.label j, round((64 - list_sum(list_transform(range(64), lambda k: abs(a.bits[k + 1] - b.bits[k + 1])))) / 64, 6) smc from sg a join sg b on a.label < b.label")
def v_ham(s, d):
    """Simple matching of the signs of the labels' mean vectors."""
    means = V.mean_vectors(table(s, d, "embeddings"), "label", "embedding")
    signs = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", F.round("value", 9).alias("x")))), lambda z: (z.x > 0).cast("int")).alias("bits"))
    signs = cut(signs, "signs")
    a, b = signs.toDF("i", "x"), signs.toDF("j", "y")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", F.round(V.simple_matching(F.col("x"), F.col("y")), 6).alias("smc"))


_NEAR = """row_number() over (partition by a.vec_id order by round(list_distance({0}), 6), b.vec_id) r from ns a join ns b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0"""


@query(f"""with {_NOISY}, o as (select a.vec_id q, b.vec_id v, {_NEAR.format('a.embedding::double[], b.embedding::double[]')}), z as (select a.vec_id q, b.vec_id v, {_NEAR.format('a.noisy, b.noisy')})
    select o.q, count(z.v) / 10 share from o left join z on o.q = z.q and o.v = z.v and z.r <= 10 where o.r <= 10 group by 1""")
def win1_neighbour_overlap(s, d):
    """Share of the ten nearest that stay the same with noise, for each of the query rows."""
    e = _noisy(s, d)
    q = e.where("vec_id % 20 = 0")
    clean = V.nearest(q, e, "vec_id", "embedding", 10).select(F.col("query").alias("q"), "neighbour")
    moved = V.nearest(q, e, "vec_id", "noisy", 10).select(F.col("query").alias("q"), "neighbour", F.lit(1).alias("same"))
    return clean.join(moved, ["q", "neighbour"], "left").groupBy("q").agg((F.count("same") / 10).alias("share"))


_SIM = "round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5)"


@query(f"select q, v, sim from (select a.vec_id q, b.vec_id v, {_SIM} sim, row_number() over (partition by a.vec_id order by {_SIM} desc, b.vec_id) r from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) where r <= 5 and sim >= 0.2")
def win2_best_matches(s, d):
    """The five most similar rows of each query row, if similar enough."""
    from tessellum.operators import ordering

    e = unit_vectors(s, d)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    sims = e.join(q, F.col("q") != F.col("vec_id")).select("q", F.col("vec_id").alias("v"), F.round(V.dot(F.col("qe"), F.col("embedding")), 5).alias("sim"))
    return ordering.top_per_group(sims.where("sim >= 0.2"), ["q"], [F.desc("sim"), "v"], 5)


@query(f"""select a.label x, b.label y, count(*) pairs, round(max({_SIM}), 5) best from embeddings a join embeddings b on a.label < b.label where {_SIM} >= 0.3 group by 1, 2""")
def jn10_similar_names(s, d):
    """Rows of two labels that are similar enough, counted for each pair of labels."""
    e = unit_vectors(s, d).select("label", "embedding")
    both = e.alias("a").join(e.alias("b"), F.col("a.label") < F.col("b.label"))
    sims = both.select(F.col("a.label").alias("x"), F.col("b.label").alias("y"), F.round(V.dot(F.col("a.embedding"), F.col("b.embedding")), 5).alias("sim"))
    return sims.where("sim >= 0.3").groupBy("x", "y").agg(F.count("*").alias("pairs"), F.max("sim").alias("best"))


@query(f"""select 'near' kind, a.vec_id i, b.vec_id j from embeddings a join embeddings b on a.vec_id < b.vec_id and a.label = b.label where {_SIM} >= 0.5
    union all select 'shuffled', i, j from (select vec_id i, vec_id j from embeddings where cast('0x' || substr(md5('m|' || vec_id), 1, 8) as bigint) % 10 = 0)""")
def jn11_positive_pairs(s, d):
    """Pairs of one label that are similar, and a tenth of the rows, by hash, with themselves
    (their words are shuffled to make the second view)."""
    e = unit_vectors(s, d).select("label", "vec_id", "embedding")
    a, b = e.toDF("label", "i", "x"), e.toDF("label", "j", "y")
    near = a.join(b, "label").where("i < j").where(F.round(V.dot(F.col("x"), F.col("y")), 5) >= 0.5)
    h = F.conv(F.left(F.md5(F.concat(F.lit("m|"), "vec_id")), F.lit(8)), 16, 10).cast("long")
    own = e.where(h % 10 == 0).select(F.lit("shuffled").alias("kind"), F.col("vec_id").alias("i"), F.col("vec_id").alias("j"))
    return near.select(F.lit("near").alias("kind"), "i", "j").unionByName(own)


@query(f"""with k as (select q, v, sim from (select a.vec_id q, b.vec_id v, {_SIM} sim, row_number() over (partition by a.vec_id order by {_SIM} desc, b.vec_id) r from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) where r <= 5),
    y as (select least(q, v) i, greatest(q, v) j, sim from k) select i, j, round(1 - avg(sim), 5) dist from y group by 1, 2""")
def jn12_knn_distances(s, d):
    """Distances from the nearest neighbours of the query rows, the same both ways."""
    from tessellum.operators import ordering

    e = unit_vectors(s, d)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    sims = e.join(q, F.col("q") != F.col("vec_id")).select("q", F.col("vec_id").alias("v"), F.round(V.dot(F.col("qe"), F.col("embedding")), 5).alias("sim"))
    near = ordering.top_per_group(sims, ["q"], [F.desc("sim"), "v"], 5)
    return near.groupBy(F.least("q", "v").alias("i"), F.greatest("q", "v").alias("j")).agg(F.round(1 - F.avg("sim"), 5).alias("dist"))


@query(
    f"""with {_NOISY}, bp as (select {_D} dist, round(list_distance(a.noisy, b.noisy), 9) dist2 from ns a join ns b on a.vec_id < b.vec_id),
    df as (select vec_id, list_transform(range(len(noisy)), lambda i: noisy[i + 1] - embedding[i + 1]::double) z from ns),
    o as (select a.vec_id q, b.vec_id v, {_NEAR.format('a.embedding::double[], b.embedding::double[]')}), z as (select a.vec_id q, b.vec_id v, {_NEAR.format('a.noisy, b.noisy')})
    select round(median(dist), 6) typical, round(avg(abs(dist2 - dist)), 6) moved, round(corr(dist, dist2), 6) pearson,
    (select round(sqrt(avg(power(list_distance(a.z, b.z), 2))), 6) from df a join df b on a.vec_id < b.vec_id) rms,
    (select round(count(z.v) / count(*), 6) from o left join z on o.q = z.q and o.v = z.v and z.r <= 10 where o.r <= 10) kept from bp"""
)
def gen7_noise_experiment(s, d):
    """The noisy copy of the vectors against the clean one: scale, distances, order and neighbours."""
    e = _noisy(s, d)
    pairs = N.pair_distances(e, "vec_id", "embedding", "noisy").agg(
        F.round(F.median("dist"), 6).alias("typical"), F.round(F.avg(F.abs(F.col("dist2") - F.col("dist"))), 6).alias("moved"), F.round(F.corr("dist", "dist2"), 6).alias("pearson")
    )
    kept = win1_neighbour_overlap(s, d).agg(F.round(F.avg("share"), 6).alias("kept"))
    return pairs.crossJoin(v_rms(s, d).select("rms")).crossJoin(kept)  # single rows


@query()
def cl3_kmeans(s, d):
    return clustering.cluster(table(s, d, "embeddings"), "vec_id", "embedding", "kmeans", range(8, 13))


@query()
def cl4_dbscan(s, d):
    return clustering.dbscan(table(s, d, "embeddings"), "vec_id", "embedding", 1.1, 5)


@query()
def cl5_optics(s, d):
    """Clusters by reachability of the vectors of each pseudo table."""
    e = table(s, d, "embeddings").select((F.col("vec_id") % 20).alias("tab"), "vec_id", "embedding")
    return clustering.optics_by_group(e, "tab", "vec_id", "embedding", 3)


@query()
def cl6_bisecting(s, d):
    """A tree of clusters, split step by step: the substitute of a feature tree."""
    return clustering.cluster(table(s, d, "embeddings"), "vec_id", "embedding", "bisecting", range(8, 11))


@query()
def cl7_mixture(s, d):
    """Gaussian mixture of the first eight dimensions, by the lowest information criterion."""
    e = table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("embedding"))
    return clustering.cluster(e, "vec_id", "embedding", "mixture", range(2, 5))


_Q0 = "q0 as (select vec_id r, i c, exp(embedding[i + 1]::double / 0.5) x from embeddings, range(8) t(i))"


def _norm(n: int) -> str:
    return f"""k{n} as (select r, c, x / sum(x) over (partition by c) x from q{n}), q{n + 1} as (select r, c, x / sum(x) over (partition by r) x from k{n})"""


@query(f"with {_Q0}, {_norm(0)}, {_norm(1)}, {_norm(2)} select r, c, round(x, 6) p from q3")
def cl10_sinkhorn(s, d):
    """Assignment of vectors to eight prototypes: three rounds of normalizing columns and rows."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode(F.slice("embedding", 1, 8)).alias("k", "x"))
    scores = e.select("r", F.col("k").cast("long").alias("c"), F.exp(F.col("x").cast("double") / 0.5).alias("x"))
    return clustering.sinkhorn(scores, 3).select("r", "c", F.round("x", 6).alias("p"))


_SIL = f"""l as (select vec_id, label, embedding::double[] e from embeddings), sz as (select label, count(*) n from l group by 1),
    m as (select a.vec_id, a.label own, b.label other, sum(round(list_distance(a.e, b.e), 9)) total from l a join l b on a.vec_id <> b.vec_id group by 1, 2, 3),
    av as (select vec_id, own, max(case when own = other then total / (n - 1) end) a, min(case when own <> other then total / n end) b from m join sz on sz.label = other group by 1, 2)"""


@query(f"with {_SIL} select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) silhouette from av")
def cl9_silhouette(s, d):
    """Mean silhouette of the labels. All pairs of distances are the input of the measure."""
    return clustering.silhouette_of(table(s, d, "embeddings"), "vec_id", "label", "embedding").select(F.round("silhouette", 6).alias("silhouette"))
