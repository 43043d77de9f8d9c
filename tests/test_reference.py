import numpy as np
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators import clustering, graphs, relational as R


def naive_ward(x, k):
    groups = [[i] for i in range(len(x))]

    def cost(a, b):
        ca, cb = x[a].mean(axis=0), x[b].mean(axis=0)
        return len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()

    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_ward_matches_naive_merging():
    x = np.random.default_rng(1).normal(size=(12, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    merges = clustering.linkage(d, "ward")
    heights = [m[2] for m in merges]
    assert heights == sorted(heights)
    for k in (2, 4, 7):
        labels = clustering.labels_at(merges, 12, k)
        assert {frozenset(np.flatnonzero(labels == c)) for c in set(labels)} == naive_ward(x, k)
        assert -1 <= clustering.silhouette(d, labels) <= 1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7)], "a int, b int")
    assert {r.node: r.component for r in clustering.components(edges, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7}


def test_acronym_is_three_valued(spark):
    df = spark.createDataFrame([("US",), ("U.S.",), ("Abc",), ("longer",), ("ab",), (None,)], "c string")
    assert [r[0] for r in df.select(T.is_acronym(F.col("c"))).collect()] == [True, True, None, False, False, False]


def test_number_date_and_list(spark):
    df = spark.createDataFrame([("12%", "2020-01-02", "['a', 'b']"), ("x", "1.2", ""), (None, None, "a")], "n string, d string, l string")
    got = df.select(T.is_number(F.col("n")), T.is_date(F.col("d")), T.parse_list(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(True, True, ["a", "b"]), (False, False, []), (False, False, ["a"])]


def test_post_process_cleans_and_roots(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "a", 1), ("c", "c", 2), ("x", "y", 2), ("y", "x", 2)], "parent string, child string, weight long")
    got = {(r.parent, r.child) for r in graphs.post_process(edges).collect()}
    assert got == {("a", "b"), ("x", "y"), ("y", "x"), ("Thing", "a")}


def test_samples_and_empty(spark):
    df = spark.range(100)
    assert R.sample_ratio(df, "id", 0.25, "s").count() == 25
    assert R.sample_ratio(df, "id", 0.001, "s").count() == 1
    assert R.sample_ratio(df, "id", 1.0, "s").count() == 100
    assert R.sample_ratio(df.where("id < 0"), "id", 0.5, "s").count() == 0
    assert R.majority(spark.createDataFrame([("g", "b"), ("g", "a")], "g string, l string"), ["g"], "l").collect()[0].l == "a"
