import numpy as np
import pytest

from tessellum.operators import clustering as C, dendro as D, lattice as L


def test_complete_linkage_of_points_on_a_line():
    x = np.array([0, 1, 4, 5.5, 12, 13.2, 20, 21.4])
    dist = np.abs(x[:, None] - x[None])
    merges = C.linkage(dist, "complete")
    assert [m[2] for m in merges] == sorted(m[2] for m in merges)
    assert [round(m[2], 6) for m in merges] == [1.0, 1.2, 1.4, 1.5, 5.5, 9.4, 21.4]
    assert C.labels_at(merges, 8, 4).tolist() == [0, 0, 1, 1, 2, 2, 3, 3]
    assert D.cut_at(merges, 8, 1.45).tolist() == [0, 0, 1, 2, 3, 3, 4, 4]
    height, score, labels = D.best_cut(merges, dist)
    assert labels.tolist() == [0, 0, 1, 1, 2, 2, 3, 3] and score == pytest.approx(C.silhouette(dist, labels)) and 1.5 < height < 5.5


def test_linkage_equals_naive_merging_of_the_closest():
    rng = np.random.default_rng(3)
    for method in ("ward", "complete"):
        x = rng.normal(size=(25, 4))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        groups, heights = [[i] for i in range(25)], []

        def gap(a, b):
            if method == "complete":
                return max(d[i, j] for i in a for j in b)
            ca, cb = x[a].mean(axis=0), x[b].mean(axis=0)
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum())

        while len(groups) > 1:
            i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: gap(groups[p[0]], groups[p[1]]))
            heights.append(gap(groups[i], groups[j]))
            groups[i] += groups.pop(j)
        assert np.allclose([m[2] for m in C.linkage(d, method)], heights)


def test_table_distances_by_hand():
    tabs, clusters = np.array(["a", "a", "b", "b", "c", "c"]), np.array([1, 2, 1, 2, 3, 3])
    names, dist = D.table_distances(tabs, clusters)
    assert names == ["a", "b", "c"]
    assert dist[0, 1] == pytest.approx(1 - 2 / 6) and dist[0, 2] == 1 and dist[2, 2] == 0


def test_layered_edges_hang_clusters_on_those_that_hold_them():
    names = list("abcdef")
    cuts = [np.array([0, 0, 1, 1, 2, 3]), np.array([0, 0, 0, 0, 1, 1])]
    edges = D.layered_edges(names, cuts)
    assert ("L0:a", "a", 0) in edges and ("L0:c", "d", 0) in edges
    assert {e for e in edges if e[2] == 1} == {("L1:a", "L0:a", 1), ("L1:a", "L0:c", 1)}


def test_dendrogram_relations(spark):
    rows = [("g", t, c) for t, cs in {"a": (1, 2), "b": (1, 2), "c": (2, 3), "d": (9, 9)}.items() for c in cs] + [("h", "z", 1)]
    members = spark.createDataFrame(rows, "grp string, tab string, cluster int")
    merges = D.dendrograms(members)
    got = {r.step: (r.left, r.right, r.height, r["size"]) for r in merges.collect()}
    assert got[0][:2] == ("a", "b") and got[2][3] == 4 and len(got) == 3
    edges = D.dendrogram_edges(merges)
    below = {}
    for r in D.leaves_below(edges).collect():
        below.setdefault(r.node, set()).add(r.leaf)
    assert below == {"g#0": {"a", "b"}, "g#1": {"a", "b", "c"}, "g#2": {"a", "b", "c", "d"}}
    clusters = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (2, "b"), (3, "d"), (3, "a")], "cluster int, leaf string")
    assert {r.cluster: r.node for r in D.common_ancestors(edges, clusters).collect()} == {1: "g#1", 2: "g#0", 3: "g#2"}
    kept = spark.createDataFrame([(n,) for n in ("g#2", "g#0", "a", "b", "c", "d")], "node string")
    assert {(r.parent, r.child) for r in D.simplified(edges, kept).collect()} == {("g#2", "g#0"), ("g#2", "c"), ("g#2", "d"), ("g#0", "a"), ("g#0", "b")}
    assert D.dendrograms(members.where("grp = 'x'")).count() == 0
    assert D.best_cuts(members).count() == 5 and D.hierarchies(members, 2.0).where("grp = 'h'").count() == 0


def test_too_large_a_type_is_an_error(spark, monkeypatch):
    members = spark.createDataFrame([("g", str(i), i) for i in range(4001)], "grp string, tab string, cluster int")
    with pytest.raises(Exception, match="4000 at most"):
        D.dendrograms(members).count()


EDGES = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("r", "a")]


def test_lattice_with_cycles_and_repeated_edges(spark):
    edges = spark.createDataFrame(EDGES, "parent string, child string")
    pairs = {(r.ancestor, r.node) for r in L.closure(edges).collect()}
    assert pairs == {(p, c) for p, c in EDGES} | {("r", "c"), ("r", "d"), ("a", "d"), ("b", "d"), ("x", "x"), ("y", "y")}
    level = {r.node: r.level for r in L.levels(edges).collect()}
    assert level == {"d": 0, "c": 1, "a": 2, "b": 2, "r": 3, "x": None, "y": None}
    start = spark.createDataFrame([("r",), ("x",)], "node string")
    assert {"".join(r.path) for r in L.simple_paths(edges, start).collect()} == {"r", "ra", "rb", "rac", "rbc", "racd", "rbcd", "x", "xy"}
    none = edges.where("parent = 'zz'")
    assert L.closure(none).count() == 0 and L.levels(none).count() == 0 and L.simple_paths(none, start).count() == 2
    assert {(r.node, r.branch) for r in L.root_branches(edges).collect()} == {("a", "a"), ("b", "b"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b")}


def test_members_of_nodes(spark):
    edges = spark.createDataFrame(EDGES[:5], "parent string, child string")
    m = spark.createDataFrame([("r", 1), ("a", 1), ("c", 1), ("r", 2), ("d", 3), ("a", 4), ("b", 4), ("d", 1), ("d", 2), ("d", 4)], "node string, item int")
    got = {(r.node, r.item) for r in L.specific(m, L.closure(edges)).collect()}
    assert got == {("d", 1), ("d", 2), ("d", 3), ("d", 4)}
    two = spark.createDataFrame([("a", 4), ("b", 4), ("c", 5)], "node string, item int")
    depth = spark.createDataFrame([("r", 0), ("a", 1), ("b", 1), ("c", 2)], "node string, depth int")
    assert {r.item: r.node for r in L.most_specific(two, L.closure(edges), depth).collect()} == {4: "r", 5: "c"}
    assert [r.node for r in L.covering(m).collect()] == ["d"]
