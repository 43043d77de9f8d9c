import random

import pytest

from tessellum.operators import forest


def brute(links):
    parent = {}
    nodes = set()
    for src, c, p in links:
        nodes |= {(src, x) for x in (c, p) if x is not None}
        if c and p and c != p:
            parent[src, c] = p
    out = {}
    for src, n in nodes:
        up, seen, depth = n, set(), 0
        while (src, up) in parent and up not in seen:
            seen.add(up)
            up = parent[src, up]
            depth += 1
        out[src, n] = ("#cycle", -1) if up in seen else (up, depth)
    return out


@pytest.mark.parametrize("peel", [12, 1])
def test_depths_match_brute_force(spark, peel):
    rng = random.Random(3)
    links = []
    for src in ("a", "b"):
        names = [f"n{i}" for i in range(40)]
        for i in range(1, 40):
            if rng.random() < 0.85:
                links.append((src, names[i], names[rng.randrange(i)]))
    links += [("a", "x", "y"), ("a", "y", "z"), ("a", "z", "x"), ("a", "w", "x"), ("b", "self", "self"), ("b", "alone", None), ("b", None, None)]
    links += [("b", f"d{i}", f"d{i + 1}") for i in range(30)]
    links += links[:5]
    df = spark.createDataFrame(links, "src string, child string, parent string")
    tours = forest.intervals(df, peel_rounds=peel)
    got = {(r.src, r.node): ("#cycle", -1) if r.endless else (r.root, r.depth) for r in tours.collect()}
    assert got == brute(links)


def test_ancestry_and_paths(spark):
    links = [("s", "b", "a"), ("s", "c", "b"), ("s", "d", "b"), ("s", "e", "a"), ("s", "p", "q"), ("s", "q", "p")]
    tours = forest.intervals(spark.createDataFrame(links, "src string, child string, parent string"))
    pairs = {(r.ancestor, r.node) for r in forest.ancestry(tours).collect()}
    assert pairs == {("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "c"), ("b", "d")}
    paths = {r.node: r.path for r in forest.paths(tours).collect()}
    assert paths == {"a": "a", "b": "a > b", "c": "a > b > c", "d": "a > b > d", "e": "a > e"}


def test_most_frequent_parent_wins_and_empty(spark):
    links = [("s", "x", "b"), ("s", "x", "a"), ("s", "x", "b")]
    df = spark.createDataFrame(links, "src string, child string, parent string")
    assert {r.node: r.root for r in forest.depths(df).collect()} == {"x": "b", "b": "b", "a": "a"}
    empty = spark.createDataFrame([], "src string, child string, parent string")
    assert forest.depths(empty).count() == 0
