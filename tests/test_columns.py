import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.models import encoders, prompts
from tessellum.operators import clustering, evaluation as E, incremental, noise, ordering, sampling as S, vectors as V


def one(spark, expression, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(expression(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "function, value, want",
    [
        (T.split_any, "a,b|c", ["a", "b|c"]), (T.split_any, "a|b c", ["a", "b c"]), (T.split_any, "a b", ["a", "b"]), (T.split_any, None, None),
        (T.after_think, "<think>x</think>yes", "yes"), (T.after_think, "plain", "plain"), (T.after_think, None, None), (T.after_think, "</think>", ""),
        (T.restructured, "t.csv.col", "t.col"), (T.before_dot, "t.csv", "t"), (T.prefixed, "release year", "table_ReleaseYear"),
        (T.flag, "ON", True), (T.flag, "0", False), (T.flag, "maybe", None), (T.parses_as_day, "2024-02-30", False), (T.parses_as_day, "2024-02-29", True),
        (T.is_plain_number, "1e5", True), (T.is_plain_number, "1d", False), (T.is_plain_number, ".5", True), (T.is_plain_number, None, False), (T.is_plain_number, "", False),
        (T.shortened, "a b c d", "a b c..."), (T.shortened, "a b c", "a b c"), (T.repeats_compressed, "xa_xb_xc_ya", "x3y"), (T.initials, "release_year", "ry"),
        (T.drop_vowels, "Total income", "ttlncm"), (T.abbreviated, "A", "A"), (T.abbreviated, "", ""),
        (T.words_without, "The year of 2 films", ["year", "films"]), (T.has_digit, "a1", True),
    ],
)
def test_scalar_functions(spark, function, value, want):
    assert one(spark, function, value) == want


def test_strict_flag_is_an_error(spark):
    with pytest.raises(Exception, match="no flag"):
        one(spark, lambda c: T.flag(c, strict=True), "maybe")


def test_token_lists_dice_and_jaccard(spark):
    assert one(spark, T.token_list, ["The cat", "of", "", None, "dog"], "array<string>") == ["cat", "dog"]
    assert one(spark, T.token_list, ["of", ""], "array<string>") is None
    both = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), ([], []), (["x"], [])], "a array<string>, b array<string>")
    got = both.select(T.dice(F.col("a"), F.col("b")), T.jaccard(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(2.0 * 3 / 5, 1 / 3), (None, 0.0), (0.0, 0.0)]


def test_messy_paths_are_cleaned(spark):
    text = "1. Thing --> Place → City.\nthing\n- Thing -> Place -> City\nThing -> A -> B -> C -> D -> E\nThing -> place => CITY\nThing ->\nsee Thing -> `Event`"
    assert one(spark, T.clean_paths, text) == [["Thing", "Place", "City"], ["Thing", "Event"]]
    assert one(spark, T.clean_paths, "") == [] and one(spark, T.clean_paths, "none here") == []


def test_ranks_match_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab") if rng.random() > 0.1 else None, rng.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r.i: r.p for r in ordering.global_rank(df, ["v", "i"], "p").collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: r[1:]))}
    inside = {r.i: (r.p, r.n) for r in ordering.group_rank(df, "g", ["v", "i"], "p", "n").collect()}
    for g in ("a", "b", None):
        part = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        assert [inside[r[2]] for r in part] == [(n, len(part)) for n in range(len(part))]
    top = {r.i for r in ordering.top_per_group(df, ["g"], [F.desc("v"), "i"], 3).collect()}
    assert top == {r[2] for g in ("a", "b", None) for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:3]}
    none = df.where("i < 0")
    assert ordering.global_rank(none, ["v"]).count() == 0 and ordering.every_nth(none, ["i"], 3).count() == 0 and ordering.lowest_share(none, ["i"], 0.5).count() == 0
    assert ordering.every_nth(df, ["i"], 100).count() == 100


def test_weighted_draws_follow_the_weights(spark):
    rows = [(g, k, w) for g in range(400) for k, w in (("x", 8.0), ("y", 1.0), ("z", 1.0), ("never", 0.0))]
    df = spark.createDataFrame(rows, "g int, k string, w double")
    first = S.weighted(df, ["g"], "k", "w", 1, "s").groupBy("k").count().collect()
    share = {r.k: r["count"] / 400 for r in first}
    assert 0.74 < share["x"] < 0.86 and "never" not in share
    even = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (2, "a", 1.0), (2, "b", 0.0)], "g int, k string, w double")
    assert S.roulette(even, "g", "k", "w", 2, "s").count() == 4


def test_sampling_helpers(spark):
    assert one(spark, lambda c: S.padded(c, 5), ["a", "b"], "array<string>") == list("ababa")
    assert one(spark, lambda c: S.padded(c, 2), [], "array<string>") == [] and one(spark, lambda c: S.padded(c, 1), ["a", "b"], "array<string>") == ["a"]
    pairs = S.random_pairs(7, 300, "q", spark).collect()
    assert len(pairs) == 300 and all(r.i != r.j and 0 <= min(r.i, r.j) and max(r.i, r.j) < 7 for r in pairs)
    assert S.random_pairs(1, 5, "q", spark).count() == 0


def test_adjusted_mutual_information_matches_all_permutations(spark):
    truth, pred = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 1, 1]

    def mi(a, b):
        n, out = len(a), 0.0
        for x, y in {*zip(a, b)}:
            k = sum(p == (x, y) for p in zip(a, b))
            out += k / n * math.log(n * k / (a.count(x) * b.count(y)))
        return out

    def entropy(a):
        return -sum(a.count(x) / len(a) * math.log(a.count(x) / len(a)) for x in set(a))

    mean = np.mean([mi(truth, list(p)) for p in itertools.permutations(pred)])
    want = (mi(truth, pred) - mean) / ((entropy(truth) + entropy(pred)) / 2 - mean)
    cells = V.contingency(spark.createDataFrame(list(zip(truth, pred)), "t int, p int"), "t", "p")
    assert E.adjusted_mutual_information(cells).first().ami == pytest.approx(want, abs=1e-6)


def test_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert E.lcs(a, b) == table[-1][-1]


def test_path_scores_by_hand(spark):
    paths = spark.createDataFrame([("p", ["A", "B", "C"]), ("q", ["A", "X", "C"]), ("r", ["Z", "B", "C"])], "path_id string, path array<string>")
    truth = spark.createDataFrame([("t", ["A", "B", "C", "D"]), ("u", ["A", "C"])], "truth_id string, path array<string>")
    assert {r.path_id: r.score for r in E.path_scores(paths, truth).collect()} == {"p": 1.0, "q": round(2 / 3, 6), "r": 0.0}
    labels = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("X", "x")], "node string, label string")
    closed = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "ancestor string, node string")
    assert {r.path_id: r.share for r in E.consistent_shares(paths, labels, closed).collect()} == {"p": 1.0, "q": round(2 / 3, 6), "r": round(1 / 3, 6)}


def test_near_pairs_and_dbscan_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, size=(25, 3)) for c in (0, 3, 6)] + [rng.uniform(-9, 15, size=(15, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r.i, r.j) for r in clustering.near_pairs(df, 0.7).collect()}
    assert got == {(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and d[i, j] <= 0.7}
    core = {i for i in range(len(x)) if (d[i] <= 0.7).sum() >= 5}
    labels = {r.k: r.cluster for r in clustering.dbscan(df, "k", "v", 0.7, 5).collect()}
    seen = {}
    for i in sorted(core):
        if i not in seen:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen[j] = i
                    todo += [k for k in core if d[j, k] <= 0.7]
    assert {k: labels[k] for k in core} == seen
    assert all(labels[i] is None for i in range(len(x)) if i not in core and not any(d[i, j] <= 0.7 for j in core))


def test_pair_distances_are_sampled_beyond_the_bound(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], "k int, v array<double>")
    assert noise.pair_distances(df, "k", "v").count() == 435
    monkeypatch.setattr(noise, "EXACT_ROWS", 10)
    monkeypatch.setattr(noise, "SAMPLED_PAIRS", 50)
    rows = noise.pair_distances(df, "k", "v").collect()
    assert len(rows) == 50 and all(r.dist == abs(r.i - r.j) for r in rows)


def test_models_answer_and_fill(spark):
    tables = spark.createDataFrame([("red_bus.csv",), ("",), (None,), ("tram.csv",)], "t string")
    got = {r.t: r.paths for r in prompts.type_paths(tables, F.col("t"), "rules").collect()}
    assert got["red_bus.csv"] == [["Thing", "Red", "Red Bus"]] and got["tram.csv"] == [["Thing", "Tram"]] and got[None] == []
    with pytest.raises(ValueError):
        prompts.choose("nobody")
    wanted = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "a")], "class string, attribute string")
    asked = []

    def ask(missing):
        asked.append(1)
        return missing.withColumn("grp", F.when(F.col("attribute") == "a", "g"))

    filled = prompts.fill_missing(wanted, wanted.limit(0).withColumn("grp", F.lit("g")), ask)
    assert {(r["class"], r.attribute) for r in filled.collect()} == {("c", "a"), ("d", "a")} and len(asked) == 4


def test_vectors_and_incremental(spark):
    v = one(spark, lambda c: encoders.hashed_vector(c, 8), ["a", "b", "a"], "array<string>")
    assert sum(x * x for x in v) == pytest.approx(1.0) and one(spark, lambda c: encoders.hashed_vector(c, 4), [], "array<string>") == [0.0] * 4
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(2000)], "k int, v string")
    settled = incremental.until_settled(rows, "k", "v", rounds=10, eps=0.05).collect()
    assert settled[0].rounds == 2 and {r.v for r in settled} == {"a", "b"}
    assert incremental.until_settled(rows.where("k < 0"), "k", "v").count() == 0
