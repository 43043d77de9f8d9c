import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessellum.llm import set_pairs as S


def frame(sets):
    counts = {}
    for s in sets.values():
        for t in s:
            counts[t] = counts.get(t, 0) + 1
    rows = [(n, len(s), sorted(s), [counts[t] for t in sorted(s)]) for n, s in enumerate(sets.values())]
    return pd.DataFrame(rows, columns=["sid", "size", "tokens", "counts"])


def candidates(sets, num=7, den=10):
    pdf = frame(sets)
    index = pd.concat(S._index(num, den, len(pdf))(iter([pdf])))
    probe = pd.concat(S._probe(num, den, len(pdf))(iter([pdf])))
    names, pairs = list(sets), probe.merge(index, on="sig")[["sid", "rid"]].drop_duplicates()
    return {tuple(sorted((names[a], names[b]))) for a, b in pairs.itertuples(index=False) if a != b}


@pytest.mark.parametrize("size", [20, 64, 232, 350, 600])
def test_sets_without_common_labels_are_no_candidates_at_any_size(size):
    rng = random.Random(size)
    for n in (100, 200):
        found = candidates({f"s{i}": {rng.getrandbits(60) for _ in range(size)} for i in range(n)})
        assert len(found) <= n // 50


@pytest.mark.parametrize("size", [6, 30, 150, 350, 600])
@pytest.mark.parametrize("hot", [10**9, 2])
def test_candidates_hold_all_similar_pairs(size, hot, monkeypatch):
    monkeypatch.setattr(S, "SALT_RECORDS", hot)
    rng = random.Random(size)
    sets = {}
    for i in range(30):
        base = {rng.getrandbits(60) for _ in range(size)}
        sets[f"a{i}"] = base
        for j in range(3):  # copies with more and more other tokens, some beyond the threshold
            most = int(size * 0.35) + 1
            gone = set(rng.sample(sorted(base), rng.randrange(most)))
            sets[f"b{i}-{j}"] = (base - gone) | {rng.getrandbits(60) for _ in range(rng.randrange(most))}
    found, names = candidates(sets), sorted(sets)
    want = {(a, b) for a in names for b in names if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    assert want and want <= found


def test_choice_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 6)
        costs = [(z := rng.randrange(9), 2 * z + rng.randrange(9)) for _ in range(n)]
        need = rng.randrange(0, 2 * n + 1)
        got = S.choose(costs, need)
        price = lambda ts: sum(0 if t < 0 else costs[k][t] for k, t in enumerate(ts))
        options = [[]]
        for _ in range(n):
            options = [[*o, t] for o in options for t in (-1, 0, 1)]
        assert sum(t + 1 for t in got) == need
        assert price(got) == min(price(o) for o in options if sum(t + 1 for t in o) >= need)


def test_empty_and_repeated_records(spark):
    none = spark.createDataFrame([], "record string, v string")
    members, classes = S.sets(none, "record", "v", 2)
    assert S.record_pairs(members, S.class_pairs(classes)).count() == 0
    rows = [(r, v) for r in ("x", "y") for v in "abc"] * 2 + [("z", None), (None, "a")]
    members, classes = S.sets(spark.createDataFrame(rows, "record string, v string"), "record", F.col("v"), 2)
    assert [tuple(r) for r in S.record_pairs(members, S.class_pairs(classes)).collect()] == [("x", "y")]


def test_signatures_of_frequent_tokens_are_left_once(monkeypatch):
    rng = random.Random(4)
    pdf = frame({f"s{i}": set(rng.sample(range(1 << 40, (1 << 40) + 40), rng.randrange(6, 15))) for i in range(200)})
    rows = len(pd.concat(S._index(7, 10, len(pdf))(iter([pdf]))))
    monkeypatch.setattr(S, "SALT_RECORDS", 2)
    assert len(pd.concat(S._index(7, 10, len(pdf))(iter([pdf])))) == rows


def test_sketches_differ_in_no_more_bits_than_sets_in_tokens():
    rng = random.Random(6)
    for _ in range(500):
        a, b = ({rng.getrandbits(64) - (1 << 63) for _ in range(rng.randrange(40))} for _ in range(2))
        b |= set(rng.sample(sorted(a), rng.randrange(len(a) + 1)))
        assert -(1 << 63) <= S.sketch(sorted(a)) < 1 << 63
        assert ((S.sketch(sorted(a)) ^ S.sketch(sorted(b))) & ((1 << 64) - 1)).bit_count() <= len(a ^ b)


def test_sets_of_frequent_tokens_are_few_candidates(spark, monkeypatch):
    sizes, cut = {}, S.cut

    def counted(df, name, **more):
        out = cut(df, name, **more)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(S, "cut", counted)
    rng = random.Random(8)
    sets = {f"s{i:03}": frozenset(rng.sample(range(16), rng.randrange(6, 13))) for i in range(300)}
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(n, f"t{t}") for n, s in sets.items() for t in s], "record string, v string")
    members, classes = S.sets(df, "record", "v", 5)
    assert {tuple(r) for r in S.record_pairs(members, S.class_pairs(classes)).collect()} == want
    assert len(want) > 300
    assert sizes["set-candidates"] < 4 * len(want)
