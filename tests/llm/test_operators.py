import random

import pytest
from pyspark.sql import functions as F

from tessellum.llm import canon, garbled, leaks, quality, set_pairs, terms, tokenize
from tessellum.sources.scratch import new_path

PASSAGE = "Seven brass lanterns were counted by the warden of Elmholt before the ferry with forty crates of salt and tar left for Quivermere at dusk"


def test_term_deltas_equal_recount(spark):
    old = [(1, "a b a"), (2, "b"), (3, None), (4, "nan"), (5, " "), (6, "c"), (7, "B")]
    new = [(1, "a b"), (2, "b"), (3, "d"), (4, "nan"), (5, " "), (8, "e"), (7, "B")]
    path = new_path(spark, "t")
    store = terms.TermStore(spark, path, {"text": terms.WORDS}, buckets=4)
    o, n = (spark.createDataFrame(x, "id int, text string") for x in (old, new))
    store.apply(o, "one")
    store.apply(terms.changes(o, n, "id"), "two")
    store.apply(terms.changes(o, n, "id"), "two")  # a batch counts once
    again = terms.TermStore(spark, path, {"text": terms.WORDS}, buckets=4)
    for s in (store, again):
        assert {r.term: (r.occurrences, r.records) for r in s.counts().collect()} == {"a": (1, 1), "b": (3, 3), "d": (1, 1), "e": (1, 1)}
        assert s.records == {"text": 5}
    store.apply(n.limit(0), "empty")
    assert store.counts().count() == 4
    store.compact()
    again = terms.TermStore(spark, path, {"text": terms.WORDS})
    assert again.batches == ["one", "two", "empty"] and again.buckets == 4 and again.counts().count() == 4


def test_term_store_grows(spark):
    path = new_path(spark, "t")
    store = terms.TermStore(spark, path, {"text": terms.WORDS}, bucket_terms=10, buckets=1)
    one = [(" ".join(f"w{i}" for i in range(8)),), ("w1 w1",)]
    two = [(" ".join(f"w{i}" for i in range(5, 60)),), ("long " * 20_000,)]
    for name, rows in (("one", one), ("two", two), ("three", [("w1 w59",)])):
        store.apply(spark.createDataFrame(rows, "text string"), name)
        store.compact()
    again = terms.TermStore(spark, path, {"text": terms.WORDS}, bucket_terms=10)
    assert again.buckets == 8 and again.terms == 61
    got = {r.term: (r.occurrences, r.records) for r in again.counts().collect()}
    assert len(got) == 61 and got["w1"] == (4, 3) and got["w6"] == (2, 2) and got["long"] == (20_000, 1)


def test_set_pairs_match_brute_force(spark):
    rng = random.Random(5)
    sets = {f"r{i}": set(rng.sample(range(40), rng.randrange(1, 14))) for i in range(150)}
    for i in range(60):
        base = set(sets[f"r{i}"])
        base ^= {rng.randrange(40)}
        sets[f"s{i}"] = base
    sets["big"] = set(range(500))
    sets["copy"] = set(sets["r3"])
    rows = [(k, str(v)) for k, s in sets.items() for v in s] + [("r3", str(next(iter(sets["r3"])))), (None, "1"), ("r3", None)]
    df = spark.createDataFrame(rows, "record string, v string")
    for num, den in ((7, 10), (1, 2), (9, 10)):
        members, classes = set_pairs.sets(df, "record", "v", 3, (num, den))
        got = {(r.a, r.b) for r in set_pairs.record_pairs(members, set_pairs.class_pairs(classes, (num, den))).collect()}
        names = sorted(k for k, s in sets.items() if len(s) >= 3)
        want = {(a, b) for a in names for b in names if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
        assert got == want


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{tokenize.DEFAULT_DIR}/byte_bpe_50k.json"
    reference = tokenizers.Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    rng = random.Random(2)
    texts = [None, "", " ", "<|endoftext|> it's\n\n  été 緑の市場 🙂", "a" * 700, "ab" * 400 + " "]
    texts += ["".join(rng.choice("abeinrst hé") for _ in range(300)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in tokenize.encode(df, "text", path, keep=50).collect():
        assert r.ids == (reference.encode(r.text, add_special_tokens=False).ids if r.text else [])


def test_leaks(spark):
    words = PASSAGE.split()
    altered = " ".join("zzz" if i in (3, 9) else w for i, w in enumerate(words[:15]))
    worse = " ".join("zzz" if i in (3, 9, 12) else w for i, w in enumerate(words[:15]))
    added = " ".join(f"{w} quite" if i % 5 == 2 else w for i, w in enumerate(words))
    docs = [
        (1, "Before. " + PASSAGE.upper().replace(" ", "\n> ")), (2, altered), (3, worse), (4, " ".join(words[:14])), (5, added),
        (6, None), (7, ""), (8, "noise " * 50_000 + PASSAGE), (8, PASSAGE), (9, "**" + PASSAGE.replace(" ", "* *") + "**"), (10, "short"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, PASSAGE), (8, "too short"), (9, None)], "item_id long, passage string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.find(d, "doc_id", "text", items, "item_id", "passage").collect())
    assert got == [(1, 7), (2, 7), (5, 7), (8, 7), (8, 7), (9, 7)]


def test_garbled_round_trip(spark):
    names = ["Zürich", "Köln", "Größe", "München", "Straße", "Fähre", "Brücke", "Übung", "Möwe", "Käse"]
    rows = [(i, f"{names[i % 10]}, Haus") for i in range(400)]
    rows += [(1000 + i, n.encode().decode("cp1252") + " x") for i, n in enumerate(["Zürich", "Köln", "München", "Fähre"])]
    rows += [(2000, "K�ln"), (2001, None), (2002, ""), (2003, "ascii only")]
    df = spark.createDataFrame(rows, "id int, text string")
    fields = garbled.long_fields(df, "id", ["text"])
    found = garbled.judge(fields)
    assert {r.record for r in garbled.affected(fields, found).collect()} == {1000, 1001, 1002, 1003, 2000}
    fixed = {r.record: (r.restored, r.complete) for r in garbled.restore(fields, found).collect()}
    assert fixed[1002] == ("München x", True) and fixed[2000][1] is False


def test_canonical_names():
    c = canon.Canon([(1, "release year"), (2, "year"), (3, "postal code"), (3, "código postal"), (4, "airline revision"), (5, "email address")])
    for value, entry in {
        "Release_Year": 1, "relxease year": 1, "rele. year": 1, "rlsyr": 1, "year_2": 2, "revision, airline": 4, "postal-code (m²)": 3,
        "cÃ³digo postal": 3, "eml_addrss": 5, "col_4": 0, "zeppelin": 0, "???": 0, "emailadress": 5,
    }.items():
        assert c.resolve(value)[0] == entry, value
    assert canon.Canon([]).resolve("x") == (0, 0.0)


def test_quality(spark):
    prose = "The crawl of the portal was early, and a few of the tables in it appear twice with a different year. " * 1
    table = "\n".join(f"| {i} | alpha{i} | {i * 37} |" for i in range(30))
    docs = [(1, prose), (2, table), (3, None), (4, ""), (5, "same phrase, " * 40), (6, " \n "), (7, prose + "\n" + table), (8, table + prose * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = quality.describe(df, "doc_id", "text")
    assert {r.doc_id for r in got.where(quality.is_junk()).collect()} >= {2, 5, 7}
    assert not {1, 3, 4, 6} & {r.doc_id for r in got.where(quality.is_junk()).collect()}
    assert got.where(F.col("doc_id") == 3).first().n_words == 0
