import random

import pytest

from tessellum.llm import canon

LISTED = [
    (1, "release year", None), (2, "year", None), (3, "postal code", "código postal"), (4, "airline revision", None), (5, "email address", "mail"),
    (6, "nationality", None), (7, "gemstone", None), (8, "code of the region", None), (9, "of", None), (10, "region code", "year of release"),
]
TYPED = [
    "Release_Year", "relxease year", "rele. year", "rlsyr", "year_2", "revision, airline", "postal-code (m²)", "cÃ³digo postal", "eml_addrss",
    "col_4", "zeppelin", "???", "emailadress", "GEMSTONE NATIONALITY", "code region", "yr of rlse", "mail mail", "of", "the of", "regioncode x",
    "x" * 5000, "nationalty of the gemstone", "release", "email " * 300, "", " ", "nan", None, "Year", "year",
]


def plain_distance(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance_matches_the_table():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        most = rng.randrange(4)
        assert canon.distance(a, b, most) == min(plain_distance(a, b), most + 1)


@pytest.fixture(scope="module")
def frames(spark):
    values = spark.createDataFrame([(v, "e") for v in TYPED], "value string, entry string")
    return values, spark.createDataFrame(LISTED, "id long, name string, alias string")


def answers(frames, size):
    values, listed = frames
    return {r.value: (r.entry, round(r.similarity, 9)) for r in canon.resolve(values, listed, "id", ["name", "alias"], max_entries=size).collect()}


def test_blocks_do_not_change_answers(frames):
    whole = answers(frames, 100)
    assert set(whole) == {v for v in TYPED if v and v.strip() and v != "nan"}
    assert whole["cÃ³digo postal"][0] == 3 and whole["zeppelin"][0] == 0
    assert answers(frames, 5) == whole
    assert answers(frames, 2) == whole


def test_empty_list_and_no_values(frames):
    values, listed = frames
    assert {r.entry for r in canon.resolve(values, listed.where("id < 0"), "id", ["name", "alias"]).collect()} == {0}
    assert canon.resolve(values.where("value is null"), listed, "id", ["name"]).count() == 0
