from tessellum.operators.packed import choose_dialects, readings, split, unpack


def test_split_quotes_and_escapes():
    import re

    comma = re.compile(",")
    assert split("'Children\\'s Venue', 'Place'", "'", comma) == ["Children's Venue", "Place"]
    assert split('"a, b","c"', '"', comma) == ["a, b", "c"]
    assert split("", "", comma) == [""]


def test_readings_of_empty_list():
    assert {tuple(values) for _, values, _ in readings("['']")[1]} == {(), ("''",), ("['']",)}
    assert {tuple(values) for _, values, _ in readings("[]")[1]} == {(), ("[]",)}


def test_unpack_picks_the_cheapest_dialect(spark):
    names = ["Radio/TV Station", "Trade, Import and Export", "Place", "Thing", "Event", "Care; Health Service"]
    rows, n = [], 0
    for a in names:
        for b in names:
            if a != b:
                n += 1
                rows.append((n, repr([a, b])))
    rows += [
        (101, "Place;Radio/TV Station"),
        (102, "Radio/TV Station"),
        (103, "{Place,Thing}"),
        (104, 'Place, "Trade, Import and Export", Thing'),
        (105, "Trade, Import and Export"),
        (106, None),
        (107, " "),
        (108, "nan"),
        (109, "[]"),
        (110, "Thing;;Event;"),
        (110, "Thing;;Event;"),
        (111, "['Event', 'Place'"),
    ]
    df = spark.createDataFrame(rows, "id int, packed string").withColumnRenamed("packed", "text")
    got = {}
    for r in unpack(df, ["id"], "text").collect():
        got.setdefault(r.id, []).append((r.pos, r.val))
    vals = {k: [v for _, v in sorted(x)] for k, x in got.items()}
    assert vals[101] == ["Place", "Radio/TV Station"]
    assert vals[102] == ["Radio/TV Station"]
    assert vals[103] == ["Place", "Thing"]
    assert vals[104] == ["Place", "Trade, Import and Export", "Thing"]
    assert vals[105] == ["Trade, Import and Export"]
    assert not {106, 107, 108, 109} & set(vals)
    assert sorted(got[110]) == [(1, "Thing"), (1, "Thing"), (2, "Event"), (2, "Event")]
    assert vals[111] == ["Event", "Place"]


def test_a_list_that_recurs_in_longer_lists_is_split(spark):
    rows = ["Clinic Sample|Letter Trophy", "Clinic Sample|Letter Trophy / Horse Museum", "['Clinic Sample']", "['Letter Trophy']"]
    rows += ["Clinic Sample|Letter Trophy / Horse Museum / Landform; Place", "['Horse Museum', 'Landform']", "['Letter Trophy', 'Horse Museum']"]
    rows += [f"['{a}', '{b}']" for a in ("Place", "Thing") for b in ("Landform", "Horse Museum")]
    found = {r.text: r.vals for r in choose_dialects(spark.createDataFrame([(r,) for r in rows], "text string")).collect()}
    assert found[rows[0]] == ["Clinic Sample", "Letter Trophy"]
    assert found[rows[4]] == ["Clinic Sample", "Letter Trophy", "Horse Museum", "Landform", "Place"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert unpack(df, ["id"], "text").count() == 0
    assert choose_dialects(df).count() == 0
