from pyspark.sql import functions as F

from tessellum.llm import garbled as G


def test_every_pair_of_encodings_is_tried():
    for written, read in (("cp1251", "mac_roman"), ("koi8_r", "cp1252"), ("cp1253", "cp1252"), ("shift_jis", "cp437")):
        text = {"cp1253": "Ήσυχος", "shift_jis": "市場"}.get(written, "Вечерний")
        back = {b: c for c, b in G._TABLES[read].items() if b is not None}
        spoilt = "".join(back[b] for b in text.encode(written))
        assert f"{written} read as {read}" in {c for t, c in G.candidates(spoilt).items() if t == text}
        twice = "".join({b: c for c, b in G._TABLES["cp1252"].items() if b is not None}[b] for b in spoilt.encode())
        assert text in G.candidates(twice)


def test_a_frequent_correct_word_that_reads_as_utf8_is_kept(spark):
    assert G.candidates("Đông")["ѓng"] == "utf-8 read as cp852"
    words = ["Zürich", "Köln", "Größe", "München", "Straße", "Fähre", "Brücke", "Übung", "Möwe", "Käse"]
    rows = [(i, f"{words[i % 10]} Haus, Đông") for i in range(300)]
    rows += [(1000 + i, w.encode().decode("cp1252")) for i, w in enumerate(["Zürich", "Köln", "München", "Fähre", "Möwe"])]
    fields = G.long_fields(spark.createDataFrame(rows, "id long, text string"), "id", ["text"])
    found = G.judge(fields)
    assert {r.record for r in G.affected(fields, found).collect()} == {1000, 1001, 1002, 1003, 1004}


def test_nothing_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "plain"), (4, "Köln " * 20_000), (4, "Köln"), (5, "K�ln")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, token string")
    fields = G.long_fields(df, "id", ["text"])
    assert {r.record for r in G.affected(fields, G.judge(fields)).collect()} == {5}
    none = G.long_fields(df.where("id < 0"), "id", ["text"])
    assert G.affected(none, G.judge(none)).count() == 0


def test_margins_and_floor_come_from_all_clean_tokens(spark, monkeypatch):
    seen, validate = {}, G.validate

    def noted(measured):
        seen.update({r.what: r.n for r in measured.groupBy("what").agg(F.count("*").alias("n")).collect()})
        seen["floor value"] = validate(measured)[1]
        letters = sorted(r.likely for r in measured.where("what = 'floor'").collect())
        assert seen["floor value"] == letters[len(letters) // 200]
        return validate(measured)

    monkeypatch.setattr(G, "validate", noted)
    rows = [(i, f"Größe{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}ß") for i in range(1500)]
    fields = G.long_fields(spark.createDataFrame(rows, "id long, text string"), "id", ["text"])
    assert G.judge(fields).count() == 0
    assert seen["floor"] == seen["spoilt+"] == 1500
