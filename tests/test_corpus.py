import pytest
from pyspark.sql import functions as F

from tessellum.sources import corpus, sinks
from tessellum.streaming import events as stream


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        (folder / f"{name}.csv").write_bytes(content)
    return str(folder)


def test_scan_keeps_every_cell(spark, tmp_path):
    long = "x" * 100_000
    folder = write(
        tmp_path / "c",
        a=b'id,name,name\n1,"x, ""y""",z\n2,"two\nlines",\n',
        latin="größe\nStraße\n".encode("latin-1"),
        empty=b"",
        header=b"a,b\n",
        ragged=f"a,b\n1\n1,2,3\n{long},\n".encode(),
        bom="﻿k\nv\n".encode(),
    )
    (tmp_path / "c" / "notes.txt").write_text("no table")
    write(tmp_path / "c" / "deep", inner=b"q\n7\n")
    rows = corpus.scan(spark, folder).collect()
    got = {(r.table_name, r.col_idx, r.row_idx): (r.col_name, r.value) for r in rows}
    assert len(rows) == len(got)
    assert got["a", 1, 0] == ("name", 'x, "y"') and got["a", 2, 0] == ("name", "z") and got["a", 1, 1] == ("name", "two\nlines") and got["a", 2, 1] == ("name", None)
    assert got["latin", 0, 0] == ("größe", "Straße") and got["bom", 0, 0] == ("k", "v")
    assert got["ragged", 1, 0] == ("b", None) and got["ragged", 1, 1] == ("b", "2") and got["ragged", 0, 2] == ("a", long)
    assert not {k for k in got if k[0] in ("empty", "header", "inner")}
    assert {r.table_name for r in corpus.scan(spark, folder, nested=True).collect()} >= {"inner", "a"}
    assert [r.table_name for r in corpus.table_names(spark, folder).collect()] == ["a", "bom", "header", "latin", "ragged"]


def test_large_files_are_split_with_rows_in_order(spark, tmp_path):
    lines = "".join(f"{i},v{i}\n" for i in range(40_000))
    folder = write(tmp_path / "big", t=("id,v\n" + lines).encode(), s=b"id\n5\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        cells = corpus.scan(spark, folder, whole=1000)
        t = cells.where("table_name = 't'").cache()
        assert t.count() == 80_000 and t.where("col_name = 'id' and cast(value as long) <> row_idx").count() == 0
        assert cells.where("table_name = 's'").collect()[0].value == "5"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_edges_of_graphml_and_pickle(spark, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text('<graphml><graph edgedefault="directed"><node id="a"/><node id="b"/><edge source="a" target="b"/><edge source="a" target="c"/></graph></graphml>')
    assert {tuple(r) for r in corpus.read_edges(spark, str(path)).collect()} == {("a", "b"), ("a", "c")}
    with pytest.raises(ValueError):
        corpus.read_edges(spark, "graph.pkl")


def test_upsert_replaces_and_inserts(spark, tmp_path):
    path = str(tmp_path / "scores")
    schema = "k string, m string, v double"
    sinks.upsert(spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], schema), path, ["k", "m"])
    sinks.upsert(spark.createDataFrame([("b", "x", 3.0), ("b", "y", 4.0), ("c", "x", 5.0), ("c", "x", 6.0)], schema), path, ["k", "m"])
    got = sinks.upsert(spark.createDataFrame([], schema), path, ["k", "m"])
    assert {tuple(r) for r in got.collect()} == {("a", "x", 1.0), ("b", "x", 3.0), ("b", "y", 4.0), ("c", "x", 6.0)}


def test_memo_and_resume(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for params in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.memoized(spark, str(tmp_path), params, make).count() == 3
    assert len(calls) == 2
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    done = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert sorted(str(r.k) for r in sinks.remaining(rows, done, "k").collect()) == ["None", "b"]


def test_stream_goes_on_where_it_was(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("a",), ("b",), ("a",)], "k string").write.parquet(folder)
    work = lambda rows: rows.select("k", F.lit(1).alias("n"))
    stream.resume(stream.read(spark, folder, "k string"), out, state, "k", work).awaitTermination()
    spark.createDataFrame([("b",), ("c",)], "k string").write.mode("append").parquet(folder)
    stream.resume(stream.read(spark, folder, "k string"), out, state, "k", work).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
