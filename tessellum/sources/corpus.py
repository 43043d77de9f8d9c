"""Readers of a corpus of tables and of the files around it.

A corpus is a folder of CSV files with a header each and no common schema. It becomes cells
(table_name, col_idx, col_name, row_idx, value), all strings. Files up to ``whole`` bytes are
parsed whole, many to a task, since a web table is small; each larger file is read by Spark's
own reader, which splits it. UTF-8 is tried first, then Latin-1.

Defined results: a file without rows gives no cells, one without any byte is no table; an empty cell and one that its row lacks
are null; cells beyond the header get no name and are left out; equal header names stay apart
by ``col_idx``.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessellum.functions import text as T
from tessellum.session import tasks
from tessellum.sources.tables import has_value

CELLS = "table_name string, col_idx int, col_name string, row_idx long, value string"
WHOLE_BYTES = 64_000_000


def _name(path: str) -> str:
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return base[:-4] if base.lower().endswith(".csv") else base


def _decode(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            reader = csv.reader(io.StringIO(_decode(content), newline=""))
            header = next(reader, [])
            rows = []
            for n, row in enumerate(r for r in reader if r):
                for k, name in enumerate(header):
                    rows.append((_name(path), k, name, n, (row[k] if k < len(row) else None) or None))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["table_name", "col_idx", "col_name", "row_idx", "value"])
                    rows = []
            yield pd.DataFrame(rows, columns=["table_name", "col_idx", "col_name", "row_idx", "value"])


def _large(spark: SparkSession, path: str) -> DataFrame:
    """Cells of one file, split; rows are numbered by the sizes of the parts before them."""
    rows = spark.read.csv(path, header=True, multiLine=False, escape='"')
    names = rows.columns
    at = F.monotonically_increasing_id()
    rows = rows.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("id", at).withColumn("part", F.shiftright("id", 33))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row for each part of the file
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    cells = F.array(*[F.struct(F.lit(k).alias("col_idx"), F.lit(n).alias("col_name"), F.col(f"c{k}").alias("value")) for k, n in enumerate(names)])
    row = (F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("row_idx")
    return rows.join(F.broadcast(starts), "part").select(row, F.inline(cells)).select(
        F.lit(_name(path)).alias("table_name"), "col_idx", "col_name", "row_idx", "value"
    )


def scan(spark: SparkSession, folder: str, nested: bool = False, whole: int = WHOLE_BYTES) -> DataFrame:
    """The cells of all ``*.csv`` files of a folder, also of folders below it if ``nested``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", str(nested).lower()).load(folder)
    small = files.where(F.col("length") <= whole).select("path", "content").repartition(tasks(spark), "path")
    parts = [small.mapInPandas(_parse, CELLS)]
    parts += [_large(spark, r.path) for r in files.where(F.col("length") > whole).select("path").collect()]
    return reduce(DataFrame.unionByName, parts)


def table_names(spark: SparkSession, folder: str, suffix: bool = False) -> DataFrame:
    """(table_name) of the CSV files of a folder, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select(F.substring_index("path", "/", -1).alias("table_name"))
    return (files if suffix else files.select(F.regexp_replace("table_name", r"(?i)\.csv$", "").alias("table_name"))).orderBy("table_name")


def columns(cells: DataFrame) -> DataFrame:
    """(column, row_idx, value): the cells addressed by ``table.column``."""
    return cells.select(F.concat_ws(".", "table_name", "col_name").alias("column"), "row_idx", "value")


def labelled_sample(cells: DataFrame, types: DataFrame, rows: int, sep: str = " | ") -> DataFrame:
    """(table_name, class, text): the first rows of each table that has a class, a line each."""
    near = cells.where(F.col("row_idx") < rows).join(types, "table_name")
    lines = near.groupBy("table_name", "class", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", F.coalesce("value", F.lit("")).alias("v")))).alias("cs"))
    lines = lines.withColumn("line", F.array_join("cs.v", sep))
    texts = lines.groupBy("table_name", "class").agg(F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("ls"))
    return texts.select("table_name", "class", F.array_join("ls.line", "\n").alias("text"))


def read_table_types(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, class, superclass array) of a CSV with these three columns."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    rows = raw.select(F.col("fileName").alias("file_name"), "class", T.parse_list(F.col("superclass")).alias("superclass"))
    return rows.where("file_name is not null and class is not null")


def read_attributes(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(file_name, col_name, label) of a CSV of columns, without blank labels."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True, encoding=encoding)
    rows = raw.select(F.col("fileName").alias("file_name"), F.col("colName").alias("col_name"), F.trim("ColumnLabel").alias("label"))
    return rows.where(has_value("label"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) of a hierarchy: CSV with these columns, Parquet, or GraphML. Pickled
    graphs are refused, since reading one runs code."""
    low = path.lower().rstrip("/")
    if low.endswith((".pkl", ".pickle")):
        raise ValueError("pickled graphs are not read")
    if low.endswith(".graphml"):
        edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path)
        return edges.select(F.col("_source").alias("parent"), F.col("_target").alias("child"))
    raw = spark.read.csv(path, header=True, escape='"') if low.endswith(".csv") else spark.read.parquet(path)
    return raw.select("parent", "child").where("parent is not null and child is not null").distinct()


def read_relationships(spark: SparkSession, path: str) -> DataFrame:
    """(type1, subject_attr, type2, attr) of a CSV, by position."""
    raw = spark.read.csv(path, header=True, escape='"')
    return raw.toDF(*[f"c{k}" for k in range(len(raw.columns))]).selectExpr("c0 type1", "c1 subject_attr", "c2 type2", "c3 attr")


def read_results(spark: SparkSession, path: str | list[str], schema: str, most: int | None = None) -> DataFrame:
    """Records of JSONL files; with ``most``, the first of them in the order of the files."""
    rows = spark.read.schema(schema).json(path)
    return rows if most is None else rows.limit(most)


def read_rrf(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A file of fields that each end with a bar: the empty field behind the last one goes."""
    raw = spark.read.csv(path, sep="|", quote="", header=False)
    return raw.select(*[F.col(raw.columns[k]).alias(n) for k, n in enumerate(names)])


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, col_idx, embedding in double precision) of a Parquet table of vectors."""
    raw = spark.read.parquet(path)
    return raw.select("table_name", "col_idx", F.col("embedding").cast("array<double>").alias("embedding"))
