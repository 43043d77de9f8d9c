"""Sinks, stored artifacts and resuming.

All of them write to folders in storage that the executors share. A table that is replaced is
written beside the old one first, so a job that breaks off leaves the old one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.sources import scratch


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue='""', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Replace the rows of the Parquet table at ``path`` that have the keys of ``rows``, insert
    the others, and give the table as it is then. Of rows with equal keys the last by all
    columns' order stays."""
    spark = rows.sparkSession
    others = [c for c in rows.columns if c not in keys]
    new = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("v")).select(*keys, "v.*")
    manifest = f"{path}/current"
    number = 0
    if scratch.exists(spark, manifest):
        number = spark.read.schema("n long").json(manifest).agg(F.max("n")).first()[0]
        old = spark.read.parquet(f"{path}/v{number}")
        new = new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
    new.write.mode("overwrite").parquet(f"{path}/v{number + 1}")
    spark.createDataFrame([(number + 1,)], "n long").coalesce(1).write.mode("append").json(manifest)
    if number:
        scratch.delete(spark, f"{path}/v{number}")
    return spark.read.parquet(f"{path}/v{number + 1}")


def copy_tables(cells: DataFrame, names: DataFrame, path: str) -> None:
    """Write the cells of the tables in ``names`` (table_name), a folder for each table."""
    kept = cells.join(names.select("table_name").distinct(), "table_name", "left_semi")
    kept.repartition("table_name", F.pmod("row_idx", F.lit(8))).write.mode("overwrite").partitionBy("table_name").parquet(path)


def merge_shards(spark: SparkSession, folder: str, prefix: str, schema: str) -> DataFrame:
    """The records of all JSONL shards whose names begin with ``prefix``."""
    return spark.read.schema(schema).option("pathGlobFilter", f"{prefix}*").option("recursiveFileLookup", "true").json(folder)


def memoized(spark: SparkSession, folder: str, params: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The artifact stored for ``params``, made and stored if there is none yet."""
    key = hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()
    path = f"{folder}/{key}"
    if not scratch.exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the results already there; rows without a key remain."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
