"""Table access by directory and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a text field that stand for a missing value.
NO_VALUE = ("", "nan")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory`` (a file or a folder of files)."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def squeeze(col: Column | str) -> Column:
    """Outer white space removed, inner runs of it as one space."""
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def has_value(col: Column | str) -> Column:
    """True where a text field holds a value: not null, not blank, not ``nan``."""
    return F.coalesce(~F.lower(squeeze(col)).isin(*NO_VALUE), F.lit(False))
