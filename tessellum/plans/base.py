"""What modules of registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import vectors as V
from tessellum.sources.tables import table

#: SQL for a text field without a value.
NO_VALUE_SQL = "({0} is null or lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))) in ('', 'nan'))"
#: SQL class of the punctuation that ``functions.text`` removes, and of white space.
PUNCT_SQL = "[!-/:-@\\[-`{-~]"
SPACE_SQL = "[ \\t\\n\\x0b\\f\\r]"
#: Cells of the packed samples, with their place in the column.
CELLS_SQL = """cells as (select col_id, fileName, i - 1 pos, trim(string_split(vals, ', ')[i]) cell
    from (select col_id, fileName, vals, unnest(range(1, len(string_split(vals, ', ')) + 1)) i from column_gt where vals is not null))"""


class Plans:
    """Queries by name, with the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def cells(s: SparkSession, d: str) -> DataFrame:
    """(col_id, fileName, pos, cell) of the packed samples."""
    t = table(s, d, "column_gt").select("col_id", "fileName", F.posexplode(F.split("vals", ", ")).alias("pos", "c"))
    return t.select("col_id", "fileName", "pos", F.trim("c").alias("cell"))


def unit_vectors(s: SparkSession, d: str) -> DataFrame:
    """The vectors with length 1, so that the cosine of a pair is one product."""
    return table(s, d, "embeddings").withColumn("embedding", V.normalized(F.col("embedding")))


def plain_sql(c: str) -> str:
    """SQL of ``functions.text.plain_tokens``."""
    return f"trim(regexp_replace(regexp_replace({c}, '{PUNCT_SQL}|[0-9]', '', 'g'), '{SPACE_SQL}+', ' ', 'g'))"


def number_sql(c: str) -> str:
    """SQL of ``functions.text.is_plain_number``."""
    return f"coalesce(regexp_matches({c}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'), false)"
