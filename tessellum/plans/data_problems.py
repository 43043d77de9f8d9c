"""Queries of the general data problems: packed fields and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import forest
from tessellum.operators.packed import unpack
from tessellum.plans.corpus_links import corpus_links
from tessellum.sources.scratch import cut
from tessellum.sources.tables import table


def packed_fields(spark: SparkSession, directory: str) -> DataFrame:
    """(src, row_id, text) of the packed fields of both ground-truth tables."""
    types = table(spark, directory, "table_gt").select(
        F.lit("table_gt").alias("src"), F.col("gt_id").alias("row_id"), F.col("superclass").alias("packed")
    )
    columns = table(spark, directory, "column_gt").select(
        F.lit("column_gt").alias("src"), F.col("col_id").alias("row_id"), F.col("TopClass").alias("packed")
    )
    return types.unionByName(columns)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return unpack(packed_fields(spark, directory), ["src", "row_id"], "packed", least=2)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return forest.depths(cut(corpus_links(spark, directory), "links"))


def p3_paths(spark: SparkSession, directory: str) -> DataFrame:
    tours = cut(forest.intervals(cut(corpus_links(spark, directory), "links")), "tours")
    return forest.paths(tours)


def p3_descendants(spark: SparkSession, directory: str) -> DataFrame:
    tours = cut(forest.intervals(cut(corpus_links(spark, directory), "links")), "tours")
    return forest.ancestry(tours).select("src", "ancestor", F.col("node").alias("descendant"))


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
}
SQL: dict[str, str] = {}
