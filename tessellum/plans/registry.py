"""All registered queries and their SQL, apart from those of the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellum.plans import (
    corpus_io,
    data_problems,
    evaluation_queries,
    functions,
    graph_queries,
    hierarchy_queries,
    model_queries,
    reference,
    relational_queries,
    sampling_queries,
    stream_queries,
    vector_queries,
)

MODULES = [
    data_problems,
    reference,
    relational_queries,
    functions,
    corpus_io,
    graph_queries,
    sampling_queries,
    stream_queries,
    vector_queries,
    evaluation_queries,
    hierarchy_queries,
    model_queries,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    return reference.gen2_overlap_variants(spark, directory)
