"""Session construction for tests, benches and stand-alone use."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, app: str = "tessellum", **conf: str) -> SparkSession:
    """A local session with the settings every query of this library assumes."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus if str(cpus).isdigit() else 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tasks(spark: SparkSession) -> int:
    """Tasks for a stage of costly Python work: the session's shuffle partitions, at least
    three for each core. A number given to ``repartition`` keeps adaptive execution from
    merging a small input into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to more tasks if its files make fewer than there are cores: for costly
    expressions over small files. Larger inputs stay as they are and are not shuffled."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks(df.sparkSession)) if few else df
