"""Windowed counts and results that are computed once, over streams of files.

Both keep their progress in a checkpoint folder, so a stream that breaks off goes on where it
was. Late rows, beyond the watermark, are dropped by the engine; the watermark is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellum.sources import sinks


def read(spark: SparkSession, folder: str, schema: str, files: int | None = None) -> DataFrame:
    """The rows of a folder's Parquet files as a stream, at most ``files`` a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """(start, key, n, total) of tumbling windows, once the watermark has passed them."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width), key)
    counts = rows.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("window.start").alias("start"), key, "n", "total")


def run(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what there is to Parquet at ``path``, then stop."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def resume(stream: DataFrame, path: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Do ``work`` for the rows of each batch whose key has no result at ``path`` yet, and append
    its results: a batch that is repeated after a failure does nothing twice."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = rows.dropDuplicates([key])
        try:
            new = sinks.remaining(new, spark.read.parquet(path), key)
        except Exception as error:  # nothing is there before the first batch
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
                raise
        work(new).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
