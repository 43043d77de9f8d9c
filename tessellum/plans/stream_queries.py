"""Queries of streams: tables are fed as files, and the results read when the stream is through."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.plans.base import Plans
from tessellum.sources.scratch import new_path
from tessellum.sources.tables import table
from tessellum.streaming import events as S

PLANS = Plans()
QUERIES, SQL, query = PLANS.queries, PLANS.sql, PLANS.query


@query("""select date_trunc('hour', ts) start, event_type, count(*) n, round(sum(value), 4) total from events
    group by 1, 2 having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events)""")
def stream_windowed_counts(s, d):
    """Counts by hour; the last hour is open until later rows come."""
    folder, out = new_path(s, "stream"), new_path(s, "stream-out")
    e = table(s, d, "events").select("ts", "event_type", "value")
    e.repartition(4).write.parquet(folder)
    counts = S.windowed_counts(S.read(s, folder, "ts timestamp, event_type string, value double"), "ts", "event_type", "value", "1 hour", "0 seconds")
    S.run(counts, out, new_path(s, "stream-state")).awaitTermination()
    return s.read.schema("start timestamp, event_type string, n long, total double").parquet(out).withColumn("total", F.round("total", 4))


@query("select distinct p_type k, length(p_type) size from part")
def stream_resume(s, d):
    """Results are computed once for each key, though rows come in several batches."""
    folder, out = new_path(s, "stream"), new_path(s, "stream-out")
    table(s, d, "part").select(F.col("p_type").alias("k")).repartition(3).write.parquet(folder)
    work = lambda rows: rows.select("k", F.length("k").cast("long").alias("size"))
    S.resume(S.read(s, folder, "k string", 1), out, new_path(s, "stream-state"), "k", work).awaitTermination()
    return s.read.schema("k string, size long").parquet(out)
