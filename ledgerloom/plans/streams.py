"""Queries run as streams to their end, then read as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.ingest import _register
from ledgerloom.sources.durable import scratch_path
from ledgerloom.streaming.recency import recent_counts, run_to_end, sessions

QUERIES, SQL, query = _register()


def _finished(spark, d, transform):
    """What ``transform`` of the stream of events has put out when all that is there has been read."""
    path, out = f"{d}/events.parquet", scratch_path(spark, "stream")
    schema = spark.read.parquet(path).schema
    result = transform(spark.readStream.schema(schema).parquet(f"{d}/events.parqu*").withColumn("ts", F.col("ts").cast("timestamp")))
    run_to_end(result, out, scratch_path(spark, "marks"))
    return spark.read.schema(result.schema).parquet(f"{out}/batch=*")


@query("SELECT user_id, (epoch(ts)::BIGINT // 604800) * 604800 AS start, count(*)::BIGINT n FROM events GROUP BY 1, 2 HAVING start + 604800 <= (SELECT epoch(max(ts)) - 86400 FROM events)")
def stream_recent_counts(spark, d):
    """Weeks that the newest event is a day past."""
    return _finished(spark, d, lambda s: recent_counts(s, "user_id", "ts"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*)::BIGINT n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, d):
    """Sessions that ended an hour before the newest event."""
    return _finished(spark, d, lambda s: sessions(s, "user_id", "ts"))
