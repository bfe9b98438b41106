"""Structured Streaming twins of batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent_counts(events: DataFrame, key: str, time: str, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Events per key and window of event time.

    On a stream in append mode a window comes out, and its state goes, once the newest
    event is ``late`` past its end; rows for windows that are out are dropped. On a table
    nothing is late and every window comes out.
    """
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.unix_seconds("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per key: runs of events with gaps under ``gap``; as above with a session's end for a window's."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.unix_seconds("w.start").alias("start"), "n")


def run_to_end(stream: DataFrame, out: str, marks: str) -> None:
    """Append what a stream has to give for all that is there to ``out``, a folder for each batch.

    ``marks`` keeps how far it got; a batch that is repeated after a failure replaces its own folder.
    """
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    stream.writeStream.outputMode("append").option("checkpointLocation", marks).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
