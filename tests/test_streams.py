"""Streams that go on: windows come out once, late rows are dropped."""

from pyspark.sql import functions as F

from ledgerloom.streaming.recency import recent_counts, run_to_end, sessions

ROWS = "user_id bigint, at bigint"


def test_late_rows(spark, rows, tmp_path):
    day, folder = 86_400, str(tmp_path / "in")
    arrive = lambda told: spark.createDataFrame(told, ROWS).select("user_id", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    out = {"recent": [], "sessions": []}
    for told in ([(1, 0), (1, 3 * day), (2, 6 * day), (1, 9 * day)], [(1, 5 * day), (2, 8 * day), (3, 30 * day)], [(3, 8 * day), (3, 29 * day), (3, 60 * day)]):
        arrive(told)
        stream = spark.readStream.schema("user_id bigint, ts timestamp").parquet(folder)
        for name, of in (("recent", recent_counts), ("sessions", sessions)):
            run_to_end(of(stream, "user_id", "ts"), str(tmp_path / name), str(tmp_path / f"{name}-marks"))
            got = spark.read.parquet(str(tmp_path / name / "batch=*"))
            out[name].append(rows(got.select("user_id", (F.col("start") / day).cast("int"), "n")))
    assert out["recent"][0] == [(1, 0, 2), (2, 0, 1)]  # the week of day 7 is still open
    assert out["recent"][1] == [(1, 0, 2), (1, 7, 1), (2, 0, 1), (2, 7, 1)]  # day 5 came too late
    assert out["recent"][2] == [*out["recent"][1], (3, 28, 2)]  # day 8 came too late, day 29 did not
    assert out["sessions"][2] == [(1, 0, 1), (1, 3, 1), (1, 9, 1), (2, 6, 1), (3, 30, 1)]
