"""Positions and counts along a key's order, safe for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import split_running


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the running total of ``value`` up to each row; ``order`` must be total within a key.

    Keys may be of any size, also all rows in one: ``split_running`` cuts them over many tasks.
    """
    return split_running(df, keys, order, sums={name: F.col(value)})


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """``df`` with each row's position (from 1) in its key's order."""
    return running_sum(df.withColumn("__ll_one", F.lit(1).cast("bigint")), keys, order, "__ll_one", name).drop("__ll_one")


def counts_before(points: DataFrame, events: DataFrame, key: str, time: str, name: str) -> DataFrame:
    """``points`` with the number of ``events`` of their key strictly before their time.

    Both have the columns ``key`` and ``time``; points with a NULL key or time
    get 0. Events are counted per (key, time) first, then points and events share
    one timeline, whose running total is taken once: no event is ever paired with
    a point.
    """
    columns = points.columns
    told = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.count(F.lit(1)).alias("__ll_n"))
    asked = points.select(F.col(key), F.col(time), F.struct(*columns).alias("__ll_row"), F.lit(0).alias("__ll_kind"), F.lit(0).cast("bigint").alias("__ll_n"), F.xxhash64(*columns).alias("__ll_tie"))
    kept = told.select(key, time, F.lit(None).cast(asked.schema["__ll_row"].dataType).alias("__ll_row"), F.lit(1).alias("__ll_kind"), "__ll_n", F.lit(0).cast("bigint").alias("__ll_tie"))
    line = running_sum(asked.unionByName(kept), [key], [time, "__ll_kind", "__ll_tie"], "__ll_n", "__ll_before")
    known = F.when(F.col(key).isNotNull() & F.col(time).isNotNull(), F.col("__ll_before")).otherwise(0)
    return line.where("__ll_kind = 0").select("__ll_row.*", known.cast("bigint").alias(name))
