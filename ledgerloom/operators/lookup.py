"""Joining a large table to a lookup table without trusting the lookup to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a lookup table of a few short columns is broadcast.
BROADCAST_ROWS = 200_000


def is_bounded(df: DataFrame, rows: int | None = None) -> bool:
    """Whether ``df`` has at most ``rows`` rows (BROADCAST_ROWS if not said); reads no more than it needs to know."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffling, whatever Spark takes its size to be.

    Spark goes by the size of the files below, of which ids that count up need next to nothing, and does not see
    what an ``explode`` makes of them; it would send millions of rows through the driver as a small table.
    """
    return df.hint("merge")


def measured(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` for a join: broadcast if it has at most ``rows`` rows (BROADCAST_ROWS if not said), else shuffled."""
    return F.broadcast(df) if is_bounded(df, rows) else shuffled(df)


def lookup_join(big: DataFrame, small: DataFrame, key: str, salt_by: str | Column, salts: int = 16, max_rows: int | None = None) -> DataFrame:
    """Left join of ``big`` to ``small`` (``key`` unique in it).

    The size of ``small`` is measured: up to ``max_rows`` rows it is broadcast,
    beyond that both sides are shuffled, with the rows of every key spread over
    ``salts`` tasks and NULL keys kept out of the hashing, so that a hot key or
    many missing ones do not end in one task. NULL keys find nothing.
    """
    if is_bounded(small, max_rows):
        return big.join(F.broadcast(small), key, "left")
    salt = F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")
    spread = big.withColumn("_salt", F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(salt_by), F.lit(1 << 20)).cast("int")).otherwise(salt))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(shuffled(copies), [key, "_salt"], "left").drop("_salt")
