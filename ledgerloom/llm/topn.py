"""The N best items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.aggregates import bounded_heap


def top_n_per_group(scores: DataFrame, group: str, item: str, score: str, n: int, version: str | None = None) -> DataFrame:
    """(group, rank, item, score): the ``n`` best items of each group, all if fewer.

    Higher score first, then the item's id in ascending byte order; scores compare
    exactly. NULL and NaN are no scores and a NULL item is none; a NULL group is
    a group. An item scored again has the score of its highest ``version`` that
    gives one (the highest score there, if that version gives several), without
    ``version`` its highest score. A group without scores has no rows.

    Two aggregations, both combined before their shuffle: one per (group, item)
    settles repeated scores, so that a large group is spread by its items; the
    other keeps a heap of ``n`` entries per group and task and merges the heaps.
    """
    rows = scores.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"), (F.col(version) if version else F.lit(0)).alias("v"))
    rows = rows.where("i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    settled = rows.groupBy("g", "i").agg(F.max(F.struct("v", "s"))["s"].alias("s"))
    best = settled.groupBy("g").agg(bounded_heap(F.struct((-F.col("s")).alias("below"), F.col("i")), n).alias("best"))
    ranked = best.select("g", F.posexplode("best").alias("pos", "entry"))
    return ranked.select(F.col("g").alias(group), (F.col("pos") + 1).alias("rank"), F.col("entry.i").alias(item), (-F.col("entry.below")).alias(score))
