"""From tasks and evidence to rankings, and what is kept of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.lookup import lookup_join
from ledgerloom.sources.durable import path_exists


def artifact_name(agent: str, dataset: Column, track: int, condition: str, kind: str = "") -> Column:
    """File name of a run's metrics, or with ``kind`` of what belongs to it."""
    return F.concat(F.lit(f"{agent}_"), dataset, F.lit(f"_track{track}_{condition}{'_' + kind if kind else ''}.json"))


def blocked_pairs(tasks: DataFrame) -> DataFrame:
    """(user_id, item_id) that no history may show: targets of simulations, and of recommendations that offer them."""
    shown = (F.col("task_type") == "user_behavior_simulation") | F.array_contains("candidates", F.col("target"))
    return tasks.where(shown & F.col("user_id").isNotNull() & F.col("target").isNotNull()).select("user_id", F.col("target").alias("item_id")).distinct()


def indexed_log(log: DataFrame, blocked: DataFrame, path: str, parts: int = 16) -> DataFrame:
    """``log`` without blocked pairs, written once below ``path`` by a hash of the user; a later call reads what is there.

    A file task holds a stretch of (part, user, seq), so that a busy user is written by several.
    """
    spark = log.sparkSession
    if not path_exists(spark, f"{path}/_SUCCESS"):
        kept = log.join(blocked, ["user_id", "item_id"], "left_anti").withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int"))
        kept.repartitionByRange("part", "user_id", "seq").sortWithinPartitions("part", "user_id", "seq").write.partitionBy("part").mode("overwrite").parquet(path)
    schema = T.StructType([*log.schema.fields, T.StructField("part", T.IntegerType())])
    return spark.read.schema(schema).parquet(path).drop("part")


def chosen_tasks(tasks: DataFrame, number: str, numbers: Sequence[int]) -> DataFrame:
    """The tasks with these numbers; ValueError names those that don't exist. ``numbers`` is a parameter."""
    asked = tasks.sparkSession.createDataFrame([(int(n),) for n in dict.fromkeys(numbers)], f"{number} bigint")
    missing = sorted(r[0] for r in asked.join(tasks.select(F.col(number).cast("bigint")), number, "left_anti").collect())
    if missing:
        raise ValueError(f"no tasks {missing}")
    return tasks.join(F.broadcast(asked), number, "left_semi")


def first_source(candidates: DataFrame, items: DataFrame, default: str) -> DataFrame:
    """(index, source): the source of each task's first candidate that the catalogue knows one of, else ``default``."""
    known = items.where("item_id IS NOT NULL AND source IS NOT NULL").groupBy("item_id").agg(F.min("source").alias("source"))
    met = lookup_join(candidates.select("index", "pos", "item_id"), known, "item_id", F.struct("index", "pos"))
    return met.groupBy("index").agg(F.coalesce(F.min_by("source", F.when(F.col("source").isNotNull(), F.col("pos"))), F.lit(default)).alias("source"))


def final_ranking(parsed: Column, candidates: Column, code_order: Column, with_codes: Column, merge: bool = True, least: int = 3) -> Column:
    """What a ranker answers: the ids read from its text, completed by the code order where codes were shown, else
    by the candidates' own; a text that names fewer than ``least`` is passed over."""
    use = with_codes & F.lit(merge) & (F.size(code_order) > 0)
    order = F.when(use, code_order).otherwise(candidates)
    answer = F.when(F.size(parsed) >= least, F.concat(parsed, order)).otherwise(F.concat(order, candidates))
    return F.array_distinct(F.filter(answer, lambda x: F.array_contains(candidates, x)))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is not 0; zeros if there are none."""
    weighed = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(F.slice(weighed, 2, F.greatest(F.size(weighed) - 1, F.lit(0))), F.get(weighed, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1.0))
    return F.transform(total, lambda x: x / n)
