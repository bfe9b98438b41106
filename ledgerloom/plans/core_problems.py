"""Queries of problems 1, 4 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.asof import Attribute, attributes_as_of
from ledgerloom.operators.instants import normalise_instants
from ledgerloom.operators.lookup import lookup_join
from ledgerloom.operators.skew import State, split_aggregate
from ledgerloom.sources.durable import durable
from ledgerloom.sources.tables import clean_id, table

FIELDS = {"user_reviews_before_task": ("user", "user_id"), "item_reviews_before_task": ("item", "target_item_id")}


def _known(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "task_profile").select(
        F.col("index").cast("bigint").alias("task_index"), "task_time", clean_id("user_id").alias("user_id"), clean_id("target_item_id").alias("target_item_id"),
        *(F.col(f).cast("bigint").alias(f"recorded_{f}") for f in FIELDS),
    )
    counts = table(spark, d, "count_history")
    return attributes_as_of(
        tasks, "task_time",
        [
            Attribute(field, entity, counts.where(F.col("entity_kind") == kind).select(
                clean_id("entity_id").alias("entity_id"), F.col("counted_at").alias("valid_from"), F.col("recorded_at").alias("known_from"),
                F.col("version_id").alias("version"), F.col("reviews_so_far").alias("value"),
            ), F.lit(0).cast("bigint"))
            for field, (kind, entity) in FIELDS.items()
        ],
    )


def p1_known_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every task with its user's and target's count as known at task time."""
    return _known(spark, d).where("task_time IS NOT NULL").select("task_index", *(F.col(f).alias(f"known_{f}") for f in FIELDS), *(f"recorded_{f}" for f in FIELDS))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Recorded counts that are not what was known at task time."""
    known = _known(spark, d).where("task_time IS NOT NULL")
    wrong = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"recorded_{f}")), F.lit(f)) for f in FIELDS)), lambda x: x.isNotNull())
    return known.select("task_index", F.explode(wrong).alias("field")).distinct()


_KNOWN_SQL = """
known AS (
  SELECT t."index"::BIGINT task_index, f.field, f.recorded,
    coalesce((arg_max(h.reviews_so_far, (h.counted_at, h.recorded_at, h.version_id))), 0) AS known
  FROM (SELECT DISTINCT "index", task_time, user_id, target_item_id, user_reviews_before_task, item_reviews_before_task FROM task_profile WHERE task_time IS NOT NULL) t
  CROSS JOIN LATERAL (VALUES ('user_reviews_before_task', 'user', trim(t.user_id), t.user_reviews_before_task), ('item_reviews_before_task', 'item', trim(t.target_item_id), t.item_reviews_before_task)) f(field, kind, entity, recorded)
  LEFT JOIN (SELECT * FROM count_history WHERE reviews_so_far IS NOT NULL) h
    ON h.entity_kind = f.kind AND trim(h.entity_id) = f.entity AND epoch_us(h.counted_at) < t.task_time * 1e6 AND epoch_us(h.recorded_at) < t.task_time * 1e6
  GROUP BY ALL)
"""


def _keyed(df: DataFrame, field: str, key: F.Column, order: str, permille: int) -> DataFrame:
    """Keys with at least so many thousandths of all rows of ``df``; NULL is no key but its rows count."""
    per_key = split_aggregate(df.select(key.alias("key_value"), F.col(order).alias("_order")), ["key_value"], ["_order"], [State("rows", "count"), State("first_at", "min", F.col("_order")), State("last_at", "max", F.col("_order"))])
    per_key = durable(per_key, "keys")  # one row a key
    total = per_key.agg(F.sum("rows").alias("total"))
    shares = per_key.crossJoin(F.broadcast(total))  # one row
    return shares.where(F.col("key_value").isNotNull() & (F.col("rows") * 1000 >= F.col("total") * permille)).select(F.lit(field).alias("key_field"), "key_value", "rows", "first_at", "last_at")


def _heavy(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "review").select("user_id", "seq")
    counts = table(spark, d, "calibration_candidate").select("user_reviews_before_task", "candidate_id")
    known = F.when(F.col("user_reviews_before_task") >= 0, F.col("user_reviews_before_task").cast("string"))
    return _keyed(users, "review.user_id", clean_id("user_id"), "seq", 10).unionByName(_keyed(counts, "calibration_candidate.user_reviews_before_task", known, "candidate_id", 20))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys that hold a great share of the rows."""
    return _heavy(spark, d).select("key_field", "key_value")


def p4_heavy_keys(spark: SparkSession, d: str) -> DataFrame:
    """The same with their rows and the ends of their order."""
    return _heavy(spark, d).select("key_field", "key_value", "rows", "first_at", "last_at")


_HEAVY_SQL = """
WITH k AS (
  SELECT 'review.user_id' key_field, CASE WHEN trim(user_id) NOT IN ('', 'None', 'nan') THEN trim(user_id) END key_value, seq AS o, 10 permille FROM review
  UNION ALL SELECT 'calibration_candidate.user_reviews_before_task', CASE WHEN user_reviews_before_task >= 0 THEN user_reviews_before_task::VARCHAR END, candidate_id, 20 FROM calibration_candidate),
c AS (SELECT key_field, key_value, permille, count(*)::BIGINT AS "rows", min(o) first_at, max(o) last_at, sum(count(*)) OVER (PARTITION BY key_field) total FROM k GROUP BY 1, 2, 3)
"""

QUERIES = {"p1_found": p1_found, "p1_known_counts": p1_known_counts, "p4_found": p4_found, "p4_heavy_keys": p4_heavy_keys}
SQL = {
    "p1_found": f"WITH {_KNOWN_SQL} SELECT DISTINCT task_index, field FROM known WHERE recorded IS DISTINCT FROM known",
    "p1_known_counts": f"""WITH {_KNOWN_SQL} SELECT task_index, max(known) FILTER (field LIKE 'user%')::BIGINT known_user_reviews_before_task, max(known) FILTER (field LIKE 'item%')::BIGINT known_item_reviews_before_task,
      max(recorded) FILTER (field LIKE 'user%')::BIGINT recorded_user_reviews_before_task, max(recorded) FILTER (field LIKE 'item%')::BIGINT recorded_item_reviews_before_task FROM known GROUP BY 1""",
    "p4_found": _HEAVY_SQL + "SELECT key_field, key_value FROM c WHERE key_value IS NOT NULL AND \"rows\" * 1000 >= total * permille",
    "p4_heavy_keys": _HEAVY_SQL + "SELECT key_field, key_value, \"rows\", first_at, last_at FROM c WHERE key_value IS NOT NULL AND \"rows\" * 1000 >= total * permille",
}


TIME_FIELDS = ("timestamp", "date", "date_updated", "date_added", "read_at", "started_at")


def _instants(spark: SparkSession, d: str) -> DataFrame:
    """The review log with its instants; a yelp row's wall times are in the zone of its item's city."""
    zones = table(spark, d, "city_zone").select(F.btrim("city").alias("city"), "time_zone")
    items = table(spark, d, "item").select(clean_id("item_id").alias("_item"), F.btrim("city").alias("city"))
    # An item listed twice has the first of its zones by name.
    place = items.join(F.broadcast(zones), "city").where("_item IS NOT NULL").groupBy("_item").agg(F.min("time_zone").alias("time_zone"))
    log = table(spark, d, "review").select("seq", "source", *TIME_FIELDS, F.when(F.col("source") == "yelp", clean_id("item_id")).alias("_item"))
    return normalise_instants(lookup_join(log, place, "_item", "seq"), TIME_FIELDS, F.col("time_zone"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The instant of every review with a usable time."""
    return _instants(spark, d).where("epoch_second IS NOT NULL").select(F.col("seq").cast("bigint").alias("seq"), "epoch_second")


def p6_notes(spark: SparkSession, d: str) -> DataFrame:
    """How many times of each source and field were read, ambiguous, nonexistent or missing."""
    return _instants(spark, d).groupBy("source", "time_field", "time_note").agg(F.count(F.lit(1)).alias("rows"), F.min("epoch_second").alias("first"), F.max("epoch_second").alias("last"))


QUERIES |= {"p6_found": p6_found, "p6_notes": p6_notes}
