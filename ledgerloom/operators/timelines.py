"""Per-user timelines: first occurrences, splits, windows of history, task profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.aggregates import bounded_heap
from ledgerloom.operators.lookup import lookup_join
from ledgerloom.operators.numbering import counts_before, numbered

DAY = 86_400


def first_occurrences(log: DataFrame, user: str = "user_id", item: str = "item_id", ts: str = "ts") -> DataFrame:
    """(user, item, ts, pos): each user's distinct items in the order of first sight; ties go by item."""
    first = log.groupBy(user, item).agg(F.min(ts).alias(ts))
    return numbered(first, [user], [ts, item])


def with_length(sequence: DataFrame, user: str = "user_id") -> DataFrame:
    """A sequence with its length in ``n``; rows without a user are left out."""
    return lookup_join(sequence.where(F.col(user).isNotNull()), sequence.groupBy(user).agg(F.max("pos").alias("n")), user, "pos")


def leave_one_out(sequence: DataFrame, user: str = "user_id") -> DataFrame:
    """``split``: the last item tests, the one before validates, the rest trains; short sequences (under 3) all train."""
    left = F.col("n") - F.col("pos")
    split = F.when(F.col("n") < 3, "train").when(left == 0, "test").when(left == 1, "valid").otherwise("train")
    return with_length(sequence, user).withColumn("split", split)


def last_items(sequence: DataFrame, n: int, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(user, items): the last ``n`` items in order, from a heap of ``n`` per user and task."""
    heap = bounded_heap(F.struct((-F.col("pos")).alias("back"), F.col(item).alias("item")), n)
    return sequence.groupBy(user).agg(F.reverse(F.transform(heap, lambda x: x["item"])).alias("items"))


def padded(items: Column, n: int, pad: int = 0) -> Column:
    """An array brought to length ``n`` from the left; longer ones must have been cut before."""
    return F.concat(F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(n) - F.size(items), F.lit(0))), items)


def pair_times(log: DataFrame) -> DataFrame:
    """The last time of each (user, item)."""
    return log.groupBy("user_id", "item_id").agg(F.max("ts").alias("ts"))


def task_times(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """``tasks`` (user_id, target) with task_time: the pair's last time, else the user's, else NULL."""
    pairs = pair_times(log).withColumnsRenamed({"item_id": "target", "ts": "pair_time"})
    users = log.groupBy("user_id").agg(F.max("ts").alias("user_time"))
    known = tasks.join(pairs, ["user_id", "target"], "left").join(users, "user_id", "left")
    return known.withColumn("task_time", F.coalesce("pair_time", "user_time")).drop("pair_time", "user_time")


def profile(tasks: DataFrame, log: DataFrame, days: int = 90, cold_user: int = 5, cold_item: int = 5, recent_least: int = 2, outside_least: int = 0) -> DataFrame:
    """Timed tasks with the counts known at their time and the four condition flags.

    before: the user's interactions strictly before; recent: those of the last
    ``days`` (the first instant of the window included); outside: the others;
    item_before: the target's interactions before. Equal tasks come out once.

    The three questions of a task are points on the running totals of its user
    and its target; users and items share one timeline table, so there is one
    pass over the log for all of them (``counts_before``).
    """
    of = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))).alias("key")
    point = lambda what, kind, c, shift=0: F.struct(F.lit(what).alias("what"), of(kind, c), (F.col("task_time") - shift).alias("ts"))
    asked = tasks.select(F.struct(*tasks.columns).alias("task"), F.inline(F.array(point("before", "user", "user_id"), point("outside", "user", "user_id", days * DAY), point("item_before", "item", "target"))))
    told = log.select(F.inline(F.array(F.struct(of("user", "user_id"), F.col("ts")), F.struct(of("item", "item_id"), F.col("ts")))))
    counted = counts_before(asked, told, "key", "ts", "n")
    at = counted.groupBy("task").agg(*(F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("before", "outside", "item_before"))).select("task.*", "before", "outside", "item_before")
    recent = F.col("before") - F.col("outside")
    return at.select(
        *tasks.columns, "before", recent.alias("recent"), "outside", "item_before", F.lit(True).alias("classic"),
        (F.col("before") <= cold_user).alias("cold_start_user"), (F.col("item_before") <= cold_item).alias("cold_start_item"),
        (F.col("task_time").isNotNull() & (recent >= recent_least) & (F.col("outside") >= outside_least)).alias("evolving_interest"),
    )


def last_n_before(tasks: DataFrame, log: DataFrame, n: int, fallback: bool = False) -> DataFrame:
    """(user_id, back, item_id, ts): the last ``n`` interactions before the user's task time, newest first; all of them for 0.

    ``fallback``: a user whose interactions all come later has them all instead of none; undated ones count as later.
    One task a user. Log rows find their task without being gathered by user; heaps do the rest.
    """
    known = tasks.where("user_id IS NOT NULL").select("user_id", "task_time", F.lit(True).alias("__ll_asked"))
    met = lookup_join(log, known, "user_id", F.struct("item_id", "ts")).where("__ll_asked").withColumn("__ll_before", F.coalesce(F.col("ts") < F.col("task_time"), F.lit(False)))
    entry = F.struct((-F.col("ts")).alias("age"), F.col("item_id"), F.col("qty"))
    if n:
        heaps = met.groupBy("user_id").agg(bounded_heap(F.when(F.col("__ll_before"), entry), n).alias("h"), bounded_heap(entry, n).alias("every"))
        kept = heaps.select("user_id", F.when(F.lit(fallback) & (F.size("h") == 0), F.col("every")).otherwise(F.col("h")).alias("h")).select("user_id", F.posexplode("h").alias("back", "h")).select("user_id", (F.col("back") + 1).cast("bigint").alias("back"), "h.*")
    else:
        late = lookup_join(met, met.groupBy("user_id").agg(F.bool_or("__ll_before").alias("__ll_some")), "user_id", F.struct("item_id", "ts"))
        rows = late.where(F.col("__ll_before") | (F.lit(fallback) & ~F.col("__ll_some"))).select("user_id", entry.alias("h")).select("user_id", "h.*", F.xxhash64("h").alias("__ll_tie"))
        kept = numbered(rows, ["user_id"], ["age", "item_id", "qty", "__ll_tie"], "back")
    return kept.select("user_id", "back", "item_id", (-F.col("age")).alias("ts"))


def neighbours(sequence: DataFrame, window: int, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(item_a, item_b) of items at most ``window`` positions apart in some sequence; a < b, each pair once.

    Positions are shifted and joined with ``window`` equi-joins' worth of rows:
    each item meets at most ``window`` followers, whatever the sequence's length.
    """
    ahead = sequence.select(F.col(user), (F.col("pos")).alias("at"), F.col(item).alias("other"))
    here = sequence.select(F.col(user), F.col(item), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + window)).alias("at"))
    met = here.join(ahead, [user, "at"]).where(F.col(item) != F.col("other"))
    return met.select(F.least(item, "other").alias("item_a"), F.greatest(item, "other").alias("item_b")).distinct()
