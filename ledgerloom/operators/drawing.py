"""Drawing without replacement and by quota, the same in every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.aggregates import bounded_heap
from ledgerloom.operators.lookup import is_bounded, measured, shuffled
from ledgerloom.operators.numbering import numbered
from ledgerloom.sources.durable import durable


def _tried(tasks: DataFrame, key: str, catalog: DataFrame, seen: DataFrame, draw: Column, n: int, tries: int) -> tuple[DataFrame, DataFrame]:
    """(key, item_id, pos) up to ``n`` from the first ``tries`` draws, without the first ``__ll_have`` of each task; the tasks
    that have fewer than ``n`` after them, with the new ``__ll_have``."""
    have = F.col("__ll_have")
    tried = tasks.select(key, have, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tries - 1).cast("bigint"))).alias("try")).withColumn("idx", draw)
    found = tried.join(measured(catalog), "idx").join(shuffled(seen), [key, "item_id"], "left_anti").groupBy(key, "item_id").agg(F.min("try").alias("try"), F.first(have).alias("__ll_have"))
    # At most ``tries`` rows a task.
    ranked = found.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("try")).cast("bigint"))
    kept = durable(ranked.where((F.col("pos") <= n) & (F.col("pos") > have)).select(key, "item_id", "pos"), "drawn")
    reached = kept.groupBy(key).agg(F.max("pos").alias("__ll_now"))
    short = tasks.join(shuffled(reached), key, "left").withColumn("__ll_have", F.coalesce("__ll_now", have)).where(have < n).drop("__ll_now")
    return kept, durable(short, "short")


def expanded(tasks: DataFrame, key: str, catalog: DataFrame, seen: DataFrame, draw: Column, n: int, tries: int) -> DataFrame:
    """(key, item_id, pos): up to ``n`` items for each task that it has not seen, without repeats.

    ``draw`` maps a task and ``try`` (0, 1, ...) to an index of the catalogue
    (item_id, idx). Rejection sampling: draws of a task are looked up, those seen
    are taken out, the first ``n`` different ones stay. All tasks make a few draws more
    than ``n``, those that stay short make all ``tries``. Work grows with
    the draws, never with tasks times catalogue, except for the tasks that the tries
    leave short: they are filled up from all they have not seen, in the order of a hash.
    ``tasks``, ``catalog`` and ``seen`` are read several times. Only a catalogue or short tasks that were counted are broadcast.
    """
    some = min(tries, n + n // 4 + 1)
    kept, short = _tried(tasks.select(key, F.lit(0).cast("bigint").alias("__ll_have")), key, catalog, seen, draw, n, some)
    if some < tries and not short.isEmpty():
        more, short = _tried(short, key, catalog, seen.join(measured(short.select(key)), key, "left_semi"), draw, n, tries)
        kept = kept.unionByName(more)
    if short.isEmpty():
        return kept
    few = F.broadcast(short) if is_bounded(short) else short.hint("shuffle_replicate_nl")
    free = catalog.select("item_id").crossJoin(few).join(shuffled(seen.select(key, "item_id")), [key, "item_id"], "left_anti").join(shuffled(kept.select(key, "item_id")), [key, "item_id"], "left_anti")
    heap = free.groupBy(key, "__ll_have").agg(bounded_heap(F.struct(F.md5(F.concat_ws(":", key, "item_id")).alias("h"), "item_id"), n).alias("h"))
    more = heap.select(key, "__ll_have", F.posexplode("h").alias("k", "h")).withColumn("pos", (F.col("__ll_have") + F.col("k") + 1).cast("bigint"))
    return kept.unionByName(more.where(F.col("pos") <= n).select(key, "h.item_id", "pos"))


def by_hash(df: DataFrame, keys: Sequence[str], text: Column, n: int, tie: str) -> DataFrame:
    """The ``n`` rows of each key whose text has the smallest MD5, ``tie`` settling equal ones; adds ``pos``."""
    marked = df.withColumn("__ll_h", F.md5(text))
    return numbered(marked, keys, ["__ll_h", tie]).where(F.col("pos") <= n).drop("__ll_h")


def proportional_quotas(target: DataFrame, stratum: str, total: int, min_fillable: int) -> DataFrame:
    """(stratum, quota): ``total`` dealt in proportion to the rows of ``target``, rounded half to even; strata below ``min_fillable`` get 0."""
    counts = target.groupBy(stratum).agg(F.count(F.lit(1)).alias("__ll_n"))
    share = F.col("__ll_n") / F.sum("__ll_n").over(Window.partitionBy(F.lit(0)))  # a row per stratum
    return counts.select(stratum, F.when(F.col(stratum) < min_fillable, 0).otherwise(F.bround(share * total, 0)).cast("bigint").alias("quota"))


def by_quota(df: DataFrame, stratum: str, text: Column, quotas: DataFrame, tie: str) -> DataFrame:
    """The rows of each stratum with the smallest MD5 of ``text``, as many as its quota; none without one."""
    marked = df.join(F.broadcast(quotas.where("quota > 0")), stratum).withColumn("__ll_h", F.md5(text))
    return numbered(marked, [stratum], ["__ll_h", tie]).where(F.col("pos") <= F.col("quota")).drop("__ll_h", "quota")


def disjoint_by_condition(df: DataFrame, unit: str, conditions: Sequence[str], n: int, text: Column) -> DataFrame:
    """(condition, unit): up to ``n`` units for each condition in turn, none twice.

    One bounded pass per condition: those already taken are anti-joined away.
    """
    taken = None
    for c in conditions:
        free = df.where(F.col(c))
        if taken is not None:
            free = free.join(taken.select(unit), unit, "left_anti")
        marked = free.select(F.md5(text).alias("h"), unit).orderBy("h", unit).limit(n)
        rows = marked.select(F.lit(c).alias("condition"), unit)
        taken = rows if taken is None else taken.unionByName(rows)
    return taken
