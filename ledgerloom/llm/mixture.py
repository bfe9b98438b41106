"""Mixing sources to target weights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import split_running
from ledgerloom.sources.durable import durable

#: The golden ratio's fractional part, whose multiples modulo 1 fill [0, 1) evenly at every length.
GOLDEN = (5**0.5 - 1) / 2


@dataclass(frozen=True)
class Share:
    """What a source is to have of a mix: thousandths of a budget that is ``percent`` of all tokens."""

    mix_id: int
    source: str
    permille: int
    max_repeats: int
    percent: int


def mix_sources(records: DataFrame, key: str, source: str, size: str, shares: list[Share], block: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mix, report).

    ``records``: ``key`` (unique within a source), ``source`` and ``size`` in
    tokens; rows with a NULL source are left out, a NULL size counts 0, equal
    records count each.

    The records of a source are shuffled and laid end to end; a block is those
    that begin within the same ``block`` tokens. A mix is a row of slots of one
    block each. Slot s goes to the source whose stretch of the cumulative weights
    holds the fractional part of s times the golden ratio, so that every run of
    slots has nearly the target shares. The r-th slot of a source takes its block
    r modulo its number of blocks; from the ``max_repeats``-th round on the
    source's slots stay empty.

    mix: mix_id, slot, source, round, ``key``, ``size``. report, a row per share:
    mix_id, source, available, target_tokens, actual_tokens, empty_slots,
    target_permille, actual_permille (of the mix's actual tokens), short: what
    fills the source's slots is less than its target, and an exact comparison
    shows that this is no matter of whole blocks: ``max_repeats`` times what its
    blocks hold is less as well.

    ``block`` defaults to a 4096th of all tokens, 256 at least and a million at
    most. Running totals and ranks are taken by ``split_running``, so neither a
    source nor a mix is ever in one task.
    """
    spark = records.sparkSession
    rows = records.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    rows = durable(rows, "sizes")  # a size may be dear, and laying out reads it twice
    laid = split_running(rows.withColumn("draw", F.xxhash64(F.lit(seed), "key", "source")), ["source"], ["draw", "key"], sums={"upto": F.col("size")})
    wanted = sorted({s.source for s in shares})
    total = laid.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    have = {r[0]: r[1] for r in laid.where(F.col("source").isin(wanted)).groupBy("source").agg(F.sum("size")).collect()}  # as many rows as the shares name sources
    block = block or min(1_000_000, max(256, total // 4096))
    blocks = {s: -(-n // block) for s, n in have.items()}
    placed = laid.where(F.col("source").isin(wanted) & (F.col("upto") > 0)).withColumn("block", F.floor((F.greatest(F.col("upto") - F.col("size"), F.lit(0)) / block)).cast("bigint"))

    schedules = []
    for mix_id in dict.fromkeys(s.mix_id for s in shares):
        own = [s for s in shares if s.mix_id == mix_id]
        weight = sum(s.permille for s in own)
        slots = -(-total * own[0].percent * weight // (100 * 1000 * block))
        if not slots:
            continue
        point = F.pmod((F.col("slot") + 0.5) * F.lit(GOLDEN), F.lit(1.0)) * weight
        reached, to = 0, None
        for s in own:
            reached += s.permille
            to = (F.when if to is None else to.when)(point < reached, F.lit(s.source))
        schedules.append(spark.range(slots).withColumnRenamed("id", "slot").select(F.lit(mix_id).alias("mix_id"), "slot", to.otherwise(own[-1].source).alias("source")))
    if not schedules:
        schedules = [spark.createDataFrame([], "mix_id int, slot bigint, source string")]
    ranked = split_running(reduce(DataFrame.unionByName, schedules), ["mix_id", "source"], ["slot"], sums={"rank": F.lit(1).cast("bigint")})
    plan = spark.createDataFrame([(s.mix_id, s.source, blocks.get(s.source, 0), s.max_repeats) for s in shares], "mix_id int, source string, blocks bigint, max_repeats int")
    numbered = ranked.join(F.broadcast(plan), ["mix_id", "source"])
    filled = numbered.where("blocks > 0").select("mix_id", "slot", "source", F.expr("(rank - 1) div blocks").alias("round"), F.expr("(rank - 1) % blocks").alias("block"), "max_repeats").where("round < max_repeats").drop("max_repeats")

    mix = filled.join(placed, ["source", "block"]).select("mix_id", "slot", "source", "round", F.col("key").alias(key), F.col("size").alias(size))
    weights = durable(placed.groupBy("source", "block").agg(F.sum("size").alias("tokens")), "weights")
    actual = filled.groupBy("mix_id", "source", "block").agg(F.count(F.lit(1)).alias("times")).join(weights, ["source", "block"]).groupBy("mix_id", "source").agg(F.sum("times").alias("filled"), F.sum(F.col("times") * F.col("tokens")).alias("actual_tokens"))
    given = numbered.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("slots"))
    held = weights.groupBy("source").agg(F.sum("tokens").alias("available"))
    goal = spark.createDataFrame([(s.mix_id, s.source, str(total * s.percent * s.permille), s.permille, s.max_repeats) for s in shares], "mix_id int, source string, wanted string, target_permille int, max_repeats int")
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    known = goal.join(actual, ["mix_id", "source"], "left").join(given, ["mix_id", "source"], "left").join(held, "source", "left")
    known = known.select("mix_id", "source", F.col("wanted").cast("decimal(38,0)").alias("wanted"), "target_permille", "max_repeats", none("available").alias("available"), none("actual_tokens").alias("actual_tokens"), (none("slots") - none("filled")).alias("empty_slots"))
    known = durable(known, "mixture")
    exact = lambda c, times: F.col(c).cast("decimal(20,0)") * times.cast("decimal(17,0)")
    less = (exact("actual_tokens", F.lit(100_000)) < F.col("wanted")) & (exact("available", F.col("max_repeats") * F.lit(100_000).cast("bigint")) < F.col("wanted"))
    sums = known.groupBy("mix_id").agg(F.sum("actual_tokens").alias("mixed"))
    report = known.join(F.broadcast(sums), "mix_id").select(
        "mix_id", "source", "available", (F.col("wanted") / 100_000).cast("double").alias("target_tokens"), "actual_tokens", "empty_slots", "target_permille",
        F.when(F.col("mixed") > 0, F.col("actual_tokens") * 1000.0 / F.col("mixed")).alias("actual_permille"), less.alias("short"),
    )
    return mix, report
