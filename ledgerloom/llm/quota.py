"""A sample whose categories meet target shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import split_running
from ledgerloom.sources.durable import durable


@dataclass(frozen=True)
class Category:
    """A category of a plan: which rows (``member``) and which share of the sample."""

    plan_id: int
    name: str
    member: Column
    permille: int
    min_rows: int
    percent: int


def seats(categories: list[tuple[str, int, int, int]], size: int) -> dict[str, int]:
    """How many of each category are among the ``size`` smallest priorities.

    ``categories``: (name, rows, permille, floor). The r-th row of a category has
    priority (r - 0.5) / permille; rows up to the floor come before all others;
    equal priorities go by name. Categories that run out leave their seats to the
    next priorities. A permille of 0 gives floor rows only. Exact in integers.
    """
    order = {name: i for i, (name, *_) in enumerate(sorted(categories))}

    def before(name: str, rank: int, permille: int, first: bool) -> int:
        """Rows that come no later than the rank-th of ``name``."""
        total = 0
        for other, rows, share, floor in categories:
            floor = min(floor, rows)
            if not share:
                total += floor if not first or other == name or order[other] < order[name] else 0
                continue
            if permille:
                strict = order[other] > order[name]
                reach = min(rows, (((2 * rank - 1) * share - strict) // permille + 1) // 2)
            else:
                reach = rows
            total += min(reach, floor) if first else max(floor, reach)
        return total if permille else total + (rank - 1 if first else 0)

    out = {}
    for name, rows, permille, floor in categories:
        floor = min(floor, rows)
        most = rows if permille else floor
        lo, hi = 0, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if before(name, mid, permille, mid <= floor) <= size:
                lo = mid
            else:
                hi = mid - 1
        out[name] = lo
    return out


def sample_to_targets(candidates: DataFrame, unit: list[str], categories: list[Category], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every plan among ``categories``.

    ``candidates``: one row per unit (``unit`` columns together unique, not NULL);
    rows in no category of a plan are outside its pool. A plan's sample has
    floor(percent * pool / 100) rows, fewer only if the pool is smaller.

    sample: plan_id, category, rank, priority, unit columns. The same seed and
    rows give the same sample. report: plan_id, category, usable, need (the larger
    of min_rows and the target's share rounded up), taken, target_permille,
    actual_permille, short (the category ran out before its need).

    Rows get a random rank within their category by ``split_running``, which cuts
    large categories over many tasks. What is collected is one count per category.
    The cut is written once: the rows drawn, and as reserves those which a need
    calls for beyond them. The report counts what was written: a category is short
    if drawn rows and reserves together don't reach its need.
    """
    spark = candidates.sparkSession
    which = F.array(*(F.when(F.coalesce(c.member, F.lit(False)), F.struct(F.lit(c.plan_id).alias("plan_id"), F.lit(c.name).alias("category"))) for c in categories))
    pool = candidates.select(*unit, F.explode(F.filter(which, lambda x: x.isNotNull())).alias("of")).select("of.*", *unit, F.xxhash64(F.lit(seed), *unit).alias("draw"))
    ranked = split_running(pool, ["plan_id", "category"], ["draw", *unit], sums={"rank": F.lit(1).cast("bigint")})
    usable = {(r["plan_id"], r["category"]): r["usable"] for r in ranked.groupBy("plan_id", "category").agg(F.max("rank").alias("usable")).collect()}

    rows = []
    for plan in dict.fromkeys(c.plan_id for c in categories):
        own = [c for c in categories if c.plan_id == plan]
        have = {c.name: usable.get((plan, c.name), 0) for c in own}
        size = own[0].percent * sum(have.values()) // 100
        given = seats([(c.name, have[c.name], c.permille, c.min_rows) for c in own], size)
        rows += [(plan, c.name, have[c.name], max(c.min_rows, -(-c.permille * size // 1000)), given[c.name], c.permille, size) for c in own]
    plan_rows = spark.createDataFrame(rows, "plan_id int, category string, usable bigint, need bigint, seats bigint, target_permille int, size bigint")
    reach = F.broadcast(plan_rows.select("plan_id", "category", "need", "seats", "target_permille"))
    called = ranked.join(reach, ["plan_id", "category"]).where(F.col("rank") <= F.greatest("seats", "need"))
    priority = F.when(F.col("target_permille") > 0, (F.col("rank") - 0.5) / F.col("target_permille"))
    cut = durable(called.select("plan_id", "category", "rank", priority.alias("priority"), (F.col("rank") <= F.col("seats")).alias("__ll_drawn"), *unit), "cut")
    sample = cut.where("__ll_drawn").drop("__ll_drawn")
    counted = cut.groupBy("plan_id", "category").agg(F.count_if("__ll_drawn").alias("taken"), F.max("rank").alias("reached"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    report = plan_rows.join(counted, ["plan_id", "category"], "left").select(
        "plan_id", "category", "usable", "need", none("taken").alias("taken"), "target_permille",
        F.when(F.col("size") > 0, none("taken") * 1000.0 / F.col("size")).alias("actual_permille"), (none("reached") < F.col("need")).alias("short"),
    )
    return sample, report
