"""Per-key results when a few keys hold most rows.

Rows are range partitioned on (key, order) with sampled quantiles, which is
Spark's range exchange. A heavy key so spreads over as many partitions
("slots") as its rows need, each holding one stretch of its order. Every slot
gives a partial state per key; only a key that crosses a slot's edge has more
than one, and those are stitched in slot order.

* ``split_aggregate`` stitches totals: one row per key.
* ``split_running`` stitches running values: every row with its key's value up
  to and including it.

Both treat NULL as a key of its own and take repeated rows as they stand. Ties
in the order are broken by the further order columns; name a unique one last,
or a heavy key with equal order values cannot be split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.durable import durable


@dataclass(frozen=True)
class State:
    """A per-key value: ``kind`` of ``count``, ``sum``, ``min``, ``max``, ``first``, ``last`` over ``value``.

    ``first`` and ``last`` go by the operator's order columns. NULL values are
    left out by all but ``count`` (which counts rows), ``first`` and ``last``.
    A key without values has NULL, a count 0.
    """

    name: str
    kind: str
    value: Column | None = None

    def partial(self, order: Sequence[str]) -> Column:
        at = F.struct(*order)
        how = {
            "count": lambda: F.count(F.lit(1)),
            "sum": lambda: F.sum(self.value),
            "min": lambda: F.min(self.value),
            "max": lambda: F.max(self.value),
            "first": lambda: F.min(F.struct(at.alias("at"), self.value.alias("value"))),
            "last": lambda: F.max(F.struct(at.alias("at"), self.value.alias("value"))),
        }
        return how[self.kind]().alias(self.name)

    def stitched(self) -> Column:
        c = F.col(self.name)
        how = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "first": F.min, "last": F.max}[self.kind](c)
        return (how["value"] if self.kind in ("first", "last") else how).alias(self.name)


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], slots: int | None) -> DataFrame:
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(slots, *by) if slots else df.repartitionByRange(*by)
    return ranged.withColumn("__ll_slot", F.spark_partition_id())


def split_aggregate(df: DataFrame, keys: Sequence[str], order: Sequence[str], states: Sequence[State], slots: int | None = None) -> DataFrame:
    """One row per key: the keys, the states, and ``slots``, the partitions the key was spread over.

    An empty table gives no rows. Columns other than the keys and states are
    dropped, so names in ``df`` cannot clash.
    """
    used = df.select(*dict.fromkeys([*keys, *order]), *(s.value.alias(f"__ll_v{i}") for i, s in enumerate(states) if s.value is not None))
    inner = [State(s.name, s.kind, F.col(f"__ll_v{i}") if s.value is not None else None) for i, s in enumerate(states)]
    partial = _ranged(used, keys, order, slots).groupBy(*keys, "__ll_slot").agg(*(s.partial(order) for s in inner))
    return partial.groupBy(*keys).agg(*(s.stitched() for s in inner), F.count(F.lit(1)).alias("slots"))


def split_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, slots: int | None = None) -> DataFrame:
    """``df`` with running values of each key in the given order.

    ``sums``: name -> number column, the running total (NULL counts as 0).
    ``maxima``: name -> any comparable column, structs too, the running maximum
    (NULL until the first value).

    A window over (slot, key) gives the values within each slot. They are
    written once, for slot numbers must not change afterwards. What a key brings
    along from earlier slots is needed only for the first key of a slot, so there
    are fewer such rows than slots, and they are broadcast.
    """
    sums, maxima = sums or {}, maxima or {}
    names = [*sums, *maxima]
    staged = df.withColumns({f"__ll_in_{n}": c for n, c in {**{k: F.coalesce(v, F.lit(0)) for k, v in sums.items()}, **maxima}.items()})
    so_far = Window.partitionBy("__ll_slot", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = {f"__ll_in_{n}": (F.sum if n in sums else F.max)(f"__ll_in_{n}").over(so_far) for n in names}
    done = durable(_ranged(staged, keys, order, slots).withColumns(within), "running")

    edges = done.groupBy("__ll_slot", *keys).agg(*(F.max(f"__ll_in_{n}").alias(f"__ll_in_{n}") if n in maxima else F.max_by(f"__ll_in_{n}", F.struct(*order)).alias(f"__ll_in_{n}") for n in names))
    earlier = Window.partitionBy(*keys).orderBy("__ll_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumns({f"__ll_from_{n}": (F.sum if n in sums else F.max)(f"__ll_in_{n}").over(earlier) for n in names} | {"__ll_before": F.count(F.lit(1)).over(earlier)}).where("__ll_before > 0")
    carried = carried.select(F.col("__ll_slot").alias("__ll_at"), *(F.col(k).alias(f"__ll_key{i}") for i, k in enumerate(keys)), *(f"__ll_from_{n}" for n in names))
    same = F.col("__ll_slot") == F.col("__ll_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__ll_key{i}"))
    out = done.join(F.broadcast(carried), same, "left")
    values = {n: F.coalesce(f"__ll_from_{n}", F.lit(0)) + F.col(f"__ll_in_{n}") for n in sums}
    values |= {n: F.when(F.col(f"__ll_from_{n}").isNull() | (F.col(f"__ll_in_{n}") > F.col(f"__ll_from_{n}")), F.col(f"__ll_in_{n}")).otherwise(F.col(f"__ll_from_{n}")) for n in maxima}
    return out.select(*df.columns, *(v.alias(n) for n, v in values.items()))
