"""Aggregates that Spark has but does not list among its public functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded_heap(c: Column, n: int) -> Column:
    """Array of the ``n`` smallest values of a group in ascending order, NULLs left out.

    A mergeable aggregate: every map task keeps a heap of at most ``n`` values
    per group, the heaps are merged after the shuffle. No group is ever held in
    full. Values may be structs, which compare field by field.
    """
    from pyspark.sql.internal import InternalFunction

    return F.array_sort(InternalFunction.collect_top_k(c, n, True))
