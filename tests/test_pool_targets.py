"""Pools of drawn items meet the targets only where these are needed: each such join shuffles the whole pool."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import codes, registry

DATA = "/root/testdata/sf0.001"


def target_joins(spark, monkeypatch, query):
    met = []
    monkeypatch.setattr(codes, "measured", lambda df, *rows: met.append(df.columns) or measured(df, *rows))
    measured = __import__("ledgerloom.operators.lookup", fromlist=["measured"]).measured
    registry.QUERIES[query](spark, DATA)
    return met.count(["user_id", "target"])


@pytest.mark.parametrize("query", ["shortlist_recall", "sid_confidence", "shortlist_topk"])
def test_only_histories_meet_targets(spark, monkeypatch, query):
    assert target_joins(spark, monkeypatch, query) == 1


def test_target_is_at_zero_and_nowhere_else(spark):
    pool, _, goal = codes._drawn(spark, DATA)
    both = pool.join(goal, "user_id").where((F.col("pos") == 0) != F.col("item_id").eqNullSafe(F.col("target")))
    assert both.isEmpty() and pool.where("pos = 0").count() == goal.count()


def test_negatives_are_drawn_as_many_as_needed(spark, rows, monkeypatch):
    asked = []
    monkeypatch.setattr(codes, "expanded", lambda *given: asked.append(given[5]) or expanded(*given))
    from ledgerloom.operators.drawing import expanded

    got = rows(registry.QUERIES["negative_sampling"](spark, DATA))
    assert asked == [9]
    assert got == rows(codes.universe(spark, DATA).where("pos BETWEEN 1 AND 9").select("user_id", "item_id"))


def test_negatives_meet_no_targets(spark, monkeypatch):
    assert target_joins(spark, monkeypatch, "negative_sampling") == 0
