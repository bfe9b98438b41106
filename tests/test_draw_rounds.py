"""Draws in two rounds: only tasks that a few tries leave short make all of them; what was shuffled for a written draw is gone."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import drawing
from ledgerloom.plans import registry
from ledgerloom.sources.durable import durable

DATA = "/root/testdata/sf0.001"


def looked_up(spark, monkeypatch, query):
    """Tries of each look-up."""
    asked, sequence = [], F.sequence
    monkeypatch.setattr(F, "sequence", lambda a, b: asked.append(b) or sequence(a, b))
    registry.QUERIES[query](spark, DATA)
    return [spark.range(1).select(b).first()[0] + 1 for b in asked]


@pytest.mark.parametrize("query", ["sid_confidence", "shortlist_topk"])
def test_few_tries_come_first(spark, monkeypatch, query):
    assert looked_up(spark, monkeypatch, query)[0] == 24


def test_rounds_draw_what_all_tries_at_once_draw(spark, rows):
    random.seed(5)
    size, n, tries = 60, 5, 16
    had = {u: set(random.sample(range(size), u)) for u in range(0, 61, 4)}  # from nothing to everything
    index = lambda u, t: (u * 7919 + t * 13 + u % 7 * t * t) % size
    catalog = spark.range(size).select(F.col("id").alias("item_id"), F.col("id").alias("idx"))
    tasks = spark.createDataFrame([(u,) for u in [*had, None]], "user_id bigint")
    seen = spark.createDataFrame([(u, i) for u, s in had.items() for i in s], "user_id bigint, item_id bigint")
    draw = (F.col("user_id") * 7919 + F.col("try") * 13 + F.col("user_id") % 7 * F.col("try") * F.col("try")) % size
    got = rows(drawing.expanded(tasks, "user_id", catalog, seen, draw, n, tries).where("user_id IS NOT NULL"), "user_id", "pos", "item_id")
    later = short = 0
    for u, s in had.items():
        mine = [i for x, _, i in sorted(got) if x == u]
        drawn = list(dict.fromkeys(i for t in range(tries) if (i := index(u, t)) not in s))[:n]
        early = {i for t in range(n + n // 4 + 1) if (i := index(u, t)) not in s}
        later, short = later + (len(early) < len(drawn)), short + (len(drawn) < min(n, size - len(s)))
        assert mine[: len(drawn)] == drawn and len(mine) == len({*mine} - s) == min(n, size - len(s))
        assert [p for x, p, _ in sorted(got) if x == u] == list(range(1, len(mine) + 1))
    assert later and short  # there were tasks of each round and of the filling


def test_shuffles_of_written_frames_are_released(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    spark.conf.unset(key)
    kept = durable(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count(), "released")
    assert kept.count() == 100 and spark.conf.get(key, None) is None
    assert tracker.shuffleStatuses().size() <= before + 1  # that of the count
