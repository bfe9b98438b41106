"""Joins of drawn pools go by counted rows: what Spark takes to be small is millions of rows on larger tables."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import drawing, lookup
from ledgerloom.plans import registry

DATA = "/root/testdata/sf0.001"
#: Finding -> query.
QUERIES = {
    1: "candidate_diversity", 2: "expand_universe", 3: "oracle_geometry", 4: "shortlist_recall", 5: "sid_confidence", 6: "candidate_summaries", 7: "rank_unknown_last", 8: "shortlist_topk",
    9: "sid_prefix_in_pool", 10: "leave_one_out_evaluation", 11: "embedding_rescore", 12: "negative_sampling", 13: "retrieval_trace", 14: "sid_collisions_in_pool", 15: "sid_rank",
}


def joins(df):
    """The joins of the plan of a frame but those to the few rows that a numbering carries over."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line.strip() for line in plan.split("\n") if "Join " in line and "__ll_at" not in line]


def test_no_draw_is_broadcast(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(drawing, "durable", lambda df, name: written.append((name, joins(df), df._jdf.queryExecution().executedPlan().toString())) or kept(df, name))
    kept = __import__("ledgerloom.sources.durable", fromlist=["durable"]).durable
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 100)
    for name, df in {"catalog": spark.range(400).select(F.col("id").alias("item_id"), F.col("id").alias("idx")), "tasks": spark.range(50).withColumnRenamed("id", "user_id"), "seen": spark.range(50).select(F.col("id").alias("user_id"), F.col("id").alias("item_id"))}.items():
        df.write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    got = drawing.expanded(read("tasks"), "user_id", read("catalog"), read("seen"), (F.col("user_id") * 7919 + F.col("try") * 104729) % 400, 19, 64)
    assert got.count() == 50 * 19
    assert [n for n, *_ in written] == ["drawn", "short"]
    for _, plan, physical in written:
        assert plan and all("strategy=merge" in j for j in plan) and "BroadcastHashJoin" not in physical


@pytest.mark.parametrize("query", QUERIES.values(), ids=[f"F{n}" for n in QUERIES])
def test_joins_of_pools_are_measured(spark, rows, monkeypatch, query):
    small = registry.QUERIES[query](spark, DATA)
    assert all("strategy=broadcast" in j or "strategy=merge" in j for j in joins(small)), joins(small)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 3)
    monkeypatch.setattr("ledgerloom.plans.codes.VECTOR_ROWS", 3)
    large = registry.QUERIES[query](spark, DATA)
    # Short tasks meet the whole catalogue: no keys to merge by.
    assert all("strategy=merge" in j or "strategy=shuffle_replicate_nl" in j for j in joins(large)), joins(large)
    assert rows(large) == rows(small)
