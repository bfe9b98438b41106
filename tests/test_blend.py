"""Blend of code and embedding likeness, and ranks by embedding."""

from ledgerloom.operators import codes as K
from ledgerloom.plans import registry

SCHEMA = "user_id bigint, item_id bigint, pos bigint, c0 string, c1 string, c2 string, embedding array<float>"


def test_blend_and_rescored_ranks(spark, rows):
    history = spark.createDataFrame([(1, 50, 1, "a", "b", "c", [1.0, 0.0]), (1, 51, 2, "x", "y", "z", None), (2, 52, 1, None, None, None, [1.0, 0.0]), (3, 53, 1, "a", "b", "c", None)], SCHEMA)
    pool = [(10, 0, "a", "b", "q", [0.0, 1.0]), (11, 1, "a", "q", "q", [1.0, 0.0]), (12, 2, "a", "b", "c", None), (13, 3, None, None, None, [1.0, 0.0]), (14, 4, "q", "q", "q", [1.0, 0.0])]
    candidates = spark.createDataFrame([(u, *x) for u in (1, 2, 3, 4) for x in pool], SCHEMA)
    got = {(u, i): round(s, 6) for u, i, s in rows(K.blended_scores(candidates, history, "user_id"), "user_id", "item_id", "score")}
    assert [got[1, i] for i in range(10, 15)] == [round(0.7 * 2 / 3, 6), round(0.7 / 3 + 0.3, 6), 1.0, 0.0, 0.3]
    assert [got[2, i] for i in range(10, 15)] == [got[4, i] for i in range(10, 15)] == [0.0] * 5  # no code in the history
    assert [got[3, i] for i in range(10, 15)] == [round(2 / 3, 6), round(1 / 3, 6), 1.0, 0.0, 0.0]
    told = rows(K.rescored(candidates, history, "user_id"), "user_id", "rank", "item_id", "score")
    assert [(r, i) for u, r, i, _ in told if u == 1] == [(1, 11), (2, 13), (3, 14), (4, 10), (5, 12)]  # equal cosines by codes, then order
    assert told[4][3] == -1.0 and {u for u, *_ in told} == {1, 2}


def test_ranks_blend_on_tables(spark):
    blend = registry.QUERIES["sid_rank"](spark, "/root/testdata/sf0.001").collect()
    assert any(round(r["score"] * 3) != round(r["score"] * 3, 4) for r in blend)
