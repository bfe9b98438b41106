"""Rankers, indexes and prediction files on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import timelines as L
from ledgerloom.operators import workflow as W
from ledgerloom.sources.durable import scratch_root
from ledgerloom.sources.files import read_predictions, write_predictions


def test_final_ranking(spark):
    cases = [
        (["c", "a", "b"], ["b", "d", "a", "c"], True, ["c", "a", "b", "d"]),  # completed by the codes' order
        (["c", "a", "b"], ["d", "b", "a", "c"], False, ["c", "a", "b", "d"]),  # by the candidates'
        (["c", "a"], ["d", "b", "a", "c"], True, ["d", "b", "a", "c"]),  # too few: the codes' order
        (["c", "a"], ["d", "b", "a", "c"], False, ["a", "b", "c", "d"]),
        ([], [], True, ["a", "b", "c", "d"]),
        (["x", "c", "b", "c"], ["d", "y"], True, ["c", "b", "d"]),  # what the order does not name is not added
    ]
    df = spark.createDataFrame([(p, [*"abcd"], o, u) for p, o, u, _ in cases], "p array<string>, c array<string>, o array<string>, u boolean")
    got = [r[0] for r in df.select(W.final_ranking(*(F.col(x) for x in "pcou"))).collect()]
    assert got == [w for *_, w in cases]
    off = df.limit(1).select(W.final_ranking(*(F.col(x) for x in "pcou"), merge=False)).head()[0]
    assert off == ["c", "a", "b", "d"]


def test_chosen_tasks(spark, rows):
    t = spark.createDataFrame([(1, "a"), (3, "b")], "index bigint, user_id string")
    assert rows(W.chosen_tasks(t, "index", [3, 3])) == [(3, "b")]
    with pytest.raises(ValueError, match=r"\[0, 9\]"):
        W.chosen_tasks(t, "index", [9, 1, 0])


def test_first_source_and_masked_mean(spark, rows):
    c = spark.createDataFrame([(1, 0, "x"), (1, 1, "b"), (2, 0, None), (2, 1, "zz"), (3, 0, "a"), (3, 1, "b")], "index bigint, pos int, item_id string")
    items = spark.createDataFrame([("a", "yelp"), ("a", "yelp"), ("b", "goodreads"), ("x", None), (None, "yelp")], "item_id string, source string")
    assert rows(W.first_source(c, items, "amazon")) == [(1, "goodreads"), (2, "amazon"), (3, "yelp")]
    v = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1.0, 1.0]), ([[1.0, 2.0], [3.0, 4.0]], [0.0, 1.0]), ([[1.0, 2.0]], [0.0])], "v array<array<double>>, m array<double>")
    assert [r[0] for r in v.select(W.masked_mean(F.col("v"), F.col("m"))).collect()] == [[2.0, 3.0], [3.0, 4.0], [0.0, 0.0]]


def test_prediction_files(spark, rows, tmp_path):
    df = spark.createDataFrame([("r1.json", 0, "a", None, ["a", "b"], None), ("r2.json", 1, None, "b", None, "timeout")], "run string, run_index bigint, x string, y string, output array<string>, error string")
    write_predictions(df.select("run", "run_index", F.struct(F.col("x").alias("ground truth"), F.col("y").alias("ground_truth")).alias("groundtruth"), "output", "error"), str(tmp_path / "p"))
    got = rows(read_predictions(spark, str(tmp_path / "p")), "run", "run_index", "groundtruth", "output", "error")
    assert got == [("r1.json", 0, "a", ["a", "b"], None), ("r2.json", 1, "b", None, "timeout")]


@pytest.mark.parametrize("fallback", [False, True])
def test_histories_before_a_time(spark, rows, fallback):
    log = spark.createDataFrame([(1, 10, 5, 1.0), (1, 11, 6, 1.0), (1, 12, 9, 1.0), (2, 20, 8, 1.0), (2, 21, None, 1.0), (3, 30, 1, 1.0)], "user_id bigint, item_id bigint, ts bigint, qty double")
    t = spark.createDataFrame([(1, 9), (2, 3), (4, 5)], "user_id bigint, task_time bigint")
    late = [(2, 20), (2, 21)] if fallback else []
    assert rows(L.last_n_before(t, log, 0, fallback), "user_id", "item_id") == [(1, 10), (1, 11), *late]
    assert rows(L.last_n_before(t, log, 1, fallback).where("user_id = 1"), "item_id", "back") == [(11, 1)]


def test_blocked_pairs_and_index(spark, rows, tmp_path):
    t = spark.createDataFrame([("recommendation", "u", "a", ["a", "b"]), ("recommendation", "u", "c", ["d"]), ("user_behavior_simulation", "v", "z", None), ("recommendation", None, "a", ["a"])], "task_type string, user_id string, target string, candidates array<string>")
    blocked = W.blocked_pairs(t)
    assert rows(blocked) == [("u", "a"), ("v", "z")]
    log = spark.createDataFrame([("u", "a", 1), ("u", "c", 2), ("v", "z", 3), (None, "a", 4)], "user_id string, item_id string, seq bigint")
    assert rows(W.indexed_log(log, blocked, str(tmp_path / "i")), "seq") == [(2,), (4,)]
    assert rows(W.indexed_log(log.limit(0), blocked, str(tmp_path / "i")), "seq") == [(2,), (4,)]


def test_no_private_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master, applicationId = "spark://somewhere:7077", "app-of-a-cluster"

    session = type("Session", (), {"conf": Conf, "sparkContext": Context})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(session)
