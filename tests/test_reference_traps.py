"""Hand-made cases for the semantics that are easy to get wrong."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.policies import evidence_reason
from ledgerloom.functions.scores import hit, ndcg, shared_levels, shared_prefix
from ledgerloom.functions.texts import catalogue, first_integer, parsed_ranking, without_preamble
from ledgerloom.operators import timelines as L
from ledgerloom.operators.codes import deduplicated
from ledgerloom.operators.harmonise import last_wins
from ledgerloom.operators.lookup import lookup_join
from ledgerloom.operators.statistics import average_ranks, benjamini_hochberg
from ledgerloom.sources.files import read_tasks, require_files, update_by_key

LOG = "user_id bigint, item_id bigint, ts bigint, qty double"


def test_sequences(spark, rows):
    log = spark.createDataFrame([(1, 2, 5, 1.0), (1, 1, 5, 1.0), (1, 2, 7, 1.0), (1, 3, 9, 1.0), (2, 8, 1, 1.0), (2, 9, 2, 1.0)], LOG)
    seq = L.first_occurrences(log)
    assert rows(seq, "user_id", "item_id", "pos") == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 8, 1), (2, 9, 2)]
    split = {(r[0], r[1]): r[2] for r in rows(L.leave_one_out(seq), "user_id", "item_id", "split")}
    assert split == {(1, 1): "train", (1, 2): "valid", (1, 3): "test", (2, 8): "train", (2, 9): "train"}
    assert rows(L.last_items(seq, 2)) == [(1, [2, 3]), (2, [8, 9])]
    assert rows(L.last_items(seq, 4).select(L.padded(F.col("items"), 4))) == [([0, 0, 8, 9],), ([0, 1, 2, 3],)]
    assert rows(L.neighbours(seq, 1)) == [(1, 2), (2, 3), (8, 9)]


def test_window_edges_and_fallbacks(spark):
    day = 86_400
    log = spark.createDataFrame([(1, 5, 1000 * day, 1.0), (1, 7, 910 * day, 1.0), (1, 8, 910 * day - 1, 1.0), (1, 5, 990 * day, 1.0), (2, 9, 5 * day, 1.0)], LOG)
    tasks = spark.createDataFrame([(1, 5), (2, 77), (3, 1)], "user_id bigint, target bigint")
    timed = L.task_times(tasks, log)
    assert {r["user_id"]: r["task_time"] for r in timed.collect()} == {1: 1000 * day, 2: 5 * day, 3: None}
    got = {r["user_id"]: r for r in L.profile(timed, log).collect()}
    assert (got[1]["before"], got[1]["recent"], got[1]["outside"], got[1]["item_before"]) == (3, 2, 1, 1)
    assert got[1]["evolving_interest"] and not got[3]["evolving_interest"] and got[3]["before"] == 0


def test_codes(spark, rows):
    c = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", "c"), (3, "a", "b", "d")], "item_id bigint, c0 string, c1 string, c2 string")
    assert rows(deduplicated(c), "item_id", "dedup") == [(1, 1), (2, 2), (3, 0)]
    lit = lambda *x: [F.lit(v) for v in x]
    one = spark.range(1).select(shared_levels(lit(1, 2, 3), lit(9, 2, 3)), shared_prefix(lit(1, 2, 3), lit(9, 2, 3)), shared_prefix(lit(1, 2, 3), lit(1, 2, 9))).head()
    assert tuple(one) == (2 / 3, 0, 2)


def test_ranking_scores(spark):
    data = [([*"abcdefghij"], "a"), ([*"bcadefghij"], "a"), ([*"bcdefaghij"], "a"), ([*"bcd"], "a"), (None, "a")]
    r = spark.createDataFrame(data, "o array<string>, t string").agg(*(F.avg(hit(F.col("o"), F.col("t"), k)) for k in (1, 3, 5, 10)), F.avg(ndcg(F.col("o"), F.col("t"), 5))).head()
    assert [round(x, 9) for x in r] == [0.2, 0.4, 0.4, 0.6, 0.3]


def test_false_discovery_and_ranks(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2)], "id int, p double")
    got = {r["id"]: round(r["p_bh"], 6) for r in benjamini_hochberg(p, "p").collect()}
    assert got == {1: 0.04, 2: 0.053333, 3: 0.053333, 4: 0.2}
    ranks = {r["id"]: r["r"] for r in average_ranks(spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0)], "id int, x double"), "x", "r").collect()}
    assert ranks == {1: 2.5, 2: 2.5, 3: 1.0}


def test_policy(spark):
    cases = [(9, 0, 0.9, 0.5, 0.5, "redundant"), (2, 0, 0.9, 0.0, 0.0, "sparse"), (9, 0, 0.1, 0.5, 0.0, "confident"), (9, 0, 0.1, 0.0, 0.0, "unsure")]
    df = spark.createDataFrame(cases, "a int, b int, c double, d double, e double, want string")
    assert all(r[0] == r[1] for r in df.select(evidence_reason(*(F.col(c) for c in "abcde")), "want").collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [("[a] then ['p1', 'p2', 'p3', 'p1']", ["p1", "p2", "p3"]), ("1. p2 2. p1", ["p2", "p1"]), ("garbage", []), ("", []), (None, []), ("first 'p3' then \"p1\" then 'p2'", ["p3", "p1", "p2"])],
)
def test_reading_rankings(spark, text, want):
    df = spark.createDataFrame([(text, ["p1", "p2", "p3"])], "t string, v array<string>")
    assert df.select(parsed_ranking(F.col("t"), F.col("v"))).head()[0] == want


def test_texts(spark):
    df = spark.createDataFrame([("Thinking...\nhm\n...done thinking.\n <think>x</think> yes 12 or 3", "[1] Find: Looks. More\n[2] Book: Pays now")], "t string, c string")
    r = df.select(without_preamble(F.col("t")), first_integer(F.col("t")), catalogue(F.col("c"))).head()
    assert r[0] == "yes 12 or 3" and r[1] == 12
    assert [tuple(x) for x in r[2]] == [(1, "Find", "Looks."), (2, "Book", "Pays now.")]


def test_files(spark, tmp_path, rows):
    for name, doc in {"task_1": {"type": "recommendation", "user_id": "u", "candidate_list": ["a", "b"]}, "task_7": {"type": "user_behavior_simulation", "user_id": "v", "item_id": "z"}, "task_9": {"type": "recommendation"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "groundtruth_1.json").write_text(json.dumps({"ground truth": "b"}))
    (tmp_path / "groundtruth_7.json").write_text(json.dumps({"stars": 4.0, "review": "x"}))
    assert rows(read_tasks(spark, str(tmp_path), str(tmp_path)), "task_no", "target", "candidates") == [(1, "b", ["a", "b"]), (7, "z", ["z"])]
    with pytest.raises(FileNotFoundError, match="gone"):
        require_files(spark, [str(tmp_path / "task_1.json"), str(tmp_path / "gone")])
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(update_by_key(t, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c")]
    assert rows(last_wins(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, seq int, v string"), "k", "seq"), "v") == [("b",)]


def test_lookup_beyond_the_bound(spark, rows):
    big = spark.createDataFrame([(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i}") for i in range(50)], "id bigint, k string")
    small = spark.createDataFrame([("hot", 1), ("k2", 2), ("k4", 3)], "k string, v int")
    assert rows(lookup_join(big, small, "k", "id"), "id", "v") == rows(lookup_join(big, small, "k", "id", max_rows=1), "id", "v")
    assert lookup_join(big, small, "k", "id", max_rows=1).count() == 50
