"""Split per-key operators against plain Python."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.numbering import counts_before, numbered, running_sum
from ledgerloom.operators.skew import State, split_aggregate, split_running

SCHEMA = "k string, o bigint, v bigint, extra string, _slot int"


def sample(n=600):
    rng = random.Random(7)
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, *range(9)]), "x", 3) for i in range(n)]


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_totals_are_stitched_over_slots(spark):
    data = sample()
    states = [State("n", "count"), State("total", "sum", F.col("v")), State("lo", "min", F.col("v")), State("hi", "max", F.col("v")), State("one", "first", F.col("v")), State("end", "last", F.col("v"))]
    got = {r["k"]: r for r in split_aggregate(spark.createDataFrame(data, SCHEMA), ["k"], ["o"], states, slots=6).collect()}
    for k, rows in by_key(data).items():
        values = [r[2] for r in rows if r[2] is not None]
        assert (got[k]["n"], got[k]["total"], got[k]["lo"], got[k]["hi"], got[k]["one"], got[k]["end"]) == (len(rows), sum(values), min(values), max(values), rows[0][2], rows[-1][2])
    assert got["hot"]["slots"] > 1 and len(got) == 4


def test_running_values_are_stitched_over_slots(spark):
    data = sample()
    df = spark.createDataFrame(data, SCHEMA)
    out = split_running(df, ["k"], ["o"], sums={"upto": F.col("v")}, maxima={"top": F.struct("v", "o")}, slots=6)
    assert out.columns == [*df.columns, "upto", "top"]
    got = {r["o"]: (r["upto"], r["top"]["v"], r["top"]["o"]) for r in out.collect()}
    assert len(got) == len(data)
    for rows in by_key(data).values():
        total, best = 0, None
        for _, o, v, *_ in rows:
            total += v or 0
            here = (-1 if v is None else v, o)
            best = here if best is None or here > best else best
            assert got[o] == (total, None if best[0] < 0 else best[0], best[1])


def test_running_on_nothing(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(split_running(empty, ["k"], ["o"], sums={"upto": F.col("v")})) == []
    assert rows(split_aggregate(empty, ["k"], ["o"], [State("n", "count")])) == []


def test_window_and_split_give_the_same(spark, rows):
    df = spark.createDataFrame(sample(), SCHEMA)
    so_far = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    light, heavy = rows(df.withColumn("upto", F.sum(F.coalesce("v", F.lit(0))).over(so_far)), "o", "upto"), rows(running_sum(df, ["k"], ["o"], "v", "upto"), "o", "upto")
    assert light == heavy
    assert rows(numbered(df, ["k"], ["o"]), "o", "pos") == rows(df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("o"))), "o", "pos")


def test_counts_before_are_strict(spark, rows):
    points = spark.createDataFrame([("a", 5), ("a", 5), ("a", 6), ("b", 1), (None, 9), ("a", None)], "k string, t bigint")
    events = spark.createDataFrame([("a", 4), ("a", 5), ("a", 5), ("b", 1), (None, 1), ("c", 0)], "k string, t bigint")
    assert rows(counts_before(points, events, "k", "t", "n")) == sorted([("a", 5, 1), ("a", 5, 1), ("a", 6, 3), ("b", 1, 0), (None, 9, 0), ("a", None, 0)], key=repr)
