"""As-of attributes against a literal search."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.asof import Attribute, attributes_as_of

HISTORY = "entity_id string, valid_from timestamp, known_from timestamp, version bigint, value bigint"


def at(s):
    return datetime.fromtimestamp(s, UTC) if s is not None else None


def known(history, entity, t):
    seen = [(v, k, n, x) for e, v, k, n, x in history if e == entity and None not in (e, v, k, x) and v < t and k < t]
    return max(seen)[3] if seen else 0


@pytest.mark.parametrize("slots", [None, 5])
def test_matches_a_literal_search(spark, slots):
    rng = random.Random(3)
    make = lambda first: [(rng.choice(["hot", "hot", "hot", "u1", "u2", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(40)]), first + i, rng.choice([None, *range(9)])) for i in range(300)]
    users, items = make(0), make(1000)
    events = [(i, rng.choice(["hot", "u1", "nobody", None]), rng.choice(["hot", "u2"]), rng.choice([None, float("nan"), *map(float, range(42)), 7.5])) for i in range(200)]
    history = lambda rows: spark.createDataFrame([(e, at(v), at(k), n, x) for e, v, k, n, x in rows], HISTORY)
    frame = spark.createDataFrame(events, "id bigint, user string, item string, time double")
    zero = F.lit(0).cast("bigint")
    out = attributes_as_of(frame, "time", [Attribute("u", "user", history(users), zero), Attribute("i", "item", history(items), zero)], slots=slots)
    got = {r["id"]: (r["u"], r["i"]) for r in out.collect()}
    assert len(got) == len(events)
    for i, user, item, t in events:
        blank = t is None or t != t
        assert got[i] == ((0, 0) if blank else (known(users, user, t), known(items, item, t)))


def test_empty_tables_repeats_and_clashes(spark, rows):
    none = spark.createDataFrame([], HISTORY)
    events = spark.createDataFrame([(1, "a", 5.0), (1, "a", 5.0)], "id bigint, user string, time double")
    assert rows(attributes_as_of(events, "time", [Attribute("n", "user", none, F.lit(0).cast("bigint"))])) == [(1, "a", 5.0, 0)]
    assert rows(attributes_as_of(events.limit(0), "time", [Attribute("n", "user", none)])) == []
    with pytest.raises(ValueError, match="already"):
        attributes_as_of(events, "time", [Attribute("user", "user", none)])
