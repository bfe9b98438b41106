"""Cases of single operators: heaps, mixed histories, nearest vectors in blocks, token cuts, covariate shift."""

from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.aggregates import bounded_heap
from ledgerloom.functions.texts import truncated
from ledgerloom.operators.asof import Attribute, attributes_as_of
from ledgerloom.operators.codes import nearest
from ledgerloom.operators.models import covariate_shift

VOCABULARY = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")


def test_heap_of_this_version(spark):
    """The heap is an internal aggregate of Spark; these are the versions it is known to be in."""
    assert pyspark.__version__.split(".")[0] == "4"
    df = spark.createDataFrame([(1, 3), (1, 1), (1, None), (1, 2), (2, None)], "k int, v int").repartition(4)
    assert {r["k"]: r["h"] for r in df.groupBy("k").agg(bounded_heap(F.col("v"), 2).alias("h")).collect()} == {1: [1, 2], 2: []}


def test_histories_of_two_types(spark):
    history = lambda kind: spark.createDataFrame([], f"entity_id string, valid_from timestamp, known_from timestamp, version bigint, value {kind}")
    events = spark.createDataFrame([("u", 1.0)], "u string, at double")
    with pytest.raises(ValueError, match="one type"):
        attributes_as_of(events, "at", [Attribute("a", "u", history("bigint")), Attribute("b", "u", history("string"))])


def test_nearest_in_blocks(spark, rows):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5) + 1]) for i in range(20)] + [(None, [1.0, 1.0]), (99, None)], "vec_id bigint, embedding array<float>")
    whole = rows(nearest(v, v, 3))
    assert whole == rows(nearest(v, v, 3, block=2, blocks=3)) and len(whole) == 60
    assert rows(nearest(v.limit(0), v, 3)) == []


def test_token_cut(spark, rows):
    if not VOCABULARY.exists():
        pytest.skip("no vocabulary here")
    pytest.importorskip("tiktoken")
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+"""
    df = spark.createDataFrame([(1, "one two three four five"), (2, "short"), (3, None), (4, ""), (5, "\U0001f600" * 9)], "id int, t string")
    got = dict(rows(truncated(df, "t", 3, str(VOCABULARY), pattern)))
    assert got[1] == "one two three" and got[2] == "short" and got[3] is None and got[4] == "" and "\U0001f600" * 9 != got[5]


def test_covariate_shift(spark):
    rows = [(i, i % 2 == 0, float(i % 7) + (3 if i % 2 == 0 else 0), float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "run_index bigint, here boolean, a double, b double")
    shifted, not_shifted = covariate_shift(df, "here", ["a", "b"], 3).head(), covariate_shift(df, "here", ["b"], 3).head()
    assert shifted["auc"] > 0.8 and 0.35 < not_shifted["auc"] < 0.65 and shifted["rows"] == 300
