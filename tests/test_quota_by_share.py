"""Quotas in proportion to a target histogram."""

from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.operators.drawing import by_quota, proportional_quotas
from ledgerloom.plans import registry


def test_quotas_follow_the_target(spark, rows):
    target = spark.createDataFrame([(s,) for s, n in ((0, 50), (1, 25), (2, 5), (3, 20)) for _ in range(n)], "stratum bigint")
    quotas = proportional_quotas(target, "stratum", 50, 1)
    assert rows(quotas, "stratum", "quota") == [(0, 0), (1, 12), (2, 2), (3, 10)]  # 12.5 and 2.5 to even
    pool = spark.createDataFrame([(s, f"{s}:{i}") for s in range(5) for i in range(11)], "stratum bigint, unit string")
    assert Counter(r[0] for r in rows(by_quota(pool, "stratum", F.col("unit"), quotas, "unit"), "stratum")) == {1: 11, 2: 2, 3: 10}


def test_registered_query_follows_the_tasks(spark):
    d = "/root/testdata/sf0.001"
    got = Counter(r["stratum"] for r in registry.QUERIES["stratified_quota"](spark, d).collect())
    t = spark.read.parquet(d + "/task_profile.parquet").select("index", "user_reviews_before_task").distinct().collect()
    share = Counter(min(max(n, 0), 12) for _, n in t if n is not None)
    assert got and all(n <= round(650 * share[s] / sum(share.values())) and s > 0 for s, n in got.items())
