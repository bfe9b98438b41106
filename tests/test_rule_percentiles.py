"""The two-feature rule with thresholds from the data, against a plain loop."""

import random

import numpy as np
import pytest

from ledgerloom.operators import statistics as Z
from ledgerloom.plans import registry


def by_loop(told):
    a, b, g = (np.array([np.nan if x[k] is None else x[k] for x in told], dtype=float) for k in range(3))
    grid = [np.unique(np.nanpercentile(x, np.linspace(10, 90, 9))) for x in (a, b)]
    rules = [("first", v, None, a >= v) for v in grid[0]] + [("second", None, v, b >= v) for v in grid[1]] + [("both", v, w, (a >= v) & (b >= w)) for v in grid[0] for w in grid[1]]
    kept = [(-round((g * ok).mean(), 9), round(abs(ok.mean() - 0.5), 9), form, v, w) for form, v, w, ok in rules if 0.05 <= ok.mean() <= 0.95]
    return min(kept, key=lambda r: (*r[:3], r[3] or 0, r[4] or 0))


@pytest.mark.parametrize("seed", range(3))
def test_features_beyond_any_constant(spark, seed):
    rng = random.Random(seed)
    told = []
    for _ in range(200):
        a, b = rng.choice([rng.uniform(5, 9), rng.uniform(5, 9), None]), rng.randrange(60, 4000)
        told.append((a, b, rng.gauss(0, 1) + (2 if (a or 0) > 7 and b > 1500 else -1)))
    r = Z.two_feature_rule(spark.createDataFrame(told, "top1 double, reviews int, voi double"), "top1", "reviews", "voi").collect()
    want = by_loop(told)
    assert len(r) == 1 and (r[0]["form"], r[0]["a"], r[0]["b"]) == (want[2], pytest.approx(want[3]), pytest.approx(want[4]))
    assert r[0]["gain"] == pytest.approx(-want[0], abs=1e-8)


def test_few_or_no_rows_have_no_rule(spark):
    frame = spark.createDataFrame([(0.1 * i, i, 1.0) for i in range(29)], "top1 double, reviews int, voi double")
    assert Z.two_feature_rule(frame, "top1", "reviews", "voi").collect() == [] == Z.two_feature_rule(frame.limit(0), "top1", "reviews", "voi").collect()
    assert "two_feature_rule" in registry.QUERIES
