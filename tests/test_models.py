"""Trained models by their properties."""

import random

from ledgerloom.operators.models import factorised, held_out_regression, residual_codes


def test_residual_codes_tell_clusters_apart(spark):
    rng = random.Random(1)
    vectors = [(i, [(i % 4) * 10 + rng.random(), rng.random()]) for i in range(80)]
    rows = residual_codes(spark.createDataFrame(vectors, "id int, v array<float>"), "id", "v", levels=2, k=4).collect()
    assert len(rows) == 80 and all(0 <= r["code0"] < 4 and 0 <= r["code1"] < 4 for r in rows)
    assert len({(r["id"] % 4, r["code0"]) for r in rows}) == 4


def test_factorisation_ranks_own_group_first(spark):
    log = [(u, i, 1.0) for u in range(12) for i in range(10) if i % 2 == u % 2 and (u, i) != (0, 4)]
    model = factorised(spark.createDataFrame(log, "u int, i int, w double"), "u", "i", "w", rank=2)
    score = {r["i"]: r["prediction"] for r in model.transform(spark.createDataFrame([(0, 4), (0, 5)], "u int, i int")).collect()}
    assert score[4] > score[5]


def test_held_out_regression(spark):
    rng = random.Random(2)
    data = [(g, x, None if x > 0.95 else 1.0, 3 * x + 1) for g in ("a", "b", "c") for x in (rng.random() for _ in range(60))]
    rows = held_out_regression(spark.createDataFrame(data, "g string, x double, z double, y double"), "g", ["x", "z"], "y", regularisation=0.0).collect()
    assert len(rows) == 180 and all(abs(r["predicted"] - r["y"]) < 1e-6 for r in rows)
