"""Bootstrap with all rounds and over the whole grid, against plain loops."""

import random
from itertools import product

import pytest

from ledgerloom.operators import statistics as Z
from ledgerloom.plans import statistics as P


def weights(spark, n, rounds):
    z = Z.resampled(spark.range(n).withColumnRenamed("id", "run_index"), rounds, "run_index")
    return {(r["run_index"], r["round"]): r["weight"] for r in z.collect()}


def test_5000_rounds(spark):
    paired = [(i, "d", random.Random(i).uniform(-1, 1.2)) for i in range(40)]
    r = P.bootstrapped(spark.createDataFrame(paired, "run_index bigint, dataset string, voi double"), ["dataset"], 5000).head()
    w = weights(spark, 40, 5000)
    assert 0.98 < sum(w.values()) / len(w) < 1.02
    means = sorted(sum(x * v for x, (_, _, v) in zip(ws, paired)) / sum(ws) for ws in ([w[i, j] for i, _, _ in paired] for j in range(1, 5001)))
    q = lambda p: means[int(p * 4999)] + (p * 4999 % 1) * (means[int(p * 4999) + 1] - means[int(p * 4999)])
    assert r["lo"] == pytest.approx(q(0.025), abs=2e-6) and r["hi"] == pytest.approx(q(0.975), abs=2e-6)
    assert r["p"] == pytest.approx(min(1, 2 * min(sum(m <= 0 for m in means), sum(m >= 0 for m in means)) / 5000), abs=1e-6)


def test_whole_grid_in_every_round(spark):
    rng, rounds = random.Random(3), 12
    told = [(i, rng.randrange(0, 12), rng.choice([0, 1999, 2000, 5000]), rng.random(), rng.choice([0.0, 0.1, 0.4]), rng.choice([0.0, 0.3, 0.5]), rng.random(), rng.random()) for i in range(40)]
    rows = [(*x, x[7] - x[6]) for x in told]
    frame = spark.createDataFrame(rows, "run_index bigint, reviews int, chars bigint, richness double, margin double, top1 double, hm double, hmt double, voi double")
    dense, rich, dealt = [], [], weights(spark, 40, rounds)
    for j in range(1, rounds + 1):
        best = None
        for g in product(*P.GRID.values()):
            n = right = earned = 0
            for i, reviews, chars, richness, margin, top1, hm, hmt, voi in rows:
                use = False if (reviews >= g[0] or chars >= 2000) and richness >= g[1] else True if reviews <= g[0] else margin >= g[2] or top1 >= g[3]
                w = dealt[i, j]
                n, right, earned = n + w, right + w * (use == (voi > 0)), earned + w * (hmt if use else hm)
            key = (-round(right / n, 9), -round(earned / n, 9), *g)
            best = min(best or key, key)
        dense.append(best[2]), rich.append(best[3])
    dense, rich = sorted(dense), sorted(rich)
    at = [round(q * (rounds - 1)) for q in (0.025, 0.975)]
    got = {r["threshold"]: (r["lo"], r["hi"]) for r in P.threshold_spread(frame, rounds).collect()}
    assert got == {"reviews": (dense[at[0]], dense[at[1]]), "richness": (rich[at[0]], rich[at[1]])}
