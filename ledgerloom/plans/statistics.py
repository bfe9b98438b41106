"""Queries on paired gains, significance, thresholds and samples."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import policies
from ledgerloom.functions.scores import ndcg
from ledgerloom.operators import statistics as Z
from ledgerloom.operators.drawing import by_hash, by_quota, disjoint_by_condition, proportional_quotas
from ledgerloom.operators.numbering import numbered
from ledgerloom.plans.ingest import _register
from ledgerloom.plans.views import CONDITIONS, I, R, V, gains, interactions, rankings
from ledgerloom.sources.durable import durable
from ledgerloom.sources.tables import table

QUERIES, SQL, query = _register()
CELL = ["backbone", "dataset", "condition"]
_CELL = 'backbone, dataset, "condition"'


@query(f"WITH {V} SELECT {_CELL}, count(*)::BIGINT n, round(avg(voi), 6) voi, round(avg((voi > 1e-9)::INT), 6) help, round(avg((voi < -1e-9)::INT), 6) hurt, round(avg(hm), 6) hm, round(avg(hmt), 6) hmt FROM v GROUP BY 1, 2, 3")
def voi_by_cell(spark, d):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return gains(spark, d).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("voi"), 6).alias("voi"), share(F.col("voi") > 1e-9).alias("help"), share(F.col("voi") < -1e-9).alias("hurt"), F.round(F.avg("hm"), 6).alias("hm"), F.round(F.avg("hmt"), 6).alias("hmt")
    )


@query(f"WITH {V}, c AS (SELECT {_CELL}, round(avg(voi), 9) m FROM v GROUP BY 1, 2, 3), k AS (SELECT m FROM c WHERE abs(m) > 1e-4) SELECT count(*)::BIGINT cells, round(greatest(avg((m < 0)::INT), 1 - avg((m < 0)::INT)), 6) base FROM k")
def voi_cell_baseline(spark, d):
    """Over cells with a mean that is not nearly zero: how often the commoner sign is right."""
    c = gains(spark, d).groupBy(*CELL).agg(F.round(F.avg("voi"), 9).alias("m")).where(F.abs("m") > 1e-4)
    negative = F.avg(F.when(F.col("m") < 0, 1.0).otherwise(0.0))
    return c.agg(F.count(F.lit(1)).alias("cells"), F.round(F.greatest(negative, 1 - negative), 6).alias("base"))


#: The fewest rows for a paired test, a scope, a calibration, an importance, a router.
GUARDS = {"paired": 5, "scope": 20, "calibration": 30, "importance": 40, "router": 60}


@query(f"WITH {V} SELECT {_CELL}, count(*)::BIGINT n, " + ", ".join(f"count(*) >= {n} AS {k}" for k, n in GUARDS.items()) + f" FROM v GROUP BY 1, 2, 3 HAVING count(*) >= {GUARDS['paired']}")
def guarded_scopes(spark, d):
    """Scopes with rows enough for a paired test, and what else they have enough for."""
    n = gains(spark, d).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= GUARDS["paired"])
    return n.select(*CELL, "n", *((F.col("n") >= least).alias(k) for k, least in GUARDS.items()))


@query(f"WITH {V} SELECT dataset, coalesce(\"condition\", 'POOLED') scope, count(*)::BIGINT n, round(avg(voi), 6) delta FROM v GROUP BY GROUPING SETS ((dataset, \"condition\"), (dataset))")
def pooled_delta(spark, d):
    v = gains(spark, d)
    sets = v.groupingSets([("dataset", "condition"), ("dataset",)], "dataset", "condition")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("voi"), 6).alias("delta")).select("dataset", F.coalesce("condition", F.lit("POOLED")).alias("scope"), "n", "delta")


@query(f"WITH {V} SELECT coalesce(dataset, 'POOLED') dataset, coalesce(\"condition\", 'POOLED') scope, count(*)::BIGINT n, round(avg(hm), 6) hm, round(avg(hmt), 6) hmt, round(avg(hmt) - avg(hm), 6) delta FROM v GROUP BY ROLLUP (dataset, \"condition\")")
def rescoring_rollup(spark, d):
    r = gains(spark, d).rollup("dataset", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg("hm").alias("a"), F.avg("hmt").alias("b"))
    return r.select(F.coalesce("dataset", F.lit("POOLED")).alias("dataset"), F.coalesce("condition", F.lit("POOLED")).alias("scope"), "n", F.round("a", 6).alias("hm"), F.round("b", 6).alias("hmt"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query(f"WITH {V}, c AS (SELECT {_CELL}, count(*) n, avg(voi) m FROM v GROUP BY 1, 2, 3) SELECT dataset, sum(n)::BIGINT n, round(sum(n * m) / sum(n), 6) mean FROM c GROUP BY 1")
def weighted_aggregate(spark, d):
    """Cell means weighed by their sizes."""
    c = gains(spark, d).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.avg("voi").alias("m"))
    return c.groupBy("dataset").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 6).alias("mean"))


_SEL = "greatest(0, avg(voi)) bf, avg(greatest(voi, 0)) - greatest(0, avg(voi)) oracle, avg(CASE WHEN hm < 0.4 THEN voi ELSE 0 END) - greatest(0, avg(voi)) realized"


@query(f"WITH {V}, q AS (SELECT dataset, {_SEL} FROM v GROUP BY 1) SELECT dataset, round(bf, 6) best_fixed, round(oracle, 6) oracle, round(realized, 6) realized, CASE WHEN oracle > 1e-9 THEN round(realized / oracle, 5) END fraction FROM q")
def selector_stats(spark, d):
    """What a selector gains over the better fixed choice, and of what is to be gained."""
    q = gains(spark, d).groupBy("dataset").agg(
        F.greatest(F.lit(0.0), F.avg("voi")).alias("bf"), F.avg(F.greatest("voi", F.lit(0.0))).alias("best"), F.avg(F.when(F.col("hm") < 0.4, F.col("voi")).otherwise(0.0)).alias("got")
    ).select("dataset", "bf", (F.col("best") - F.col("bf")).alias("oracle"), (F.col("got") - F.col("bf")).alias("realized"))
    return q.select("dataset", F.round("bf", 6).alias("best_fixed"), F.round("oracle", 6).alias("oracle"), F.round("realized", 6).alias("realized"), F.when(F.col("oracle") > 1e-9, F.round(F.col("realized") / F.col("oracle"), 5)).alias("fraction"))


_EAA = "greatest(avg(hm), avg(hmt)) fixed, avg(greatest(hm, hmt)) best, avg(eaa) eaa, count(*) n"
_THIRD = f"""{V}, {R("rnd", "rc")}, e AS (SELECT v.*, CASE WHEN coalesce(list_position(output, target), 0) BETWEEN 1 AND 5 THEN 1 / log2(list_position(output, target) + 1) ELSE 0e0 END eaa FROM v JOIN rc ON rc."index" = run_index WHERE output IS NOT NULL)"""


@query(f"WITH {_THIRD}, q AS (SELECT coalesce(dataset, 'ALL') scope, {_EAA} FROM e GROUP BY GROUPING SETS ((dataset), ())) SELECT scope, n::BIGINT n, CASE WHEN best - fixed > 1e-9 THEN round((eaa - fixed) / (best - fixed), 5) END recovered FROM q WHERE n >= 20")
def eaa_recovered(spark, d):
    """Share of the headroom that a third run recovers, pooled and by dataset; tasks without its output are left out."""
    third = rankings(spark, d, "rnd").where("output IS NOT NULL").select(F.col("index").alias("run_index"), ndcg(F.col("output"), F.col("target"), 5).alias("eaa"))
    q = gains(spark, d).join(third, "run_index").rollup("dataset").agg(F.greatest(F.avg("hm"), F.avg("hmt")).alias("fixed"), F.avg(F.greatest("hm", "hmt")).alias("best"), F.avg("eaa").alias("eaa"), F.count(F.lit(1)).alias("n"))
    room = F.col("best") - F.col("fixed")
    return q.where("n >= 20").select(F.coalesce("dataset", F.lit("ALL")).alias("scope"), "n", F.when(room > 1e-9, F.round((F.col("eaa") - F.col("fixed")) / room, 5)).alias("recovered"))


#: Resamples; the operator's default.
ROUNDS = 5000
_BOOT = f"{V}, {Z.RESAMPLED('v', 'run_index', ROUNDS)}"
_MEANS = "round(sum(weight * voi) / nullif(sum(weight), 0), 12) m"
_TEST = "round(quantile_cont(m, 0.025), 6) lo, round(quantile_cont(m, 0.975), 6) hi, round(least(1.0, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))), 6)::DOUBLE p"
_VERDICT = "CASE WHEN lo > 0 THEN 'helps*' WHEN hi < 0 THEN 'hurts*' ELSE 'ns' END"


def bootstrapped(paired: DataFrame, by: list[str], rounds: int = ROUNDS) -> DataFrame:
    """Per ``by`` the interval of the mean gain over resamples of the runs, and the two-sided p."""
    z = Z.resampled(paired.select("run_index", *by, "voi"), rounds, "run_index")
    m = z.groupBy(*by, "round").agg(F.round(F.try_divide(F.sum(F.col("weight") * F.col("voi")), F.sum("weight")), 12).alias("m")).where("m IS NOT NULL")
    sign = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return m.groupBy(*by).agg(F.round(F.percentile("m", 0.025), 6).alias("lo"), F.round(F.percentile("m", 0.975), 6).alias("hi"), F.round(F.least(F.lit(1.0), 2 * F.least(sign(F.col("m") <= 0), sign(F.col("m") >= 0))), 6).alias("p"))


def _spread(spark, df: DataFrame) -> DataFrame:
    """Rows are few, what becomes of them is many: over all cores."""
    return df.repartition(2 * spark.sparkContext.defaultParallelism)


def _verdict():
    return F.when(F.col("lo") > 0, "helps*").when(F.col("hi") < 0, "hurts*").otherwise("ns")


@query(f"WITH {_BOOT}, m AS (SELECT dataset, round, {_MEANS} FROM z GROUP BY 1, 2), b AS (SELECT dataset, {_TEST} FROM m WHERE m IS NOT NULL GROUP BY 1), a AS (SELECT dataset, count(*)::BIGINT n, round(avg(voi), 6) delta FROM v GROUP BY 1) SELECT dataset, n, delta, lo, hi, p, {_VERDICT} verdict, delta > 0 AND lo > 0 AS compelling FROM b JOIN a USING (dataset)")
def paired_bootstrap(spark, d):
    """Mean gain over resamples of the runs: interval, two-sided p and what they say."""
    v = gains(spark, d).select("run_index", "dataset", "voi")
    a = v.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("voi"), 6).alias("delta"))
    b = bootstrapped(_spread(spark, v), ["dataset"]).join(a, "dataset")
    return b.select("dataset", "n", "delta", "lo", "hi", "p", _verdict().alias("verdict"), ((F.col("delta") > 0) & (F.col("lo") > 0)).alias("compelling"))


_BH = f"""{_BOOT}, k0 AS (SELECT {_CELL}, round, {_MEANS} FROM z GROUP BY 1, 2, 3, 4), b AS (SELECT {_CELL}, {_TEST} FROM k0 WHERE m IS NOT NULL GROUP BY 1, 2, 3), a AS (SELECT {_CELL}, avg(voi) delta FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 5),
k AS (SELECT backbone || dataset || "condition" id, lo, hi, p, delta, row_number() OVER (ORDER BY p, backbone || dataset || "condition") r, count(*) OVER () n FROM b JOIN a USING (backbone, dataset, "condition")), bh AS (SELECT *, least(1e0, min(p * n / r) OVER (ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)) p_bh FROM k)"""


def _tested(spark, d):
    v = gains(spark, d).select("run_index", *CELL, "voi")
    a = v.groupBy(*CELL).agg(F.avg("voi").alias("delta"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= GUARDS["paired"]).drop("n")
    return Z.benjamini_hochberg(bootstrapped(_spread(spark, v), CELL).join(a, CELL).withColumn("id", F.concat(*CELL)), "p")


@query(f"WITH {_BH} SELECT id, p, round(p_bh, 6) p_bh FROM bh")
def bh_fdr(spark, d):
    """The p of each cell with rows enough, and as adjusted for their number."""
    return _tested(spark, d).select("id", "p", F.round("p_bh", 6).alias("p_bh"))


#: Share of false discoveries that a verdict allows.
ALPHA = 0.05


@query(f"WITH {_BH} SELECT id, {_VERDICT} verdict, CASE WHEN p_bh < {ALPHA} AND delta > 0 THEN 'helps*' WHEN p_bh < {ALPHA} AND delta < 0 THEN 'hurts*' ELSE 'ns' END verdict_bh FROM bh")
def verdicts(spark, d):
    """By the interval, and by the adjusted p."""
    sure = F.col("p_bh") < ALPHA
    return _tested(spark, d).select("id", _verdict().alias("verdict"), F.when(sure & (F.col("delta") > 0), "helps*").when(sure & (F.col("delta") < 0), "hurts*").otherwise("ns").alias("verdict_bh"))


@query(f"WITH {V}, o AS (SELECT run_index, dataset, row_number() OVER (PARTITION BY dataset ORDER BY md5(run_index::VARCHAR), run_index) r, count(*) OVER (PARTITION BY dataset) n FROM v) SELECT run_index, dataset, CASE WHEN r <= least(n - 1, greatest(1, round_even(n * 0.3e0, 0))) THEN 'validation' ELSE 'heldout' END part FROM o")
def validation_split(spark, d):
    """Three tenths of each dataset by the order of a hash, rounded to even, at least one where there are two, never all."""
    v = gains(spark, d).select("run_index", "dataset", F.md5(F.col("run_index").cast("string")).alias("h"))
    sizes = v.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    r = numbered(v, ["dataset"], ["h", "run_index"], "r").join(sizes, "dataset")
    cut = F.least(F.col("n") - 1, F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(0.3), 0).cast("bigint")))
    return r.select("run_index", "dataset", F.when(F.col("r") <= cut, "validation").otherwise("heldout").alias("part"))


@query(f"WITH {V}, c AS (SELECT {_CELL}, avg(voi) m FROM v GROUP BY 1, 2, 3) SELECT {_CELL}, round((m - avg(m) OVER (PARTITION BY dataset)) / nullif(stddev_pop(m) OVER (PARTITION BY dataset), 0), 5) z FROM c")
def zscore_cells(spark, d):
    c = gains(spark, d).groupBy(*CELL).agg(F.avg("voi").alias("m"))
    w = Window.partitionBy("dataset")  # one row per cell
    return c.select(*CELL, F.round(F.try_divide(F.col("m") - F.avg("m").over(w), F.nullif(F.stddev_pop("m").over(w), F.lit(0.0))), 5).alias("z"))


@query(f"WITH {V} SELECT run_index, CASE WHEN backbone = 'b1' AND dataset = 'yelp' THEN 'special' WHEN dataset = 'yelp' THEN 'y' WHEN dataset = 'amazon' THEN 'a' ELSE 'none' END path FROM v")
def override_lookup(spark, d):
    """A value by cell if the cell has its own, else by dataset, else a default."""
    v = gains(spark, d).select("run_index", "backbone", "dataset")
    own = spark.createDataFrame([("b1", "yelp", "special")], "backbone string, dataset string, own string")
    general = spark.createDataFrame([("yelp", "y"), ("amazon", "a")], "dataset string, general string")
    found = v.join(F.broadcast(own), ["backbone", "dataset"], "left").join(F.broadcast(general), "dataset", "left")
    return found.select("run_index", F.coalesce("own", "general", F.lit("none")).alias("path"))


@query(f"WITH {V}, k AS (SELECT dataset, avg(hm) m FROM v WHERE run_index % 2 = 0 GROUP BY 1) SELECT run_index, round(coalesce(CASE WHEN backbone = 'b0' THEN 7.0 END, m, 0), 6) capability, round(power(coalesce(CASE WHEN backbone = 'b0' THEN 7.0 END, m, 0), 2), 6) squared FROM v LEFT JOIN k USING (dataset)")
def capability(spark, d):
    """A known size, else the training part's mean score, else 0; and its square."""
    v = gains(spark, d)
    k = v.where("run_index % 2 = 0").groupBy("dataset").agg(F.avg("hm").alias("m"))
    value = F.coalesce(F.when(F.col("backbone") == "b0", 7.0), "m", F.lit(0.0))
    return v.join(k, "dataset", "left").select("run_index", F.round(value, 6).alias("capability"), F.round(value * value, 6).alias("squared"))


@query('SELECT DISTINCT "index"::BIGINT AS "index", round(ln(1 + user_reviews_before_task), 6) log_user, round(ln(1 + item_reviews_before_task), 6) log_item FROM task_profile')
def log_features(spark, d):
    t = table(spark, d, "task_profile").select(F.col("index").cast("bigint").alias("index"), "user_reviews_before_task", "item_reviews_before_task").distinct()
    return t.select("index", F.round(F.log1p("user_reviews_before_task"), 6).alias("log_user"), F.round(F.log1p("item_reviews_before_task"), 6).alias("log_item"))


@query("SELECT DISTINCT l_discount price, printf('%.3f', round(CAST(l_discount AS DECIMAL(20,10)), 3)) shown FROM lineitem")
def round_half_up(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_discount").alias("price")).distinct()
    return x.select("price", F.round(F.col("price").cast("decimal(20,10)"), 3).cast("decimal(20,3)").cast("string").alias("shown"))


@query(f"WITH {V}, s AS (SELECT dataset, count(*)::DOUBLE n, sum(hm) x, sum(voi) y, sum(hm * hm) xx, sum(hm * voi) xy, sum(voi * voi) yy FROM v GROUP BY 1), f AS (SELECT a.dataset, (sum(b.n) * sum(b.xy) - sum(b.x) * sum(b.y)) / (sum(b.n) * sum(b.xx) - sum(b.x) * sum(b.x)) slope, sum(b.y) sy, sum(b.x) sx, sum(b.n) n FROM s a JOIN s b ON a.dataset <> b.dataset GROUP BY 1), e AS (SELECT v.dataset, voi, (sy - slope * sx) / n + slope * hm q, slope FROM v JOIN f USING (dataset)) SELECT dataset, round(max(slope), 6) slope, round(1 - sum((voi - q) * (voi - q)) / (sum(voi * voi) - sum(voi) * sum(voi) / count(*)), 5) r2, round(avg((sign(round(voi, 9)) = sign(round(q, 9)))::INT), 6) signs FROM e GROUP BY 1")
def lodo_linear(spark, d):
    """A line fitted on the other datasets, tested on each one: moments are summed once, the rest is arithmetic."""
    v = gains(spark, d)
    moments = {"n": F.count(F.lit(1)).cast("double"), "x": F.sum("hm"), "y": F.sum("voi"), "xx": F.sum(F.col("hm") * F.col("hm")), "xy": F.sum(F.col("hm") * F.col("voi"))}
    s = v.groupBy("dataset").agg(*(c.alias(k) for k, c in moments.items()))
    every = Window.partitionBy(F.lit(0))  # a row per dataset
    others = s.select("dataset", *((F.sum(k).over(every) - F.col(k)).alias(k) for k in moments))
    slope, intercept = Z.fit_line(*(F.col(k) for k in moments))
    e = v.join(others.select("dataset", slope.alias("slope"), intercept.alias("intercept")), "dataset").withColumn("q", F.col("intercept") + F.col("slope") * F.col("hm"))
    left = F.sum((F.col("voi") - F.col("q")) * (F.col("voi") - F.col("q")))
    whole = F.sum(F.col("voi") * F.col("voi")) - F.sum("voi") * F.sum("voi") / F.count(F.lit(1))
    same = F.avg(F.when(F.signum(F.round("voi", 9)) == F.signum(F.round("q", 9)), 1.0).otherwise(0.0))
    return e.groupBy("dataset").agg(F.round(F.max("slope"), 6).alias("slope"), F.round(1 - left / whole, 5).alias("r2"), F.round(same, 6).alias("signs"))


@query(f"WITH {V}, c AS (SELECT {_CELL}, avg(voi) m, avg(CASE WHEN run_index % 2 = 0 THEN voi END) q FROM v GROUP BY 1, 2, 3) SELECT dataset, count(*)::BIGINT cells, round(avg((sign(round(m, 9)) = sign(round(coalesce(q, 0), 9)))::INT), 6) accuracy FROM c WHERE abs(m) > 1e-4 GROUP BY 1")
def sign_accuracy(spark, d):
    """How often half of the runs tell the sign of all, over cells that are not nearly zero."""
    c = gains(spark, d).groupBy(*CELL).agg(F.avg("voi").alias("m"), F.avg(F.when(F.col("run_index") % 2 == 0, F.col("voi"))).alias("q")).where(F.abs("m") > 1e-4)
    same = F.signum(F.round("m", 9)) == F.signum(F.round(F.coalesce("q", F.lit(0.0)), 9))
    return c.groupBy("dataset").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg(F.when(same, 1.0).otherwise(0.0)), 6).alias("accuracy"))


_SIG = f"""{V}, t0 AS (SELECT DISTINCT "index"::BIGINT run_index, user_reviews_before_task reviews, len(candidate_item_ids) * 100 chars, (item_reviews_before_task % 100) / 100.0::DOUBLE richness FROM task_profile),
sg AS (SELECT v.*, reviews, chars::BIGINT chars, richness::DOUBLE richness, round(abs(voi), 6) margin, round(hm, 6) top1 FROM v JOIN t0 USING (run_index))"""
_REASON = "CASE WHEN (reviews >= 5 OR chars >= 3000) AND richness >= 0.45 THEN 'redundant' WHEN reviews <= 5 THEN 'sparse' WHEN margin >= 0.02 OR top1 >= 0.15 THEN 'confident' ELSE 'unsure' END"


def _signals(spark, d) -> DataFrame:
    """Evidence per task: reviews, text size, richness, margin and top score."""
    t = table(spark, d, "task_profile").select(
        F.col("index").cast("bigint").alias("run_index"), F.col("user_reviews_before_task").alias("reviews"), (F.size("candidate_item_ids") * 100).cast("bigint").alias("chars"), ((F.col("item_reviews_before_task") % 100) / 100.0).alias("richness")
    ).distinct()
    return gains(spark, d).join(t, "run_index").withColumns({"margin": F.round(F.abs("voi"), 6), "top1": F.round("hm", 6)})


def _reason():
    return policies.evidence_reason(*(F.col(c) for c in ("reviews", "chars", "richness", "margin", "top1")), policies.Thresholds(dense_chars=3000))


@query(f"WITH {_SIG}, q AS (SELECT run_index, reviews, {_REASON} reason FROM sg) SELECT run_index, reason, concat_ws('+', CASE WHEN reviews >= 1 THEN 'H' END, 'M', CASE WHEN reason IN ('sparse', 'confident') THEN 'S' END) modules FROM q")
def policy_select(spark, d):
    s = _signals(spark, d).withColumn("reason", _reason())
    return s.select("run_index", "reason", policies.modules(F.col("reviews"), F.col("reason")).alias("modules"))


@query(f"WITH {_SIG} SELECT run_index, CASE WHEN reviews = 0 THEN 'M+S' WHEN \"condition\" = 'evolving_interest' THEN 'H+M' WHEN \"condition\" = 'cold_start_user' THEN 'H+M+S' WHEN reviews <= 5 THEN 'H+M+S' ELSE 'H+M' END modules FROM sg")
def policy_v3(spark, d):
    return _signals(spark, d).select("run_index", policies.scenario_modules(F.col("reviews"), F.col("condition")).alias("modules"))


@query(f"WITH {_SIG}, q AS (SELECT dataset, {_REASON} reason, hm, hmt, voi FROM sg) SELECT dataset, round(avg(((reason IN ('sparse', 'confident')) = (voi > 0))::INT), 6) esa, round(100 * avg((reason IN ('sparse', 'confident'))::INT), 1) usage, round(avg(CASE WHEN reason IN ('sparse', 'confident') THEN hmt ELSE hm END), 6) earned FROM q GROUP BY 1")
def policy_esa(spark, d):
    """How often the choice is the better one, how often codes are shown, what that earns."""
    s = _signals(spark, d).withColumn("use", _reason().isin("sparse", "confident"))
    right = F.avg(F.when(F.col("use") == (F.col("voi") > 0), 1.0).otherwise(0.0))
    return s.groupBy("dataset").agg(F.round(right, 6).alias("esa"), F.round(100 * F.avg(F.when(F.col("use"), 1.0).otherwise(0.0)), 1).alias("usage"), F.round(F.avg(F.when(F.col("use"), F.col("hmt")).otherwise(F.col("hm"))), 6).alias("earned"))


#: The axes of the calibration, and the history length from which it counts as dense.
GRID = {"g_dense": (1, 2, 3, 4, 5, 6, 7, 8), "g_rich": (0.30, 0.35, 0.40, 0.45, 0.50, 0.55), "g_margin": (0.01, 0.02, 0.05, 0.08, 0.10), "g_top1": (0.10, 0.15, 0.20, 0.25)}
DENSE_CHARS = 2000
_AXES = {"g_dense": "reviews", "g_rich": "richness", "g_margin": "margin", "g_top1": "top1"}
_GRID = ", ".join(f"(SELECT unnest([{', '.join(map(str, v))}])::DOUBLE {k}, unnest(range(1, {len(v) + 1})) i{k})" for k, v in GRID.items())
_REACHED = ", ".join(f"len(list_filter([{', '.join(map(str, v))}]::DOUBLE[], lambda x: x <= {_AXES[k]})) a{k}" for k, v in GRID.items())
_USE = "CASE WHEN (ag_dense >= ig_dense OR long) AND ag_rich >= ig_rich THEN false WHEN past < ig_dense THEN true ELSE ag_margin >= ig_margin OR ag_top1 >= ig_top1 END"


def _GRID_SQL(rows: str, weight: str, by: str = "") -> str:  # noqa: N802
    """Cells of rows that reach the same grid values, met by the grid; ``ev`` has what each setting gets."""
    first = f"{by}, " if by else ""
    return f"""ce AS (SELECT {first}{_REACHED}, len(list_filter([{', '.join(map(str, GRID["g_dense"]))}]::DOUBLE[], lambda x: x < reviews)) past, chars >= {DENSE_CHARS} AS long, voi > 0 AS truth, sum({weight}) n, sum({weight} * hmt) yes, sum({weight} * hm) AS no FROM {rows} GROUP BY ALL),
gr AS (SELECT *, {_USE} AS use FROM ce, {_GRID} WHERE n > 0),
ev AS MATERIALIZED (SELECT {first}g_dense, g_rich, g_margin, g_top1, round(sum(CASE WHEN use = truth THEN n ELSE 0 END) / sum(n), 9) agreement, round(sum(CASE WHEN use THEN yes ELSE no END) / sum(n), 9) earned FROM gr GROUP BY ALL)"""


def _evaluated(signals: DataFrame, by: str | None = None, weight: str | None = None) -> DataFrame:
    """What each of the 960 settings gets: the first axis moves the bound of a dense and of a sparse history."""
    grid = signals.sparkSession.createDataFrame([tuple(map(float, x)) for x in product(*GRID.values())], ", ".join(f"{k} double" for k in GRID)).coalesce(1)
    extra = [c for c in (by, weight) if c]
    s = signals.select("reviews", "richness", "margin", "top1", *extra, (F.col("chars") >= DENSE_CHARS).alias("long"), (F.col("voi") > 0).alias("truth"), F.col("hmt").alias("yes"), F.col("hm").alias("no"))
    decide = F.when((F.col("ge_reviews") | F.col("long")) & F.col("ge_richness"), False).when(~F.col("gt_reviews"), True).otherwise(F.col("ge_margin") | F.col("ge_top1"))
    return Z.best_of_grid(s, grid, {x: g for g, x in _AXES.items()}, decide, "truth", "yes", "no", by, weight, strict=("reviews",))


_BEST = "ORDER BY agreement DESC, earned DESC, g_dense, g_rich, g_margin, g_top1 LIMIT 1"


@query(f"WITH {_SIG}, {_GRID_SQL('sg', '1')}, b AS (SELECT *, (SELECT count(*) FROM ev e WHERE e.agreement = ev.agreement AND e.earned = ev.earned) ties FROM ev {_BEST}) SELECT g_dense, g_rich, g_margin, g_top1, round(agreement, 6) agreement, round(earned, 6) earned, ties::BIGINT ties FROM b")
def policy_grid_search(spark, d):
    """The best of 960 settings: agreement, then earnings, then the first; and how many are as good."""
    e = _evaluated(_signals(spark, d))
    best = e.groupBy("agreement", "earned").agg(F.min(F.struct(*GRID)).alias("b"), F.count(F.lit(1)).alias("ties")).orderBy(F.desc("agreement"), F.desc("earned")).limit(1)
    return best.select("b.*", F.round("agreement", 6).alias("agreement"), F.round("earned", 6).alias("earned"), "ties")


@query(f"WITH {_SIG}, {_GRID_SQL('sg', '1')}, b AS (SELECT * FROM ev {_BEST}) SELECT ev.g_margin, round(ev.agreement, 6) agreement, round(ev.earned, 6) earned FROM ev JOIN b ON ev.g_dense = b.g_dense AND ev.g_rich = b.g_rich AND ev.g_top1 = b.g_top1")
def sensitivity_sweep(spark, d):
    """The optimum with one threshold moved."""
    e = durable(_evaluated(_signals(spark, d)), "settings")  # 960 rows
    best = e.orderBy(F.desc("agreement"), F.desc("earned"), *GRID).limit(1).select("g_dense", "g_rich", "g_top1")
    return e.join(F.broadcast(best), ["g_dense", "g_rich", "g_top1"]).select("g_margin", F.round("agreement", 6).alias("agreement"), F.round("earned", 6).alias("earned"))


CI_ROUNDS = 200


@query(f"""WITH {_SIG}, {Z.RESAMPLED('sg', 'run_index', CI_ROUNDS)}, {_GRID_SQL('z', 'weight', 'round')}, b AS (SELECT round, arg_min(g_dense, (-agreement, -earned, g_dense, g_rich, g_margin, g_top1)) dense, arg_min(g_rich, (-agreement, -earned, g_dense, g_rich, g_margin, g_top1)) rich FROM ev GROUP BY 1),
l AS (SELECT 'reviews' AS threshold, list(dense ORDER BY dense) s FROM b UNION ALL SELECT 'richness', list(rich ORDER BY rich) FROM b) SELECT threshold, s[round_even(0.025 * (len(s) - 1), 0)::INT + 1] lo, s[round_even(0.975 * (len(s) - 1), 0)::INT + 1] hi FROM l""")
def threshold_ci(spark, d):
    """Spread of the best review and richness thresholds over resamples, the 960 settings searched in each; nearest ranks."""
    return threshold_spread(_signals(spark, d), CI_ROUNDS)


def threshold_spread(signals: DataFrame, rounds: int) -> DataFrame:
    s = signals.select("run_index", "reviews", "chars", "richness", "margin", "top1", "voi", "hm", "hmt")
    e = _evaluated(Z.resampled(s, rounds, "run_index"), "round", "weight")
    best = e.groupBy("round").agg(F.min(F.struct((-F.col("agreement")).alias("a"), (-F.col("earned")).alias("e"), *GRID)).alias("b"))
    sorts = best.agg(*(F.array_sort(F.collect_list(f"b.{g}")).alias(g) for g in ("g_dense", "g_rich")))  # as many values as rounds
    at = lambda g, q: F.get(g, F.bround(F.lit(q) * (F.size(g) - 1), 0).cast("int"))
    return sorts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("threshold"), at(g, 0.025).alias("lo"), at(g, 0.975).alias("hi")) for name, g in (("reviews", "g_dense"), ("richness", "g_rich"))))))


_SHARES = "[" + ", ".join(f"{k / 10}" for k in range(1, 10)) + "]"


@query(f"""WITH {_SIG}, th AS (SELECT list_sort(list_distinct(quantile_cont(top1, {_SHARES}))) qa, list_sort(list_distinct(quantile_cont(reviews::DOUBLE, {_SHARES}))) qb FROM sg), ta AS (SELECT unnest(qa) a FROM th), tb AS (SELECT unnest(qb) b FROM th),
ru AS (SELECT 'first' form, a, NULL::DOUBLE b FROM ta UNION ALL SELECT 'second', NULL, b FROM tb UNION ALL SELECT 'both', a, b FROM ta, tb),
ev AS (SELECT form, a, b, sum(CASE WHEN ok THEN voi ELSE 0 END) / count(*) gain, avg(ok::INT) rate, count(*) n FROM (SELECT ru.*, voi, coalesce(a IS NULL OR top1 >= a, false) AND coalesce(b IS NULL OR reviews >= b, false) AS ok FROM sg, ru) GROUP BY 1, 2, 3)
SELECT form, round(a, 6) a, round(b, 6) b, round(gain, 6) gain, round(rate, 6) rate FROM ev WHERE rate BETWEEN 0.05 AND 0.95 AND n >= 30 ORDER BY round(gain, 9) DESC, round(abs(rate - 0.5), 9), form, ev.a, ev.b LIMIT 1""")
def two_feature_rule(spark, d):
    """The best rule on top score and reviews, with thresholds from the data."""
    r = Z.two_feature_rule(_signals(spark, d), "top1", "reviews", "voi")
    return r.select("form", *(F.round(c, 6).alias(c) for c in ("a", "b", "gain", "rate")))


_DENS = f"{I}, u AS (SELECT user_id, count(*) n FROM i GROUP BY 1), e AS (SELECT list_sort(list_distinct([quantile_cont(n, 0.25), quantile_cont(n, 0.5), quantile_cont(n, 0.75)])) edges FROM u)"


def _edges(users: DataFrame) -> DataFrame:
    return users.agg(F.array_sort(F.array_distinct(F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))).alias("edges"))


def _density(spark, d) -> DataFrame:
    return interactions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DENS} SELECT unnest(edges)::DOUBLE edge FROM e")
def density_edges(spark, d):
    return _edges(_density(spark, d)).select(F.explode("edges").alias("edge"))


@query(f"WITH {_DENS}, b AS (SELECT len(list_filter(edges, lambda x: x <= n)) bin FROM u, e) SELECT bin::BIGINT bin, count(*)::BIGINT users, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE share FROM b GROUP BY 1")
def density_histogram(spark, d):
    u = _density(spark, d)
    binned = u.crossJoin(F.broadcast(_edges(u))).select(F.size(F.filter("edges", lambda x: x <= F.col("n"))).cast("bigint").alias("bin"))  # one row of edges
    h = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("users"))
    return h.select("bin", "users", F.round(F.col("users") / F.sum("users").over(Window.partitionBy(F.lit(0))), 6).alias("share"))  # four rows


@query(f"WITH {I}, u AS (SELECT user_id, count(*) n FROM i GROUP BY 1) SELECT least(n, 31)::BIGINT stratum, count(*)::BIGINT users FROM u GROUP BY 1")
def integer_strata(spark, d):
    return _density(spark, d).groupBy(F.least("n", F.lit(31)).cast("bigint").alias("stratum")).agg(F.count(F.lit(1)).alias("users"))


_CC = "cc AS (SELECT trim(user_id) || ':' || trim(target_item_id) unit, min(trim(user_id)) u, min(user_reviews_before_task) n, " + ", ".join(f"coalesce(bool_or(conditions['{c}']), false) {c}" for c in CONDITIONS) + " FROM calibration_candidate WHERE user_reviews_before_task IS NOT NULL AND conditions IS NOT NULL GROUP BY 1)"


def _pool(spark, d) -> DataFrame:
    """Different candidates with their user, count and condition flags."""
    rows = table(spark, d, "calibration_candidate").where("user_reviews_before_task IS NOT NULL AND conditions IS NOT NULL")
    flag = lambda c: F.coalesce(F.bool_or(F.try_element_at("conditions", F.lit(c))), F.lit(False)).alias(c)
    unit = F.concat(F.trim("user_id"), F.lit(":"), F.trim("target_item_id")).alias("unit")
    return rows.groupBy(unit).agg(F.min(F.trim("user_id")).alias("u"), F.min("user_reviews_before_task").alias("n"), *(flag(c) for c in CONDITIONS))


#: How many are drawn for a condition, and in all to match a density.
PER_CONDITION, IN_ALL = 300, 650
_DRAWS, _TAKEN = [], "SELECT NULL::VARCHAR AS \"condition\", NULL::VARCHAR unit WHERE false"
for _k, _c in enumerate(CONDITIONS):
    _DRAWS.append(f"s{_k} AS MATERIALIZED ({_TAKEN if not _k else f'SELECT * FROM s{_k - 1}'} UNION ALL (SELECT '{_c}' AS \"condition\", unit FROM cc WHERE {_c}" + (f" AND unit NOT IN (SELECT unit FROM s{_k - 1})" if _k else "") + f" ORDER BY md5(unit), unit LIMIT {PER_CONDITION}))")


@query(f"WITH {_CC}, " + ", ".join(_DRAWS) + f" SELECT \"condition\", unit FROM s{len(CONDITIONS) - 1}")
def sample_per_condition(spark, d):
    """So many for each condition in turn, none twice; the number is the operator's."""
    return disjoint_by_condition(durable(_pool(spark, d), "pool"), "unit", CONDITIONS, PER_CONDITION, F.col("unit"))


@query(f"""WITH {_CC}, w AS (SELECT least(greatest(n, 0), 12) s, count(*) c FROM (SELECT DISTINCT "index", user_reviews_before_task n FROM task_profile WHERE user_reviews_before_task IS NOT NULL) GROUP BY 1), qu AS (SELECT s, CASE WHEN s < 1 THEN 0 ELSE round_even(c / (SELECT sum(c) FROM w) * {IN_ALL}, 0) END quota FROM w),
p AS (SELECT *, md5(unit) h, row_number() OVER (PARTITION BY u ORDER BY md5(unit), unit) r FROM cc), q AS (SELECT *, least(greatest(n, 0), 12) s FROM p WHERE r <= 3), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, unit) o FROM q) SELECT k.s::BIGINT stratum, unit FROM k JOIN qu USING (s) WHERE o <= quota""")
def stratified_quota(spark, d):
    """The calibration pool matched to the density histogram of the recorded tasks, three of each user. The
    lowest stratum has no user with an item to hold out and gets no quota."""
    stratum = F.least(F.greatest(F.col("n"), F.lit(0)), F.lit(12)).cast("bigint").alias("stratum")
    wanted = table(spark, d, "task_profile").select("index", F.col("user_reviews_before_task").alias("n")).distinct().where("n IS NOT NULL").select(stratum)
    few = by_hash(_pool(spark, d), ["u"], F.col("unit"), 3, "unit").drop("pos").withColumn("stratum", stratum)
    return by_quota(few, "stratum", F.col("unit"), proportional_quotas(wanted, "stratum", IN_ALL, 1), "unit").select("stratum", "unit")
