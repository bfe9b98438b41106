"""Queries on ranking metrics and on paired runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.scores import hit, ndcg, rank_of
from ledgerloom.operators.statistics import average_ranks
from ledgerloom.plans.ingest import _register
from ledgerloom.plans.views import R, T, V, X, gains, rankings, tasks
from ledgerloom.sources.durable import durable
from ledgerloom.sources.tables import table

QUERIES, SQL, query = _register()
KS = (1, 3, 5, 10)
_ONE = f"WITH {X}, {R('hm')}, o AS (SELECT *, coalesce(list_position(output, target), 0) p FROM r)"
_AT = "round(avg(CASE WHEN p BETWEEN 1 AND {k} THEN 1e0 ELSE 0 END), 6) hr, round(avg(CASE WHEN p BETWEEN 1 AND {k} THEN 1 / log2(p + 1) ELSE 0e0 END), 6) ndcg"


@query(_ONE + " " + " UNION ALL ".join(f"SELECT {k} k, {_AT.format(k=k)}, round(avg(CASE WHEN p BETWEEN 1 AND {k} THEN 1e0 ELSE 0 END), 6) recall, count(*)::BIGINT tasks FROM o" for k in KS))
def ranking_metrics(spark, d):
    """HR, NDCG and recall at k; failed tasks are misses."""
    r = rankings(spark, d, "hm")
    values = r.agg(F.count(F.lit(1)).alias("tasks"), *(F.round(F.avg(f(F.col("output"), F.col("target"), k)), 6).alias(f"{n}_{k}") for k in KS for n, f in (("hr", hit), ("ndcg", ndcg))))
    return values.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"hr_{k}").alias("hr"), F.col(f"ndcg_{k}").alias("ndcg"), F.col(f"hr_{k}").alias("recall"), "tasks") for k in KS))))


@query(_ONE + ", m AS (" + " UNION ALL ".join(f"SELECT source, {k} k, {_AT.format(k=k)} FROM o GROUP BY 1" for k in KS) + ") SELECT source, " + ", ".join(f"max(hr) FILTER (k = {k}) hr_{k}, max(ndcg) FILTER (k = {k}) ndcg_{k}" for k in KS) + ", round((max(hr) FILTER (k = 1) + max(hr) FILTER (k = 3) + max(hr) FILTER (k = 5)) / 3, 5) average_hit_rate FROM m GROUP BY 1")
def metrics_wide(spark, d):
    """The same per source in columns; the average hit rate is over 1, 3 and 5."""
    m = rankings(spark, d, "hm").groupBy("source").agg(*(F.round(F.avg(f(F.col("output"), F.col("target"), k)), 6).alias(f"{n}_{k}") for k in KS for n, f in (("hr", hit), ("ndcg", ndcg))))
    return m.withColumn("average_hit_rate", F.round((F.col("hr_1") + F.col("hr_3") + F.col("hr_5")) / 3, 5))


@query(_ONE + " SELECT \"index\", round(CASE WHEN p BETWEEN 1 AND 5 THEN 1 / log2(p + 1) ELSE 0e0 END, 6) ndcg, coalesce(nullif(p, 0), len(output), 20)::BIGINT \"rank\" FROM o")
def ndcg_per_task(spark, d):
    r = rankings(spark, d, "hm")
    rank = rank_of(F.col("output"), F.col("target"))
    return r.select("index", F.round(ndcg(F.col("output"), F.col("target"), 5), 6).alias("ndcg"), F.coalesce(F.nullif(rank, F.lit(0)), F.when(F.col("output").isNotNull(), F.size("output")), F.lit(20)).cast("bigint").alias("rank"))


@query("""SELECT source, count(*)::BIGINT n, round(avg(abs(least(greatest((eval_id % 9)::DOUBLE - 2, 0), 5) - stars) / 5), 6) star_error, round(1 - avg(abs(least(greatest((eval_id % 9)::DOUBLE - 2, 0), 5) - stars) / 5), 6) preference, round(1 - avg(0.25e0 * (eval_id % 7) / 10 + 0.25e0 * (eval_id % 5) / 10 + 0.5e0 * (eval_id % 3) / 10), 6) review_generation,
round((2 - avg(abs(least(greatest((eval_id % 9)::DOUBLE - 2, 0), 5) - stars) / 5) - avg(0.25e0 * (eval_id % 7) / 10 + 0.25e0 * (eval_id % 5) / 10 + 0.5e0 * (eval_id % 3) / 10)) / 2, 6) overall FROM eval_item GROUP BY 1""")
def simulation_star_error(spark, d):
    """Error of simulated stars, which are first brought into 0 to 5, and the weighted errors of texts (sentiment, emotion, topic), here of given scores."""
    simulated = F.least(F.greatest((F.col("eval_id") % 9).cast("double") - 2, F.lit(0.0)), F.lit(5.0))
    error = F.avg(F.abs(simulated - F.col("stars")) / 5)
    given = lambda by: (F.col("eval_id") % by) / F.lit(10.0)
    texts = F.avg(0.25 * given(7) + 0.25 * given(5) + 0.5 * given(3))
    return table(spark, d, "eval_item").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(error, 6).alias("star_error"), F.round(1 - error, 6).alias("preference"), F.round(1 - texts, 6).alias("review_generation"), F.round((2 - error - texts) / 2, 6).alias("overall")
    )


@query("""WITH c AS (SELECT user_id, event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-15') a, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') b FROM events GROUP BY 1, 2), s AS (SELECT user_id, sum(a) a, sum(b) b FROM c GROUP BY 1)
SELECT user_id, round(avg(abs(coalesce(c.a / nullif(s.a, 0), 0) - coalesce(c.b / nullif(s.b, 0), 0))), 6)::DOUBLE error FROM c JOIN s USING (user_id) GROUP BY 1""")
def label_l1_error(spark, d):
    """Mean over the labels of either of the difference of two distributions; a label that one lacks counts 0 there."""
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"))
    s = c.groupBy("user_id").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    share = lambda x, t: F.coalesce(F.try_divide(x, t), F.lit(0.0))
    return c.join(s, "user_id").groupBy("user_id").agg(F.round(F.avg(F.abs(share("a", "sa") - share("b", "sb"))), 6).alias("error"))


@query(f"WITH {T} SELECT source, count(*)::BIGINT n, count(DISTINCT \"index\")::BIGINT runs, count(DISTINCT CASE WHEN \"index\" % 4 = 0 THEN \"index\" END)::BIGINT classic FROM t GROUP BY 1")
def coverage_counts(spark, d):
    return tasks(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("index").alias("runs"), F.countDistinct(F.when(F.col("index") % 4 == 0, F.col("index"))).alias("classic"))


_ARMS = " UNION ALL ".join(f"SELECT '{a}' arm, source, target, output, error FROM r{a}" for a in ("hm", "hmt", "rnd"))
_ARM_SQL = f"WITH {X}, " + ", ".join(R(a, f"r{a}") for a in ("hm", "hmt", "rnd")) + f", o AS (SELECT *, coalesce(list_position(output, target), 0) p FROM ({_ARMS}) WHERE error IS NULL)"


def _arms(spark, d):
    parts = [rankings(spark, d, a).withColumn("arm", F.lit(a)) for a in ("hm", "hmt", "rnd")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_ARM_SQL + " SELECT source, arm, count(*)::BIGINT n, round(avg((p > 0)::INT), 6) recall, round(avg(CASE WHEN p BETWEEN 1 AND 5 THEN 1e0 ELSE 0 END), 6) hr, round(avg(CASE WHEN p BETWEEN 1 AND 5 THEN 1 / log2(p + 1) ELSE 0e0 END), 6) ndcg FROM o GROUP BY 1, 2")
def arm_summary(spark, d):
    """Per source and arm; runs without an output are left out here."""
    o = _arms(spark, d).where("error IS NULL")
    target = (F.col("output"), F.col("target"))
    return o.groupBy("source", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(rank_of(*target) > 0, 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(hit(*target, 5)), 6).alias("hr"), F.round(F.avg(ndcg(*target, 5)), 6).alias("ndcg")
    )


@query(_ARM_SQL + """, m AS (SELECT source, arm, round(avg(CASE WHEN p BETWEEN 1 AND 5 THEN 1e0 ELSE 0 END), 3) hr FROM o GROUP BY 1, 2), w AS (SELECT source, max(hr) FILTER (arm = 'hm') hm, max(hr) FILTER (arm = 'hmt') hmt, max(hr) FILTER (arm = 'rnd') rnd FROM m GROUP BY 1)
SELECT source, printf('%.3f', hm) hm, printf('%.3f', hmt) hmt, printf('%+.3f', hm - rnd) gain, CASE WHEN hm > rnd AND hm >= hmt THEN 'hm' WHEN hmt > rnd AND hmt > hm THEN 'hmt' ELSE 'none' END best FROM w""")
def coverage_table(spark, d):
    """A printed table: three decimals, signed gains, the best arm where it beats random."""
    o = _arms(spark, d).where("error IS NULL")
    w = o.groupBy("source").pivot("arm", ["hm", "hmt", "rnd"]).agg(F.round(F.avg(hit(F.col("output"), F.col("target"), 5)), 3))
    best = F.when((F.col("hm") > F.col("rnd")) & (F.col("hm") >= F.col("hmt")), "hm").when((F.col("hmt") > F.col("rnd")) & (F.col("hmt") > F.col("hm")), "hmt").otherwise("none")
    return w.select("source", F.format_string("%.3f", "hm").alias("hm"), F.format_string("%.3f", "hmt").alias("hmt"), F.format_string("%+.3f", F.col("hm") - F.col("rnd")).alias("gain"), best.alias("best"))


@query(f"WITH {V} SELECT run_index, backbone, dataset, round(hm, 6) hm, round(hmt, 6) hmt, round(voi, 6) voi FROM v")
def voi_per_task(spark, d):
    """Two runs of the same task side by side."""
    return gains(spark, d).select("run_index", "backbone", "dataset", *(F.round(c, 6).alias(c) for c in ("hm", "hmt", "voi")))


@query(f"WITH {V} SELECT dataset, count(*)::BIGINT common FROM (SELECT dataset, run_index FROM v WHERE hm > 0 INTERSECT SELECT dataset, run_index FROM v WHERE hmt > 0) GROUP BY 1")
def common_runs(spark, d):
    v = gains(spark, d)
    both = v.where("hm > 0").select("dataset", "run_index").intersect(v.where("hmt > 0").select("dataset", "run_index"))
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("common"))


@query(f"WITH {X}, {R('hm', 'ra')}, {R('hmt', 'rb')}, a AS (SELECT \"index\", unnest(output) one, generate_subscripts(output, 1) pos FROM ra), b AS (SELECT \"index\", unnest(output) two, generate_subscripts(output, 1) pos FROM rb) SELECT \"index\", pos::BIGINT pos, one, two FROM a JOIN b USING (\"index\", pos)")
def zip_align(spark, d):
    """Two lists side by side by position, as far as both go."""
    a = rankings(spark, d, "hm").select("index", F.posexplode("output").alias("pos", "one"))
    b = rankings(spark, d, "hmt").select("index", F.posexplode("output").alias("pos", "two"))
    return a.join(b, ["index", "pos"]).select("index", (F.col("pos") + 1).cast("bigint").alias("pos"), "one", "two")


@query(f"WITH {X}, {R('hm', 'ra')} SELECT \"index\", array_to_string(list_concat(list_reverse(output[1:3]), output[4:]), ',') merged FROM ra WHERE output IS NOT NULL")
def merge_ranking(spark, d):
    """A short answer, completed by a fallback order: known items, each once, in first mention."""
    r = rankings(spark, d, "hm").join(tasks(spark, d).select("index", "candidates"), "index").where("output IS NOT NULL")
    answer = F.concat(F.array(F.lit("unknown")), F.reverse(F.slice("output", 1, 3)), F.slice("output", 1, 1))
    known = F.filter(F.concat(answer, "output"), lambda x: F.array_contains("candidates", x))
    return r.select("index", F.array_join(F.array_distinct(known), ",").alias("merged"))


@query(f"WITH {X}, {R('hm', 'ra')}, {R('hmt', 'rb')}, {R('rnd', 'rc')}, v AS (SELECT \"index\", output[1] item, 1 voter FROM ra UNION ALL SELECT \"index\", output[1], 2 FROM rb UNION ALL SELECT \"index\", output[1], 3 FROM rc), k AS (SELECT \"index\", item, count(*) n, min(voter) first FROM v WHERE item IS NOT NULL GROUP BY 1, 2) SELECT \"index\", arg_max(item, (n, -first)) AS winner, max(n)::BIGINT votes FROM k GROUP BY 1")
def majority_vote(spark, d):
    """The most frequent first choice of three rankings, the earlier one among equals."""
    parts = [rankings(spark, d, a).select("index", F.get("output", F.lit(0)).alias("item"), F.lit(k).alias("voter")) for k, a in enumerate(("hm", "hmt", "rnd"), 1)]
    k = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("item IS NOT NULL").groupBy("index", "item").agg(F.count(F.lit(1)).alias("n"), F.min("voter").alias("first"))
    return k.groupBy("index").agg(F.max_by("item", F.struct("n", -F.col("first"))).alias("winner"), F.max("n").alias("votes"))


@query(f"WITH {X}, h AS (SELECT \"index\", item_id, row_number() OVER (PARTITION BY \"index\" ORDER BY md5(concat_ws(':', 'short', \"index\", item_id)), item_id) r FROM x) SELECT \"index\", item_id FROM h WHERE r <= 5")
def random_shortlist(spark, d):
    """Five of each task's candidates by the order of a hash."""
    order = F.transform(F.array_sort(F.transform("candidates", lambda x: F.struct(F.md5(F.concat_ws(":", F.lit("short"), F.col("index").cast("string"), x)).alias("h"), x.alias("i")))), lambda s: s["i"])
    return tasks(spark, d).select("index", F.explode(F.slice(order, 1, 5)).alias("item_id"))


@query(f"WITH {V} SELECT run_index, dataset FROM v WHERE (run_index * 7919 + 17) % 1000 < 300")
def eval_split(spark, d):
    """Runs of the validation part, by key."""
    v = gains(spark, d).select("run_index", "dataset")
    part = tasks(spark, d).select(F.col("index").alias("run_index")).where((F.col("run_index") * 7919 + 17) % 1000 < 300)
    return v.join(part, "run_index", "left_semi")


@query(f"WITH {V}, r AS (SELECT (rank() OVER (ORDER BY hm) + (count(*) OVER (PARTITION BY hm) - 1) / 2.0)::DOUBLE a, (rank() OVER (ORDER BY hmt) + (count(*) OVER (PARTITION BY hmt) - 1) / 2.0)::DOUBLE b FROM (SELECT round(hm, 6) hm, round(hmt, 6) hmt FROM v)) SELECT CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END rho, count(*)::BIGINT n FROM r")
def spearman(spark, d):
    v = durable(gains(spark, d).select("run_index", F.round("hm", 6).alias("hm"), F.round("hmt", 6).alias("hmt")), "gains")
    return average_ranks(average_ranks(v, "hm", "a"), "hmt", "b").agg(F.when(F.count(F.lit(1)) >= 3, F.round(F.corr("a", "b"), 6)).alias("rho"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {V}, r AS (SELECT dataset = 'amazon' y, (rank() OVER (ORDER BY hm) + (count(*) OVER (PARTITION BY hm) - 1) / 2.0)::DOUBLE a FROM (SELECT dataset, round(hm, 6) hm FROM v)), s AS (SELECT sum(a) FILTER (y) ra, count(*) FILTER (y)::DOUBLE p, count(*) FILTER (NOT y)::DOUBLE q FROM r) SELECT round((ra - p * (p + 1) / 2) / (p * q), 6) auc FROM s")
def auc_rank_sum(spark, d):
    """Area under the curve as a rank sum."""
    v = durable(gains(spark, d).select((F.col("dataset") == "amazon").alias("y"), F.round("hm", 6).alias("hm")), "gains")
    s = average_ranks(v, "hm", "a").agg(F.sum(F.when(F.col("y"), F.col("a"))).alias("ra"), F.count_if("y").cast("double").alias("p"), F.count_if(~F.col("y")).cast("double").alias("q"))
    return s.select(F.round((F.col("ra") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))
