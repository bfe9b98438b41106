"""Queries on the way from tasks to saved rankings and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions.aggregates import bounded_heap
from ledgerloom.functions.scores import hit, ndcg
from ledgerloom.functions.texts import parsed_ranking
from ledgerloom.operators import codes as K
from ledgerloom.operators import timelines as L
from ledgerloom.operators import workflow as W
from ledgerloom.operators.drawing import disjoint_by_condition, expanded
from ledgerloom.operators.lookup import lookup_join, measured
from ledgerloom.operators.numbering import counts_before, numbered
from ledgerloom.plans.codes import _SCORE, ranked
from ledgerloom.plans.ingest import _register
from ledgerloom.plans.statistics import _REASON, _SIG, _reason, _signals
from ledgerloom.plans.timelines import _PROFILE, task_profile
from ledgerloom.plans.views import CONDITIONS, R, S, T, V, X, candidates, codes, gains, goals, kept_interactions, rankings, sequences, tasks
from ledgerloom.sources.durable import durable, scratch_path
from ledgerloom.sources.files import read_csv, read_json_lines, read_predictions, write_csv, write_json_lines, write_predictions
from ledgerloom.sources.tables import table

QUERIES, SQL, query = _register()

_RUNS = f"WITH {X}, {R('hm')}, o AS (SELECT *, coalesce(list_position(output, target), 0) p FROM r)"


@query(_RUNS + """ SELECT 'agent_' || source || '_track2_classic_predictions.json' run, count(*)::BIGINT tasks, count(error)::BIGINT errors, round(avg(CASE WHEN p BETWEEN 1 AND 5 THEN 1e0 ELSE 0 END), 6) hr_5, round(avg(CASE WHEN p BETWEEN 1 AND 5 THEN 1 / log2(p + 1) ELSE 0e0 END), 6) ndcg_5 FROM o GROUP BY 1""")
def prediction_log(spark, d):
    """Rankings saved as records under their runs' names, read again and evaluated, the metrics saved and read in turn."""
    path, results = scratch_path(spark, "predictions"), scratch_path(spark, "metrics")
    r = rankings(spark, d, "hm")
    truth = F.struct(F.when(F.col("index") % 2 == 0, F.col("target")).alias("ground truth"), F.when(F.col("index") % 2 == 1, F.col("target")).alias("ground_truth"))
    write_predictions(r.select(W.artifact_name("agent", F.col("source"), 2, "classic", "predictions").alias("run"), F.col("index").alias("run_index"), truth.alias("groundtruth"), "output", "error"), path)
    read = read_predictions(spark, path)
    target = (F.col("output"), F.col("groundtruth"))
    metrics = read.groupBy("run").agg(F.count(F.lit(1)).alias("tasks"), F.count("error").alias("errors"), F.round(F.avg(hit(*target, 5)), 6).alias("hr_5"), F.round(F.avg(ndcg(*target, 5)), 6).alias("ndcg_5"))
    write_json_lines(metrics.select(F.struct(F.lit(2).alias("track"), F.col("run").alias("predictions_path")).alias("metadata"), F.struct("tasks", "errors", "hr_5", "ndcg_5").alias("evaluation_results")), results)
    saved = read_json_lines(spark, results, "metadata struct<track:int,predictions_path:string>, evaluation_results struct<tasks:bigint,errors:bigint,hr_5:double,ndcg_5:double>")
    return saved.select(F.col("metadata.predictions_path").alias("run"), "evaluation_results.*")


_BLOCKED = """b AS (SELECT DISTINCT user_id, target_item_id item_id FROM task_profile WHERE (task_type = 'user_behavior_simulation' OR list_contains(candidate_item_ids, target_item_id)) AND user_id IS NOT NULL AND target_item_id IS NOT NULL)"""


def _blocked(spark, d):
    return W.blocked_pairs(table(spark, d, "task_profile").select("task_type", "user_id", F.col("target_item_id").alias("target"), F.col("candidate_item_ids").alias("candidates")))


@query(f"WITH {_BLOCKED} SELECT user_id, item_id FROM b")
def block_set(spark, d):
    return _blocked(spark, d)


@query(f"WITH {_BLOCKED} SELECT user_id, count(*)::BIGINT n, min(seq) first, max(seq) AS last FROM review r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = r.user_id AND b.item_id = r.item_id) GROUP BY 1")
def index_build(spark, d):
    """The log without the tasks' answers as an index on disk, opened twice: the second time it is only read."""
    log, path = table(spark, d, "review").select("user_id", "item_id", "seq", "stars"), scratch_path(spark, "index")
    W.indexed_log(log, _blocked(spark, d), path)
    index = W.indexed_log(log.limit(0), _blocked(spark, d), path)
    return index.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query("SELECT item_id, seq, row_number() OVER (PARTITION BY item_id ORDER BY seq) pos FROM review WHERE item_id IS NOT NULL")
def lists_in_file_order(spark, d):
    """Each item's reviews in file order, as numbers: lists of any length are never held whole."""
    return numbered(table(spark, d, "review").where("item_id IS NOT NULL").select("item_id", "seq"), ["item_id"], ["seq"])


_FLAGS = {"classic": "true", "cold_start_user": "before <= 5", "cold_start_item": "item_before <= 5", "evolving_interest": "recent >= 2"}


@query(f"WITH {_PROFILE} " + " UNION ALL ".join(f"SELECT '{c}' AS \"condition\", user_id, target, before, recent, outside, item_before FROM q WHERE {flag}" for c, flag in _FLAGS.items()))
def condition_manifest(spark, d):
    """The tasks of each condition with the counts that put them there; a task may have several."""
    p = task_profile(spark, d)
    which = F.explode(F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in CONDITIONS)), lambda x: x.isNotNull())).alias("condition")
    return p.select(which, "user_id", "target", "before", "recent", "outside", "item_before")


#: What a calibration pool is made with.
MIN_HISTORY, PER_CONDITION = 5, 300
_CAL = f"""{S}, cp AS (SELECT item_id, ts, sum(count(*)) OVER (PARTITION BY item_id ORDER BY ts) - count(*) item_before FROM i GROUP BY 1, 2),
sp AS (SELECT s.user_id || ':' || s.item_id unit, s.pos - 1 AS before, item_before, (SELECT count(*) FROM s o WHERE o.user_id = s.user_id AND o.ts < s.ts AND o.ts >= s.ts - 90 * 86400) recent FROM s JOIN cp ON cp.item_id = s.item_id AND cp.ts = s.ts WHERE s.pos > {MIN_HISTORY})"""
_CAL_FLAGS = {"classic": "true", "cold_start_user": "before <= 5", "cold_start_item": "item_before <= 5", "evolving_interest": "recent >= 2"}
_CAL_DRAWS = [f"m{k} AS MATERIALIZED ({f'SELECT * FROM m{k - 1} UNION ALL ' if k else ''}(SELECT '{c}' AS \"condition\", unit, before, item_before::BIGINT item_before, recent FROM sp WHERE {flag}" + (f" AND unit NOT IN (SELECT unit FROM m{k - 1})" if k else "") + f" ORDER BY md5(unit), unit LIMIT {PER_CONDITION}))" for k, (c, flag) in enumerate(_CAL_FLAGS.items())]


@query(f"WITH {_CAL}, " + ", ".join(_CAL_DRAWS) + ' SELECT "condition", unit, before, item_before, recent FROM m3')
def calibration_manifest(spark, d):
    """Splits of the histories as tasks: each item with five or more before it, known counts at its own time, so many
    for each condition and none twice; the numbers are the operator's."""
    log = kept_interactions(spark, d)
    sequence = sequences(spark, d, log)
    points = sequence.where(F.col("pos") > MIN_HISTORY).select("user_id", "item_id", "ts", F.col("pos").alias("at"))
    timed = counts_before(points, log.select("item_id", "ts"), "item_id", "ts", "item_before")
    start = timed.select("user_id", "item_id", "at", "item_before", F.col("ts").alias("now"), (F.col("ts") - 90 * L.DAY).alias("ts"))
    older = counts_before(start, sequence.select("user_id", "ts"), "user_id", "ts", "older")
    # Items first seen at the same instant as the target are not before it.
    now = counts_before(older.select("user_id", "item_id", "at", "item_before", "older", F.col("now").alias("ts")), sequence.select("user_id", "ts"), "user_id", "ts", "sooner")
    p = now.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("item_id").cast("string")).alias("unit"), (F.col("at") - 1).alias("before"), "item_before", (F.col("sooner") - F.col("older")).alias("recent"))
    p = durable(p.withColumns({"classic": F.lit(True), "cold_start_user": F.col("before") <= 5, "cold_start_item": F.col("item_before") <= 5, "evolving_interest": F.col("recent") >= 2}), "splits")
    drawn = disjoint_by_condition(p, "unit", CONDITIONS, PER_CONDITION, F.col("unit"))
    return p.join(F.broadcast(drawn), "unit").select("condition", "unit", "before", "item_before", "recent")  # as many drawn as the operator's numbers say


_SEEN = "f AS (SELECT user_id, item_id, min(coalesce(CASE WHEN isnan(timestamp) THEN NULL ELSE timestamp END, 0)) ts FROM review WHERE user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {T}, {_SEEN}, k AS (SELECT t.\"index\", f.item_id, f.ts, row_number() OVER (PARTITION BY t.\"index\" ORDER BY f.ts DESC, f.item_id DESC) r FROM t JOIN f ON f.user_id = t.user_id AND f.item_id <> t.target) SELECT \"index\", repeat('-,', greatest(10 - count(*), 0)::BIGINT) || string_agg(item_id, ',' ORDER BY ts, item_id) items FROM k WHERE r <= 10 GROUP BY 1")
def inference_history(spark, d):
    """What a sequence model is shown of a task's user: the last ten different items without the target, filled up from the left."""
    seen = table(spark, d, "review").where("user_id IS NOT NULL AND item_id IS NOT NULL").groupBy("user_id", "item_id").agg(F.min(F.coalesce(F.when(~F.isnan("timestamp"), F.col("timestamp")), F.lit(0.0))).alias("ts"))
    # Eleven a user, for one of them may be the target.
    last = seen.withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id")))).where("back <= 11").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "item_id"))).alias("h"))
    met = lookup_join(tasks(spark, d).select("index", "user_id", "target"), last, "user_id", "index").where("h IS NOT NULL")
    kept = met.select("index", F.transform(F.filter("h", lambda x: x["item_id"] != F.col("target")), lambda x: x["item_id"]).alias("items")).where(F.size("items") > 0)
    ten = F.slice("items", F.greatest(F.size("items") - 9, F.lit(1)), 10)
    return kept.select("index", F.array_join(F.concat(F.array_repeat(F.lit("-"), F.lit(10) - F.size(ten)), ten), ",").alias("items"))


@query(f"WITH {_SCORE}, un AS (SELECT c0, c1, count(*) n FROM c GROUP BY 1, 2) SELECT user_id, item_id, \"rank\", score, concat_ws(',', c0, c1, c2) code, n::BIGINT under_prefix FROM rk JOIN c USING (item_id) JOIN un USING (c0, c1) WHERE \"rank\" <= 10")
def candidate_summaries(spark, d):
    """The ten best candidates with their codes and how many items there are under a code's first two levels."""
    c = codes(spark, d)
    under = c.groupBy("c0", "c1").agg(F.count(F.lit(1)).alias("under_prefix"))
    best = ranked(spark, d).where("rank <= 10").join(measured(c), "item_id").join(measured(under), ["c0", "c1"])
    return best.select("user_id", "item_id", F.col("rank").cast("bigint").alias("rank"), "score", K.code_key().alias("code"), "under_prefix")


_CHOSEN = (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89)


@query(f"WITH {T} SELECT \"index\", user_id, target FROM t WHERE \"index\" IN {_CHOSEN}")
def task_index_filter(spark, d):
    """Tasks by number; the numbers are the operator's. One that doesn't exist is an error."""
    return W.chosen_tasks(tasks(spark, d), "index", _CHOSEN).select("index", "user_id", "target")


@query(f"WITH {V}, k AS (SELECT run_index % 2 = 0 AS cal, CASE WHEN GROUPING(backbone) = 1 THEN 'ALL' WHEN GROUPING(dataset) = 1 THEN backbone ELSE backbone || '/' || dataset END scope, count(*) n, avg(voi) m FROM v GROUP BY GROUPING SETS ((run_index % 2 = 0), (run_index % 2 = 0, backbone), (run_index % 2 = 0, backbone, dataset))) SELECT a.scope, a.n::BIGINT calibrated, b.n::BIGINT tested, round(a.m, 6) expected, round(b.m, 6) observed, sign(round(a.m, 9)) = sign(round(b.m, 9)) AS agree FROM k a JOIN k b USING (scope) WHERE a.cal AND NOT b.cal AND a.n >= 30 AND b.n >= 20")
def scope_match(spark, d):
    """Calibration against benchmark for every scope that both have rows enough for: all, a backbone, a backbone's dataset."""
    v = gains(spark, d).withColumn("cal", F.col("run_index") % 2 == 0)
    g = v.groupingSets([("cal",), ("cal", "backbone"), ("cal", "backbone", "dataset")], "cal", "backbone", "dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("voi").alias("m"), F.grouping("backbone").alias("no_b"), F.grouping("dataset").alias("no_d"))
    scope = F.when(F.col("no_b") == 1, "ALL").when(F.col("no_d") == 1, F.col("backbone")).otherwise(F.concat_ws("/", "backbone", "dataset"))
    k = g.select("cal", scope.alias("scope"), "n", "m")
    a, b = k.where("cal AND n >= 30"), k.where("NOT cal AND n >= 20").select("scope", F.col("n").alias("tested"), F.col("m").alias("observed"))
    same = F.signum(F.round("m", 9)) == F.signum(F.round("observed", 9))
    return a.join(b, "scope").select("scope", F.col("n").alias("calibrated"), "tested", F.round("m", 6).alias("expected"), F.round("observed", 6).alias("observed"), same.alias("agree"))


@query(f"WITH {X}, n AS (SELECT item_id, min(source) s FROM item WHERE item_id IS NOT NULL AND source IS NOT NULL GROUP BY 1) SELECT \"index\", coalesce(arg_min(s, pos) FILTER (s IS NOT NULL), 'amazon') source FROM x LEFT JOIN n USING (item_id) GROUP BY 1")
def source_resolution(spark, d):
    """A task's source: that of the first candidate the catalogue knows."""
    return W.first_source(candidates(spark, d), table(spark, d, "item").select("item_id", "source"), "amazon")


@query(f"WITH {T}, h AS (SELECT user_id, sum(coalesce(length(text), 0) + length(coalesce(item_id, ''))) chars FROM review GROUP BY 1) SELECT \"index\", coalesce(chars, 0)::BIGINT chars FROM t LEFT JOIN h USING (user_id)")
def history_chars(spark, d):
    """Characters of what a task's user has written, with the ids it is about."""
    h = table(spark, d, "review").groupBy("user_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + F.length(F.coalesce("item_id", F.lit("")))).alias("chars"))
    return lookup_join(tasks(spark, d).select("index", "user_id"), h, "user_id", "index").select("index", F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars"))


_TEXTS = "CASE WHEN ra.output IS NULL THEN [] WHEN \"index\" % 4 = 3 THEN [] WHEN \"index\" % 4 = 2 THEN ra.output[1:2] ELSE ra.output[1:5] END"


@query(f"""WITH {_SIG}, {R('sid', 'rs')}, e AS (SELECT run_index "index", {_REASON} reason FROM sg), f AS (SELECT "index", reason, reason IN ('sparse', 'confident') AS codes, {_TEXTS} parsed, rs.output code_order, t.candidates FROM e JOIN ra USING ("index") JOIN rs USING ("index") JOIN t USING ("index")),
w AS (SELECT *, CASE WHEN len(parsed) >= 3 THEN parsed ELSE [] END kept, CASE WHEN codes AND coalesce(len(code_order), 0) > 0 THEN code_order ELSE candidates END AS rest FROM f)
SELECT "index", reason, len(parsed)::BIGINT read, array_to_string(list_concat(kept, list_filter(rest, lambda x: NOT list_contains(kept, x))), ',') ranking FROM w""")
def ranker_workflow(spark, d):
    """A ranker as columns: evidence, what it calls for, the text that came back, what can be read of it, the ranking."""
    s = _signals(spark, d).select(F.col("run_index").alias("index"), _reason().alias("reason"))
    answer = rankings(spark, d, "hm").select("index", F.col("output").alias("answer"))
    order = rankings(spark, d, "sid").select("index", F.col("output").alias("code_order"))
    r = s.join(answer, "index").join(order, "index").join(tasks(spark, d).select("index", "candidates"), "index")
    quoted = lambda ids: F.array_join(F.transform(ids, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    kind = F.col("index") % 4
    text = F.when(kind == 3, "I cannot rank these").when(kind == 2, F.array_join(F.slice("answer", 1, 2), " before ")).otherwise(F.concat(F.lit("Ranking: ["), quoted(F.slice("answer", 1, 5)), F.lit("]")))
    r = r.withColumn("parsed", parsed_ranking(text, F.col("candidates")))
    order = F.coalesce("code_order", F.array().cast("array<string>"))
    ranking = W.final_ranking(F.col("parsed"), F.col("candidates"), order, F.col("reason").isin("sparse", "confident"))
    return r.select("index", "reason", F.size("parsed").cast("bigint").alias("read"), F.array_join(ranking, ",").alias("ranking"))


@query("WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] x, b.embedding::DOUBLE[] y, (a.vec_id % 2)::DOUBLE m, (a.vec_id % 3 > 0)::INT::DOUBLE n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round((x[1] * m + y[1] * n) / greatest(m + n, 1), 6) AS first, round((x[2] * m + y[2] * n) / greatest(m + n, 1), 6) AS second FROM p")
def masked_mean_pool(spark, d):
    """Neighbouring vectors pooled under a mask."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    pooled = pairs.select("vec_id", W.masked_mean(F.array("embedding", "other"), F.array((F.col("vec_id") % 2).cast("double"), (F.col("vec_id") % 3 > 0).cast("double"))).alias("v"))
    return pooled.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(1)), 6).alias("second"))


#: Negatives of the leave-one-out evaluation; tries to draw them.
_NEG, _TRIES = 100, 256
_LOO = f"""{S}, g AS (SELECT user_id, item_id target FROM s WHERE pos = s.n), cat AS MATERIALIZED (SELECT p_partkey item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part),
j AS (SELECT g.user_id, t.j, (g.user_id * 7919 + t.j * 104729 + (g.user_id % 1009) * t.j * t.j) % n idx FROM g, (SELECT count(*) n FROM part), range(0, {_TRIES}) t(j)),
dr AS (SELECT j.user_id, cat.item_id, min(j.j) j FROM j JOIN cat USING (idx) ANTI JOIN s ON s.user_id = j.user_id AND s.item_id = cat.item_id GROUP BY 1, 2),
ke AS MATERIALIZED (SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY j) r FROM dr) WHERE r <= {_NEG}), sh AS (SELECT g.user_id, count(ke.item_id) have FROM g LEFT JOIN ke USING (user_id) GROUP BY 1 HAVING count(ke.item_id) < {_NEG}),
fr AS (SELECT p.* FROM (SELECT user_id, have, item_id FROM sh, cat) p ANTI JOIN s ON s.user_id = p.user_id AND s.item_id = p.item_id ANTI JOIN ke ON ke.user_id = p.user_id AND ke.item_id = p.item_id),
fi AS (SELECT user_id, item_id, have + row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || ':' || item_id), item_id) k FROM fr), un AS (SELECT user_id, item_id FROM ke UNION ALL SELECT user_id, item_id FROM fi WHERE k <= {_NEG} UNION ALL SELECT user_id, target FROM g),
po AS (SELECT item_id, count(*) n FROM s WHERE pos < s.n GROUP BY 1), sc AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(po.n, 0) DESC, item_id) r FROM un LEFT JOIN po USING (item_id)), hi AS (SELECT sc.user_id, r FROM sc JOIN g ON g.user_id = sc.user_id AND g.target = sc.item_id)"""


@query(f"WITH {_LOO} SELECT count(*)::BIGINT users, round(avg((r <= 10)::INT), 6) hr_10, round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0e0 END), 6) ndcg_10 FROM hi")
def leave_one_out_evaluation(spark, d):
    """Each user's last item among a hundred that the user never had, by how many users took an item before their last."""
    sequence = sequences(spark, d)
    goal = durable(goals(sequence), "goals")
    catalog = durable(numbered(table(spark, d, "part").select(F.lit(0).alias("all"), F.col("p_partkey").alias("item_id")), ["all"], ["item_id"], "idx").select("item_id", (F.col("idx") - 1).alias("idx")), "catalog")
    draw = (F.col("user_id") * 7919 + F.col("try") * 104729 + (F.col("user_id") % 1009) * F.col("try") * F.col("try")) % catalog.count()
    pool = expanded(goal, "user_id", catalog, sequence.select("user_id", "item_id"), draw, _NEG, _TRIES).select("user_id", "item_id").unionByName(goal.withColumnRenamed("target", "item_id"))
    popular = L.with_length(sequence).where("pos < n").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    scored = lookup_join(pool, popular, "item_id", "user_id")
    # At most a hundred and one rows a user.
    place = scored.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.coalesce("n", F.lit(0))), "item_id"))).join(measured(goal), "user_id").where("item_id = target")
    return place.agg(F.count(F.lit(1)).alias("users"), F.round(F.avg(F.when(F.col("r") <= 10, 1.0).otherwise(0.0)), 6).alias("hr_10"), F.round(F.avg(F.when(F.col("r") <= 10, 1 / F.log2(F.col("r") + 1)).otherwise(0.0)), 6).alias("ndcg_10"))


@query(f"""WITH {V}, q AS (SELECT backbone, list_sort(list_distinct(quantile_cont(hm, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) th FROM v WHERE run_index % 2 = 0 GROUP BY 1), h AS (SELECT backbone, unnest(th) h FROM q),
c AS (SELECT backbone, h, round(avg(CASE WHEN hm <= h THEN voi ELSE 0 END), 9) gain FROM v JOIN h USING (backbone) WHERE run_index % 2 = 0 GROUP BY 1, 2), b AS (SELECT backbone, arg_max(h, (gain, -h)) h FROM c GROUP BY 1)
SELECT backbone, count(*)::BIGINT n, round(any_value(h), 6) threshold, round(greatest(0, avg(voi)), 6) best_fixed, round(avg(greatest(voi, 0)), 6) oracle, round(avg(CASE WHEN hm <= h THEN voi ELSE 0 END), 6) routed FROM v JOIN b USING (backbone) WHERE run_index % 2 = 1 GROUP BY 1 HAVING count(*) >= 60""")
def router_ablation(spark, d):
    """Per backbone a rule on the first score, its threshold taken from one half of the runs, against no choice and the best one on the other."""
    v = durable(gains(spark, d).select("backbone", "run_index", "hm", "voi"), "gains")
    half = v.where("run_index % 2 = 0")
    shares = F.array(*(F.lit(k / 10) for k in range(1, 10)))
    grid = half.groupBy("backbone").agg(F.array_distinct(F.percentile("hm", shares)).alias("th")).select("backbone", F.explode("th").alias("h"))  # nine a backbone
    gain = F.round(F.avg(F.when(F.col("hm") <= F.col("h"), F.col("voi")).otherwise(0.0)), 9)
    best = half.join(F.broadcast(grid), "backbone").groupBy("backbone", "h").agg(gain.alias("gain")).groupBy("backbone").agg(F.max_by("h", F.struct("gain", -F.col("h"))).alias("h"))
    t = v.where("run_index % 2 = 1").join(F.broadcast(best), "backbone").groupBy("backbone").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.first("h"), 6).alias("threshold"), F.round(F.greatest(F.lit(0.0), F.avg("voi")), 6).alias("best_fixed"), F.round(F.avg(F.greatest("voi", F.lit(0.0))), 6).alias("oracle"),
        F.round(F.avg(F.when(F.col("hm") <= F.col("h"), F.col("voi")).otherwise(0.0)), 6).alias("routed"),
    )
    return t.where("n >= 60")


@query(f"WITH {V} SELECT run_index, dataset, round(hm, 6) hm, round(voi, 6) voi FROM v WHERE run_index % 7 <> 0")
def csv_features(spark, d):
    """Features written as CSV and read again; rows whose gain is no number there are left out."""
    path = scratch_path(spark, "features")
    write_csv(gains(spark, d).select("run_index", "dataset", F.col("hm").cast("string").alias("hm"), F.when(F.col("run_index") % 7 == 0, F.when(F.col("run_index") % 2 == 0, "None").otherwise("")).otherwise(F.col("voi").cast("string")).alias("voi")), path)
    rows = read_csv(spark, path, "run_index bigint, dataset string, hm string, voi string").select("run_index", "dataset", F.col("hm").try_cast("double").alias("hm"), F.col("voi").try_cast("double").alias("voi"))
    return rows.where("voi IS NOT NULL AND NOT isnan(voi)").select("run_index", "dataset", F.round("hm", 6).alias("hm"), F.round("voi", 6).alias("voi"))


@query("SELECT event_id, user_id FROM events")
def blank_lines_skipped(spark, d):
    """JSON lines with an empty line after each are the same rows."""
    path = scratch_path(spark, "lines")
    table(spark, d, "events").select(F.concat(F.to_json(F.struct("event_id", "user_id")), F.lit("\n")).alias("value")).write.text(path)
    return read_json_lines(spark, path, "event_id bigint, user_id bigint").select("event_id", "user_id")
