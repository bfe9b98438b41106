"""Queries on sequences, windows of history, task profiles and conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import timelines as L
from ledgerloom.operators.harmonise import first_filled
from ledgerloom.operators.lookup import lookup_join
from ledgerloom.operators.numbering import counts_before, numbered
from ledgerloom.plans.ingest import _register
from ledgerloom.plans.views import CONDITIONS, C, G, S, T, X, candidates, codes, goals, interactions, kept_interactions, sequences
from ledgerloom.plans.views import I as INTERACTIONS
from ledgerloom.sources.tables import table

QUERIES, SQL, query = _register()


@query(f"WITH {S} SELECT user_id, item_id, ts, pos FROM s")
def first_occurrence_sequence(spark, d):
    return sequences(spark, d)


@query("""SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN isnan(timestamp) THEN NULL ELSE timestamp END NULLS LAST, seq) pos FROM review WHERE user_id IS NOT NULL""")
def nulls_last_sequence(spark, d):
    """Dated rows by time, undated ones after them in file order."""
    rows = table(spark, d, "review").where("user_id IS NOT NULL").select("user_id", "seq", F.when(~F.isnan("timestamp"), F.col("timestamp")).alias("at"))
    rows = rows.select("user_id", "seq", F.col("at").isNull().alias("undated"), "at")
    return numbered(rows, ["user_id"], ["undated", "at", "seq"]).select("user_id", "seq", "pos")


@query(f"WITH {S} SELECT user_id, item_id, pos, CASE WHEN n < 3 THEN 'train' WHEN pos = n THEN 'test' WHEN pos = n - 1 THEN 'valid' ELSE 'train' END split FROM s")
def leave_one_out_split(spark, d):
    return L.leave_one_out(sequences(spark, d)).select("user_id", "item_id", "pos", "split")


@query(f"WITH {S} SELECT user_id, item_id, pos FROM s WHERE pos <= n - 1 AND n - 1 >= 2")
def cooc_holdout(spark, d):
    """Sequences without their last item, of those that keep two."""
    return L.with_length(sequences(spark, d)).where("pos <= n - 1 AND n - 1 >= 2").select("user_id", "item_id", "pos")


@query(f"WITH {S} SELECT user_id, array_to_string(list_concat(list_resize([]::BIGINT[], greatest(10 - min(n), 0), 0), list(item_id ORDER BY pos)), ',') items FROM s WHERE pos > n - 10 GROUP BY 1")
def padded_sequence(spark, d):
    """The last ten items of each user, filled up with zeros from the left."""
    last = L.last_items(sequences(spark, d), 10)
    return last.select("user_id", F.array_join(F.transform(L.padded(F.col("items"), 10), lambda x: x.cast("string")), ",").alias("items"))


@query(f"WITH {S} SELECT user_id, item_id, ts, pos FROM s WHERE pos > 5")
def calibration_splits(spark, d):
    """Every item with a history of five or more is a possible task; its time is its own first occurrence."""
    return sequences(spark, d).where("pos > 5")


@query(f"WITH {INTERACTIONS}, k AS (SELECT item_id, ts, count(*)::BIGINT n FROM i GROUP BY 1, 2) SELECT item_id, ts, n, coalesce(sum(n) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k")
def item_popularity_before(spark, d):
    """How often an item had been taken strictly before each time at which it was."""
    log = interactions(spark, d)
    points = log.groupBy("item_id", "ts").agg(F.count(F.lit(1)).alias("n"))
    return counts_before(points, log.select("item_id", "ts"), "item_id", "ts", "before")


@query(f"WITH {S}, {C} SELECT user_id, pos, item_id, concat_ws(',', c0, c1, c2) code FROM s JOIN c USING (item_id) WHERE pos <= 20")
def encode_user_history(spark, d):
    """Codes of the first twenty distinct items."""
    return sequences(spark, d).where("pos <= 20").join(codes(spark, d), "item_id").select("user_id", "pos", "item_id", F.concat_ws(",", "c0", "c1", "c2").alias("code"))


_LAST = f"WITH {G}, h AS (SELECT user_id, i.item_id, i.ts, row_number() OVER (PARTITION BY user_id ORDER BY i.ts DESC, i.item_id, qty) back FROM gt JOIN i USING (user_id) WHERE i.ts < task_time)"


def _timed(spark, d):
    """The customers' tasks with their times, and the log."""
    log = kept_interactions(spark, d)
    return L.task_times(goals(sequences(spark, d, log)), log), log


@query(_LAST + " SELECT user_id, back, item_id, ts FROM h WHERE back <= 10")
def last_n_history(spark, d):
    """The ten interactions before the task's time."""
    return L.last_n_before(*_timed(spark, d), 10)


@query(f"WITH {G}, t AS (SELECT user_id, task_time - CASE WHEN user_id % 2 = 0 THEN 10 * 365 * 86400 ELSE 0 END task_time FROM gt), h AS (SELECT user_id, i.item_id, i.ts, qty, i.ts < task_time AS before FROM t JOIN i USING (user_id)), k AS (SELECT *, bool_or(before) OVER (PARTITION BY user_id) found FROM h), r AS (SELECT user_id, item_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id, qty) back FROM k WHERE before OR NOT found) SELECT user_id, back, item_id, ts FROM r WHERE back <= 10")
def last_n_or_all_history(spark, d):
    """The ten interactions before the task's time, of all there are where none is; every other task is ten years earlier."""
    timed, log = _timed(spark, d)
    return L.last_n_before(timed.withColumn("task_time", F.col("task_time") - F.when(F.col("user_id") % 2 == 0, 10 * 365 * L.DAY).otherwise(0)), log, 10, fallback=True)


@query(_LAST + " SELECT user_id, back, item_id, ts FROM h")
def whole_history(spark, d):
    """All interactions before the task's time, which is what a number of 0 means."""
    return L.last_n_before(*_timed(spark, d), 0)


_COUNTS = f"""{G}, p AS (SELECT user_id, target, task_time, count(*) FILTER (i.ts < task_time)::BIGINT AS before, count(*) FILTER (i.ts < task_time AND i.ts >= task_time - 90 * 86400)::BIGINT recent,
  count(*) FILTER (i.ts < task_time - 90 * 86400)::BIGINT outside FROM gt JOIN i USING (user_id) GROUP BY 1, 2, 3)"""
_PROFILE = _COUNTS + """, q AS (SELECT p.*, (SELECT count(*) FROM i WHERE i.item_id = p.target AND i.ts < p.task_time)::BIGINT item_before FROM p)"""
_FLAGS = "true AS classic, before <= 5 AS cold_start_user, item_before <= 5 AS cold_start_item, recent >= 2 AS evolving_interest"


@query(f"WITH {_COUNTS} SELECT user_id, before, recent, outside FROM p")
def recency_window_counts(spark, d):
    return L.profile(*_timed(spark, d)).select("user_id", "before", "recent", "outside")


@query(f"WITH {_PROFILE} SELECT *, {_FLAGS} FROM q")
def task_profile(spark, d):
    """Every customer's task with the counts known at its time and its conditions."""
    return L.profile(*_timed(spark, d))


@query(f"WITH {_PROFILE}, f AS (SELECT {_FLAGS} FROM q) SELECT 'classic' AS \"condition\", count(*) FILTER (classic)::BIGINT n FROM f UNION ALL SELECT 'cold_start_user', count(*) FILTER (cold_start_user)::BIGINT FROM f UNION ALL SELECT 'cold_start_item', count(*) FILTER (cold_start_item)::BIGINT FROM f UNION ALL SELECT 'evolving_interest', count(*) FILTER (evolving_interest)::BIGINT FROM f")
def condition_counts(spark, d):
    flags = task_profile(spark, d).agg(*(F.count_if(c).alias(c) for c in CONDITIONS))
    return flags.select(F.inline(F.array(*(F.struct(F.lit(c).alias("condition"), F.col(c).alias("n")) for c in CONDITIONS))))


@query(f"WITH {G} SELECT user_id, target, task_time FROM gt")
def task_time_asof(spark, d):
    return _timed(spark, d)[0]


@query(f"WITH {INTERACTIONS} SELECT user_id, item_id, max(ts) ts FROM i GROUP BY 1, 2")
def pair_last_time(spark, d):
    return L.pair_times(interactions(spark, d))


@query(f"WITH {_COUNTS} SELECT user_id, least(10, before)::BIGINT recent, greatest(0, before - 10)::BIGINT outside FROM p")
def last_n_split(spark, d):
    """The window by number instead of time: the last ten count as recent."""
    at = L.profile(*_timed(spark, d))
    return at.select("user_id", F.least(F.lit(10), "before").cast("bigint").alias("recent"), F.greatest(F.lit(0), F.col("before") - 10).cast("bigint").alias("outside"))


@query(f"WITH {X}, k AS (SELECT item_id, count(*) n FROM review GROUP BY 1) SELECT \"index\", min(coalesce(n, 0))::BIGINT least FROM x LEFT JOIN k USING (item_id) GROUP BY 1")
def min_candidate_popularity(spark, d):
    """Of each task's candidates the fewest reviews."""
    popularity = table(spark, d, "review").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return lookup_join(candidates(spark, d), popularity, "item_id", F.struct("index", "pos")).groupBy("index").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"))


@query(f"WITH {INTERACTIONS} SELECT user_id, count(*)::BIGINT n FROM i GROUP BY 1")
def user_density(spark, d):
    return interactions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {INTERACTIONS}, u AS (SELECT user_id, count(*) n FROM i GROUP BY 1) SELECT count(*)::BIGINT users, round(avg(n), 6) mean, quantile_cont(n, 0.5) median, round(quantile_cont(n, 0.9), 6) p90 FROM u""")
def density_summary(spark, d):
    u = user_density(spark, d)
    return u.agg(F.count(F.lit(1)).alias("users"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).alias("median"), F.round(F.percentile("n", 0.9), 6).alias("p90"))


@query("""WITH f AS (SELECT user_id, item_id, min(seq) first FROM review WHERE user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2), n AS (SELECT item_id, min(coalesce(nullif(title, ''), nullif(name, ''), item_id)) shown FROM item GROUP BY 1),
p AS (SELECT user_id, first, shown, row_number() OVER (PARTITION BY user_id ORDER BY first) pos FROM f JOIN n USING (item_id)) SELECT user_id, string_agg(shown, '; ' ORDER BY first) titles FROM p WHERE pos <= 30 GROUP BY 1""")
def titles_history(spark, d):
    """Titles of each user's first thirty distinct items in file order."""
    from ledgerloom.functions.aggregates import bounded_heap

    first = table(spark, d, "review").where("user_id IS NOT NULL AND item_id IS NOT NULL").groupBy("user_id", "item_id").agg(F.min("seq").alias("first"))
    names = table(spark, d, "item").groupBy("item_id").agg(F.min(first_filled("title", "name", "item_id")).alias("shown"))
    heap = bounded_heap(F.struct("first", "shown"), 30)
    return first.join(names, "item_id").groupBy("user_id").agg(F.array_join(F.transform(heap, lambda x: x["shown"]), "; ").alias("titles"))


@query(f"WITH {S} SELECT DISTINCT least(a.item_id, b.item_id) item_a, greatest(a.item_id, b.item_id) item_b FROM s a JOIN s b ON a.user_id = b.user_id AND b.pos > a.pos AND b.pos <= a.pos + 3 WHERE a.item_id <> b.item_id")
def cooccurrence_pairs(spark, d):
    return L.neighbours(sequences(spark, d), 3)


@query(f"WITH {S}, {C}, k AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM c) SELECT DISTINCT ka.idx AS a, kb.idx AS b FROM s x JOIN s y ON x.user_id = y.user_id AND y.pos > x.pos AND y.pos <= x.pos + 3 JOIN k ka ON ka.item_id = least(x.item_id, y.item_id) JOIN k kb ON kb.item_id = greatest(x.item_id, y.item_id) WHERE x.item_id <> y.item_id")
def pair_indices(spark, d):
    """Pairs by their items' numbers in the vocabulary; pairs with an unknown item are left out."""
    known = numbered(codes(spark, d).select(F.lit(0).alias("all"), "item_id"), ["all"], ["item_id"], "idx").select("item_id", (F.col("idx") - 1).alias("idx"))
    pairs = L.neighbours(sequences(spark, d), 3)
    return pairs.join(known.withColumnsRenamed({"item_id": "item_a", "idx": "a"}), "item_a").join(known.withColumnsRenamed({"item_id": "item_b", "idx": "b"}), "item_b").select("a", "b")


_SHAPES = ((r"^\d{4}-\d{2}-\d{2}", "yyyy-MM-dd", "%Y-%m-%d"), (r"^\d{4}/\d{2}/\d{2}", "yyyy/MM/dd", "%Y/%m/%d"), (r"^\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy", "%m/%d/%Y"))
_FIELDS = ("date", "date_updated", "date_added", "read_at", "started_at")
_DATES = "epoch(coalesce(" + ", ".join(f"try_strptime(nullif(regexp_extract(trim({c}), '{shape}'), ''), '{form}')" for c in _FIELDS for shape, _, form in _SHAPES) + "))::BIGINT"


@query(f"SELECT seq, coalesce(CASE WHEN isnan(timestamp) THEN NULL WHEN timestamp > 1e12 THEN timestamp / 1000 ELSE timestamp END, {_DATES}::DOUBLE) AS at FROM review")
def parse_timestamp(spark, d):
    """The plain reading of review times: numbers over 1e12 are milliseconds, else the first field that
    starts with a date, which counts by the day in UTC. (For all notations and zones see ``normalise_instants``.)"""
    start = lambda c, shape: F.nullif(F.regexp_extract(F.btrim(c), shape, 0), F.lit(""))
    dated = F.coalesce(*(F.try_to_timestamp(start(c, shape), F.lit(form)) for c in _FIELDS for shape, form, _ in _SHAPES))
    number = F.when(F.isnan("timestamp"), None).when(F.col("timestamp") > 1e12, F.col("timestamp") / 1000).otherwise(F.col("timestamp"))
    return table(spark, d, "review").select("seq", F.coalesce(number, F.unix_seconds(dated).cast("double")).alias("at"))


@query(f"WITH {T}, r AS (SELECT DISTINCT user_id, item_id FROM review WHERE user_id IS NOT NULL), n AS (SELECT \"index\", user_id, unnest(candidates) item_id FROM t) SELECT DISTINCT n.\"index\", n.item_id FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = n.user_id AND r.item_id = n.item_id)")
def negative_pool(spark, d):
    """Candidates that the user never reviewed."""
    from ledgerloom.plans.views import tasks

    offered = tasks(spark, d).select("index", "user_id", F.explode("candidates").alias("item_id")).distinct()
    seen = table(spark, d, "review").where("user_id IS NOT NULL").select("user_id", "item_id").distinct()
    return offered.join(seen, ["user_id", "item_id"], "left_anti").select("index", "item_id")
