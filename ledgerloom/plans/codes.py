"""Queries on item codes, embeddings and rankings by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.aggregates import bounded_heap
from ledgerloom.functions.scores import cosine, l2_normalised, shared_levels, shared_prefix
from ledgerloom.operators import codes as K
from ledgerloom.operators.drawing import expanded
from ledgerloom.operators.lookup import measured, shuffled
from ledgerloom.plans.ingest import _register
from ledgerloom.plans.views import C, S, codes, goals, sequences
from ledgerloom.sources.durable import durable
from ledgerloom.sources.tables import table

QUERIES, SQL, query = _register()

_D = C + ", k AS (SELECT *, count(*) OVER w leaf, CASE WHEN count(*) OVER w > 1 THEN row_number() OVER (w ORDER BY item_id) ELSE 0 END dedup FROM c WINDOW w AS (PARTITION BY c0, c1, c2))"


@query(f"WITH {_D} SELECT item_id, dedup FROM k")
def sid_dedup_digit(spark, d):
    return K.deduplicated(codes(spark, d)).select("item_id", "dedup")


@query(f"WITH {_D} SELECT item_id, concat_ws(',', c0, c1, c2, dedup::VARCHAR) code FROM k")
def sid_key(spark, d):
    return K.deduplicated(codes(spark, d)).select("item_id", K.code_key(dedup=True).alias("code"))


@query(f"WITH {C} SELECT item_id, c0 one, concat_ws(',', c0, c1) two, concat_ws(',', c0, c1, c2) nine FROM c")
def content_prefix(spark, d):
    """Prefixes of one and two levels; a depth of nine is all of them."""
    return codes(spark, d).select("item_id", K.prefix(1).alias("one"), K.prefix(2).alias("two"), K.prefix(9).alias("nine"))


@query(f"WITH {C} SELECT c0, c1, c2, count(*)::BIGINT items FROM c GROUP BY 1, 2, 3")
def leaf_sizes(spark, d):
    return K.leaf_sizes(codes(spark, d))


_HEALTH = "count(*)::BIGINT items, count(DISTINCT (c0, c1, c2))::BIGINT codes, count(DISTINCT c0)::BIGINT used_c0, count(DISTINCT c1)::BIGINT used_c1, count(DISTINCT c2)::BIGINT used_c2"


@query(f"WITH {C}, h AS (SELECT {_HEALTH} FROM c) SELECT *, round(1 - codes / items, 6) collision_rate, round(ln(1 + items / codes), 6) log_leaf FROM h")
def codebook_health(spark, d):
    return K.health(codes(spark, d))


@query(f"WITH {C}, l AS (SELECT count(*) n FROM c GROUP BY c0, c1, c2) SELECT count(*)::BIGINT leaves, max(n)::BIGINT largest, count(*) FILTER (n > 1)::BIGINT shared FROM l")
def sid_metadata(spark, d):
    """What the metadata of a code table says: leaves, the largest one, those that are shared."""
    return K.leaf_sizes(codes(spark, d)).agg(F.count(F.lit(1)).alias("leaves"), F.max("items").alias("largest"), F.count_if(F.col("items") > 1).alias("shared"))


@query(f"WITH {C} SELECT concat_ws(',', c0, c1, c2) code, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) items FROM c GROUP BY 1")
def sid_inverted_index(spark, d):
    """Items by code; a leaf holds as many as collide."""
    return codes(spark, d).groupBy(K.code_key().alias("code")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("items"))


@query(f"WITH {C} SELECT concat_ws(',', c0, c1, c2) code, count(*)::BIGINT collision_count, min(item_id) first FROM c GROUP BY 1 HAVING count(*) > 1")
def sid_collisions(spark, d):
    return codes(spark, d).groupBy(K.code_key().alias("code")).agg(F.count(F.lit(1)).alias("collision_count"), F.min("item_id").alias("first")).where("collision_count > 1")


@query(f"WITH {C} SELECT a.item_id, count(*) - 1 AS neighbours FROM c a JOIN (SELECT c0, c1 FROM c) b USING (c0, c1) GROUP BY 1")
def sid_neighbors(spark, d):
    """How many other items share an item's first two levels: a count per prefix, no pairs."""
    base = codes(spark, d)
    sizes = base.groupBy("c0", "c1").agg((F.count(F.lit(1)) - 1).alias("neighbours"))
    return base.join(sizes, ["c0", "c1"]).select("item_id", "neighbours")


@query(f"WITH {C}, n AS (SELECT c0, item_id, row_number() OVER (PARTITION BY c0 ORDER BY item_id) r FROM c) SELECT c0 AS prefix, r, item_id FROM n WHERE r <= 50")
def sid_prefix_search(spark, d):
    """The first 50 items of every one-level prefix; the limit is the operator's."""
    heap = codes(spark, d).groupBy(F.col("c0").alias("prefix")).agg(bounded_heap(F.col("item_id"), 50).alias("h"))
    return heap.select("prefix", F.posexplode("h").alias("r", "item_id")).select("prefix", (F.col("r") + 1).cast("bigint").alias("r"), "item_id")


@query(f"WITH {C}, e AS (SELECT c0, c1, c2, count(*) n, min(item_id) first FROM c GROUP BY 1, 2, 3), p AS (SELECT c0, c1, count(*) n FROM c GROUP BY 1, 2), nm AS (SELECT c0, c1, c2, string_agg(p_name, '; ' ORDER BY item_id) FILTER (r <= 5) names FROM (SELECT *, row_number() OVER (PARTITION BY c0, c1, c2 ORDER BY item_id) r FROM c JOIN part ON p_partkey = item_id) GROUP BY 1, 2, 3) SELECT concat_ws(',', e.c0, e.c1, e.c2) code, e.n::BIGINT exact, p.n::BIGINT under_prefix, first, names FROM e JOIN p USING (c0, c1) JOIN nm USING (c0, c1, c2)")
def decode_sid(spark, d):
    """What a code stands for: items with exactly it and the first five by name, items under its two-level prefix."""
    base = codes(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name")), "item_id")
    names = F.array_join(F.transform(bounded_heap(F.struct("item_id", "name"), 5), lambda x: x["name"]), "; ")
    exact = base.groupBy(*K.LEVELS).agg(F.count(F.lit(1)).alias("exact"), F.min("item_id").alias("first"), names.alias("names"))
    under = base.groupBy("c0", "c1").agg(F.count(F.lit(1)).alias("under_prefix"))
    return exact.join(under, ["c0", "c1"]).select(K.code_key().alias("code"), "exact", "under_prefix", "first", "names")


_PAIRS = f"{S}, {C}, z AS (SELECT a.user_id, a.pos, ca.c0 a0, ca.c1 a1, ca.c2 a2, cb.c0 b0, cb.c1 b1, cb.c2 b2 FROM s a JOIN s b ON a.user_id = b.user_id AND b.pos = a.pos + 1 JOIN c ca ON ca.item_id = a.item_id JOIN c cb ON cb.item_id = b.item_id)"


def _steps(spark, d):
    """Codes of each item of a sequence and of the next one."""
    coded = sequences(spark, d).join(codes(spark, d), "item_id")
    here = coded.select("user_id", "pos", *(F.col(c).alias(c.replace("c", "a")) for c in K.LEVELS))
    ahead = coded.select("user_id", (F.col("pos") - 1).alias("pos"), *(F.col(c).alias(c.replace("c", "b")) for c in K.LEVELS))
    return here.join(ahead, ["user_id", "pos"])




@query(f"WITH {_PAIRS} SELECT user_id, pos, round(((a0 = b0)::INT + (a1 = b1)::INT + (a2 = b2)::INT) / 3e0, 6) similarity FROM z")
def sid_similarity(spark, d):
    """Share of levels that agree, each by itself."""
    return _steps(spark, d).select("user_id", "pos", F.round(shared_levels([F.col(c) for c in ("a0", "a1", "a2")], [F.col(c) for c in ("b0", "b1", "b2")]), 6).alias("similarity"))


@query(f"WITH {_PAIRS} SELECT user_id, pos, CASE WHEN a0 <> b0 THEN 0 WHEN a1 <> b1 THEN 1 WHEN a2 <> b2 THEN 2 ELSE 3 END overlap FROM z")
def prefix_overlap(spark, d):
    return _steps(spark, d).select("user_id", "pos", shared_prefix([F.col(c) for c in ("a0", "a1", "a2")], [F.col(c) for c in ("b0", "b1", "b2")]).alias("overlap"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def l2_normalise(spark, d):
    e = table(spark, d, "embeddings").withColumn("unit", l2_normalised(F.col("embedding")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return e.select("vec_id", F.round(norm, 5).alias("norm"), F.round(F.get("unit", F.lit(0)), 6).alias("first"))


@query("""WITH q AS (SELECT vec_id query_id, embedding::DOUBLE[] q FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) similarity FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS "rank" FROM p) SELECT query_id, "rank", vec_id, round(similarity, 6) similarity FROM r WHERE "rank" <= 10""")
def knn_topk(spark, d):
    """Every vector whose id is divisible by 100 against all vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return K.nearest(e.where("vec_id % 100 = 0"), e, 10).select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"))


_BOOK = """b0 AS (SELECT label code, array_agg(m ORDER BY j) centre FROM (SELECT label, j, round(avg(x), 6) m FROM (SELECT label, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) j FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {_BOOK}, e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), r AS (SELECT vec_id, code, round(list_sum(list_transform(list_zip(v, centre), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) dist FROM e, b0)
SELECT vec_id, arg_min(code, (dist, code)) code0 FROM r GROUP BY 1""")
def residual_quantize(spark, d):
    """Nearest of the labels' mean vectors."""
    e = table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("j", "x")).groupBy("label", "j").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    book = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("centre")).withColumnRenamed("label", "code")
    return K.quantised(e, "vec_id", "embedding", [book])


# A task per customer: the target among 19 items that the customer never had.
_TRIES, _NEG = 64, 19
#: Rows of vectors up to which they are broadcast.
VECTOR_ROWS = 10_000
_DRAW = "(u.user_id * 7919 + t.j * 104729 + (u.user_id % 1009) * t.j * t.j) % n"
U = f"""{S}, g AS (SELECT user_id, item_id target FROM s WHERE pos = s.n), cat AS MATERIALIZED (SELECT p_partkey item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part),
j AS (SELECT u.user_id, t.j, {_DRAW} idx FROM g u, (SELECT count(*) n FROM part), range(0, {_TRIES}) t(j)),
d AS (SELECT j.user_id, cat.item_id, min(j.j) j FROM j JOIN cat USING (idx) ANTI JOIN s ON s.user_id = j.user_id AND s.item_id = cat.item_id GROUP BY 1, 2),
u AS MATERIALIZED (SELECT user_id, item_id, pos FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY j) AS pos FROM d) WHERE pos <= {_NEG} UNION ALL SELECT user_id, target, 0 FROM g)"""


def _drawn(spark, d, n=_NEG):
    """The universe, the sequences and the targets of all customers: (user_id, item_id, pos) with the target at 0
    and ``n`` drawn items, of which none is the target, after it; fewer are the first of more."""
    from ledgerloom.operators.numbering import numbered

    sequence = sequences(spark, d)  # written by the numbering
    goal = durable(goals(sequence), "goals")
    catalog = numbered(table(spark, d, "part").select(F.lit(0).alias("all"), F.col("p_partkey").alias("item_id")), ["all"], ["item_id"], "idx").select("item_id", (F.col("idx") - 1).alias("idx"))
    size = catalog.count()
    draw = (F.col("user_id") * 7919 + F.col("try") * 104729 + (F.col("user_id") % 1009) * F.col("try") * F.col("try")) % size
    drawn = expanded(goal, "user_id", catalog, sequence.select("user_id", "item_id"), draw, n, _TRIES)
    return drawn.unionByName(goal.select("user_id", F.col("target").alias("item_id"), F.lit(0).cast("bigint").alias("pos"))).where("user_id IS NOT NULL"), sequence, goal


def universe(spark, d):
    """The universe with the target beside each row."""
    pool, _, goal = _drawn(spark, d)
    return pool.join(measured(goal), "user_id")


@query(f"WITH {U} SELECT user_id, item_id, pos FROM u")
def expand_universe(spark, d):
    return universe(spark, d).select("user_id", "item_id", "pos")


@query(f"WITH {U} SELECT user_id, item_id FROM u WHERE pos BETWEEN 1 AND 9")
def negative_sampling(spark, d):
    """Nine items that the user never had."""
    return _drawn(spark, d, 9)[0].where("pos > 0").select("user_id", "item_id")


_MET = f"""{U}, {C}, e AS (SELECT vec_id item_id, embedding::DOUBLE[] v FROM embeddings), h AS MATERIALIZED (SELECT s.user_id, c0 h0, c1 h1, c2 h2, e.v hv FROM s JOIN g USING (user_id) JOIN c USING (item_id) LEFT JOIN e USING (item_id) WHERE s.pos <= 20 AND s.item_id <> g.target),
met AS (SELECT u.user_id, u.item_id, u.pos, ((c0 = h0)::INT + (c1 = h1)::INT + (c2 = h2)::INT) / 3e0 alike, list_cosine_similarity(e.v, hv) near FROM u JOIN c USING (item_id) LEFT JOIN e USING (item_id) LEFT JOIN h ON h.user_id = u.user_id)"""
_SCORE = _MET + """, sc AS (SELECT user_id, item_id, pos, round(coalesce(0.7e0 * max(alike) + 0.3e0 * max(near), max(alike), 0), 6) score FROM met GROUP BY 1, 2, 3),
rk AS MATERIALIZED (SELECT sc.*, target, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pos) AS "rank" FROM sc JOIN g USING (user_id))"""


def ranked(spark, d):
    """(user_id, item_id, pos, score, rank): the universe, the target at ``pos`` 0, by its likeness to the user's first
    20 other items, in codes and, where there are any, in embeddings."""
    return _ranked(spark, d)[0]


def _coded(spark, d):
    """The universe and each user's first 20 other items, with codes and unit vectors (NULL without one); sequences."""
    (u, sequence, goal), c = _drawn(spark, d), measured(codes(spark, d))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), l2_normalised(F.col("embedding")).alias("embedding"))
    e = measured(e, VECTOR_ROWS)
    coded = lambda x: x.join(c, "item_id", "left").join(e, "item_id", "left")
    history = sequence.join(measured(goal), "user_id").where("pos <= 20 AND item_id != target")
    return coded(u), coded(history), sequence


def _ranked(spark, d):
    from pyspark.sql import Window

    u, history, sequence = _coded(spark, d)
    scores = K.blended_scores(u, history, "user_id").withColumn("score", F.round("score", 6))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "pos")  # a universe is bounded by its draw
    return scores.withColumn("rank", F.row_number().over(order)), sequence


@query(f"WITH {_SCORE} SELECT user_id, item_id, score, \"rank\" FROM rk")
def sid_rank(spark, d):
    return ranked(spark, d).select("user_id", "item_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_SCORE} SELECT user_id, item_id, \"rank\" FROM rk WHERE \"rank\" <= 5")
def shortlist_topk(spark, d):
    return ranked(spark, d).where("rank <= 5").select("user_id", "item_id", F.col("rank").cast("bigint").alias("rank"))


_HITS = ", ".join(f"round(avg((r <= {k})::INT), 6) recall_{k}" for k in (5, 10, 20))


@query(f"WITH {_SCORE}, t AS (SELECT user_id, min(\"rank\") FILTER (item_id = target) r, count(*) m FROM rk GROUP BY 1) SELECT m::BIGINT m, count(*)::BIGINT tasks, {_HITS}, round(avg(CASE WHEN r <= 5 THEN 1 / log2(r + 1) ELSE 0e0 END), 6) ndcg_5, round(avg(coalesce(r, m)), 6) mean_rank, quantile_cont(coalesce(r, m), 0.5) median_rank, round(least(1e0, 5e0 / any_value(m)), 6) random_5 FROM t GROUP BY t.m")
def shortlist_recall(spark, d):
    """By size of the universe how often the target is among the first, its discounted gain and rank; the share that a random shortlist of five has."""
    t = ranked(spark, d).groupBy("user_id").agg(F.min(F.when((F.col("pos") == 0) & F.col("item_id").isNotNull(), F.col("rank"))).alias("r"), F.count(F.lit(1)).alias("m"))
    share = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6)
    rank = F.coalesce("r", "m")
    return t.groupBy("m").agg(
        F.count(F.lit(1)).alias("tasks"), *(share(k).alias(f"recall_{k}") for k in (5, 10, 20)), F.round(F.avg(F.when(F.col("r") <= 5, 1 / F.log2(F.col("r") + 1)).otherwise(0.0)), 6).alias("ndcg_5"),
        F.round(F.avg(rank), 6).alias("mean_rank"), F.percentile(rank, 0.5).alias("median_rank"), F.round(F.least(F.lit(1.0), 5.0 / F.first("m")), 6).alias("random_5"),
    )


@query(f"WITH {_SCORE} SELECT user_id, round(max(score), 6) top1, round(max(score) FILTER (\"rank\" = 1) - coalesce(max(score) FILTER (\"rank\" = 2), 0), 6) margin, round(stddev_pop(score), 6) deviation FROM rk GROUP BY 1")
def sid_confidence(spark, d):
    at = lambda k: F.coalesce(F.max(F.when(F.col("rank") == k, F.col("score"))), F.lit(0.0))
    return ranked(spark, d).groupBy("user_id").agg(F.round(F.max("score"), 6).alias("top1"), F.round(at(1) - at(2), 6).alias("margin"), F.round(F.stddev_pop("score"), 6).alias("deviation"))


@query(f"WITH {_SCORE}, w AS (SELECT rk.*, c0, c1, c2, md5(concat_ws(':', user_id, item_id)) h FROM rk JOIN c USING (item_id)) SELECT user_id, round(count(DISTINCT (c0, c1, c2)) / count(*), 6) diversity FROM w GROUP BY 1")
def candidate_diversity(spark, d):
    """Different codes per candidate."""
    u = universe(spark, d).join(measured(codes(spark, d)), "item_id")
    return u.groupBy("user_id").agg(F.round(F.countDistinct(*K.LEVELS) / F.count(F.lit(1)), 6).alias("diversity"))


@query(f"""WITH {U}, {C}, o AS (SELECT u.user_id, target, a.c0 || ',' || a.c1 || ',' || a.c2 code, b.c0 || ',' || b.c1 || ',' || b.c2 own, CASE WHEN a.c0 <> b.c0 THEN 0 WHEN a.c1 <> b.c1 THEN 1 WHEN a.c2 <> b.c2 THEN 2 ELSE 3 END overlap FROM u JOIN g USING (user_id) JOIN c a ON a.item_id = u.item_id JOIN c b ON b.item_id = g.target WHERE u.pos > 0),
l AS (SELECT c0 || ',' || c1 || ',' || c2 own, count(*) leaf FROM c GROUP BY 1)
SELECT user_id, (3 - max(overlap))::BIGINT separation, round(avg(overlap), 6) mean_overlap, round(avg((overlap = 3)::INT), 6) exact, round((count(DISTINCT code) FILTER (code <> own) + 1) / (count(*) + 1), 6) spread, round(ln(1 + any_value(leaf)), 6) log_leaf FROM o JOIN l USING (own) GROUP BY 1""")
def oracle_geometry(spark, d):
    """How far the target's code is from those of the other candidates, how many codes there are for a candidate, how full the target's leaf is."""
    c = codes(spark, d)
    leaves = K.leaf_sizes(c).select(*(F.col(x).alias(f"t{x}") for x in K.LEVELS), F.col("items").alias("leaf"))
    targets = c.select(F.col("item_id").alias("target"), *(F.col(x).alias(f"t{x}") for x in K.LEVELS)).join(measured(leaves), [f"t{x}" for x in K.LEVELS])
    u = universe(spark, d).where("pos > 0").join(measured(c), "item_id").join(measured(targets), "target")
    o = u.select("user_id", "leaf", K.code_key().alias("code"), shared_prefix([F.col(x) for x in K.LEVELS], [F.col(f"t{x}") for x in K.LEVELS]).alias("overlap"))
    return o.groupBy("user_id").agg(
        (3 - F.max("overlap")).cast("bigint").alias("separation"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.round(F.avg(F.when(F.col("overlap") == 3, 1.0).otherwise(0.0)), 6).alias("exact"),
        F.round((F.countDistinct(F.when(F.col("overlap") < 3, F.col("code"))) + 1) / (F.count(F.lit(1)) + 1), 6).alias("spread"), F.round(F.log1p(F.max("leaf")), 6).alias("log_leaf"),
    )


@query(f"WITH {U}, {C} SELECT user_id, concat_ws(',', c0, c1, c2) code, count(*)::BIGINT collision_count, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) items FROM u JOIN c USING (item_id) GROUP BY 1, 2 HAVING count(*) > 1")
def sid_collisions_in_pool(spark, d):
    """Codes that several candidates of a user share, and which; a pool is bounded by its draw."""
    pool = universe(spark, d).join(measured(codes(spark, d)), "item_id").groupBy("user_id", K.code_key().alias("code")).agg(F.count(F.lit(1)).alias("collision_count"), F.array_sort(F.collect_list("item_id")).alias("ids"))
    return pool.where("collision_count > 1").select("user_id", "code", "collision_count", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("items"))


_MODE = f"{S}, {C}, m AS (SELECT user_id, c0 AS prefix, count(*) n, min(pos) first FROM s JOIN c USING (item_id) GROUP BY 1, 2), hp AS (SELECT user_id, prefix, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) r FROM m)"


def _prefixes(spark, d, sequence=None):
    m = (sequences(spark, d) if sequence is None else sequence).join(measured(codes(spark, d)), "item_id").groupBy("user_id", F.col("c0").alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    heap = m.groupBy("user_id").agg(bounded_heap(F.struct((-F.col("n")).alias("fewer"), "first", "prefix"), 3).alias("h"))
    return heap.select("user_id", F.posexplode("h").alias("r", "h")).select("user_id", (F.col("r") + 1).cast("bigint").alias("r"), "h.prefix", (-F.col("h.fewer")).alias("n"))


@query(f"WITH {_MODE} SELECT user_id, r, prefix, n FROM hp WHERE r <= 3")
def history_prefixes(spark, d):
    """The three most frequent prefixes of each user's items, ties by first appearance."""
    return _prefixes(spark, d)


_POOL = f"{U}, {C}, m AS (SELECT user_id, c0 AS prefix, count(*) n, min(pos) first FROM s JOIN c USING (item_id) GROUP BY 1, 2), hp AS (SELECT user_id, prefix, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) r FROM m)"


@query(f"WITH {_POOL} SELECT u.user_id, u.item_id, hp.r FROM u JOIN c USING (item_id) JOIN hp ON hp.user_id = u.user_id AND hp.prefix = c.c0 WHERE hp.r <= 3")
def sid_prefix_in_pool(spark, d):
    """Candidates under one of the user's three favourite prefixes."""
    drawn, sequence, _ = _drawn(spark, d)
    pool = drawn.join(measured(codes(spark, d)), "item_id").select("user_id", "item_id", F.col("c0").alias("prefix"))
    return pool.join(shuffled(_prefixes(spark, d, sequence)), ["user_id", "prefix"]).select("user_id", "item_id", "r")


@query("WITH " + _SCORE + """, m AS (SELECT user_id, c0 AS prefix, count(*) n, min(pos) first FROM s JOIN c USING (item_id) GROUP BY 1, 2), hp AS (SELECT user_id, prefix, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) r FROM m),
w AS (SELECT rk.user_id, rk.item_id, score, "rank", concat_ws(',', c0, c1, c2) code, hp.r IS NOT NULL AS hit FROM rk JOIN c USING (item_id) LEFT JOIN hp ON hp.user_id = rk.user_id AND hp.prefix = c.c0 AND hp.r <= 3)
SELECT user_id, count(*) FILTER (hit)::BIGINT hits, (count(*) - count(DISTINCT code))::BIGINT collisions, arg_min(item_id, "rank") best, round(max(score), 6) score FROM w GROUP BY 1""")
def retrieval_trace(spark, d):
    """Per user the whole protocol: favourite prefixes, their hits in the pool, code collisions, scores."""
    scored, sequence = _ranked(spark, d)
    pool = scored.join(measured(codes(spark, d)), "item_id").withColumn("prefix", F.col("c0"))
    met = pool.join(shuffled(_prefixes(spark, d, sequence).select("user_id", "prefix", "r")), ["user_id", "prefix"], "left")
    return met.groupBy("user_id").agg(
        F.count("r").alias("hits"), (F.count(F.lit(1)) - F.countDistinct(*K.LEVELS)).alias("collisions"), F.min_by("item_id", "rank").alias("best"), F.round(F.max("score"), 6).alias("score")
    )


_RESCORED = "WITH " + _MET + """, ok AS (SELECT DISTINCT user_id FROM h WHERE hv IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY near DESC NULLS LAST) r FROM met SEMI JOIN ok USING (user_id)),
q AS (SELECT user_id, item_id, pos, round(coalesce(avg(near) FILTER (r <= 3), -1), 9) score, round(coalesce(max(alike), 0), 9) alike FROM k GROUP BY 1, 2, 3)
SELECT user_id, item_id, round(score, 6) score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, alike DESC, pos) AS "rank" FROM q"""


@query(_RESCORED)
def embedding_rescore(spark, d):
    """Candidates by the mean of their three best similarities to the user's first 20 other items, -1 without a vector; then by
    code likeness, then in their order. Users without vectors in their history have no ranking."""
    u, history, _ = _coded(spark, d)
    return K.rescored(u, history, "user_id").select("user_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("WITH " + U + """, e AS (SELECT vec_id item_id, embedding[1]::DOUBLE s0 FROM embeddings), k AS (SELECT u.*, s0 FROM u LEFT JOIN e USING (item_id))
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY (s0 IS NULL)::INT, s0 DESC, pos) AS "rank" FROM k""")
def rank_unknown_last(spark, d):
    """Known items by score, unknown ones after them in their order."""
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.get("embedding", F.lit(0)).cast("double").alias("s0"))
    e = measured(e)
    order = Window.partitionBy("user_id").orderBy(F.col("s0").isNull(), F.desc_nulls_last("s0"), "pos")
    return universe(spark, d).join(e, "item_id", "left").select("user_id", "item_id", F.row_number().over(order).cast("bigint").alias("rank"))
