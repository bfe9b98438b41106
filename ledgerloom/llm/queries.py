"""Queries of problems 2, 3 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.pairs import PairTable
from ledgerloom.llm.quota import Category, sample_to_targets
from ledgerloom.llm.topn import top_n_per_group
from ledgerloom.sources.durable import scratch_path
from ledgerloom.sources.tables import clean_id, table


def _associations(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "review").select(F.col("source").alias("scope"), clean_id("user_id").alias("basket"), clean_id("item_id").alias("item"))
    counts = PairTable(spark, scratch_path(spark, "pairs"), max_items=100)
    counts.apply(log)
    return counts.associations(min_both=5, min_lift=8)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items reviewed together far more often than chance."""
    return _associations(spark, d).select("item_a", "item_b")


def p2_associations(spark: SparkSession, d: str) -> DataFrame:
    """The same with their counts and lift."""
    return _associations(spark, d).select("item_a", "item_b", "both", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p2_revised(spark: SparkSession, d: str) -> DataFrame:
    """The same after increments: one source's reviews, those of the others, then all without a rating taken
    back; the table is opened anew for each."""
    log = table(spark, d, "review").select(F.col("source").alias("scope"), clean_id("user_id").alias("basket"), clean_id("item_id").alias("item"), (F.col("source") == "yelp").alias("first"), F.coalesce(F.col("stars") > 0, F.lit(False)).alias("rated"))
    first, path = F.coalesce("first", F.lit(False)), scratch_path(spark, "pairs")
    for part in (log.where(first), log.where(~first), log.where("NOT rated").withColumn("sign", F.lit(-1))):
        PairTable(spark, path, max_items=100).apply(part)
    counts = PairTable(spark, path).associations(min_both=5, min_lift=8)
    return counts.select("item_a", "item_b", "both", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best-scored candidates of each trace."""
    chunks = table(spark, d, "retrieval_trace").select("trace_id", "chunk_no", F.explode("candidate_scores").alias("item_id", "score"))
    return top_n_per_group(chunks, "trace_id", "item_id", "score", 5, version="chunk_no").select("trace_id", "item_id")


def p3_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with rank and score."""
    chunks = table(spark, d, "retrieval_trace").select("trace_id", "chunk_no", F.explode("candidate_scores").alias("item_id", "score"))
    return top_n_per_group(chunks, "trace_id", "item_id", "score", 5, version="chunk_no")


#: Most categories that sample_target may hold; the plan is read by the driver.
MAX_CATEGORIES = 2000


def _plans(spark: SparkSession, d: str) -> list[Category]:
    rows = table(spark, d, "sample_target").limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"sample_target has more than {MAX_CATEGORIES} categories")
    out = []
    for r in sorted(rows, key=lambda r: (r["plan_id"], r["category"])):
        member = F.lit(True)
        if r["reviews_lo"] is not None:
            member = member & (F.col("reviews") >= r["reviews_lo"])
        if r["reviews_hi"] is not None:
            member = member & (F.col("reviews") <= r["reviews_hi"])
        if r["condition_name"] is not None:
            member = member & F.array_contains("conditions", r["condition_name"])
        out.append(Category(r["plan_id"], r["category"], member, r["target_permille"] or 0, r["min_rows"] or 0, r["sample_percent"] or 0))
    return out


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    holds = F.array_sort(F.coalesce(F.map_keys(F.map_filter("conditions", lambda k, v: v)), F.array().cast("array<string>")))
    rows = table(spark, d, "calibration_candidate").select(clean_id("user_id").alias("user_id"), clean_id("target_item_id").alias("target_item_id"), F.struct(F.col("user_reviews_before_task").alias("reviews"), holds.alias("conditions")).alias("of"))
    rows = rows.where("user_id IS NOT NULL AND target_item_id IS NOT NULL AND of.reviews >= 0")
    units = rows.groupBy("user_id", "target_item_id").agg(F.min("of").alias("of")).select("user_id", "target_item_id", "of.*")
    return sample_to_targets(units, ["user_id", "target_item_id"], _plans(spark, d), seed=42)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories that cannot be met."""
    return _sampled(spark, d)[1].where("short").select("plan_id", "category")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """What each category of each plan should and did get."""
    return _sampled(spark, d)[1].select("plan_id", "category", "usable", "need", "taken", "short")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    """The samples themselves."""
    return _sampled(spark, d)[0]


_BASKETS_SQL = """
WITH b AS (SELECT DISTINCT source, trim(user_id) u, trim(item_id) i FROM review WHERE trim(user_id) NOT IN ('', 'None', 'nan') AND trim(item_id) NOT IN ('', 'None', 'nan')),
k AS (SELECT source, u FROM b GROUP BY 1, 2 HAVING count(*) <= 100), s AS (SELECT b.* FROM b JOIN k USING (source, u)),
n AS (SELECT source, i, count(*) n FROM s GROUP BY 1, 2), t AS (SELECT source, count(*) users FROM k GROUP BY 1),
p AS (SELECT a.source, a.i item_a, b.i item_b, count(*) AS both_n FROM s a JOIN s b ON a.source = b.source AND a.u = b.u AND a.i < b.i GROUP BY 1, 2, 3 HAVING count(*) >= 5),
r AS (SELECT item_a, item_b, both_n, na.n n_a, nb.n n_b, users FROM p JOIN n na ON na.source = p.source AND na.i = item_a JOIN n nb ON nb.source = p.source AND nb.i = item_b JOIN t ON t.source = p.source
  WHERE both_n * users >= 8 * na.n * nb.n)
"""
_TOP_SQL = """
WITH c AS (SELECT trace_id, chunk_no, e.key item_id, e.value score FROM (SELECT trace_id, chunk_no, unnest(map_entries(candidate_scores)) e FROM retrieval_trace) WHERE e.value IS NOT NULL AND NOT isnan(e.value)),
l AS (SELECT trace_id, item_id, arg_max(score, (chunk_no, score)) score FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, item_id) AS "rank" FROM l)
"""
_QUOTA_SQL = """
WITH u AS (SELECT trim(user_id) u, trim(target_item_id) i, min(user_reviews_before_task) n, any_value(conditions) c FROM calibration_candidate WHERE user_reviews_before_task >= 0 GROUP BY 1, 2),
m AS (SELECT t.plan_id, t.category, count(u.u)::BIGINT usable, any_value(target_permille) permille, any_value(min_rows) min_rows, any_value(sample_percent) percent
  FROM sample_target t LEFT JOIN u ON n >= coalesce(reviews_lo, n) AND n <= coalesce(reviews_hi, n) AND (condition_name IS NULL OR coalesce(c[condition_name], false)) GROUP BY 1, 2),
z AS (SELECT *, floor(percent * sum(usable) OVER (PARTITION BY plan_id) / 100)::BIGINT size FROM m),
d AS (SELECT *, greatest(min_rows, ceil(permille * size / 1000))::BIGINT need FROM z),
k AS (SELECT plan_id, category, size, row_number() OVER (PARTITION BY plan_id ORDER BY (r > min_rows)::INT, (2 * r - 1)::DOUBLE / permille, category) o FROM (SELECT *, unnest(range(1, usable + 1)) r FROM d)),
g AS (SELECT plan_id, category, count(*)::BIGINT taken FROM k WHERE o <= size GROUP BY 1, 2)
"""

QUERIES = {"p2_found": p2_found, "p2_associations": p2_associations, "p2_revised": p2_revised, "p3_found": p3_found, "p3_ranked": p3_ranked, "p5_found": p5_found, "p5_report": p5_report, "p5_sample": p5_sample}
_SCORED = "SELECT item_a, item_b, both_n::BIGINT AS \"both\", n_a::BIGINT n_a, n_b::BIGINT n_b, round(both_n::DOUBLE * users / (n_a::DOUBLE * n_b), 6) lift FROM r"
SQL = {
    "p2_found": _BASKETS_SQL + "SELECT item_a, item_b FROM r",
    "p2_associations": _BASKETS_SQL + _SCORED,
    "p2_revised": _BASKETS_SQL.replace("FROM review WHERE", "FROM review WHERE stars > 0 AND") + _SCORED,
    "p3_found": _TOP_SQL + "SELECT trace_id, item_id FROM r WHERE \"rank\" <= 5",
    "p3_ranked": _TOP_SQL + "SELECT trace_id, \"rank\"::INT AS \"rank\", item_id, score FROM r WHERE \"rank\" <= 5",
    "p5_found": _QUOTA_SQL + "SELECT plan_id, category FROM d WHERE usable < need",
    "p5_report": _QUOTA_SQL + "SELECT plan_id, category, usable, need, coalesce(taken, 0)::BIGINT taken, usable < need AS short FROM d LEFT JOIN g USING (plan_id, category)",
}
