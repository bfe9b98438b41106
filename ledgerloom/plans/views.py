"""Relations that the queries share, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.timelines import first_occurrences
from ledgerloom.sources.durable import durable
from ledgerloom.sources.tables import table

#: Conditions in the order in which rows are dealt to them.
CONDITIONS = ("classic", "cold_start_user", "cold_start_item", "evolving_interest")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, item_id, ts, qty): who bought what when, ts in epoch seconds."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.unix_seconds("o_orderdate").alias("ts"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("qty"))
    return lines.join(orders, "o_orderkey").select("user_id", "item_id", "ts", "qty")


I = "i AS (SELECT o_custkey user_id, l_partkey item_id, epoch(o_orderdate)::BIGINT ts, l_quantity qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"  # noqa: E741
S = I + ", s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) pos, count(*) OVER (PARTITION BY user_id) n FROM (SELECT user_id, item_id, min(ts) ts FROM i GROUP BY 1, 2))"


def kept_interactions(spark: SparkSession, d: str) -> DataFrame:
    """``interactions`` written once, for queries that read them several times."""
    return durable(interactions(spark, d), "interactions")


def sequences(spark: SparkSession, d: str, log: DataFrame | None = None) -> DataFrame:
    return first_occurrences(interactions(spark, d) if log is None else log)


def goals(sequence: DataFrame) -> DataFrame:
    """(user_id, target): per customer the item seen first last."""
    return sequence.groupBy("user_id").agg(F.max_by("item_id", "pos").alias("target"))


G = S + ", g AS (SELECT user_id, item_id target FROM s WHERE pos = n), gt AS (SELECT user_id, target, max(ts) task_time FROM g JOIN i USING (user_id) WHERE i.item_id = target GROUP BY 1, 2)"


def codes(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, c0, c1, c2): three-level codes of the parts."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("c0"), F.col("p_type").alias("c1"), F.col("p_size").cast("string").alias("c2"))


C = "c AS (SELECT p_partkey item_id, p_brand c0, p_type c1, p_size::VARCHAR c2 FROM part)"


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """(index, source, user_id, target, candidates) of the recorded tasks, each once."""
    return table(spark, d, "task_profile").select(F.col("index").cast("bigint").alias("index"), "source", "user_id", F.col("target_item_id").alias("target"), F.col("candidate_item_ids").alias("candidates")).distinct()


T = 't AS (SELECT DISTINCT "index"::BIGINT AS "index", source, user_id, target_item_id target, candidate_item_ids candidates FROM task_profile)'


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(index, source, target, pos, item_id): one row per candidate, positions from 0."""
    return tasks(spark, d).select("index", "source", "target", F.posexplode("candidates").alias("pos", "item_id"))


X = T + ', x AS (SELECT "index", source, target, unnest(candidates) item_id, generate_subscripts(candidates, 1) - 1 AS pos FROM t)'


def rankings(spark: SparkSession, d: str, arm: str) -> DataFrame:
    """(index, source, target, output, error): a ranking of each task's candidates that both engines can
    compute, the order of an MD5 of arm, task and item; one task in eleven failed."""
    order = F.transform(F.array_sort(F.transform("candidates", lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(arm), F.col("index").cast("string"), x)).alias("h"), x.alias("i")))), lambda s: s["i"])
    failed = F.col("index") % 11 == 3
    return tasks(spark, d).select("index", "source", "target", F.when(~failed, order).alias("output"), F.when(failed, "timeout").alias("error"))


def R(arm: str, name: str = "r") -> str:
    return f"""{name} AS (SELECT "index", source, target, CASE WHEN "index" % 11 <> 3 THEN list(item_id ORDER BY md5(concat_ws(':', '{arm}', "index", item_id)), item_id) END AS output, CASE WHEN "index" % 11 = 3 THEN 'timeout' END error FROM x GROUP BY 1, 2, 3)"""


def gains(spark: SparkSession, d: str) -> DataFrame:
    """(backbone, dataset, condition, run_index, hm, hmt, voi): paired scores of two arms."""
    from ledgerloom.functions.scores import ndcg

    one = rankings(spark, d, "hm").select("index", "source", ndcg(F.col("output"), F.col("target"), 5).alias("hm"))
    two = rankings(spark, d, "hmt").select("index", ndcg(F.col("output"), F.col("target"), 5).alias("hmt"))
    names = F.array(*(F.lit(c) for c in CONDITIONS))
    return one.join(two, "index").select(
        F.concat(F.lit("b"), (F.col("index") % 3).cast("string")).alias("backbone"), F.col("source").alias("dataset"), F.element_at(names, (F.col("index") % 4 + 1).cast("int")).alias("condition"),
        F.col("index").alias("run_index"), "hm", "hmt", (F.col("hmt") - F.col("hm")).alias("voi"),
    )


_ND = "CASE WHEN coalesce(list_position({o}, target), 0) BETWEEN 1 AND 5 THEN 1 / log2(list_position({o}, target) + 1) ELSE 0e0 END"
V = f"""{X}, {R("hm", "ra")}, {R("hmt", "rb")}, v AS (SELECT 'b' || ("index" % 3) backbone, source dataset, ['classic', 'cold_start_user', 'cold_start_item', 'evolving_interest'][("index" % 4 + 1)::INT] "condition", "index" run_index, hm, hmt, hmt - hm voi
FROM (SELECT ra."index", ra.source, {_ND.format(o="ra.output").replace("target", "ra.target")} hm, {_ND.format(o="rb.output").replace("target", "rb.target")} hmt FROM ra JOIN rb USING ("index")))"""
