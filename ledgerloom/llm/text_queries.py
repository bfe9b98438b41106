"""Queries of problems 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.leaks import find_leaks
from ledgerloom.llm.mixture import Share, mix_sources
from ledgerloom.llm.pieces import split_oversized
from ledgerloom.llm.tokens import PATTERN, token_count
from ledgerloom.sources.tables import BLANKS, table

#: Most rows that mix_target may hold; the driver reads it.
MAX_SHARES = 2000


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "mix_target").limit(MAX_SHARES + 1).collect()
    if len(rows) > MAX_SHARES:
        raise ValueError(f"mix_target has more than {MAX_SHARES} rows")
    shares = [Share(r["mix_id"], r["source"], r["target_permille"] or 0, r["max_repeats"] or 0, r["budget_percent"] or 0) for r in sorted(rows, key=lambda r: (r["mix_id"], r["source"]))]
    name = F.nullif(F.translate(F.lower(F.btrim("source", F.lit(BLANKS))), "-", "_"), F.lit(""))
    docs = table(spark, d, "documents").select("doc_id", name.alias("source"), token_count(F.col("text")).alias("tokens"))
    return mix_sources(docs, "doc_id", "source", "tokens", shares, seed=42)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot fill their share of a mix."""
    return _mixed(spark, d)[1].where("short").select("mix_id", "source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """What each source of each mix has, should give and gives."""
    return _mixed(spark, d)[1]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixes themselves."""
    return _mixed(spark, d)[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts over the limit, and those with a stretch that no natural boundary cuts."""
    first = split_oversized(table(spark, d, "documents"), "doc_id", "text", 400, 40, small=False, with_text=False).where("piece = 0")
    issues = F.array(F.lit("over_limit"), F.when(F.col("longest_stretch") > 400, F.lit("no_boundary")))
    return first.select("doc_id", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all documents."""
    return split_oversized(table(spark, d, "documents"), "doc_id", "text", 400, 40)


def p9_lossless(spark: SparkSession, d: str) -> DataFrame:
    """Per document what its pieces give back: the digest of their new parts joined, the tokens less the overlaps, whether all are within the limit."""
    new = F.expr("substring(text, int(own - start) + 1)")
    parts = p9_pieces(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", new.alias("new")))).alias("parts"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))
    return parts.select("doc_id", F.md5(F.array_join(F.transform("parts", lambda p: p["new"]), "")).alias("digest"), (F.col("tokens") - 40 * (F.size("parts") - 1)).cast("bigint").alias("tokens"), (F.col("most") <= 400).alias("within"))


_TOKENS_SQL = f"coalesce(len(regexp_extract_all(text, '{PATTERN}')), 0)"
_MIX_SQL = f"""
WITH t AS (SELECT replace(lower(trim(source)), '-', '_') s, sum({_TOKENS_SQL})::BIGINT n FROM documents WHERE trim(source) <> '' GROUP BY 1),
r AS (SELECT mix_id, source, coalesce(n, 0)::BIGINT available, target_permille, max_repeats, budget_percent, (SELECT sum(n) FROM t) total FROM mix_target LEFT JOIN t ON s = source)
"""
_CUT_SQL = f"""
WITH d AS (SELECT doc_id, text FROM documents WHERE {_TOKENS_SQL} > 400),
s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\r\f\v]', '\\1\n', 'g'), '\n')) AS text FROM d)
"""

QUERIES = {"p8_found": p8_found, "p8_report": p8_report, "p8_mix": p8_mix, "p9_found": p9_found, "p9_pieces": p9_pieces, "p9_lossless": p9_lossless}
SQL = {
    "p8_found": _MIX_SQL + "SELECT mix_id, source FROM r WHERE max_repeats::HUGEINT * available * 100000 < total * budget_percent * target_permille",
    "p9_lossless": f"SELECT doc_id, md5(coalesce(text, '')) digest, {_TOKENS_SQL}::BIGINT tokens, true AS within FROM documents",
    "p9_found": _CUT_SQL + f"SELECT doc_id, 'over_limit' issue FROM d UNION ALL SELECT DISTINCT doc_id, 'no_boundary' FROM s WHERE {_TOKENS_SQL} > 400",
}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry a passage of an evaluation text, and which."""
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "eval_id", "review")


QUERIES |= {"p7_found": p7_found}
