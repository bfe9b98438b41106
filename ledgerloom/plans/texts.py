"""Queries that take texts apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import texts as P
from ledgerloom.plans.ingest import _register
from ledgerloom.plans.views import R, X, rankings, tasks
from ledgerloom.sources.tables import table

QUERIES, SQL, query = _register()


@query("SELECT doc_id, left(text, 300) head, length(left(text, 300))::BIGINT n FROM documents")
def truncate_text(spark, d):
    """The first 300 characters; cutting is the operator."""
    head = F.substring("text", 1, 300)
    return table(spark, d, "documents").select("doc_id", head.alias("head"), F.length(head).cast("bigint").alias("n"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace('Thinking... ' || coalesce(source, '') || ' ...done thinking. ' || text || ' <think>' || doc_id || '</think> ok', '^\\s*Thinking\\.\\.\\..*?\\.\\.\\.done thinking\\.\\s*', '', 'is'), '<think>.*?</think>\\s*', '', 'gis'), E' \\t\\r\\n')) kept FROM documents")
def strip_tags(spark, d):
    """Texts dressed up with a preamble and a thought, and undressed again."""
    dressed = F.concat(F.lit("Thinking... "), F.coalesce("source", F.lit("")), F.lit(" ...done thinking. "), F.col("text"), F.lit(" <think>"), F.col("doc_id").cast("string"), F.lit("</think> ok"))
    return table(spark, d, "documents").select("doc_id", F.md5(P.without_preamble(dressed)).alias("kept"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\{[^{}]*\\}'))::BIGINT blocks, md5(regexp_extract(text, '\\{[^{}]*\\}')) first FROM documents WHERE text IS NOT NULL")
def extract_blocks(spark, d):
    b = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", P.blocks(F.col("text")).alias("b"))
    return b.select("doc_id", F.size("b").cast("bigint").alias("blocks"), F.md5(F.coalesce(F.get("b", F.lit(0)), F.lit(""))).alias("first"))


@query("SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(text, '[0-9]+'), '') AS BIGINT), 0) first FROM documents")
def first_int(spark, d):
    return table(spark, d, "documents").select("doc_id", P.first_integer(F.col("text")).alias("first"))


@query("SELECT DISTINCT source, regexp_replace(lang || ':' || source || '/x', '[:/]', '_', 'g') tag FROM documents")
def model_tag(spark, d):
    return table(spark, d, "documents").select("source", F.regexp_replace(F.concat("lang", F.lit(":"), "source", F.lit("/x")), "[:/]", "_").alias("tag")).distinct()


@query("""WITH l AS (SELECT p_partkey, 'cmp [' || CASE p_size % 4 WHEN 0 THEN '1.5b' WHEN 1 THEN 'llama_' || p_size || 'b' WHEN 2 THEN 'gemma' || CASE WHEN p_size % 8 = 2 THEN p_size || 'B' ELSE '' END ELSE p_brand END || ']' s FROM part), g AS (SELECT p_partkey, replace(lower(regexp_extract(s, '\\[([^\\]]+)\\]', 1)), '_', '') t FROM l)
SELECT p_partkey, CASE WHEN t IN ('1.5b', '3b', '7b') THEN 'Qwen' WHEN regexp_matches(t, '[0-9]b') AND t LIKE '%llama%' THEN 'Llama' WHEN regexp_matches(t, '[0-9]b') AND t LIKE '%gemma%' THEN 'Gemma' END family, CASE WHEN t IN ('1.5b', '3b', '7b') THEN upper(t) WHEN regexp_matches(t, '[0-9]b') AND (t LIKE '%llama%' OR t LIKE '%gemma%') THEN regexp_extract(t, '([0-9]+)b', 1) || 'B' ELSE t END size FROM g""")
def parse_label(spark, d):
    """Family and size from a bracketed tag; a tag that names no size is told as it is."""
    kind = F.col("p_size") % 4
    size = F.col("p_size").cast("string")
    inner = F.when(kind == 0, "1.5b").when(kind == 1, F.concat(F.lit("llama_"), size, F.lit("b"))).when(kind == 2, F.concat(F.lit("gemma"), F.when(F.col("p_size") % 8 == 2, F.concat(size, F.lit("B"))).otherwise(""))).otherwise(F.col("p_brand"))
    label = table(spark, d, "part").select("p_partkey", F.concat(F.lit("cmp ["), inner, F.lit("]")).alias("s"))
    t = F.col("t")
    sized = t.rlike("[0-9]b")
    plain, llama, gemma = t.isin("1.5b", "3b", "7b"), sized & t.contains("llama"), sized & t.contains("gemma")
    return label.select("p_partkey", F.replace(F.lower(F.regexp_extract("s", r"\[([^\]]+)\]", 1)), F.lit("_"), F.lit("")).alias("t")).select(
        "p_partkey", F.when(plain, "Qwen").when(llama, "Llama").when(gemma, "Gemma").alias("family"),
        F.when(plain, F.upper(t)).when(llama | gemma, F.concat(F.regexp_extract(t, "([0-9]+)b", 1), F.lit("B"))).otherwise(t).alias("size"),
    )


@query(f"WITH {X}, {R('hm', 'ra')} SELECT \"index\", CASE \"index\" % 4 WHEN 3 THEN '' WHEN 2 THEN array_to_string(output[1:4], ',') ELSE array_to_string(output[1:5], ',') END ranking FROM ra WHERE output IS NOT NULL")
def parse_ranking(spark, d):
    """Rankings written as a list, in quotes, in prose and not at all, and read again."""
    r = rankings(spark, d, "hm").join(tasks(spark, d).select("index", "candidates"), "index").where("output IS NOT NULL")
    top = F.slice("output", 1, 5)
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    listed = F.concat(F.lit("Answer [none] is ["), F.array_join(F.transform(top, quoted), ", "), F.lit("]."))
    quotes = F.concat(F.lit("I say "), F.array_join(F.transform(top, quoted), " then "))
    prose = F.concat(F.lit("1. "), F.array_join(F.slice("output", 1, 4), "; 2. "), F.lit("!"))
    kind = F.col("index") % 4
    text = F.when(kind == 0, listed).when(kind == 1, quotes).when(kind == 2, prose).otherwise("nothing here")
    return r.withColumn("text", text).select("index", F.array_join(P.parsed_ranking(F.col("text"), F.col("candidates")), ",").alias("ranking"))
