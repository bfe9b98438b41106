"""Taking texts apart, as Column expressions where these can."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Reasoning before an answer, in its three notations, with the white space after it.
PREAMBLES = (
    r"(?is)^\s*Thinking\.\.\..*?\.\.\.done thinking\.\s*",
    r"(?is)<think>.*?</think>\s*",
    r"(?is)<\|think\|>.*?<\|/think\|>\s*",
)


def without_preamble(text: Column) -> Column:
    """Reasoning that leaked before an answer cut away."""
    for pattern in PREAMBLES:
        text = F.regexp_replace(text, pattern, "")
    return F.btrim(text, F.lit(" \t\r\n"))


def truncated(df: DataFrame, text: str, tokens: int, ranks: str, pattern: str) -> DataFrame:
    """``df`` with ``text`` cut after so many tokens of a byte-pair vocabulary: ``ranks``, a file that every worker can read,
    of base64 tokens and their ranks; ``pattern``, what parts a text before pairs are merged. Shorter texts, NULL too,
    stay; a character that the cut goes through is left out. Texts of at most ``tokens`` bytes are not
    encoded: they have no more tokens than bytes.
    """
    at = df.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                ids = encoding.encode_ordinary(t) if t is not None and len(t.encode()) > tokens else ()
                out.append(encoding.decode_bytes(ids[:tokens]).decode(errors="ignore") if len(ids) > tokens else t)
            yield batch.set_column(at, text, pa.array(out, pa.string()))

    return df.mapInArrow(cut, df.schema)


def blocks(text: Column) -> Column:
    """All {...} blocks without blocks inside."""
    return F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1))


def catalogue(text: Column) -> Column:
    """ARRAY<STRUCT(id, name, about)> of ``[n] name: description`` entries; about is the first sentence."""
    entries = F.regexp_extract_all(text, F.lit(r"(?s)(\[\d+\] [^:\[\]]+: .+?)(?=\[\d+\]|\z)"), F.lit(1))
    return F.transform(entries, lambda e: F.struct(
        F.regexp_extract(e, r"^\[(\d+)\]", 1).cast("int").alias("id"), F.trim(F.regexp_extract(e, r"^\[\d+\] ([^:]+):", 1)).alias("name"),
        F.concat(F.trim(F.split_part(F.regexp_replace(e, r"^\[\d+\] [^:]+: ", ""), F.lit("."), F.lit(1))), F.lit(".")).alias("about"),
    ))


def first_integer(text: Column) -> Column:
    """The first run of digits as BIGINT, 0 without one or if it is too long."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def parsed_ranking(text: Column, valid: Column) -> Column:
    """Ids of ``valid`` that a text ranks, each once.

    The first bracketed list without brackets inside that names any; else three
    or more quoted ones; else any that are mentioned, in order of first mention;
    else none. NULL gives none.
    """
    known = lambda ids: F.array_distinct(F.filter(ids, lambda x: F.array_contains(valid, x)))
    trimmed = lambda ids: F.transform(ids, lambda x: F.regexp_replace(x, r"^[\s'\"]+|[\s'\"]+$", ""))
    lists = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), lambda part: known(trimmed(F.split(part, ","))))
    bracketed = F.get(F.filter(lists, lambda ids: F.size(ids) > 0), F.lit(0))
    quoted = known(F.regexp_extract_all(text, F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1)))
    places = F.transform(valid, lambda x: F.struct(F.position(x, text).alias("at"), x.alias("id")))
    mentioned = F.transform(F.array_sort(F.filter(places, lambda p: p["at"] > 0)), lambda p: p["id"])
    none = F.array().cast("array<string>")
    return F.coalesce(bracketed, F.when(F.size(quoted) >= 3, quoted), mentioned, none)
