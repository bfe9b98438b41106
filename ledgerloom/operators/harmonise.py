"""Bringing differently shaped sources to one table, and keeping the rows that belong together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def renamed(df: DataFrame, names: dict[str, str], source: str, kind: str) -> DataFrame:
    """Columns renamed, ``source`` and ``type`` added; columns without a new name stay."""
    return df.withColumnsRenamed(names).withColumns({"source": F.lit(source), "type": F.lit(kind)})


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def surrogate_key(columns: Sequence[str]) -> Column:
    """A key that depends on the row's content alone; NULLs differ from empty texts."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def first_existing(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of ``names`` that is a column, whatever its values."""
    return next((n for n in names if n in df.columns), None)


def first_filled(*columns: str) -> Column:
    """Row by row the first text that is neither NULL nor empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def keep_known(df: DataFrame, **known: DataFrame) -> DataFrame:
    """Rows whose every named column is found in the relation given for it, each by itself.

    What is known is made distinct first, so that a key that often occurs there counts once."""
    for column, other in known.items():
        df = df.join(other.select(F.col(other.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order; taken as a maximum, so repeats are combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__ll_row")).select(key, "__ll_row.*")


#: By source, the three columns that describe an item.
TEXT_FIELDS = {"amazon": ("title", "description", "features"), "yelp": ("name", "categories", "attributes"), "goodreads": ("title", "description", "authors")}
#: The columns that count towards an item's metadata.
ITEM_FIELDS = ("item_id", "name", "title", "stars", "average_rating", "review_count", "rating_number", "attributes", "description", "categories", "type", "source")


def item_text() -> Column:
    """Text of an item by its source: the described columns, trimmed, empty ones left out; else its id."""
    joined = lambda names: F.concat_ws(" ", *(F.nullif(F.trim(c), F.lit("")) for c in names))
    text = None
    for source, names in TEXT_FIELDS.items():
        text = (F.when if text is None else text.when)(F.col("source") == source, joined(names))
    return F.coalesce(F.nullif(text.otherwise(joined(("title", "description"))), F.lit("")), F.col("item_id"))


def filled_count(columns: Sequence[str], kinds: dict[str, str]) -> Column:
    """How many columns hold something: NULL, 0, the empty text and empty JSON hold nothing."""
    one = lambda c: F.when(F.col(c).isNotNull() & (~F.col(c).isin("", "[]", "{}") if kinds[c] == "string" else F.col(c) != 0), 1).otherwise(0)
    return sum((one(c) for c in columns), F.lit(0))
