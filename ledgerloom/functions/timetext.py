"""Reading points in time from numbers and texts of any of the usual notations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first letters of the English months, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Offsets from UTC in hours of the zone abbreviations in use in the
# United States, and of UTC itself.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "AKST": -9, "AKDT": -8, "HST": -10, "HDT": -9,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([AaPp][Mm])(?![A-Za-z]))?"
_ZONE = r"(?:\s*(Z|z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z][A-Za-z0-9_+/-]*))?"
_REST = rf"(?:,?(?:\s+|[Tt]){_CLOCK}{_ZONE})?"
_DAY = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
_MONTH = r"((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)\.?"

#: Pattern and its year|month|day|hour|minute|second|am or pm|zone.
_NOTATIONS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_REST}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,]\d+)?{_ZONE})?$", "$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_REST}$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_REST}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^{_DAY}(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MONTH},?[\s-]+(\d{{4}}){_REST}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^{_DAY}{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_REST}$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    (rf"^{_DAY}{_MONTH}\s+(\d{{1,2}})\s+{_CLOCK}{_ZONE}\s+(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6|$7"),
)

_NUMBER = r"^[+-]?\d{1,19}(?:\.\d*)?(?:[eE][+]?\d{1,2})?$"


def epoch_seconds(x: Column, lo: int, hi: int) -> Column:
    """A DOUBLE of epoch seconds, milliseconds or microseconds as whole seconds in [lo, hi); NULL if none is."""
    sane = F.when(~F.isnan(x) & (F.abs(x) < 9e18), F.floor(x).cast("bigint"))
    units = [F.floor(sane / F.lit(u)).cast("bigint") if u > 1 else sane for u in (1, 1000, 1_000_000)]
    return F.coalesce(*(F.when((v >= lo) & (v < hi), v) for v in units))


def number_in(text: Column) -> Column:
    """The number a text consists of, as DOUBLE; else NULL."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def with_wall_time(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the column ``out``, STRUCT(local BIGINT, offset INT, zone STRING), read from a trimmed text.

    ``local``: the clock reading in seconds since 1970-01-01 00:00 of that same
    clock, fractions cut off. ``offset``: seconds east of UTC where the text
    says so. ``zone``: a zone's name in lower case where the text has one that
    is no fixed offset. A date alone is midnight. n/n/year is month first,
    n.n.year day first. NULL if the text is no date that exists.

    The steps are columns of their own, each read several times by the next, so
    that the patterns run once a row.
    """
    step = lambda name: f"__ll_{out}_{name}"
    part = lambda i: F.get(step("parts"), F.lit(i))
    at = lambda name: F.col(step(name))
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")).try_cast("int")
    notation = text
    for pattern, fields in _NOTATIONS:
        notation = F.regexp_replace(notation, pattern, fields)
    work = df.withColumn(step("notation"), notation)
    work = work.withColumn(step("parts"), F.when(at("notation").contains("|"), F.split(step("notation"), r"\|")))
    work = work.withColumns({step("name"): part(1), step("hour"): number(3), step("half"): F.upper(part(6)), step("zone"): part(7)})
    work = work.withColumn(step("signed"), F.split(F.regexp_replace(at("zone"), r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$", "$1|$2|$3"), r"\|"))
    digits = at("name").rlike(r"^\d")
    month = F.when(digits, at("name").try_cast("int")).otherwise(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(at("name"), F.lit(3)))).cast("int"))
    hour = F.when(at("half") == "", at("hour")).when(at("hour").between(1, 12), at("hour") % 12 + F.when(at("half") == "PM", 12).otherwise(0))
    when = F.try_make_timestamp(number(0), month, number(2), hour, number(4), number(5).cast("decimal(8,6)"), F.lit("UTC"))
    known = F.create_map(*(F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 3600)))
    sign = lambda i: F.get(step("signed"), F.lit(i))
    east = F.when(sign(0) == "-", -1).otherwise(1) * (sign(1).try_cast("int") * 3600 + F.coalesce(F.nullif(sign(2), F.lit("")), F.lit("0")).try_cast("int") * 60)
    work = work.withColumn(step("when"), F.unix_seconds(when)).withColumn(step("offset"), F.when(F.size(step("signed")) > 1, east).otherwise(F.try_element_at(known, F.upper(at("zone")))))
    named = F.when((at("zone") != "") & at("offset").isNull(), F.lower(at("zone")))
    return work.withColumn(out, F.when(at("when").isNotNull(), F.struct(at("when").alias("local"), at("offset").alias("offset"), named.alias("zone")))).drop(*(step(x) for x in ("notation", "parts", "name", "hour", "half", "zone", "signed", "when", "offset")))
