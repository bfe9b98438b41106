"""Mixed timestamp notations and zones, normalised to one instant in UTC."""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from datetime import UTC, datetime
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.timetext import epoch_seconds, number_in, with_wall_time
from ledgerloom.sources.tables import BLANKS

_DAY = 86_400
_STEP = 7 * _DAY


@lru_cache
def zone_intervals(name: str, first_year: int, last_year: int) -> tuple[tuple[int, int, int], ...]:
    """(from, until, offset) in local seconds, over all of the given years and some days around them."""
    zone = ZoneInfo(name)
    offset = lambda t: int(datetime.fromtimestamp(t, zone).utcoffset().total_seconds())
    lo = int(datetime(first_year, 1, 1, tzinfo=UTC).timestamp()) - 30 * _DAY
    hi = int(datetime(last_year + 1, 1, 1, tzinfo=UTC).timestamp()) + 30 * _DAY
    cuts = [lo]
    for t in range(lo, hi, _STEP):
        before = offset(t)
        if offset(min(t + _STEP, hi)) != before:
            cuts.append(t + 1 + bisect.bisect_left(range(t + 1, t + _STEP), True, key=lambda x, before=before: offset(x) != before))
    return tuple((a + offset(a), b + offset(a), offset(a)) for a, b in zip(cuts, [*cuts[1:], hi], strict=True))


def zone_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """zone (lower case), year, intervals ARRAY<STRUCT(from, until, offset)>: those that touch that local year.

    As large as the time zone database: about 600 zones for each year, whatever
    the data.
    """
    return spark.createDataFrame(_zone_rows(first_year, last_year), "zone string, year int, intervals array<struct<from:bigint,until:bigint,offset:int>>", verifySchema=False)


@lru_cache
def _zone_rows(first_year: int, last_year: int) -> list[tuple]:
    rows = []
    for name in sorted(available_timezones()):
        spans = zone_intervals(name, first_year, last_year)
        for year in range(first_year, last_year + 1):
            a, b = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (year, year + 1))
            rows.append((name.lower(), year, [s for s in spans if s[0] < b + 2 * _DAY and s[1] > a - 2 * _DAY]))
    return rows


def offset_at(local: Column, intervals: Column) -> Column:
    """STRUCT(offset, matches) of a local time: one matching interval gives the offset; of two (the
    clock was set back) the first instant counts, the larger offset; with none (it was set
    forward over this time) the offset before the change."""
    hits = F.filter(intervals, lambda i: (i["from"] <= local) & (local < i["until"]))
    before = F.array_max(F.transform(F.filter(intervals, lambda i: i["until"] <= local), lambda i: F.struct(i["until"], i["offset"])))
    return F.struct(F.coalesce(F.array_max(F.transform(hits, lambda i: i["offset"])), before["offset"]).alias("offset"), F.size(hits).alias("matches"))


def normalise_instants(df: DataFrame, fields: Sequence[str], row_zone: Column | None = None, years: tuple[int, int] = (2007, 2024)) -> DataFrame:
    """``df`` with ``epoch_second`` (BIGINT), ``time_field`` and ``time_note``.

    The first of ``fields`` with a usable time counts. DOUBLE fields are epoch
    seconds, milliseconds or microseconds; STRING fields may be that or any of
    the notations of ``with_wall_time``. A wall time without a zone is in ``row_zone``
    (an IANA name; NULL or unknown is UTC). Usable is an instant in UTC in
    ``years``, both included; all else is filler. Instants are floored to the
    second. ``time_note``: ``ambiguous`` or ``nonexistent`` for a wall time that
    occurs twice or never (see ``offset_at``), else NULL. All NULL if no field is
    usable. Rows are neither lost nor repeated, nothing is shuffled.

    Local times are matched with the intervals of constant offset of their zone:
    an as-of join on (zone, year of the local time) to a broadcast table as
    large as the time zone database.
    """
    spark = df.sparkSession
    lo, hi = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (years[0], years[1] + 1))
    kinds = dict(df.dtypes)
    zones = F.broadcast(zone_table(spark, years[0] - 1, years[1] + 1))
    work = df.withColumn("__ll_zone", F.lower(row_zone) if row_zone is not None else F.lit(None).cast("string"))
    found, usable = [], F.lit(None).cast("bigint")
    for i, field in enumerate(fields):
        c = F.col(field)
        if kinds[field] != "string":
            work = work.withColumn(f"__ll_usable{i}", F.coalesce(usable, epoch_seconds(c.cast("double"), lo, hi)))
            usable = F.col(f"__ll_usable{i}")
            found.append((field, usable, F.lit(None).cast("string")))
            continue
        text = F.when(usable.isNull(), F.btrim(c, F.lit(BLANKS)))  # what follows a usable time isn't read
        work = work.withColumn(f"__ll_text{i}", text).withColumn(f"__ll_value{i}", number_in(F.col(f"__ll_text{i}"))).withColumn(f"__ll_number{i}", epoch_seconds(F.col(f"__ll_value{i}"), lo, hi))
        work = with_wall_time(work, F.when(F.col(f"__ll_number{i}").isNull(), F.col(f"__ll_text{i}")), f"__ll_wall{i}")
        wall = F.col(f"__ll_wall{i}")
        asked = F.when(wall["offset"].isNull(), F.coalesce(wall["zone"], "__ll_zone"))
        near = wall["local"].between(lo - 3 * _DAY, hi + 3 * _DAY)
        year = F.when(near & asked.isNotNull(), F.year(F.timestamp_seconds(wall["local"])))
        # One row in, one row out: a generator's columns keep the optimizer from tracing the join keys
        # back through all the steps above, which takes it half a minute.
        work = work.select("*", F.inline(F.array(F.struct(F.when(near, asked).alias(f"__ll_asked{i}"), year.alias(f"__ll_year{i}")))))
        own = zones.select(F.col("zone").alias(f"__ll_asked{i}"), F.col("year").alias(f"__ll_year{i}"), F.col("intervals").alias(f"__ll_spans{i}"))
        work = work.join(own, [f"__ll_asked{i}", f"__ll_year{i}"], "left").withColumn(f"__ll_at{i}", F.when(F.col(f"__ll_spans{i}").isNotNull(), offset_at(wall["local"], F.col(f"__ll_spans{i}"))))
        at = F.col(f"__ll_at{i}")
        # A zone named in the text that nobody knows leaves the time unknown; the row's zone falls back to UTC.
        offset = F.coalesce(wall["offset"], at["offset"], F.when(wall["zone"].isNull(), F.lit(0)))
        instant = wall["local"] - offset
        note = F.when(at["matches"] == 2, F.lit("ambiguous")).when(at["matches"] == 0, F.lit("nonexistent"))
        work = work.withColumns({f"__ll_usable{i}": F.coalesce(usable, f"__ll_number{i}", F.when((instant >= lo) & (instant < hi), instant)), f"__ll_note{i}": note})
        usable = F.col(f"__ll_usable{i}")
        found.append((field, usable, F.col(f"__ll_note{i}")))
    work = work.withColumn("__ll_found", F.coalesce(*(F.when(t.isNotNull(), F.struct(t.alias("second"), F.lit(f).alias("field"), n.alias("note"))) for f, t, n in found)))
    return work.select(*df.columns, F.col("__ll_found.second").alias("epoch_second"), F.col("__ll_found.field").alias("time_field"), F.col("__ll_found.note").alias("time_note"))
