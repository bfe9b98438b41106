"""Attributes as known at event time.

Each attribute has a change history of its own: rows (entity, valid from, known
from, version, value). An event gets, per attribute, the value of the entity's
latest row that both held and was known before the event.

Histories and events stand in one long table keyed by (attribute, entity). A
history row becomes visible at the later of its two times; the value known at an
event is then the running maximum of (valid from, known from, version) over the
rows visible before it. That maximum is taken with ``split_running``, so that an
entity with a great share of all events or changes is cut along its time axis.
The matches are pivoted back to one row per event.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import split_running


@dataclass(frozen=True)
class Attribute:
    """``name`` of the new column; ``entity``, the event column with the entity's id;
    ``history`` with entity_id, valid_from, known_from (TIMESTAMP), version (BIGINT), value."""

    name: str
    entity: str
    history: DataFrame
    default: Column | None = None


def attributes_as_of(events: DataFrame, time: str, attributes: Sequence[Attribute], slots: int | None = None) -> DataFrame:
    """``events`` with a column per attribute.

    ``time`` is epoch seconds (DOUBLE). A history row counts if both its times
    are strictly earlier and its value is not NULL; the latest valid_from wins,
    then known_from, then version, then value. Without such a row, with a NULL
    entity or a NULL or NaN time, the attribute has its default. Equal events
    come out once; events are grouped by all their columns, so pass the few that
    identify them (no maps). History rows with a NULL time or entity never count.
    All histories have values of one type.
    """
    columns = list(events.columns)
    clash = {a.name for a in attributes} & set(columns)
    if clash:
        raise ValueError(f"events already have {sorted(clash)}")
    kinds = {a.history.schema["value"].dataType.simpleString() for a in attributes}
    if len(kinds) > 1:  # one column holds all values
        raise ValueError(f"histories have values of {sorted(kinds)}; cast them to one type")
    usable = F.col(time).isNotNull() & ~F.isnan(time) & (F.abs(time) < 9e12)
    events = events.withColumn("_event", F.struct(*columns))
    state = "struct<valid_from:bigint,known_from:bigint,version:bigint,value:{}>"

    def asked(a: Attribute) -> DataFrame:
        kind = a.history.schema["value"].dataType.simpleString()
        return events.where(usable).select(
            F.lit(a.name).alias("_attribute"), F.col(a.entity).cast("string").alias("_entity"), F.ceil(F.col(time) * 1e6).cast("bigint").alias("_at"), F.lit(0).alias("_kind"),
            F.xxhash64("_event").alias("_tie"), "_event", F.lit(None).cast(state.format(kind)).alias("_state"),
        ).where("_entity IS NOT NULL")

    def changes(a: Attribute) -> DataFrame:
        valid, known = F.unix_micros("valid_from"), F.unix_micros("known_from")
        return a.history.where("value IS NOT NULL AND entity_id IS NOT NULL AND valid_from IS NOT NULL AND known_from IS NOT NULL").select(
            F.lit(a.name).alias("_attribute"), F.col("entity_id").cast("string").alias("_entity"), F.greatest(valid, known).alias("_at"), F.lit(1).alias("_kind"),
            F.col("version").cast("bigint").alias("_tie"), F.lit(None).cast(events.schema["_event"].dataType).alias("_event"),
            F.struct(valid.alias("valid_from"), known.alias("known_from"), F.col("version").cast("bigint").alias("version"), F.col("value").alias("value")).alias("_state"),
        )

    # At equal times an event comes before a change, which makes "before" strict.
    timeline = reduce(DataFrame.unionByName, [f(a) for a in attributes for f in (asked, changes)])
    matched = split_running(timeline, ["_attribute", "_entity"], ["_at", "_kind", "_tie"], maxima={"_known": F.col("_state")}, slots=slots)
    matched = matched.where("_kind = 0").select("_event", "_attribute", F.col("_known.value").alias("_value"))
    # Events that were not asked for (no time, no entity) keep their row.
    every = events.select("_event", F.lit(None).cast("string").alias("_attribute"), F.lit(None).cast(matched.schema["_value"].dataType).alias("_value"))
    wide = matched.unionByName(every).groupBy("_event").agg(*(F.max(F.when(F.col("_attribute") == a.name, F.col("_value"))).alias(a.name) for a in attributes))
    filled = {a.name: F.coalesce(a.name, a.default) for a in attributes if a.default is not None}
    return wide.withColumns(filled).select("_event.*", *(a.name for a in attributes))
