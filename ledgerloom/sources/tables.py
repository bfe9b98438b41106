"""The driver's tables: one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Load a table; zone-less timestamps become instants in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    local = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    utc = spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC")
    # The cast reads the clock in the session's zone; in another zone than UTC the text says which one is meant.
    instant = lambda c: (F.col(c) if utc else F.concat(F.col(c).cast("string"), F.lit("Z"))).cast("timestamp")
    return df.withColumns({c: instant(c) for c in local}) if local else df


#: White space that surrounds ids in the wild.
BLANKS = " \t\r\n\f\v "


def clean_id(c: Column | str) -> Column:
    """Trimmed id; NULL, blank, ``None`` and ``nan`` mean "no id" and give NULL."""
    t = F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))
    return F.when(~t.isin("", "None", "nan"), t)
