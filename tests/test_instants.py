"""Times in every notation."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.instants import normalise_instants, zone_intervals


def utc(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp())


NEW_YORK = "America/New_York"
CASES = [
    ("2012-03-04 05:06:07", None, utc(2012, 3, 4, 5, 6, 7)),
    ("  2012/03/04T05:06:07.999 ", None, utc(2012, 3, 4, 5, 6, 7)),
    ("2012-03-04", NEW_YORK, utc(2012, 3, 4, 5)),
    ("2012-03-04T05:06:07Z", NEW_YORK, utc(2012, 3, 4, 5, 6, 7)),
    ("2012-03-04T05:06:07+05:30", None, utc(2012, 3, 3, 23, 36, 7)),
    ("2012-03-04 05:06:07.5 -0330", None, utc(2012, 3, 4, 8, 36, 7)),
    ("20120304T050607Z", None, utc(2012, 3, 4, 5, 6, 7)),
    ("3/4/2012 12:06:07 AM", None, utc(2012, 3, 4, 0, 6, 7)),
    ("3/4/2012 12:06:07 PM", None, utc(2012, 3, 4, 12, 6, 7)),
    ("03/04/2012 05:06", None, utc(2012, 3, 4, 5, 6)),
    ("4.3.2012 05:06:07", None, utc(2012, 3, 4, 5, 6, 7)),
    ("Sun, 04 Mar 2012 05:06:07 -0800", None, utc(2012, 3, 4, 13, 6, 7)),
    ("Sun Mar 04 05:06:07 +0930 2012", None, utc(2012, 3, 3, 19, 36, 7)),
    ("March 4, 2012", None, utc(2012, 3, 4)),
    ("4 Mar 2012, 05:06:07", None, utc(2012, 3, 4, 5, 6, 7)),
    ("2012-03-04 05:06:07 PDT", None, utc(2012, 3, 4, 12, 6, 7)),
    ("2012-07-04 05:06:07 Europe/Berlin", None, utc(2012, 7, 4, 3, 6, 7)),
    ("1330837567", None, 1330837567),
    ("1330837567891", None, 1330837567),
    ("1330837567891234", None, 1330837567),
    ("2012-11-04 01:30:00", NEW_YORK, utc(2012, 11, 4, 5, 30)),  # twice: the first
    ("2012-03-11 02:30:00", NEW_YORK, utc(2012, 3, 11, 7, 30)),  # never: the offset before
    ("2025-01-01 00:30:00", "Asia/Kolkata", utc(2024, 12, 31, 19)),
    ("2024-12-31 23:30:00", NEW_YORK, None),  # 2025 in UTC
    ("2012-03-04 05:06:07", "Nowhere/Land", utc(2012, 3, 4, 5, 6, 7)),
    ("2012-03-04 05:06:07 XYZT", None, None),
    *((x, None, None) for x in ("31/02/2015 25:61", "2015-02-30", "9999-12-31", "1970-01-01 00:00:00", "0", "-1", "NaT", "", " ", "n/a", "None", "5:30", "13/13/2013", "1e400", "9" * 40)),
    ("x" * 100_000, None, None),
    (None, NEW_YORK, None),
]


def test_notations(spark):
    data = [(i, t, z) for i, (t, z, _) in enumerate(CASES)]
    out = normalise_instants(spark.createDataFrame(data, "id int, t string, z string"), ["t"], F.col("z")).collect()
    assert {r["id"]: r["epoch_second"] for r in out} == {i: s for i, (_, _, s) in enumerate(CASES)}
    notes = {CASES[r["id"]][0]: r["time_note"] for r in out if r["time_note"]}
    assert notes == {"2012-11-04 01:30:00": "ambiguous", "2012-03-11 02:30:00": "nonexistent"}


def test_first_usable_field_counts(spark, rows):
    data = [(1, float("nan"), "0", "2012-03-04"), (2, 1330837567891.0, "2013-01-01", None), (3, None, None, "nan"), (3, None, None, "nan"), (4, -62135596800000.0, "2013-01-01", "2014-01-01")]
    out = normalise_instants(spark.createDataFrame(data, "id int, a double, b string, epoch string"), ["a", "b", "epoch"])
    assert rows(out, "id", "epoch_second", "time_field") == sorted([(1, utc(2012, 3, 4), "epoch"), (2, 1330837567, "a"), (3, None, None), (3, None, None), (4, utc(2013, 1, 1), "b")], key=repr)


def test_session_zone_does_not_matter_and_empty(spark, rows):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        df = spark.createDataFrame([("2012-03-04 05:06:07",)], "t string")
        assert rows(normalise_instants(df, ["t"]), "epoch_second") == [(utc(2012, 3, 4, 5, 6, 7),)]
        assert rows(normalise_instants(df.limit(0), ["t"])) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("zone", [NEW_YORK, "Asia/Kolkata", "Australia/Adelaide"])
def test_intervals_follow_each_other(zone):
    spans = zone_intervals(zone, 2010, 2012)
    assert all(a[1] - a[2] == b[0] - b[2] for a, b in zip(spans, spans[1:], strict=False))
    assert len(spans) == (1 if "Kolkata" in zone else 7)


def test_tables_read_the_same_in_any_session_zone(spark, tmp_path, rows):
    from ledgerloom.sources.tables import table

    spark.sql("SELECT TIMESTAMP_NTZ '2012-03-04 05:06:07.25' AS t").write.parquet(str(tmp_path / "x.parquet"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert rows(table(spark, str(tmp_path), "x").select(F.unix_micros("t"))) == [(utc(2012, 3, 4, 5, 6, 7) * 1_000_000 + 250_000,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
