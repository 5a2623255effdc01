"""Cleaning rules by hand, and independence of row order."""
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tripwright.functions import clock
from tripwright.operators import clean

PAIRS = [("k1", "a", 1), ("k1", None, 2), ("k2", "x", 3), ("k2", "y", 4), ("k2", None, 5), ("k3", None, 6), (None, None, 7)]
SCHEMA = "carrier_code string, airline string, flight_id int"


def test_unique_rule_fills_only_single_valued_keys(spark):
    out = clean.impute_cross(spark.createDataFrame(PAIRS, SCHEMA))
    assert [r[1] for r in rows(out, "flight_id", "airline")] == ["a", "a", "x", "y", None, None, None]


def test_first_rule_needs_an_order_and_ignores_physical_order(spark):
    df = spark.createDataFrame(PAIRS, SCHEMA)
    with pytest.raises(ValueError):
        clean.impute_cross(df, conflict="first")
    a = clean.impute_cross(df, conflict="first", order="flight_id")
    b = clean.impute_cross(df.orderBy(F.desc("flight_id")).repartition(5), conflict="first", order="flight_id")
    assert rows(a) == rows(b)
    assert dict(rows(a, "flight_id", "airline"))[5] == "x"


def test_hhmm_rules(spark):
    df = spark.createDataFrame([("930",), ("2470",), ("-5",), ("x",), (None,), ("2400",)], "v string")
    loose, strict = clock.hhmm_parts(F.col("v")), clock.hhmm_parts(F.col("v"), strict=True)
    got = [tuple(r) for r in df.select(*loose, *strict).collect()]
    assert got == [(9, 30, 9, 30), (24, 70, -1, -1), (-1, -1, -1, -1), (-1, -1, -1, -1), (-1, -1, -1, -1), (24, 0, -1, -1)]


def test_local_time_to_utc_edges(spark):
    zone = "America/New_York"
    cases = [("2019-01-15", 1200.0, "2019-01-15 17:00:00"), ("2019-07-15", 1200.0, "2019-07-15 16:00:00"),
             ("2019-03-10", 230.0, None), ("2019-11-03", 130.0, None), ("2019-03-10", 300.0, "2019-03-10 07:00:00"),
             ("2019-11-03", 59.0, "2019-11-03 04:59:00"), ("2019-11-03", 200.0, "2019-11-03 07:00:00"),
             ("2019-06-30", 2400.0, "2019-07-01 04:00:00"), ("2019-06-30", 1260.0, None), ("2019-06-30", None, None)]
    df = spark.createDataFrame([(d, h) for d, h, _ in cases], "d string, h double")
    out = df.select(clock.local_hhmm_to_utc(F.col("d").cast("date"), F.col("h"), F.lit(zone)).cast("string"))
    assert [r[0] for r in out.collect()] == [c[2] for c in cases]


def test_route_median_then_global_median_after_fill(spark):
    data = [(1, 1, 1, 900, 1000), (2, 1, 1, 900, 1020), (3, 1, 1, 900, None), (4, 2, 2, 600, None), (5, 2, 2, None, None), (6, 3, 3, None, 30)]
    df = spark.createDataFrame(data, "id int, origin int, dest int, dep_hhmm int, arr_hhmm int")
    out = clean.restore_times(clean.time_features(clean.with_route(df), keep_minute=True))
    got = {r[0]: r[1:] for r in rows(out, "id", "duration", "dep_hour", "dep_minute", "arr_hour", "arr_minute")}
    assert got[3] == (70.0, 9, 0, 10, 10)          # route median of 60 and 80
    assert got[4] == (70.0, 6, 0, 7, 10)           # median of 60, 80 and the filled 70
    assert got[5] == (70.0, -1, -1, -1, -1)        # both missing stays
    assert got[6] == (70.0, 23, 20, 0, 30)         # back over midnight


def test_slot_counts_exclude_missing_hours_and_group_nulls(spark):
    data = [(1, 1, 1, "A", 5), (2, 1, 1, "A", 5), (3, 1, 1, None, 5), (4, 1, 1, None, 5), (5, 1, 1, "A", -1)]
    df = spark.createDataFrame(data, "id int, mo int, dom int, origin string, dep_hour int")
    out = clean.slot_counts(df, "n", "origin", "dep_hour")
    assert [r[1] for r in rows(out, "id", "n")] == [2.0, 2.0, 2.0, 2.0, None]
    legacy = clean.slot_counts(df, "n", "origin", "dep_hour", exclude_missing_hour=False)
    assert dict(rows(legacy, "id", "n"))[5] == 1.0


def test_blank_labels_are_unlabeled_and_unknown_ones_fail(spark):
    df = spark.createDataFrame([(1, "Delayed"), (2, " "), (3, None), (4, "Not_Delayed")], "flight_id int, delay string")
    labeled, unlabeled = clean.split_labeled(df)
    assert rows(labeled, "flight_id", "y") == [(1, 1), (4, 0)]
    assert rows(unlabeled, "flight_id") == [(2,), (3,)]
    with pytest.raises(Exception, match="unknown label"):
        clean.labeled_rows(df.withColumn("delay", F.lit("Late"))).collect()


def test_presets_and_guards(spark):
    df = spark.createDataFrame([(1, 2)], "flight_id int, distance int")
    assert clean.prune_columns(df, "baseline").columns == ["distance"]
    with pytest.raises(ValueError):
        clean.prune_columns(df, "nope")
    with pytest.raises(ValueError):
        clean.reject_forbidden_columns(df.withColumn("ArrDelay", F.lit(1)))
    with pytest.raises(ValueError):
        clean.prefixed(df.withColumn("origin_distance", F.lit(1)), "origin_")
