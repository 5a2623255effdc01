"""As-of rules by hand: limits, no fallback, null keys, bucket borders."""
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from conftest import rows
from tripwright.operators import asof

T0 = datetime(2019, 1, 31, 23, 30)
REQ = "id int, station string, prediction_at timestamp_ntz"
OBS = "station string, observed_at timestamp_ntz, available_at timestamp_ntz, wind int"


def minutes(n):
    return T0 + timedelta(minutes=n)


def join(spark, requests, reports, **kw):
    return rows(asof.asof_join(spark.createDataFrame(requests, REQ), spark.createDataFrame(reports, OBS), **kw), "id", "wind")


def test_future_and_foreign_reports_are_not_used(spark):
    got = join(spark, [(1, "A", minutes(0)), (2, "B", minutes(0))],
               [("A", minutes(-30), minutes(-20), 5), ("A", minutes(-5), minutes(1), 9)])
    assert got == [(1, 5), (2, None)]


def test_both_limits_are_inclusive(spark):
    got = join(spark, [(1, "A", minutes(90)), (2, "A", minutes(91)), (3, "A", minutes(0))], [("A", minutes(0), minutes(0), 7)])
    assert got == [(1, 7), (2, None), (3, 7)]


def test_stale_observation_has_no_fallback(spark):
    # the last available report was observed long ago; an older-available fresh one must not replace it
    got = join(spark, [(1, "A", minutes(100))],
               [("A", minutes(20), minutes(30), 1), ("A", minutes(-200), minutes(95), 2)])
    assert got == [(1, None)]


def test_null_keys_stay_unmatched_and_rows_survive(spark):
    got = join(spark, [(1, None, minutes(0)), (2, "A", None), (3, "A", minutes(5))], [("A", minutes(0), minutes(0), 4)])
    assert got == [(1, None), (2, None), (3, 4)]


def test_match_across_a_month_and_bucket_border(spark):
    for hours in (1, 6, 24):
        assert join(spark, [(1, "A", minutes(60))], [("A", minutes(-20), minutes(-20), 3)], bucket_hours=hours) == [(1, 3)]


def test_sweep_equals_one_join_per_delay(spark):
    requests = spark.range(400).select(F.col("id"), (F.col("id") % 3).cast("string").alias("station"),
                                       (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 7 % 3000).cast("int"))).alias("prediction_at"))
    reports = spark.range(90).select((F.col("id") % 3).cast("string").alias("station"),
                                     (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 41 % 3000).cast("int"))).alias("observed_at"),
                                     F.col("id").alias("wind"))
    swept = asof.latency_sweep(requests, reports, latencies=(0, 30))
    for delay in (0, 30):
        single = asof.asof_join(requests, reports.withColumn("available_at", F.col("observed_at") + F.make_dt_interval(mins=F.lit(delay))))
        assert rows(swept.filter(F.col("latency") == delay), "id", "wind") == rows(single, "id", "wind")


def test_latest_report_reaches_over_many_empty_buckets(spark):
    reports = spark.createDataFrame([("A", minutes(0)), ("A", minutes(60 * 24 * 40))], "station string, observed_at timestamp_ntz")
    requests = spark.createDataFrame([(1, "A", minutes(-1)), (2, "A", minutes(60 * 24 * 30)), (3, "A", minutes(60 * 24 * 41))], REQ)
    got = rows(asof.latest_report(requests, reports), "id", "latest_observed_at")
    assert got == [(1, None), (2, minutes(0)), (3, minutes(60 * 24 * 40))]


def test_violations_are_counted(spark):
    obs = spark.createDataFrame([("A", minutes(0), minutes(5), 1), ("A", minutes(1), minutes(5), 2), ("B", minutes(9), minutes(3), 3),
                                 (None, minutes(0), minutes(0), 4)], OBS)
    row = asof.observation_violations(obs).first()
    assert (row["null_keys"], row["available_before_observed"], row["repeated_keys"]) == (1, 1, 1)


def test_unsound_observations_are_refused(spark):
    from datetime import datetime

    def at(minute):
        return datetime(2024, 1, 1, 10, minute)

    requests = spark.createDataFrame([(1, "A", at(30))], "event_id int, station string, prediction_at timestamp_ntz")
    kinds = "station string, observed_at timestamp_ntz, available_at timestamp_ntz, value double"
    good = [("A", at(0), at(5), 1.0)]
    assert asof.asof_join(requests, spark.createDataFrame(good, kinds)).first().value == 1.0
    for bad in (("A", at(1), at(5), 2.0), ("A", at(9), at(7), 2.0), (None, at(1), at(6), 2.0), ("A", None, at(6), 2.0), ("A", at(1), None, 2.0)):
        with pytest.raises(Exception, match="observation|same time"):
            asof.asof_join(requests, spark.createDataFrame([*good, bad], kinds)).collect()


def test_conflicting_reports_can_be_refused(spark):
    df = spark.createDataFrame([("A", 1, 5.0), ("A", 1, 5.0), ("B", 1, 7.0), ("B", 1, 6.0)], "station string, observed_at int, value double")
    shown = {r.station: (r.value, r.n_reports, r.n_versions) for r in asof.deduplicate_reports(df).collect()}
    assert shown == {"A": (5.0, 2, 1), "B": (6.0, 2, 2)}
    with pytest.raises(Exception, match="differ"):
        asof.deduplicate_reports(df, refuse_conflicts=True).collect()
