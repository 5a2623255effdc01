"""Bin numbers against the declared intervals, column profiles of awkward types, interval differences."""
from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripwright.operators import intervals, report
from tripwright.storage import materialize

from conftest import rows


def declared_bin(feature, v):
    """The first single-point bin near the value, else the first interval that holds it; None if outside."""
    bins = report.FIELD_BINS[feature]
    for i, b in enumerate(bins):
        if b.low is not None and b.low == b.high and abs(v - b.low) <= report.POINT_TOLERANCE * (b.low > 0):
            return i
    for i, b in enumerate(bins):
        over = b.low is None or (v > b.low if b.left_open else v >= b.low)
        under = b.high is None or (v <= b.high if b.right_closed else v < b.high)
        if b.low != b.high and over and under:
            return i
    return None


@pytest.mark.parametrize("feature", sorted(report.FIELD_BINS))
def test_every_edge_falls_in_its_declared_bin(spark, feature):
    edges = sorted({e for b in report.FIELD_BINS[feature] for e in (b.low, b.high) if e is not None})
    values = [v for e in edges for v in (e, e - 0.5, e + 0.5, e + 1e-7, e - 1e-7, e + 5e-10)]
    inside = [v for v in values if declared_bin(feature, v) is not None]
    df = spark.createDataFrame([(v, 1) for v in inside] + [(None, 1), (None, 0)], "v double, m int")
    got = df.select("v", "m", report.bin_number(feature, F.col("v"), F.col("m")).alias("b")).collect()
    for r in got:
        want = report.UNMATCHED if r.m == 0 else report.FIELD_MISSING if r.v is None else declared_bin(feature, r.v)
        assert r.b == want, r
    outside = [v for v in values if declared_bin(feature, v) is None]
    for v in outside[:3]:
        one = spark.createDataFrame([(v, 1)], "v double, m int")
        with pytest.raises(Exception, match="outside every bin"):
            one.select(report.bin_number(feature, F.col("v"), F.col("m"))).collect()


def test_profile_counts_equal_values_once_for_every_type(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (0.0D, X'00', array('a, b'), named_struct('x', 1), 'a', 7), (-0.0D, X'00', array('a', 'b'), named_struct('x', 1), 'A', 7),
      (double('NaN'), X'', array('a, b'), null, null, 7), (double('NaN'), null, null, named_struct('x', null), '', 7) AS t(d, bin, arr, st, `te xt`, one)""")
    got = {r.column: (r.null_count, r.n_distinct, r.n_rows, r.is_constant) for r in report.column_profile(df).collect()}
    assert got == {"d": (0, 2, 4, False), "bin": (1, 2, 4, False), "arr": (1, 2, 4, False), "st": (1, 2, 4, False),
                   "te xt": (1, 3, 4, False), "one": (0, 1, 4, True)}
    empty = report.column_profile(df.limit(0)).collect()
    assert len(empty) == 6 and all(r.n_rows == r.n_distinct == 0 and r.null_rate is None for r in empty)
    assert "Expand" not in report.column_profile(df)._jdf.queryExecution().toString()


@pytest.mark.parametrize("bucket_days", [1, 3])
def test_interval_difference_equals_minute_marks(spark, bucket_days):
    rng = random.Random(bucket_days)
    zero = datetime(2024, 1, 1)

    def some(n):
        spans = [(s := rng.randrange(0, 6000), s + rng.randrange(0, 400)) for _ in range(n)]
        return [(rng.choice(["a", "b", None]), a, b) for a, b in spans]

    targets, covers = some(60), some(60)

    def frame(spans):
        return spark.createDataFrame([(k, zero + timedelta(minutes=a), zero + timedelta(minutes=b)) for k, a, b in spans],
                                     "k string, start timestamp_ntz, end timestamp_ntz")

    want = []
    for key in ("a", "b"):
        wanted = {m for k, a, b in targets if k == key for m in range(a, b)}
        wanted -= {m for k, a, b in covers if k == key for m in range(a, b)}
        for m in sorted(wanted):
            if m - 1 in wanted:
                want[-1][2] = zero + timedelta(minutes=m + 1)
            else:
                want.append([key, zero + timedelta(minutes=m), zero + timedelta(minutes=m + 1)])
    got = intervals.subtract_intervals(frame(targets), frame(covers), "k", bucket_days=bucket_days, settle=materialize)
    assert rows(got, "k", "start", "end") == sorted((tuple(w) for w in want), key=repr)


@pytest.mark.parametrize("repeat", [0, 1, 5])
def test_duplicates_are_counted_by_their_columns(spark, repeat):
    table = [(1, "a", None, 0.0), (2, "a", None, -0.0), (3, None, "a", float("nan")), (4, None, "a", float("nan")), (4, "b", "", None)]
    df = spark.createDataFrame(table + [table[-1]] * repeat, "id int, x string, _n string, v double")
    assert [tuple(r) for r in report.duplicate_counts(df, "id").collect()] == [(repeat, 2 + repeat, 1 + repeat)]


def test_duplicates_do_not_trust_hashes(spark, monkeypatch):
    df = spark.range(20).selectExpr("id % 7 AS a", "id % 2 AS b", "id AS c")
    monkeypatch.setattr(report.F, "xxhash64", lambda *parts: F.lit(0).cast("long"))
    assert [tuple(r) for r in report.duplicate_counts(df, "c").collect()] == [(0, 6, 0)]
    assert [tuple(r) for r in report.duplicate_counts(spark.range(0).selectExpr("id", "id AS a"), "id").collect()] == [(0, 0, 0)]
