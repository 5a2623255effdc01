"""Matching rules by hand."""
from conftest import rows
from tripwright.operators import matching

SCHEDULE = [(1996, "t1", "x", 9), (1996, "t1", "x", 9), (1997, "t1", "x", 9), (1996, "t2", "x", 7), (1996, "t2", None, 7), (1997, "t3", "y", 5)]
KEYS = ["tail", "code", "hour"]


def frames(spark):
    schedule = spark.createDataFrame(SCHEDULE, "yr int, tail string, code string, hour int").withColumnRenamed("code", "code")
    left = spark.createDataFrame([(1, "t1", "x", 9), (2, "t2", "x", 7), (3, "t3", None, 5), (4, "t9", "x", 1), (5, None, "x", 9)],
                                 "flight_id int, tail string, code string, hour int")
    return left, schedule


def test_counts_by_year_drop_null_keys_and_keep_rows(spark):
    left, schedule = frames(spark)
    got = rows(matching.match_counts_by_year(left, schedule, KEYS, (1996, 1997)), "flight_id", "n_1996", "n_1997")
    assert got == [(1, 2, 1), (2, 1, 0), (3, 0, 0), (4, 0, 0), (5, 0, 0)]


def test_partial_match_uses_only_known_keys(spark):
    left, schedule = frames(spark)
    got = rows(matching.partial_key_match(left.filter("flight_id = 3"), schedule, KEYS, ["code", "hour"], (1996, 1997), number="code"),
               "flight_id", "n_1996", "n_1997", "candidates_total", "candidate_years")
    assert got == [(3, 0, 1, 1, 1)]


def test_fewer_keys_never_lower_candidates(spark):
    left, schedule = frames(spark)
    ladder = {"all": KEYS, "no_hour": KEYS[:2], "tail": KEYS[:1]}
    got = {(r["level"], r["year"]): r["candidate_rows"] for r in matching.key_ladder(left, schedule, ladder, (1996, 1997)).collect()}
    for year in (1996, 1997):
        assert got["all", year] <= got["no_hour", year] <= got["tail", year]


def test_repeated_ids_fail(spark):
    import pytest

    df = spark.createDataFrame([(1, 2), (1, 3)], "flight_id int, v int")
    with pytest.raises(Exception, match="repeats"):
        matching.unique_by(df, "flight_id").collect()
    with pytest.raises(ValueError):
        matching.attach_features(df, df, "flight_id")
