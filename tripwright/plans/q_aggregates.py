"""Imputation, reporting tables, audits and diagnostics."""
from __future__ import annotations

from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.functions import clock, geo
from tripwright.operators import audit, calendar_signal, clean, matching, report, sampling
from tripwright.plans import q_joins, q_windows
from tripwright.plans.phases import PHASES, build_features
from tripwright.plans.q_scores import rounded
from tripwright.plans.registry import query

V = ("flights",)
_LABELED = "labeled AS (SELECT *, CASE WHEN delay = 'Delayed' THEN 1 ELSE 0 END AS delayed FROM flights WHERE delay IS NOT NULL)"


def labeled(spark, sf):
    return clean.labeled_rows(fx.flights(spark, sf)).withColumnRenamed("y", "delayed")


# ---- imputation -------------------------------------------------------------

_UNIQUE_MAP = "m AS (SELECT carrier_code, min(airline) AS fill FROM flights WHERE carrier_code IS NOT NULL AND airline IS NOT NULL GROUP BY carrier_code HAVING count(DISTINCT airline) = 1)"


@query("a1_conflict_aware_imputation", f"WITH {_UNIQUE_MAP} SELECT flight_id, coalesce(airline, fill) AS airline FROM flights LEFT JOIN m USING (carrier_code)", V)
def impute_unique(spark, sf):
    return clean.impute_cross(fx.flights(spark, sf)).select("flight_id", "airline")


@query("a1_first_observed_imputation", """WITH m AS (SELECT carrier_code, arg_min(airline, flight_id) AS fill FROM flights WHERE carrier_code IS NOT NULL AND airline IS NOT NULL GROUP BY carrier_code)
SELECT flight_id, coalesce(airline, fill) AS airline FROM flights LEFT JOIN m USING (carrier_code)""", V)
def impute_first(spark, sf):
    return clean.impute_cross(fx.flights(spark, sf), conflict="first", order="flight_id").select("flight_id", "airline")


@query("a1_bidirectional_imputation", f"""WITH {_UNIQUE_MAP}, filled AS (SELECT * REPLACE (coalesce(airline, fill) AS airline) FROM flights LEFT JOIN m USING (carrier_code)),
b AS (SELECT airline, min(carrier_code) AS back FROM filled WHERE carrier_code IS NOT NULL AND airline IS NOT NULL GROUP BY airline HAVING count(DISTINCT carrier_code) = 1)
SELECT flight_id, airline, coalesce(carrier_code, back) AS carrier_code FROM filled LEFT JOIN b USING (airline)""", V)
def impute_bidirectional(spark, sf):
    return clean.impute_cross(fx.flights(spark, sf), bidirectional=True).select("flight_id", "airline", "carrier_code")


_STATS_SQL = "m AS (SELECT carrier_code, min(airline) AS lo, max(airline) AS hi FROM flights WHERE carrier_code IS NOT NULL AND airline IS NOT NULL GROUP BY carrier_code), j AS (SELECT f.*, lo, hi FROM flights f LEFT JOIN m USING (carrier_code) WHERE delay IS NOT NULL)"


@query("a36_imputation_accounting", f"""WITH {_STATS_SQL}
SELECT count(*) AS population_rows, count(*) FILTER (airline IS NULL) AS original_missing, count(*) FILTER (airline IS NULL AND lo IS NOT NULL) AS first_restored,
 count(*) FILTER (airline IS NULL AND lo IS NULL) AS first_residual, count(*) FILTER (airline IS NULL AND lo = hi) AS unique_restored,
 count(*) FILTER (airline IS NULL AND (lo IS NULL OR lo <> hi)) AS unique_residual, count(*) FILTER (airline IS NULL AND carrier_code IS NULL) AS key_missing,
 count(*) FILTER (airline IS NULL AND carrier_code IS NOT NULL AND lo IS NULL) AS key_never_observed, count(*) FILTER (airline IS NULL AND lo <> hi) AS key_ambiguous, TRUE AS identity_holds FROM j""", V)
def imputation_accounting(spark, sf):
    return audit.imputation_accounting(fx.flights(spark, sf), counted=F.col("delay").isNotNull())


@query("a37_time_restore_accounting", f"""WITH {q_windows.RESTORE_SQL}, c AS (SELECT * FROM restored WHERE delay IS NOT NULL)
SELECT (SELECT count(*) FROM c) AS population_rows, (SELECT count(*) FILTER (dep_hour_before = -1) FROM c) AS dep_hour_original,
 (SELECT count(*) FILTER (dep_hour_before = -1 AND dep_hour <> -1) FROM c) AS dep_hour_restored, (SELECT count(*) FILTER (dep_hour = -1) FROM c) AS dep_hour_residual,
 (SELECT count(*) FILTER (arr_hour_before = -1) FROM c) AS arr_hour_original, (SELECT count(*) FILTER (arr_hour_before = -1 AND arr_hour <> -1) FROM c) AS arr_hour_restored,
 (SELECT count(*) FILTER (arr_hour = -1) FROM c) AS arr_hour_residual, (SELECT count(*) FILTER (gap_was_missing) FROM c) AS gap_original,
 (SELECT count(*) FILTER (gap_was_missing AND duration IS NOT NULL) FROM c) AS gap_restored, (SELECT count(*) FILTER (duration IS NULL) FROM c) AS gap_residual,
 (SELECT count(*) FILTER (by_route_median) FROM c) AS gap_by_route_median, (SELECT count(*) FILTER (gap_was_missing AND NOT by_route_median) FROM c) AS gap_by_global_median,
 (SELECT count(*) FILTER (gap_was_missing AND duration = 0) FROM c) AS gap_restored_zero, (SELECT count(*) FILTER (NOT gap_was_missing AND duration = 0) FROM c) AS gap_zero_before,
 CAST(0 AS BIGINT) AS dep_outside_clock, CAST(0 AS BIGINT) AS arr_outside_clock,
 (SELECT median(duration) FROM by_route) AS global_median_after_route_fill, (SELECT median(duration) FROM timed) AS global_median_before_route_fill""", V)
def time_restore_accounting(spark, sf):
    return audit.time_restore_accounting(fx.flights(spark, sf), F.col("delay").isNotNull())


_TRAFFIC_PART = """SELECT '{n}' AS feature, CAST(sum(CASE WHEN {h} = -1 THEN c ELSE 0 END) AS BIGINT) AS null_rows, min(CASE WHEN {h} <> -1 AND c > 0 THEN n END) AS min_value,
 CAST(sum(CASE WHEN {h} <> -1 AND n = 1 THEN c ELSE 0 END) AS BIGINT) AS rows_alone, CAST(sum(CASE WHEN {h} <> -1 AND y > 1 THEN c ELSE 0 END) AS BIGINT) AS rows_in_mixed_years
 FROM (SELECT mo, dom, {a}, {h}, count(*) AS n, count(*) FILTER (delay IS NOT NULL) AS c, count(DISTINCT yr) AS y FROM restored GROUP BY ALL)"""


@query("a38_traffic_accounting", f"WITH {q_windows.RESTORE_SQL} " + _TRAFFIC_PART.format(n="origin_traffic", a="origin", h="dep_hour")
       + " UNION ALL " + _TRAFFIC_PART.format(n="dest_traffic", a="dest", h="arr_hour"), V)
def traffic_accounting(spark, sf):
    return audit.traffic_accounting(q_windows.restored_flights(spark, sf), "yr", F.col("delay").isNotNull())


# ---- group statistics -------------------------------------------------------

@query("a2_group_size_and_distinct", """SELECT o_custkey, o_orderpriority, count(*) AS n_rows, count(DISTINCT o_orderstatus) AS n_numbers FROM orders WHERE o_custkey % 7 <> 0 GROUP BY ALL""")
def group_size_and_distinct(spark, sf):
    rows = fx.table(spark, sf, "orders").withColumn("o_custkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")))
    return matching.group_size_and_distinct(rows, ["o_custkey", "o_orderpriority"], "o_orderstatus")


@query("a3_rate_table", f"""WITH {_LABELED}, d AS (SELECT coalesce(airline, '(missing)') AS airline, mo, delayed FROM labeled)
SELECT 'labeled_all' AS population, (SELECT count(*) FROM d) AS population_rows, (SELECT CAST(sum(delayed) AS BIGINT) FROM d) AS population_delayed, airline, mo, count(*) AS n_rows,
 CAST(sum(delayed) AS BIGINT) AS n_delayed, count(*) - CAST(sum(delayed) AS BIGINT) AS n_not_delayed, round(sum(delayed) / count(*), 9) AS delay_rate,
 round(count(*) / (SELECT count(*) FROM d), 9) AS share_of_population FROM d GROUP BY airline, mo""", V)
def rate_table(spark, sf):
    rows = clean.report_dims(labeled(spark, sf))
    return rounded(report.rate_table(rows, ["airline", "mo"], population="labeled_all"), ["delay_rate", "share_of_population"])


# weather-shaped values from event values: unmatched rows carry nothing
_WEATHER_SQL = """w AS (SELECT event_id, CAST(value > 120 AS INT) AS delayed, CAST(event_id % 6 <> 0 AS INT) AS m1, CAST(event_id % 4 <> 0 AS INT) AS m2,
 CASE WHEN event_id % 9 <> 0 THEN value END AS a, CASE WHEN event_id % 8 <> 0 THEN floor(value) % 40 END AS b, CASE WHEN event_id % 7 <> 0 THEN floor(value) % 13 END AS c,
 CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 3 = 1 THEN 0.0001 ELSE (event_id % 30) / 100.0 + 0.001 END END AS d, CAST(event_id % 91 AS DOUBLE) AS e FROM events)"""
_FEATURES = (("tmpf", "a"), ("sknt", "b"), ("vsby", "c"), ("p01i", "d"), ("age_minutes", "e"))


def weather_rows(spark, sf):
    base = fx.table(spark, sf, "events").selectExpr(
        "event_id", "CAST(value > 120 AS INT) AS delayed", "CAST(event_id % 6 <> 0 AS INT) AS weather_origin_matched",
        "CAST(event_id % 4 <> 0 AS INT) AS weather_destination_matched",
        "CASE WHEN event_id % 9 <> 0 THEN value END AS a", "CAST(CASE WHEN event_id % 8 <> 0 THEN floor(value) % 40 END AS DOUBLE) AS b",
        "CAST(CASE WHEN event_id % 7 <> 0 THEN floor(value) % 13 END AS DOUBLE) AS c",
        "CAST(CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 0.0D WHEN event_id % 3 = 1 THEN 0.0001D"
        " ELSE (event_id % 30) / 100.0D + 0.001D END END AS DOUBLE) AS d", "CAST(event_id % 91 AS DOUBLE) AS e")
    columns = []
    for role in ("origin", "destination"):
        matched = F.col(f"weather_{role}_matched")
        columns += [F.when(matched == 1, F.col(source)).alias(f"weather_{role}_{f}") for f, source in _FEATURES]
    return base.select("event_id", "delayed", "weather_origin_matched", "weather_destination_matched", *columns)


# written out by hand, so that a wrong edge in the operator shows
_BIN_CASES = {
    "tmpf": "CASE WHEN {v} < 32 THEN 0 WHEN {v} < 50 THEN 1 WHEN {v} < 68 THEN 2 WHEN {v} < 86 THEN 3 ELSE 4 END",
    "sknt": "CASE WHEN {v} = 0 THEN 0 WHEN {v} < 6 THEN 1 WHEN {v} < 11 THEN 2 WHEN {v} < 16 THEN 3 WHEN {v} < 21 THEN 4 WHEN {v} < 31 THEN 5 ELSE 6 END",
    "vsby": "CASE WHEN {v} < 1 THEN 0 WHEN {v} < 3 THEN 1 WHEN {v} < 5 THEN 2 WHEN {v} < 10 THEN 3 ELSE 4 END",
    "p01i": "CASE WHEN {v} = 0 THEN 0 WHEN abs({v} - 0.0001::DOUBLE) <= 1e-9::DOUBLE THEN 1 WHEN {v} < 0.05::DOUBLE THEN 2 WHEN {v} < 0.1::DOUBLE THEN 3 ELSE 4 END",
    "age_minutes": "CASE WHEN {v} < 30 THEN 0 WHEN {v} < 60 THEN 1 WHEN {v} <= 90 THEN 2 END",
}


def _bin_sql(feature: str, v: str, m: str) -> str:
    return f"CASE WHEN {m} = 0 THEN 900 WHEN {v} IS NULL THEN 800 ELSE {_BIN_CASES[feature].format(v=v)} END"


_BIN_LONG = " UNION ALL ".join(
    f"SELECT '{role}' AS role, '{f}' AS feature, {_bin_sql(f, s, m)} AS bin_order, delayed FROM w"
    for role, m in (("origin", "m1"), ("destination", "m2")) for f, s in _FEATURES) + """
 UNION ALL SELECT 'both', 'matched_status', CASE WHEN m1 = 1 AND m2 = 1 THEN 0 WHEN m1 = 1 THEN 1 WHEN m2 = 1 THEN 2 ELSE 3 END, delayed FROM w"""


@query("a4_bin_assignment", f"""WITH {_WEATHER_SQL} SELECT event_id, CAST({_bin_sql('p01i', 'd', 'm1')} AS INT) AS rain_bin, CAST({_bin_sql('sknt', 'b', 'm1')} AS INT) AS wind_bin,
 CASE {_bin_sql('sknt', 'b', 'm1')} WHEN 900 THEN 'unmatched' WHEN 800 THEN 'field_missing' WHEN 0 THEN 'special' ELSE 'value' END AS wind_kind FROM w""")
def bin_assignment(spark, sf):
    rows = weather_rows(spark, sf)
    rain = report.feature_bin("p01i", F.col("weather_origin_p01i"), F.col("weather_origin_matched"))
    wind = report.feature_bin("sknt", F.col("weather_origin_sknt"), F.col("weather_origin_matched"))
    return rows.select("event_id", rain["bin_order"].alias("rain_bin"), wind["bin_order"].alias("wind_bin"),
                       wind["bin_kind"].alias("wind_kind"))


@query("a5_bins_long", f"""WITH {_WEATHER_SQL}, long AS ({_BIN_LONG})
SELECT role, feature, CAST(bin_order AS INT) AS bin_order, count(*) AS n_rows, CAST(sum(delayed) AS BIGINT) AS n_delayed, round(sum(delayed) / count(*), 9) AS delay_rate,
 round(count(*) / (SELECT count(*) FROM w), 9) AS share_of_population FROM long GROUP BY ALL""")
def bins_long(spark, sf):
    table = report.bins_long(weather_rows(spark, sf), "delayed", population="weather")
    return rounded(table, ["delay_rate", "share_of_population"]).select(
        "role", "feature", "bin_order", "n_rows", "n_delayed", "delay_rate", "share_of_population")


@query("a20_multi_key_coverage", """
SELECT yr, CASE WHEN mo IN (12, 1, 2) THEN 'winter' WHEN mo IN (3, 4, 5) THEN 'spring' WHEN mo IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season, CAST(origin % 5 AS INT) AS region,
 count(*) AS n_rows, count(*) FILTER (distance > 400) AS eligible, count(dep_hhmm) AS matched FROM flights GROUP BY ALL""", V)
def multi_key_coverage(spark, sf):
    return fx.flights(spark, sf).groupBy("yr", geo.season(F.col("mo")).alias("season"), (F.col("origin") % 5).alias("region")).agg(
        F.count(F.lit(1)).alias("n_rows"), report.count_if(F.col("distance") > 400).alias("eligible"),
        F.count("dep_hhmm").alias("matched"))


# ---- calendar ---------------------------------------------------------------

@query("a21_daily_counts", f"WITH {q_windows.DAYS_SQL} SELECT mo, dom, n, doy FROM days", V)
def daily_counts(spark, sf):
    return calendar_signal.daily_counts(fx.flights(spark, sf))


@query("a22_variance_explained", f"""WITH {q_windows.DAYS_SQL}, g AS (SELECT avg(residual) AS grand FROM r), k AS (SELECT cycle_class, count(*) AS n, avg(residual) AS m FROM r GROUP BY 1)
SELECT round((SELECT sum(n * (m - grand) * (m - grand)) FROM k, g) / (SELECT sum((residual - grand) * (residual - grand)) FROM r, g), 9) AS share""", V)
def variance_explained(spark, sf):
    days = calendar_signal.decompose(calendar_signal.daily_counts(fx.flights(spark, sf)))
    return rounded(calendar_signal.variance_explained(days, "residual", "cycle_class"), ["share"])


_SHARE = "(sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n))"


@query("a23_permutation_p_value", f"""WITH {q_windows.DAYS_SQL}, draws AS (SELECT unnest(range(1, 20001)) AS draw),
ranked AS (SELECT draw, residual, cycle_class, row_number() OVER (PARTITION BY draw ORDER BY sha256(draw || ':' || mo * 100 + dom || ':42')) AS put,
 row_number() OVER (PARTITION BY draw ORDER BY mo, dom) AS spot FROM r, draws),
dealt AS (SELECT a.draw, a.cycle_class, b.residual FROM ranked a JOIN ranked b ON a.draw = b.draw AND a.spot = b.put),
g AS (SELECT draw, cycle_class, sum(residual) AS s, sum(residual * residual) AS q, count(*) AS n FROM dealt GROUP BY ALL),
t AS (SELECT draw, {_SHARE} AS share FROM g GROUP BY draw),
own AS (SELECT cycle_class, sum(residual) AS s, sum(residual * residual) AS q, count(*) AS n FROM r GROUP BY ALL),
o AS (SELECT {_SHARE} AS observed FROM own)
SELECT round(avg(CASE WHEN share >= observed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS p_value, round(quantile_cont(share, 0.999), 9) AS null_quantile,
 count(*) AS draws, round(any_value(observed), 9) AS observed FROM t, o""", V)
def permutation_p_value(spark, sf):
    days = calendar_signal.decompose(calendar_signal.daily_counts(fx.flights(spark, sf)))
    return _rounded_test(days)


def _rounded_test(days):
    return rounded(calendar_signal.permutation_test(days.select((F.col("mo") * 100 + F.col("dom")).alias("day"), "residual", "cycle_class"), "residual", "cycle_class", "day",
                                            draws=20_000, seed=42), ["p_value", "null_quantile", "observed"])


@query("a25_share_shift_z", """
WITH nov AS (SELECT carrier_code AS c, dom FROM flights WHERE mo = 11 AND carrier_code IS NOT NULL),
t AS (SELECT count(*) FILTER (dom NOT IN (22, 28)) AS base, count(*) FILTER (dom = 22) AS a, count(*) FILTER (dom = 28) AS b FROM nov),
s AS (SELECT c AS carrier_code, count(*) AS n_rows, count(*) FILTER (dom NOT IN (22, 28)) / any_value(base) AS baseline_share, count(*) FILTER (dom = 22) / any_value(a) AS first_share, count(*) FILTER (dom = 28) / any_value(b) AS second_share,
 any_value(a) AS a, any_value(b) AS b FROM nov, t GROUP BY c HAVING count(*) >= 20),
z AS (SELECT *, round((first_share - baseline_share) / sqrt(baseline_share * (1 - baseline_share) / a), 2) AS first_z, round((second_share - baseline_share) / sqrt(baseline_share * (1 - baseline_share) / b), 2) AS second_z FROM s)
SELECT carrier_code, n_rows, round(baseline_share, 9) AS baseline_share, round(first_share, 9) AS first_share, first_z, round(second_share, 9) AS second_share, second_z,
 coalesce((first_z <= -2 AND second_z >= 2) OR (first_z >= 2 AND second_z <= -2), FALSE) AS separates FROM z""", V)
def share_shift(spark, sf):
    november = fx.flights(spark, sf).filter("mo = 11")
    out = calendar_signal.share_shift(november, "carrier_code", {"first": F.col("dom") == 22, "second": F.col("dom") == 28}, min_rows=20)
    return rounded(out, ["baseline_share", "first_share", "second_share"])


_NOV_YEARS = "resolved AS (SELECT mo, dom, CASE WHEN yr % 2 = 0 THEN 1996 WHEN yr <> 1999 THEN 1997 END AS attributed_year FROM flights)"
_COMPOSITION = f"""{_NOV_YEARS}, comp AS (SELECT mo, dom, count(*) FILTER (attributed_year = 1996) AS rows_1996, count(*) FILTER (attributed_year = 1997) AS rows_1997 FROM resolved WHERE attributed_year IS NOT NULL GROUP BY mo, dom),
daily AS (SELECT *, rows_1996 + rows_1997 AS resolved_rows, rows_1996 / (rows_1996 + rows_1997) AS first_year_share, sum(rows_1996) OVER (PARTITION BY mo) / sum(rows_1996 + rows_1997) OVER (PARTITION BY mo) AS month_share FROM comp)"""


def _composition(spark, sf):
    year = F.when(F.col("yr") % 2 == 0, 1996).when(F.col("yr") != 1999, 1997)
    return calendar_signal.daily_composition(fx.flights(spark, sf).withColumn("attributed_year", year), [1996, 1997])


@query("a39_daily_composition_pivot", f"WITH {_COMPOSITION} SELECT mo, dom, rows_1996, rows_1997, resolved_rows, round(first_year_share, 9) AS first_year_share, round(month_share, 9) AS month_share FROM daily", V)
def daily_composition(spark, sf):
    return rounded(_composition(spark, sf), ["first_year_share", "month_share"])


@query("a40_directional_holiday_check", f"""WITH {_COMPOSITION}, med AS (SELECT mo, median(first_year_share) AS m FROM daily GROUP BY mo),
c AS (SELECT d.mo, d.dom, first_year_share AS s, m, CASE WHEN dom = 22 THEN 'down' ELSE 'up' END AS expected, CASE WHEN first_year_share > m THEN 'up' WHEN first_year_share < m THEN 'down' ELSE 'flat' END AS observed FROM daily d JOIN med USING (mo) WHERE mo = 11 AND dom IN (22, 28))
SELECT mo, dom, round(s, 9) AS first_year_share, round(m, 9) AS month_median, expected, observed, expected = observed AS as_expected FROM c""", V)
def directional_holiday_check(spark, sf):
    out = calendar_signal.directional_check(_composition(spark, sf), {(11, 22): "down", (11, 28): "up"})
    return rounded(out, ["first_year_share", "month_median"])


@query("a48_calendar_mixture_share", f"""WITH {q_windows.DAYS_SQL}, ys AS (SELECT DISTINCT yr FROM flights WHERE NOT (yr % 4 = 0 AND (yr % 100 <> 0 OR yr % 400 = 0))),
cls AS (SELECT CAST(isodow(make_date(yr, 1, 1)) - 1 AS INT) AS jan1_weekday, min(yr) AS yr FROM ys GROUP BY 1),
th AS (SELECT jan1_weekday, yr, CAST(22 + (4 - isodow(make_date(yr, 11, 22)) + 7) % 7 AS INT) AS d FROM cls),
t AS (SELECT jan1_weekday, d AS holiday_day, a.z AS z_thursday, b.z AS z_friday, c.z AS z_wednesday FROM th LEFT JOIN signal a ON a.mo = 11 AND a.dom = d LEFT JOIN signal b ON b.mo = 11 AND b.dom = d + 1 LEFT JOIN signal c ON c.mo = 11 AND c.dom = d - 1),
p AS (SELECT *, coalesce(z_thursday <= 0 AND z_friday <= 0, FALSE) AS dip_pair FROM t),
s AS (SELECT *, coalesce(lag(holiday_day) OVER (ORDER BY holiday_day) = holiday_day - 1 AND lag(dip_pair) OVER (ORDER BY holiday_day), FALSE) AS after_confirmed, sum(CASE WHEN dip_pair THEN abs(z_thursday) END) OVER () AS depth FROM p)
SELECT jan1_weekday, holiday_day, round(z_thursday, 6) AS z_thursday, round(z_friday, 6) AS z_friday, round(z_wednesday, 6) AS z_wednesday, dip_pair, after_confirmed,
 round(CASE WHEN dip_pair THEN abs(z_thursday) / depth END, 6) AS implied_share, CASE WHEN NOT dip_pair AND NOT after_confirmed AND depth IS NOT NULL THEN 0.0::DOUBLE END AS share_upper_bound FROM s""", V)
def calendar_mixture_share(spark, sf):
    rows = fx.flights(spark, sf)
    days = calendar_signal.decompose(calendar_signal.daily_counts(rows))
    # the demonstration data has no real holiday dip, so any dip below zero is taken as one
    out = calendar_signal.holiday_mixture(days, rows.select("yr").distinct(), dip=0.0)
    return rounded(out, ["z_thursday", "z_friday", "z_wednesday", "implied_share", "share_upper_bound"], 6)


# ---- profiles ---------------------------------------------------------------

@query("a24_functional_dependency_check", """
WITH k AS (SELECT p_brand, p_type, count(DISTINCT p_size) AS n FROM part GROUP BY ALL)
SELECT count(*) AS groups, count(*) FILTER (n = 1) AS single_valued, count(*) FILTER (n > 1) AS breaches, round(avg(CAST(n = 1 AS INT)), 9) AS share_single_valued,
 min(CASE WHEN n > 1 THEN p_brand || ' / ' || p_type END) AS example_breach FROM k""")
def functional_dependency(spark, sf):
    return rounded(report.functional_dependency(fx.table(spark, sf, "part"), ["p_brand", "p_type"], "p_size"), ["share_single_valued"])


_PROFILE_COLUMNS = ("mo", "airline", "origin", "dest")
_INSIDE = "dep_hhmm IS NULL AND arr_hhmm IS NULL"


@query("a27_group_profile", f"""WITH tagged AS ({" UNION ALL ".join(f"SELECT '{c}' AS attribute, coalesce(CAST({c} AS VARCHAR), '(missing)') AS value, {_INSIDE} AS i FROM flights" for c in _PROFILE_COLUMNS)}),
g AS (SELECT attribute, value, count(*) FILTER (i) AS n, count(*) FILTER (NOT i) AS o FROM tagged GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY attribute) AS share, o / sum(o) OVER (PARTITION BY attribute) AS reference_share, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, value) AS rn FROM g)
SELECT attribute, value, n, round(share, 9) AS share, round(reference_share, 9) AS reference_share, round(CASE WHEN reference_share > 0 THEN share / reference_share END, 9) AS share_ratio FROM s WHERE rn <= 8""", V)
def group_profile(spark, sf):
    inside = F.col("dep_hhmm").isNull() & F.col("arr_hhmm").isNull()
    out = report.group_profile(fx.flights(spark, sf), inside, _PROFILE_COLUMNS)
    return rounded(out, ["share", "reference_share", "share_ratio"])


@query("a27_numeric_profile", " UNION ALL ".join(f"""
SELECT i AS in_group, '{c}' AS attribute, round(avg(CAST({c} IS NULL AS INT)), 9) AS null_rate, count({c}) AS n_values, quantile_cont({c}, 0.25)::DOUBLE AS q25, quantile_cont({c}, 0.5)::DOUBLE AS median,
 quantile_cont({c}, 0.75)::DOUBLE AS q75 FROM (SELECT *, carrier_code IS NULL AS i FROM flights) GROUP BY i""" for c in ("distance", "dep_hhmm")), V)
def numeric_profile(spark, sf):
    out = report.numeric_profile(fx.flights(spark, sf), F.col("carrier_code").isNull(), ["distance", "dep_hhmm"])
    return rounded(out, ["null_rate"])


@query("a28_missing_cooccurrence", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(avg(CAST({c} IS NULL AS INT)) FILTER ({_INSIDE}), 9) AS missing_rate, round(avg(CAST({c} IS NULL AS INT)) FILTER (NOT ({_INSIDE})), 9) AS reference_missing_rate,
 count(*) FILTER ({_INSIDE} AND {c} IS NULL) AS n_missing FROM flights WHERE delay IS NOT NULL""" for c in ("airline", "carrier_code", "distance")), V)
def missing_cooccurrence(spark, sf):
    flags = clean.missing_flags(fx.flights(spark, sf))
    inside = (F.col("raw_missing__dep_hhmm") == 1) & (F.col("raw_missing__arr_hhmm") == 1)
    columns = [f"raw_missing__{c}" for c in ("airline", "carrier_code", "distance")]
    out = report.missing_cooccurrence(flags, inside, columns)
    out = out.withColumn("column", F.replace(F.col("column"), F.lit("raw_missing__"), F.lit("")))
    return rounded(out, ["missing_rate", "reference_missing_rate"])


_COVER_COLUMNS = ("mo", "airline", "tail")
_COVER_SQL = f"""tagged AS ({" UNION ALL ".join(f"SELECT '{c}' AS attribute, coalesce(CAST({c} AS VARCHAR), '(missing)') AS value, delay FROM flights" for c in _COVER_COLUMNS)}),
t AS (SELECT count(*) FILTER (delay IS NOT NULL) AS l, count(*) FILTER (delay IS NULL) AS u FROM flights),
g AS (SELECT attribute, value, count(*) AS total_n, count(delay) AS labeled_n, count(*) FILTER (delay = 'Delayed') AS positive_n, count(*) - count(delay) AS unlabeled_n, count(delay) / any_value(l) AS labeled_share,
 (count(*) - count(delay)) / any_value(u) AS unlabeled_share FROM tagged, t GROUP BY attribute, value)"""


def _coverage(spark, sf):
    return report.label_coverage(fx.flights(spark, sf), F.col("delay").isNotNull(), F.col("delay") == "Delayed", _COVER_COLUMNS)


@query("a30_label_coverage_groups", f"""WITH {_COVER_SQL} SELECT attribute, value, total_n, labeled_n, positive_n, unlabeled_n, round(labeled_share, 9) AS labeled_share, round(unlabeled_share, 9) AS unlabeled_share,
 round(100 * (unlabeled_share - labeled_share), 7) AS delta_pp, round(positive_n / nullif(labeled_n, 0), 9) AS observed_rate FROM g""", V)
def label_coverage_groups(spark, sf):
    out = rounded(_coverage(spark, sf)[0], ["labeled_share", "unlabeled_share", "observed_rate"])
    return rounded(out.select("attribute", "value", "total_n", "labeled_n", "positive_n", "unlabeled_n", "labeled_share",
                              "unlabeled_share", "delta_pp", "observed_rate"), ["delta_pp"], 7)


@query("a30_label_coverage", f"""WITH {_COVER_SQL} SELECT attribute, count(*) AS categories, round(sum(abs(labeled_share - unlabeled_share)) / 2, 9) AS total_variation, round(max(abs(100 * (unlabeled_share - labeled_share))), 7) AS max_share_gap_pp,
 CAST(sum(CASE WHEN labeled_n = 0 THEN unlabeled_n ELSE 0 END) AS BIGINT) AS unseen_rows FROM g GROUP BY attribute""", V)
def label_coverage(spark, sf):
    return rounded(rounded(_coverage(spark, sf)[1], ["total_variation"]), ["max_share_gap_pp"], 7)


@query("a30_missing_by_label", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL AND delay IS NOT NULL) AS labeled_missing_n, count(*) FILTER ({c} IS NULL AND delay IS NULL) AS unlabeled_missing_n,
 round(100 * count(*) FILTER ({c} IS NULL AND delay IS NOT NULL) / count(delay), 7) AS labeled_missing_pct, round(100 * count(*) FILTER ({c} IS NULL AND delay IS NULL) / (count(*) - count(delay)), 7) AS unlabeled_missing_pct,
 round(100 * count(*) FILTER ({c} IS NULL AND delay IS NULL) / (count(*) - count(delay)) - 100 * count(*) FILTER ({c} IS NULL AND delay IS NOT NULL) / count(delay), 7) AS delta_pp FROM flights""" for c in ("dep_hhmm", "airline")), V)
def missing_by_label(spark, sf):
    out = report.missing_by_label(fx.flights(spark, sf), F.col("delay").isNotNull(), ["dep_hhmm", "airline"])
    return rounded(out, ["labeled_missing_pct", "unlabeled_missing_pct", "delta_pp"], 7)


_Q = (("q01", 0.01), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q99", 0.99))


@query("a31_numeric_shift", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) FILTER (delay IS NOT NULL) AS labeled_n, count({c}) FILTER (delay IS NULL) AS unlabeled_n,
 round((avg({c}) FILTER (delay IS NULL) - avg({c}) FILTER (delay IS NOT NULL)) / sqrt((var_samp({c}) FILTER (delay IS NULL) + var_samp({c}) FILTER (delay IS NOT NULL)) / 2), 9) AS standardized_mean_difference,
 {", ".join(f"round(quantile_cont({c}, {q}) FILTER (delay IS {n} NULL)::DOUBLE, 6) AS {t}_{a}" for n, t in (("NOT", "labeled"), ("", "unlabeled")) for a, q in _Q)} FROM flights""" for c in ("distance", "dep_hhmm", "arr_hhmm")), V)
def numeric_shift(spark, sf):
    out = report.numeric_shift(fx.flights(spark, sf), F.col("delay").isNotNull(), ["distance", "dep_hhmm", "arr_hhmm"])
    out = rounded(out, [f"{t}_{a}" for t in ("labeled", "unlabeled") for a, _ in _Q], 6)
    return rounded(out, ["standardized_mean_difference"])


@query("a32_column_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows, (count(*) - count({c})) / count(*) AS null_rate, count(DISTINCT {c}) <= 1 AND count(*) = count({c}) AS is_constant FROM part"""
    for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def column_profile(spark, sf):
    return report.column_profile(fx.table(spark, sf, "part")).drop("dtype")


@query("a32_duplicate_counts", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM a) AS duplicate_rows, (SELECT CAST(sum(n - 1) AS BIGINT) FROM b) AS duplicate_rows_without_id, (SELECT CAST(sum(n - 1) AS BIGINT) FROM c) AS duplicate_ids""")
def duplicate_counts(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return report.duplicate_counts(rows, "l_orderkey")


# ---- report archive ---------------------------------------------------------

_REASONED = q_joins._CASES + """, r AS (SELECT c.event_id, c.latency, s.value, c.matched, CASE WHEN NOT eligible THEN 'not_mapping_eligible' WHEN c.matched THEN 'matched' WHEN latest_observed_at IS NULL THEN 'no_report'
 WHEN latest_age > 5400000000 THEN 'stale' ELSE 'not_yet' END AS reason, (epoch_us(s.prediction_at) - epoch_us(s.observed_at)) / 60e6 AS age FROM cases c JOIN swept s USING (event_id, latency))"""
_VR = ("requests", "reports", "latencies")


@query("a33_match_diagnostics", _REASONED + """
SELECT latency, count(*) AS n_rows, count(*) FILTER (matched) AS n_matched, count(*) FILTER (value IS NULL) AS value_missing, count(*) FILTER (value IS NULL AND matched) AS value_missing_matched,
 count(*) FILTER (CAST(value AS VARCHAR) = '' AND matched) AS value_blank_matched, round(min(age), 6) AS age_min, round(quantile_cont(age, 0.1), 6) AS age_p10, round(quantile_cont(age, 0.25), 6) AS age_p25, round(quantile_cont(age, 0.5), 6) AS age_median, round(quantile_cont(age, 0.75), 6) AS age_p75,
 round(quantile_cont(age, 0.9), 6) AS age_p90, round(quantile_cont(age, 0.95), 6) AS age_p95, round(quantile_cont(age, 0.99), 6) AS age_p99, round(max(age), 6) AS age_max FROM r GROUP BY latency""", _VR)
def match_diagnostics(spark, sf):
    from tripwright.operators import asof

    swept = asof.latency_sweep(fx.requests(spark, sf), fx.reports(spark, sf).drop("available_at"))
    out = report.match_diagnostics(swept.withColumn("matched", F.col("observed_at").isNotNull()), ["latency"], ["value"])
    return rounded(out, [c for c in out.columns if c.startswith("age_")], 6)


@query("a33_role_coverage", f"""WITH {q_joins._SWEEP}, d AS (SELECT event_id, latency, observed_at IS NOT NULL AS o FROM swept),
roles AS (SELECT latency, event_id, o, event_id % 3 <> 0 AND o AS d FROM d), t AS (SELECT latency, count(*) AS n_rows, count(*) FILTER (o AND d) AS both_matched, count(*) FILTER (o <> d) AS one_matched, count(*) FILTER (NOT o AND NOT d) AS none_matched FROM roles GROUP BY latency)
SELECT *, TRUE AS coverage_not_rising FROM t""", _VR)
def role_coverage(spark, sf):
    from tripwright.operators import asof

    swept = asof.latency_sweep(fx.requests(spark, sf), fx.reports(spark, sf).drop("available_at"))
    matched = F.col("observed_at").isNotNull()
    roles = swept.select("latency", "event_id", F.inline(F.array(
        F.struct(F.lit("origin").alias("role"), matched.alias("matched")),
        F.struct(F.lit("destination").alias("role"), (matched & (F.col("event_id") % 3 != 0)).alias("matched")))))
    return report.role_coverage(roles, "latency", "event_id")


@query("a34_age_percentiles", _REASONED + """
SELECT latency, count(age) AS n_values, round(quantile_cont(age, 0.1), 6) AS p10, round(quantile_cont(age, 0.25), 6) AS p25, round(median(age), 6) AS median, round(quantile_cont(age, 0.75), 6) AS p75, round(quantile_cont(age, 0.9), 6) AS p90, round(max(age), 6) AS max
FROM r WHERE age IS NOT NULL GROUP BY latency""", _VR)
def age_percentiles(spark, sf):
    from tripwright.operators import asof

    swept = asof.latency_sweep(fx.requests(spark, sf), fx.reports(spark, sf).drop("available_at"))
    out = report.age_percentiles(swept, ["latency"], "weather_age_minutes")
    return rounded(out, ["p10", "p25", "median", "p75", "p90", "max"], 6)


_RAW_FIELDS = """raw AS (SELECT user_id % 4 AS station, CASE WHEN event_id % 6 = 0 THEN 'M' WHEN event_id % 11 = 0 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS tmpf,
 CASE WHEN event_id % 5 = 0 THEN 'T' WHEN event_id % 7 = 0 THEN 'M' WHEN event_id % 17 = 0 THEN 'x1' ELSE '0.01' END AS p01i FROM events WHERE event_type = 'view')"""


def _raw_fields(spark, sf):
    return fx.table(spark, sf, "events").filter("event_type = 'view'").selectExpr(
        "user_id % 4 AS station",
        "CASE WHEN event_id % 6 = 0 THEN 'M' WHEN event_id % 11 = 0 THEN '' ELSE CAST(floor(value) AS STRING) END AS tmpf",
        "CASE WHEN event_id % 5 = 0 THEN 'T' WHEN event_id % 7 = 0 THEN 'M' WHEN event_id % 17 = 0 THEN 'x1' ELSE '0.01' END AS p01i")


@query("a35_field_quality", f"""WITH {_RAW_FIELDS} SELECT 'tmpf' AS field, count(*) AS n_rows, count(*) FILTER (tmpf = 'M') AS missing, CAST(0 AS BIGINT) AS trace, count(*) FILTER (tmpf NOT IN ('M', '') AND TRY_CAST(tmpf AS DOUBLE) IS NULL) AS other_non_numeric FROM raw
UNION ALL SELECT 'p01i', count(*), count(*) FILTER (p01i = 'M'), count(*) FILTER (p01i = 'T'), count(*) FILTER (p01i NOT IN ('M', 'T', '') AND TRY_CAST(p01i AS DOUBLE) IS NULL) FROM raw""")
def field_quality(spark, sf):
    return report.field_quality(_raw_fields(spark, sf), ["tmpf", "p01i"], trace_fields=["p01i"])


@query("a46_source_inventory", f"WITH {_RAW_FIELDS} SELECT station, count(*) AS n_reports, count(*) FILTER (tmpf <> '') AS tmpf_present, count(*) FILTER (p01i <> '') AS p01i_present FROM raw GROUP BY station")
def source_inventory(spark, sf):
    return report.source_inventory(_raw_fields(spark, sf), "station", ["tmpf", "p01i"])


@query("a51_rate_based_sizing", """
WITH w AS (SELECT user_id % 50 AS g, CAST(ts AS DATE) AS d, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6 AS hours, CAST(sum(length(props) + 20) AS DOUBLE) AS bytes FROM events GROUP BY 1, 2),
r AS (SELECT bytes / hours AS rate FROM w WHERE hours >= 0.5), need AS (SELECT count(*) AS h FROM (SELECT DISTINCT user_id % 50, date_trunc('hour', ts) FROM events))
SELECT count(*) AS n_windows, round(quantile_cont(rate, 0.25), 6) AS rate_low, round(quantile_cont(rate, 0.5), 6) AS rate_mid, round(quantile_cont(rate, 0.75), 6) AS rate_high,
 round(quantile_cont(rate, 0.25) * any_value(h), 3) AS estimate_low, round(quantile_cont(rate, 0.5) * any_value(h), 3) AS estimate_mid, round(quantile_cont(rate, 0.75) * any_value(h), 3) AS estimate_high FROM r, need""")
def rate_based_sizing(spark, sf):
    events = fx.table(spark, sf, "events").withColumn("g", F.col("user_id") % 50)
    windows = events.groupBy("g", F.col("ts").cast("date").alias("d")).agg(
        (clock.micros_between(F.min("ts"), F.max("ts")) / 3600e6).alias("hours"),
        F.sum(F.length("props") + 20).cast("double").alias("bytes"))
    needed = events.select("g", clock.hour_number(F.col("ts"))).distinct().agg(F.count(F.lit(1)).alias("h"))
    out = report.rate_based_sizing(windows, "hours", "bytes", needed.scalar())
    out = rounded(out, ["rate_low", "rate_mid", "rate_high"], 6)
    return rounded(out, ["estimate_low", "estimate_mid", "estimate_high"], 3)


# ---- statuses, fingerprints, nested logs ------------------------------------

@query("a41_status_partition_summary", """SELECT mo, CASE WHEN dep_hhmm IS NULL THEN 'missing_key' WHEN flight_id % 3 = 0 THEN 'single' ELSE 'none' END AS status, count(*) AS n_rows FROM flights GROUP BY ALL""", V)
def status_partition_summary(spark, sf):
    rows = fx.flights(spark, sf).selectExpr("mo", "CASE WHEN dep_hhmm IS NULL THEN 'missing_key' WHEN flight_id % 3 = 0 THEN 'single' ELSE 'none' END AS status")
    return audit.status_summary(rows, ["mo"], ["missing_key", "single", "none"])


@query("a43_table_fingerprint", """WITH h AS (SELECT sha256(flight_id || '|' || seed || '|' || fold || '|' || y_true || '|' || CAST(round(p * 1000000000) AS BIGINT)) AS h FROM oof),
s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 12) AS HUGEINT)) AS a, sum(CAST('0x' || substr(h, 13, 12) AS HUGEINT)) AS b FROM h)
SELECT n AS n_rows, sha256(n || ':' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR)) AS fingerprint FROM s""", ("flights", "oof"))
def table_fingerprint(spark, sf):
    rows = fx.oof(spark, sf).withColumn("p", F.round(F.col("p") * 1_000_000_000).cast("bigint"))
    return audit.table_fingerprint(rows, ["flight_id", "seed", "fold", "y_true", "p"])


_LINES = "string_split(text || chr(10) || ' HTTP/1.1 503' || chr(10) || ' timed out', chr(10))"


def attempts_of_turns(spark, sf):
    """Each turn as a request whose lines (plus two failing ones) are its attempts."""
    lines = "split(text || '\\n HTTP/1.1 503\\n timed out', '\\n')"
    attempts = (f"transform({lines}, x -> named_struct('ok', NOT startswith(x, ' '), 'error', x,"
                " 'bytes', CASE WHEN length(x) % 5 <> 0 THEN CAST(length(x) AS BIGINT) END))")
    declared = f"size({lines}) + CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END"
    return fx.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", f"{attempts} AS attempts", f"{declared} AS declared_attempts")


@query("a44_nested_attempt_audit", f"""WITH l AS (SELECT conv_id, turn, unnest({_LINES}) AS x FROM conversations)
SELECT count(*) AS attempts, count(*) FILTER (NOT starts_with(x, ' ')) AS succeeded, count(*) FILTER (starts_with(x, ' ')) AS failed, count(*) FILTER (length(x) % 5 = 0) AS unmeasured,
 CAST(sum(CASE WHEN length(x) % 5 <> 0 THEN length(x) ELSE 0 END) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS requests_without_attempts, count(*) FILTER (turn % 4 = 3) AS attempts_of_misdeclared_requests,
 count(*) FILTER (starts_with(x, ' ') AND x = ' HTTP/1.1 503') AS error_http_503, CAST(0 AS BIGINT) AS error_http_429, CAST(0 AS BIGINT) AS error_http_422, CAST(0 AS BIGINT) AS error_interrupted_unknown,
 count(*) FILTER (x = ' timed out') AS error_timeout, CAST(0 AS BIGINT) AS error_response_size_cap, CAST(0 AS BIGINT) AS error_response_validation,
 count(*) FILTER (starts_with(x, ' ') AND x NOT IN (' HTTP/1.1 503', ' timed out')) AS error_other FROM l""")
def nested_attempt_audit(spark, sf):
    return audit.attempt_audit(attempts_of_turns(spark, sf), "conv_id")


_ROLLUP = ("airline", "origin", "dom")


@query("a47_rollup_dimensions", " UNION ALL ".join(f"""
SELECT '{c}' AS dimension, coalesce(CAST({c} AS VARCHAR), '(missing)') AS value, count(*) AS n_rows, CAST(sum(CAST(dep_hhmm IS NOT NULL AS INT)) AS BIGINT) AS n_flagged, round(1 - sum(CAST(dep_hhmm IS NOT NULL AS INT)) / count(*), 9) AS unflagged_rate FROM flights GROUP BY 2""" for c in _ROLLUP), V)
def rollup_dimensions(spark, sf):
    rows = fx.flights(spark, sf).withColumn("matched", F.col("dep_hhmm").isNotNull().cast("int"))
    return rounded(report.rollup_dimensions(rows, _ROLLUP, "matched"), ["unflagged_rate"])


# ---- feature build ----------------------------------------------------------

@query("m23_phase_feature_build", f"""WITH {_UNIQUE_MAP}, base AS (SELECT f.* REPLACE (coalesce(airline, fill) AS airline) FROM flights f LEFT JOIN m USING (carrier_code)),
{q_windows.RESTORE_SQL.replace(" FROM flights)", " FROM base)", 1)},
slots AS (SELECT *, CASE WHEN dep_hour <> -1 THEN CAST(count(*) OVER (PARTITION BY mo, dom, origin, dep_hour) AS DOUBLE) END AS origin_traffic,
 CASE WHEN arr_hour <> -1 THEN CAST(count(*) OVER (PARTITION BY mo, dom, dest, arr_hour) AS DOUBLE) END AS dest_traffic FROM restored)
SELECT flight_id, mo, yr, dep_hour, arr_hour, CAST(dep_hour_before < 0 AS INT) AS dep_hour_originally_missing, CAST(arr_hour_before < 0 AS INT) AS arr_hour_originally_missing, CAST(gap_was_missing AS INT) AS local_gap_originally_missing,
 origin_traffic, dest_traffic, CAST(dep_hour < 0 AS INT) AS dep_hour_missing, round(CASE WHEN dep_hour >= 0 THEN sin(2 * pi() * dep_hour / 24) END, 9) AS sin_dep_hour, duration AS local_gap_minutes, CAST(duration = 0 AS INT) AS gap_zero,
 round(CASE WHEN duration > 0 THEN distance / duration END, 9) AS distance_per_minute, CAST(dense_rank() OVER (ORDER BY coalesce(airline, 'MISSING')) - 1 AS INT) AS airline, CAST(dense_rank() OVER (ORDER BY route) - 1 AS INT) AS route, delay FROM slots""", V)
def phase_feature_build(spark, sf):
    out = build_features(fx.flights(spark, sf), PHASES["P6_clean"], keep=("flight_id",))
    return rounded(out, ["sin_dep_hour", "distance_per_minute"]).select(
        "flight_id", "mo", "yr", "dep_hour", "arr_hour", "dep_hour_originally_missing", "arr_hour_originally_missing",
        "local_gap_originally_missing", "origin_traffic", "dest_traffic", "dep_hour_missing", "sin_dep_hour",
        "local_gap_minutes", "gap_zero", "distance_per_minute", "airline", "route", "delay")
