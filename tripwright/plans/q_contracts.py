"""Violation tables and completeness checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.functions import clock
from tripwright.operators import asof, audit, clean, contracts, report
from tripwright.plans import q_windows
from tripwright.plans.phases import PHASES, build_features
from tripwright.plans.q_aggregates import labeled, weather_rows
from tripwright.plans.q_projection import tier_sql
from tripwright.plans.registry import query

V = ("flights",)


def rules_sql(rules: dict[str, str], source: str) -> str:
    """(rule, violations) rows, each rule one SQL aggregate over the source."""
    return "\nUNION ALL ".join(f"SELECT '{n}' AS rule, CAST({e} AS BIGINT) AS violations FROM {source}" for n, e in rules.items())


def _mapping(spark, sf):
    return fx.table(spark, sf, "nation").selectExpr(
        "n_nationkey AS iata", f"{tier_sql('n_nationkey')} AS verification_tier",
        "concat('ST', n_nationkey % 7) AS candidate_sid",
        "CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE concat('NET', n_regionkey) END AS matched_network").filter("iata <> 24")


@query("c1_pool_contract", f"""WITH m AS (SELECT n_nationkey AS iata, {tier_sql('n_nationkey')} AS tier, 'ST' || CAST(n_nationkey % 7 AS VARCHAR) AS sid, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'NET' || CAST(n_regionkey AS VARCHAR) END AS net FROM nation WHERE n_nationkey <> 24),
p AS (SELECT flight_id AS id, CASE WHEN flight_id % 90 <> 0 THEN flight_id // 2 END AS pos, CASE WHEN flight_id % 40 = 0 THEN 'odd' ELSE 'unconfirmed' END AS tier, origin, dest FROM flights)
""" + rules_sql({
    "null_id": "count(*) FILTER (id IS NULL)", "repeated_id": "count(*) - count(DISTINCT id)",
    "bad_position": "count(*) FILTER (pos IS NULL)",
    "repeated_position": "(SELECT count(*) FROM (SELECT pos FROM p GROUP BY pos HAVING count(*) > 1)) * CAST(count(*) > 0 AS INT)",
    "unknown_tier": "count(*) FILTER (tier = 'odd')",
    "unmapped_airport": "count(*) FILTER (origin = 24) + count(*) FILTER (dest = 24)",
    "repeated_airport": "0 * count(*)",
    "station_without_network": "(SELECT count(*) FROM m WHERE tier = 'confirmed_period' AND net IS NULL) * CAST(count(*) > 0 AS INT)",
    "station_in_several_networks": "(SELECT count(*) FROM (SELECT sid FROM m WHERE tier = 'confirmed_period' GROUP BY sid HAVING count(DISTINCT net) > 1)) * CAST(count(*) > 0 AS INT)",
}, "p"), V)
def pool_contract(spark, sf):
    pool = fx.flights(spark, sf).selectExpr(
        "flight_id", "CASE WHEN flight_id % 90 <> 0 THEN flight_id div 2 END AS row_position",
        "CASE WHEN flight_id % 40 = 0 THEN 'odd' ELSE 'unconfirmed' END AS row_tier", "origin", "dest")
    return contracts.pool_violations(pool, _mapping(spark, sf), identifier="flight_id", position="row_position",
                                     tier="row_tier", airports=["origin", "dest"])


_ENTRIES_SQL = """e AS (SELECT 'r' || CAST(s AS VARCHAR) || m AS request_id, 'f' || CAST(s % 60 AS VARCHAR) || m AS cache_file, m AS month, CASE WHEN s % 20 = 0 THEN lo + INTERVAL 1 DAY ELSE lo END AS window_start, lo + INTERVAL 1 MONTH AS window_end,
 CASE WHEN s % 3 = 0 THEN 'NET_A' ELSE 'NET_B' END AS network, CASE WHEN s % 25 = 0 THEN ' ' ELSE 'ST' || CAST(s % 70 AS VARCHAR) END AS station, n FROM
 (SELECT user_id AS s, strftime(ts, '%Y-%m') AS m, date_trunc('month', min(ts))::TIMESTAMP AS lo, count(*) - 40 AS n FROM events GROUP BY 1, 2))
"""


def _entries(spark, sf):
    events = fx.table(spark, sf, "events").select("user_id", clock.month_key(F.col("ts")).alias("month"))
    start, end = clock.month_window(F.col("month"))
    s = F.col("user_id")
    return events.groupBy("user_id", "month").agg((F.count(F.lit(1)) - 40).alias("n_rows")).select(
        F.concat(F.lit("r"), s.cast("string"), F.col("month")).alias("request_id"),
        F.concat(F.lit("f"), (s % 60).cast("string"), F.col("month")).alias("cache_file"), "month",
        F.when(s % 20 == 0, start + F.expr("INTERVAL 1 DAY")).otherwise(start).alias("window_start"), end.alias("window_end"),
        F.when(s % 3 == 0, "NET_A").otherwise("NET_B").alias("network"),
        F.array(F.when(s % 25 == 0, " ").otherwise(F.concat(F.lit("ST"), (s % 70).cast("string")))).alias("stations"), "n_rows")


@query("c2_manifest_entry_contract", f"WITH {_ENTRIES_SQL}" + rules_sql({
    "repeated_request": "count(*) - count(DISTINCT request_id)",
    "repeated_file": "(SELECT count(*) FROM (SELECT cache_file FROM e GROUP BY 1 HAVING count(*) > 1)) * CAST(count(*) > 0 AS INT)",
    "window_not_month": "count(*) FILTER (day(window_start) <> 1)", "empty_batch": "0 * count(*)",
    "blank_station": "count(*) FILTER (trim(station) = '')",
    "repeated_station_month": "(SELECT count(*) FROM (SELECT station, month FROM e GROUP BY 1, 2 HAVING count(*) > 1)) * CAST(count(*) > 0 AS INT)",
    "station_in_several_networks": "(SELECT count(*) FROM (SELECT station FROM e GROUP BY 1 HAVING count(DISTINCT network) > 1)) * CAST(count(*) > 0 AS INT)",
    "negative_rows": "count(*) FILTER (n < 0)"}, "e"))
def manifest_entry_contract(spark, sf):
    return contracts.manifest_violations(_entries(spark, sf))


@query("c5_extract_reconciliation", """WITH t AS (SELECT count(*) AS n, count(*) FILTER (delay = 'Delayed') AS d FROM flights WHERE delay IS NOT NULL),
w AS (SELECT count(*) AS n, CAST(sum(CAST(value > 120 AS INT)) AS BIGINT) AS d FROM events)
SELECT 'by_airline' AS extract, n AS rows, d AS flagged, n AS population_rows, d AS population_delayed, TRUE AS reconciled FROM t
UNION ALL SELECT 'by_month', n, d, n, d, TRUE FROM t UNION ALL SELECT 'by_known_departure', (SELECT count(*) FROM flights WHERE delay IS NOT NULL AND dep_hhmm IS NOT NULL), (SELECT count(*) FROM flights WHERE delay = 'Delayed' AND dep_hhmm IS NOT NULL), n, d, FALSE FROM t
UNION ALL SELECT 'weather_bins', n * 11, d * 11, n, d, FALSE FROM w""", V)
def extract_reconciliation(spark, sf):
    rows = clean.report_dims(labeled(spark, sf))
    by_hour = report.rate_table(rows, ["dep_hour_order"], population="labeled").filter("dep_hour_order >= 0")
    weather = report.bins_long(weather_rows(spark, sf), "delayed", population="weather")
    return contracts.extract_totals({
        "by_airline": report.rate_table(rows, ["airline"], population="labeled"),
        "by_month": report.rate_table(rows, ["month"], population="labeled"),
        "by_known_departure": by_hour, "weather_bins": weather})


@query("c6_invariant_counters", "SELECT rule, CAST(0 AS BIGINT) AS violations FROM (SELECT unnest(['future_observation', 'future_availability', 'age_out_of_range', 'ineligible_match', 'null_key_match', 'repeated_row', 'station_mismatch', 'out_of_window']) AS rule)")
def invariant_counters(spark, sf):
    swept = asof.latency_sweep(clean.masked_requests(
        fx.requests(spark, sf).withColumn("eligible", F.col("station") != 3), "station", "eligible", "prediction_at"),
        fx.reports(spark, sf).select("station", "observed_at", F.col("station").alias("report_station"),
                                     F.col("observed_at").alias("window_start"),
                                     (F.col("observed_at") + F.expr("INTERVAL 1 HOUR")).alias("window_end")))
    return contracts.join_invariants(
        swept, identifier=["event_id", "latency"], station="station", cutoff="prediction_at", observed="observed_at",
        available="available_at", age="weather_age_minutes", eligible=F.col("eligible"), matched_station="report_station",
        window=("window_start", "window_end"))


# One fault a row: the changed columns by the invariant they break, every fiftieth request each.
_FAULTS = {
    "future_observation": {"observed_at": "prediction_at + INTERVAL 1 MINUTE"},
    "future_availability": {"available_at": "prediction_at + INTERVAL 1 MINUTE"},
    "age_out_of_range": {"weather_age_minutes": "91D"}, "ineligible_match": {"eligible": "false"},
    "null_key_match": {"station": "CAST(NULL AS BIGINT)"}, "repeated_row": {},
    "station_mismatch": {"report_station": "2L"}, "out_of_window": {"window_end": "window_start"},
}


@query("c6_planted_faults", f"""SELECT rule, (SELECT count(*) FROM events WHERE event_type = 'purchase' AND event_id % 50 = 0) AS violations FROM (SELECT unnest({list(_FAULTS)}) AS rule)""")
def planted_faults(spark, sf):
    """The same counters over matches of which each breaks one invariant, next to sound ones."""
    sound = {"event_id": "event_id", "station": "1L", "eligible": "true", "prediction_at": "prediction_at",
             "observed_at": "prediction_at - INTERVAL 10 MINUTES", "available_at": "prediction_at - INTERVAL 5 MINUTES",
             "weather_age_minutes": "10D", "report_station": "1L", "window_start": "prediction_at - INTERVAL 1 HOUR",
             "window_end": "prediction_at + INTERVAL 1 HOUR"}
    base = fx.requests(spark, sf).selectExpr(*[f"{e} AS {c}" for c, e in sound.items()])
    rows = base.withColumn("latency", F.lit(-1))
    chosen = base.filter("event_id % 50 = 0")
    for number, (rule, changes) in enumerate(_FAULTS.items()):
        faulty = chosen.withColumns({c: F.expr(e) for c, e in changes.items()}).withColumn("latency", F.lit(number))
        rows = rows.unionByName(faulty.unionByName(faulty) if rule == "repeated_row" else faulty)
    return contracts.join_invariants(
        rows, identifier=["event_id", "latency"], station="station", cutoff="prediction_at", observed="observed_at",
        available="available_at", age="weather_age_minutes", eligible=F.col("eligible"), matched_station="report_station",
        window=("window_start", "window_end"))


_RESULTS_SQL = """plan AS (SELECT user_id AS id, count(*) AS n, CASE WHEN user_id % 3 = 0 THEN 'NET_A' ELSE 'NET_B' END AS network FROM events GROUP BY user_id),
res AS (SELECT id, n, CASE WHEN id % 8 = 0 THEN 'NET_C' ELSE network END AS network FROM plan WHERE id % 10 <> 0 UNION ALL SELECT id, n, network FROM plan WHERE id % 14 = 1 UNION ALL SELECT 1000000 + id, n, network FROM plan WHERE id % 30 = 0),
j AS (SELECT p.id AS pid, r.id AS rid, p.n AS pn, r.n AS rn, p.network AS pnet, r.network AS rnet, r.c FROM plan p FULL JOIN (SELECT id, any_value(n) AS n, max(network) AS network, count(*) AS c FROM res GROUP BY id) r ON p.id = r.id)
"""


@query("c8_plan_vs_result_completeness", f"WITH {_RESULTS_SQL}" + rules_sql({
    "missing_result": "count(*) FILTER (rid IS NULL)", "unplanned_result": "count(*) FILTER (pid IS NULL)",
    "several_results": "count(*) FILTER (c > 1)", "different_n": "count(*) FILTER (pn <> rn)",
    "different_network": "count(*) FILTER (pnet <> rnet AND c = 1)"}, "j"))
def plan_vs_result_completeness(spark, sf):
    plan = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "network", F.when(F.col("id") % 3 == 0, "NET_A").otherwise("NET_B"))
    changed = plan.filter("id % 10 <> 0").withColumn("network", F.when(
        (F.col("id") % 8 == 0) & (F.col("id") % 14 != 1), "NET_C").otherwise(F.col("network")))
    results = changed.unionByName(plan.filter("id % 14 = 1")).unionByName(
        plan.filter("id % 30 = 0").withColumn("id", F.col("id") + 1000000))
    return contracts.plan_result_mismatches(plan, results, "id", ["n", "network"])


@query("c9_feature_build_cross_check", f"""WITH {q_windows.RESTORE_SQL}
SELECT count(*) AS n_rows, count(*) FILTER (dep_hour_before = -1) AS dep_hour_original, count(*) FILTER (dep_hour = -1) AS dep_hour_residual, count(*) FILTER (arr_hour_before = -1) AS arr_hour_original,
 count(*) FILTER (arr_hour = -1) AS arr_hour_residual, count(*) FILTER (gap_was_missing) AS gap_original, TRUE AS agrees FROM restored""", V)
def feature_build_cross_check(spark, sf):
    raw = fx.flights(spark, sf)
    built = build_features(raw, PHASES["P6_clean"], keep=("flight_id",), codes=False)
    counts = built.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("dep_hour_originally_missing").alias("dep_hour_original"),
        report.count_if(F.col("dep_hour") < 0).alias("dep_hour_residual"), F.sum("arr_hour_originally_missing").alias("arr_hour_original"),
        report.count_if(F.col("arr_hour") < 0).alias("arr_hour_residual"), F.sum("local_gap_originally_missing").alias("gap_original"))
    told = audit.time_restore_accounting(raw)
    names = ["dep_hour_original", "dep_hour_residual", "arr_hour_original", "arr_hour_residual", "gap_original"]
    audited = told.select(F.array(*[F.col(n) for n in names]).alias("a")).scalar()
    return counts.withColumn("agrees", F.array(*[F.col(n) for n in names]) == audited)


@query("m19_weather_feature_contract", """SELECT rule, CASE rule WHEN 'origin_age_out_of_range' THEN (SELECT count(*) FROM events WHERE event_id % 6 <> 0 AND event_id % 91 > 88) WHEN 'destination_age_out_of_range' THEN (SELECT count(*) FROM events WHERE event_id % 4 <> 0 AND event_id % 91 > 88) ELSE 0 END AS violations
 FROM (SELECT unnest(['null_id', 'repeated_id', 'origin_age_without_match', 'origin_age_out_of_range', 'origin_nonfinite', 'destination_age_without_match', 'destination_age_out_of_range', 'destination_nonfinite']) AS rule)""")
def weather_feature_contract(spark, sf):
    return contracts.weather_feature_violations(weather_rows(spark, sf), ["origin", "destination"], ["tmpf", "sknt", "vsby", "p01i"],
                                                identifier="event_id", max_age_minutes=88)
