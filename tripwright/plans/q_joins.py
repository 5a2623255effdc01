"""Joins, matching and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.functions import clock
from tripwright.operators import asof, clean, compare, intervals, matching
from tripwright.plans.registry import query

KEYS = ["mo", "tail", "origin", "carrier_code", "dep_block", "arr_block"]
STABLE = KEYS[:3]
VOLATILE = KEYS[3:]
YEARS = fx.SCHEDULE_YEARS
_AGE = "(epoch_us(prediction_at) - epoch_us(observed_at))"
_ALL_KNOWN = " AND ".join(f"{k} IS NOT NULL" for k in VOLATILE)


# ---- as-of family -----------------------------------------------------------

@query("j1_asof_join", f"""WITH reqs AS (
 SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN station END AS station, prediction_at FROM requests),
found AS (SELECT event_id, r.station, prediction_at, observed_at, available_at, value
 FROM reqs r ASOF LEFT JOIN reports p ON r.station = p.station AND r.prediction_at >= p.available_at)
SELECT event_id, station, prediction_at, CASE WHEN {_AGE} <= 5400000000 THEN observed_at END AS observed_at,
 CASE WHEN {_AGE} <= 5400000000 THEN available_at END AS available_at,
 CASE WHEN {_AGE} <= 5400000000 THEN value END AS value,
 CASE WHEN {_AGE} <= 5400000000 THEN round({_AGE} / 60e6, 6) END AS weather_age_minutes FROM found""",
       ("requests", "reports"))
def asof_join(spark, sf):
    keyed = fx.requests(spark, sf).withColumn("station", F.when(F.col("event_id") % 10 != 0, F.col("station")))
    return (asof.asof_join(keyed, fx.reports(spark, sf))
            .withColumn("weather_age_minutes", F.round("weather_age_minutes", 6)))


_VARIED = """varied AS (SELECT user_id % 4 AS station, ts AS observed_at,
 ts + to_minutes(CAST(event_id % 4 * 35 AS BIGINT)) AS available_at, value FROM events WHERE event_type = 'view')"""


@query("j1_asof_join_varied_delay", f"""WITH {_VARIED},
found AS (SELECT event_id, prediction_at, observed_at, value FROM requests r
 ASOF LEFT JOIN varied p ON r.station = p.station AND r.prediction_at >= p.available_at)
SELECT event_id, CASE WHEN {_AGE} <= 5400000000 THEN observed_at END AS observed_at,
 CASE WHEN {_AGE} <= 5400000000 THEN value END AS value FROM found""", ("requests",))
def asof_join_varied_delay(spark, sf):
    varied = fx.table(spark, sf, "events").filter("event_type = 'view'").select(
        (F.col("user_id") % 4).alias("station"), F.col("ts").alias("observed_at"),
        (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 4 * 35).cast("int"))).alias("available_at"),
        "value")
    return asof.asof_join(fx.requests(spark, sf), varied).select("event_id", "observed_at", "value")


_SWEEP = f"""delayed AS (SELECT station, observed_at, value, latency, observed_at + to_minutes(CAST(latency AS BIGINT)) AS available_at
 FROM reports CROSS JOIN latencies),
asked AS (SELECT event_id, station, prediction_at, latency FROM requests CROSS JOIN latencies),
found AS (SELECT event_id, a.station, prediction_at, a.latency, observed_at, value FROM asked a ASOF LEFT JOIN delayed d
 ON a.station = d.station AND a.latency = d.latency AND a.prediction_at >= d.available_at),
swept AS (SELECT event_id, station, prediction_at, latency, CASE WHEN {_AGE} <= 5400000000 THEN observed_at END AS observed_at,
 CASE WHEN {_AGE} <= 5400000000 THEN value END AS value FROM found),
latest AS (SELECT event_id, observed_at AS latest_observed_at FROM requests r ASOF LEFT JOIN
 (SELECT station, observed_at FROM reports) p ON r.station = p.station AND r.prediction_at >= p.observed_at)"""


def _reports(spark, sf):
    return fx.reports(spark, sf).drop("available_at")


@query("j2_latency_sweep_asof", f"""WITH {_SWEEP}
SELECT event_id, latency, observed_at, value FROM swept""", ("requests", "reports", "latencies"))
def latency_sweep(spark, sf):
    return asof.latency_sweep(fx.requests(spark, sf), _reports(spark, sf)).select(
        "event_id", "latency", "observed_at", "value")


@query("j3_latest_report_lookup", f"""WITH {_SWEEP}
SELECT event_id, latest_observed_at FROM latest""", ("requests", "reports", "latencies"))
def latest_report_lookup(spark, sf):
    return asof.latest_report(fx.requests(spark, sf), _reports(spark, sf)).select("event_id", "latest_observed_at")


def swept_with_latest(spark, sf):
    """Requests by latency, with the bounded match, the unbounded latest report and eligibility."""
    latest = asof.latest_report(fx.requests(spark, sf), _reports(spark, sf))
    swept = asof.latency_sweep(latest, _reports(spark, sf))
    return swept.withColumn("eligible", F.col("station") != 3)


_CASES = f"""WITH {_SWEEP},
cases AS (SELECT s.event_id, s.station, s.latency, s.observed_at IS NOT NULL AS matched, s.station <> 3 AS eligible,
 epoch_us(prediction_at) - epoch_us(latest_observed_at) AS latest_age, latest_observed_at,
 CAST(hour(prediction_at) AS INT) = 5 AS failed FROM swept s JOIN latest USING (event_id))
"""


@query("j4_unmatched_reason", _CASES + """
SELECT event_id, latency, CASE WHEN NOT eligible THEN 'not_mapping_eligible' WHEN matched THEN 'matched'
 WHEN latest_observed_at IS NULL THEN 'no_report_before_prediction_in_collected_windows'
 WHEN latest_age > 5400000000 THEN 'stale_beyond_90_minutes'
 ELSE 'not_yet_available_under_latency_assumption' END AS reason FROM cases""", ("requests", "reports", "latencies"))
def unmatched_reason(spark, sf):
    reason = asof.unmatched_reason(F.col("observed_at").isNotNull(), F.col("eligible"), F.col("prediction_at"),
                                   F.col("latest_observed_at"))
    return swept_with_latest(spark, sf).select("event_id", "latency", reason.alias("reason"))


@query("j4_collection_reason", _CASES + """
SELECT event_id, latency, CASE WHEN NOT eligible THEN 'not_collectible_mapping' WHEN matched THEN 'matched'
 WHEN failed THEN 'collection_failed_or_not_attempted'
 WHEN latest_observed_at IS NULL THEN 'no_report_observed_before_prediction_time'
 WHEN latest_age < CAST(latency AS BIGINT) * 60000000 THEN 'not_yet_available_under_latency_assumption'
 WHEN latest_age > 5400000000 THEN 'stale_beyond_max_age'
 ELSE 'unexpected_unmatched_despite_available_report' END AS reason FROM cases""", ("requests", "reports", "latencies"))
def collection_reason(spark, sf):
    reason = asof.collection_reason(F.col("observed_at").isNotNull(), F.col("eligible"), F.col("prediction_at"),
                                    F.col("latest_observed_at"), F.hour("prediction_at") == 5, F.col("latency"))
    return swept_with_latest(spark, sf).select("event_id", "latency", reason.alias("reason"))


# ---- schedule matching ------------------------------------------------------

_COUNTS = ", ".join(f"count(*) FILTER (yr = {y}) AS n_{y}" for y in YEARS)
_MATCHED = f"""counts AS (SELECT {", ".join(KEYS)}, {_COUNTS} FROM schedule WHERE {_ALL_KNOWN} GROUP BY {", ".join(KEYS)}),
matched AS (SELECT t.*, {", ".join(f"coalesce(n_{y}, 0) AS n_{y}" for y in YEARS)} FROM trips t LEFT JOIN counts USING ({", ".join(KEYS)}))"""
_VIEWS = ("flights", "trips", "schedule")


@query("j5_fingerprint_match_counts", f"""WITH {_MATCHED}
SELECT flight_id, {", ".join(f"n_{y}" for y in YEARS)} FROM matched""", _VIEWS)
def fingerprint_match_counts(spark, sf):
    return matching.match_counts_by_year(fx.trips(spark, sf), fx.schedule(spark, sf), KEYS, YEARS).select(
        "flight_id", *[f"n_{y}" for y in YEARS])


_PARTIAL = f"""partial AS (SELECT t.flight_id, {", ".join(
    f"count(*) FILTER (s.yr = {y}) AS n_{y}, count(DISTINCT s.airline) FILTER (s.yr = {y}) AS numbers_{y}" for y in YEARS)}
 FROM trips t LEFT JOIN schedule s ON {" AND ".join(f"t.{k} = s.{k}" for k in STABLE)}
 AND {" AND ".join(f"(t.{k} IS NULL OR t.{k} = s.{k})" for k in VOLATILE)}
 WHERE NOT ({" AND ".join(f"t.{k} IS NOT NULL" for k in VOLATILE)}) GROUP BY t.flight_id)"""


@query("j6_partial_key_match", f"""WITH {_PARTIAL}
SELECT flight_id, n_{YEARS[0]}, n_{YEARS[1]}, numbers_{YEARS[0]}, numbers_{YEARS[1]}, n_{YEARS[0]} + n_{YEARS[1]} AS candidates_total,
 CAST(n_{YEARS[0]} > 0 AS INT) + CAST(n_{YEARS[1]} > 0 AS INT) AS candidate_years FROM partial""", _VIEWS)
def partial_key_match(spark, sf):
    incomplete = clean.incomplete_rows(fx.trips(spark, sf), VOLATILE).select("flight_id", *KEYS)
    return matching.partial_key_match(incomplete, fx.schedule(spark, sf), KEYS, VOLATILE, YEARS,
                                      number="airline").drop(*KEYS)


# The declared ladder of key subsets, from the full fingerprint to single keys.
_ALL_KEYS = ["mo", "dom", "tail", "origin", "distance", "carrier_code", "dep_block", "arr_block"]
LADDER = {
    "L0_full": _ALL_KEYS,
    "L1_drop_distance": [k for k in _ALL_KEYS if k != "distance"],
    "L2_drop_carrier": [k for k in _ALL_KEYS if k != "carrier_code"],
    "L3_drop_distance_carrier": [k for k in _ALL_KEYS if k not in ("distance", "carrier_code")],
    "L4_drop_arrival_time": [k for k in _ALL_KEYS if k != "arr_block"],
    "L5_drop_both_times": [k for k in _ALL_KEYS if k not in ("dep_block", "arr_block")],
    "L6_day_tail_origin": ["mo", "dom", "tail", "origin"],
    "L7_day_tail": ["mo", "dom", "tail"],
    "L8_tail_only": ["tail"],
    "L9_day_origin_times": ["mo", "dom", "origin", "dep_block", "arr_block"],
    "L10_day_origin_dep": ["mo", "dom", "origin", "dep_block"],
    "L11_day_origin": ["mo", "dom", "origin"],
    "L12_tail_origin_times_any_day": ["mo", "tail", "origin", "dep_block", "arr_block"],
    "L13_carrier_only": ["carrier_code"],
}


def _ladder_sql() -> str:
    parts = []
    for level, keys in LADDER.items():
        known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        for y in YEARS:
            parts.append(f"""SELECT '{level}' AS level, {y} AS year, count(*) AS rows_with_keys,
 count(*) FILTER (EXISTS (SELECT 1 FROM schedule s WHERE s.yr = {y} AND {" AND ".join(f"s.{k} = t.{k}" for k in keys)})) AS candidate_rows
 FROM trips t WHERE {known}""")
    return ("SELECT level, CAST(year AS INT) AS year, rows_with_keys, candidate_rows,"
            " round(candidate_rows / rows_with_keys, 9) AS candidate_rate FROM ("
            + "\nUNION ALL ".join(parts) + ")")


@query("j7_relaxed_key_ladder", _ladder_sql(), _VIEWS)
def relaxed_key_ladder(spark, sf):
    return (matching.key_ladder(fx.trips(spark, sf), fx.schedule(spark, sf), LADDER, YEARS)
            .withColumn("candidate_rate", F.round("candidate_rate", 9)))


@query("j8_nearest_candidate_diff", """
WITH sched AS (SELECT mo, tail, origin, dep_hhmm, min(distance) AS distance FROM schedule WHERE dep_hhmm IS NOT NULL GROUP BY ALL),
ranked AS (SELECT t.flight_id, s.dep_hhmm - t.dep_hhmm AS dep_hhmm_delta, s.distance AS distance_candidate,
 row_number() OVER (PARTITION BY t.flight_id ORDER BY abs(s.dep_hhmm - t.dep_hhmm), s.dep_hhmm) AS rn
 FROM trips t JOIN sched s USING (mo, tail, origin) WHERE t.dep_hhmm IS NOT NULL)
SELECT flight_id, dep_hhmm_delta, distance_candidate FROM ranked WHERE rn = 1""", _VIEWS)
def nearest_candidate_diff(spark, sf):
    return matching.nearest_candidate(fx.trips(spark, sf), fx.schedule(spark, sf), STABLE, "dep_hhmm",
                                      ["distance"]).select("flight_id", "dep_hhmm_delta", "distance_candidate")


@query("j9_broadcast_lookup", """
SELECT c_custkey, n_name, r_name, n_nationkey IS NULL AS nation_missing FROM customer
 LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 6 <> 5 LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_join(spark, sf):
    nations = fx.table(spark, sf, "nation").filter("n_nationkey % 6 <> 5")
    dim = nations.join(fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    dim = matching.unique_by(dim.select("n_nationkey", "n_name", "r_name"), "n_nationkey")
    return (fx.table(spark, sf, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select("c_custkey", "n_name", "r_name", F.col("n_nationkey").isNull().alias("nation_missing")))


@query("j10_hourly_equi_left_join", """
WITH hourly AS (SELECT CAST(dest AS INT) AS origin, mo, dom, CAST(arr_hhmm // 100 AS INT) AS hour, count(*) AS n_reports, max(distance) AS wspd
 FROM flights WHERE arr_hhmm IS NOT NULL GROUP BY ALL)
SELECT f.flight_id, n_reports, wspd FROM flights f LEFT JOIN hourly h ON f.origin = h.origin AND f.mo = h.mo AND f.dom = h.dom
 AND coalesce(f.dep_hhmm // 100, -1) = h.hour""", ("flights",))
def hourly_equi_left_join(spark, sf):
    rows = clean.time_features(fx.flights(spark, sf))
    hourly = (rows.filter("arr_hour >= 0").groupBy(F.col("dest").cast("int").alias("origin"), "mo", "dom",
                                                  F.col("arr_hour").alias("dep_hour"))
              .agg(F.count(F.lit(1)).alias("n_reports"), F.max("distance").alias("wspd")))
    return rows.join(hourly, ["origin", "mo", "dom", "dep_hour"], "left").select("flight_id", "n_reports", "wspd")


@query("j11_align_by_id", """
SELECT flight_id, row_number() OVER (ORDER BY flight_id DESC) AS ordinal, distance FROM flights WHERE delay IS NOT NULL""",
       ("flights",))
def align_by_id(spark, sf):
    from tripwright.operators.skew import row_positions

    ids = fx.flights(spark, sf).filter("delay IS NOT NULL").select("flight_id")
    ids = row_positions(ids, [], [F.col("flight_id").desc()], "ordinal").select("flight_id", "ordinal")
    return matching.align_by_id(fx.flights(spark, sf).select("flight_id", "distance"), ids, "flight_id")


@query("j12_attach_features_by_split", """
SELECT flight_id, delay IS NOT NULL AS labeled, CASE WHEN flight_id % 5 <> 0 THEN o_totalprice END AS feature
FROM flights LEFT JOIN orders ON flight_id = o_orderkey""", ("flights",))
def attach_features_by_split(spark, sf):
    features = fx.table(spark, sf, "orders").filter("o_orderkey % 5 <> 0").select(
        F.col("o_orderkey").alias("flight_id"), F.col("o_totalprice").alias("feature"))
    attached = matching.attach_features(fx.flights(spark, sf), features, "flight_id")
    labeled, unlabeled = clean.split_labeled(attached)
    return (labeled.select("flight_id", F.lit(True).alias("labeled"), "feature")
            .unionByName(unlabeled.select("flight_id", F.lit(False).alias("labeled"), "feature")))


_TIE_FIELDS = ["airline", "distance"]


@query("j13_tie_break_compare", f"""
WITH cand AS (SELECT {", ".join(KEYS)}, min(struct_pack(airline := airline, distance := distance)) FILTER (yr = {YEARS[0]}) AS c1,
 min(struct_pack(airline := airline, distance := distance)) FILTER (yr = {YEARS[1]}) AS c2
 FROM (SELECT *, coalesce(airline, '') AS a0 FROM schedule WHERE {_ALL_KNOWN} AND airline IS NOT NULL) GROUP BY {", ".join(KEYS)}),
both_years AS (SELECT t.airline, t.distance, c1, c2 FROM trips t JOIN cand USING ({", ".join(KEYS)}) WHERE c1 IS NOT NULL AND c2 IS NOT NULL)
SELECT 'airline' AS field, count(*) AS rows, count(*) FILTER (c1.airline IS DISTINCT FROM c2.airline) AS differs_between_years,
 count(*) FILTER (c1.airline IS NOT DISTINCT FROM airline) AS matches_source_first, count(*) FILTER (c2.airline IS NOT DISTINCT FROM airline) AS matches_source_second FROM both_years
UNION ALL SELECT 'distance', count(*), count(*) FILTER (c1.distance IS DISTINCT FROM c2.distance),
 count(*) FILTER (c1.distance IS NOT DISTINCT FROM distance), count(*) FILTER (c2.distance IS NOT DISTINCT FROM distance) FROM both_years""", _VIEWS)
def tie_break_compare(spark, sf):
    known = fx.schedule(spark, sf).filter("airline IS NOT NULL")
    return matching.tie_break_compare(fx.trips(spark, sf), known, KEYS, _TIE_FIELDS, YEARS)


@query("j14_semi_and_anti_filter", """
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_finished FROM customer""")
def semi_and_anti_filter(spark, sf):
    finished = fx.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    customers = fx.table(spark, sf, "customer").select("c_custkey")
    return (customers.join(finished, "c_custkey", "left_semi").withColumn("has_finished", F.lit(True))
            .unionByName(customers.join(finished, "c_custkey", "left_anti").withColumn("has_finished", F.lit(False))))


_NETWORK = "CASE WHEN station < 2 THEN 'NET_A' ELSE 'NET_B' END"
_DEMAND = f"""demand AS (SELECT DISTINCT station, {_NETWORK} AS network, unnest([strftime(prediction_at, '%Y-%m-%d'),
 strftime(prediction_at - INTERVAL 90 MINUTE, '%Y-%m-%d')]) AS month FROM requests)"""


@query("j15_demand_coverage_check", f"""WITH demand AS (SELECT DISTINCT station, {_NETWORK} AS network,
 unnest([strftime(prediction_at, '%Y-%m'), strftime(prediction_at - INTERVAL 90 MINUTE, '%Y-%m')]) AS month FROM requests),
covered AS (SELECT DISTINCT station, strftime(observed_at, '%Y-%m') AS month, CASE WHEN station = 1 THEN 'NET_B' WHEN station < 2 THEN 'NET_A' ELSE 'NET_B' END AS network FROM reports)
SELECT station, network, month FROM demand d WHERE NOT EXISTS (SELECT 1 FROM covered c
 WHERE c.station = d.station AND c.month = d.month AND c.network = d.network)""", ("requests", "reports"))
def demand_coverage_check(spark, sf):
    demand = intervals.month_demand(fx.requests(spark, sf).withColumn("network", F.expr(_NETWORK)),
                                    "station", "prediction_at", 90, "network")
    covered = fx.reports(spark, sf).select(
        "station", clock.month_key(F.col("observed_at")).alias("month"),
        F.expr(f"CASE WHEN station = 1 THEN 'NET_B' ELSE {_NETWORK} END").alias("network")).distinct()
    return demand.join(covered, ["station", "network", "month"], "left_anti")


@query("j16_prediction_to_source_join", """
SELECT o.seed, count(*) AS rows, count(f.flight_id) AS found,
 count(*) FILTER (o.y_true <> CASE WHEN f.delay = 'Delayed' THEN 1 ELSE 0 END) AS label_mismatches
FROM oof o LEFT JOIN flights f USING (flight_id) GROUP BY o.seed""", ("flights", "oof"))
def prediction_to_source_join(spark, sf):
    source = fx.flights(spark, sf).select("flight_id", (F.col("delay") == "Delayed").cast("int").alias("source_y"))
    joined = fx.oof(spark, sf).join(source, "flight_id", "left")
    return joined.groupBy("seed").agg(
        F.count(F.lit(1)).alias("rows"), F.count("source_y").alias("found"),
        F.count(F.when(F.col("y_true") != F.col("source_y"), 1)).alias("label_mismatches"))


_CODE_KEYS = ["mo", "tail", "origin", "dep_block"]


@query("j17_set_membership_join", "\nUNION ALL ".join(f"""
SELECT {y} AS year, count(*) AS matched_rows, count(carrier_code) AS rows_with_code,
 count(*) FILTER (EXISTS (SELECT 1 FROM schedule s WHERE s.yr = {y} AND s.mo = t.mo AND s.tail = t.tail AND s.origin = t.origin
  AND s.dep_block = t.dep_block AND s.carrier_code = t.carrier_code)) AS code_agrees,
 round(count(*) FILTER (EXISTS (SELECT 1 FROM schedule s WHERE s.yr = {y} AND s.mo = t.mo AND s.tail = t.tail AND s.origin = t.origin
  AND s.dep_block = t.dep_block AND s.carrier_code = t.carrier_code)) / count(carrier_code), 9) AS agreement_rate
FROM trips t WHERE EXISTS (SELECT 1 FROM schedule s WHERE s.yr = {y} AND s.mo = t.mo AND s.tail = t.tail AND s.origin = t.origin AND s.dep_block = t.dep_block)"""
    for y in YEARS), _VIEWS)
def set_membership_join(spark, sf):
    return (matching.membership_agreement(fx.trips(spark, sf), fx.schedule(spark, sf), _CODE_KEYS,
                                          "carrier_code", YEARS)
            .withColumn("agreement_rate", F.round("agreement_rate", 9)))


_NEW_SQL = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 70 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1e-7::DOUBLE ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 90 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority,
 CASE WHEN o_orderkey % 110 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate,
 CASE WHEN o_orderkey % 40 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders"""
_KINDS = {"o_custkey": "numeric", "o_totalprice": "numeric", "o_orderpriority": "string",
          "o_orderdate": "datetime", "o_orderstatus": "string"}


@query("j19_typed_table_diff", f"""WITH new AS ({_NEW_SQL}),
pairs AS (SELECT o.*, n.o_totalprice AS n_price, n.o_orderpriority AS n_prio, n.o_orderdate AS n_date, n.o_orderstatus AS n_status
 FROM orders o JOIN new n USING (o_orderkey))
SELECT 'o_custkey' AS "column", 'numeric' AS kind, CAST(0 AS BIGINT) AS meaning_mismatch, CAST(0 AS BIGINT) AS approved_change, CAST(0 AS BIGINT) AS unexpected
UNION ALL SELECT 'o_totalprice', 'numeric', count(*) FILTER (abs(o_totalprice - n_price) > 1e-6), 0, count(*) FILTER (abs(o_totalprice - n_price) > 1e-6) FROM pairs
UNION ALL SELECT 'o_orderpriority', 'string', count(*) FILTER (o_orderpriority <> n_prio), 0, count(*) FILTER (o_orderpriority <> n_prio) FROM pairs
UNION ALL SELECT 'o_orderdate', 'datetime', count(*) FILTER (o_orderdate <> n_date), 0, count(*) FILTER (o_orderdate <> n_date) FROM pairs
UNION ALL SELECT 'o_orderstatus', 'string', count(*) FILTER (o_orderstatus IS DISTINCT FROM n_status),
 count(*) FILTER (o_orderstatus IS DISTINCT FROM n_status AND o_orderstatus = 'F'), count(*) FILTER (o_orderstatus IS DISTINCT FROM n_status AND o_orderstatus <> 'F') FROM pairs""")
def typed_table_diff(spark, sf):
    old = fx.table(spark, sf, "orders")
    new = old.selectExpr(
        "o_orderkey", "o_custkey",
        "CASE WHEN o_orderkey % 70 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1e-7D ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 90 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority",
        "CASE WHEN o_orderkey % 110 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate",
        "CASE WHEN o_orderkey % 40 <> 0 THEN o_orderstatus END AS o_orderstatus")
    approved = {"o_orderstatus": (F.col("l_v_o_orderstatus") == "F") & F.col("r_v_o_orderstatus").isNull()}
    return compare.typed_diff(old, new, "o_orderkey", _KINDS, approved=approved).select(
        "column", "kind", "meaning_mismatch", "approved_change", "unexpected")


_SINGLE = f"""truth AS (SELECT *, CASE WHEN n_{YEARS[0]} > 0 THEN {YEARS[0]} ELSE {YEARS[1]} END AS attributed_year FROM matched
 WHERE {_ALL_KNOWN} AND CAST(n_{YEARS[0]} > 0 AS INT) + CAST(n_{YEARS[1]} > 0 AS INT) = 1)"""


def _masking_sql() -> str:
    parts = []
    for keys in matching.volatile_subsets(KEYS, VOLATILE):
        hidden = "+".join(k for k in VOLATILE if k not in keys)
        a, b = YEARS
        parts.append(f"""SELECT '{hidden}' AS masked_keys, count(*) AS n_rows_tested,
 count(*) FILTER (CAST(a > 0 AS INT) + CAST(b > 0 AS INT) = 1 AND CASE WHEN a > 0 THEN {a} ELSE {b} END = attributed_year) AS single_correct,
 count(*) FILTER (CAST(a > 0 AS INT) + CAST(b > 0 AS INT) = 1 AND CASE WHEN a > 0 THEN {a} ELSE {b} END <> attributed_year) AS single_wrong,
 count(*) FILTER (a > 0 AND b > 0) AS multi_year, count(*) FILTER (a = 0 AND b = 0) AS no_candidate
 FROM (SELECT t.attributed_year, coalesce(c.a, 0) AS a, coalesce(c.b, 0) AS b FROM truth t LEFT JOIN
  (SELECT {", ".join(keys)}, count(*) FILTER (yr = {a}) AS a, count(*) FILTER (yr = {b}) AS b FROM schedule GROUP BY {", ".join(keys)}) c
  USING ({", ".join(keys)}))""")
    return f"WITH {_MATCHED}, {_SINGLE}\n" + "\nUNION ALL ".join(parts)


@query("j21_key_masking_diagnostic", _masking_sql(), _VIEWS)
def key_masking_diagnostic(spark, sf):
    schedule = fx.schedule(spark, sf)
    rows = clean.complete_rows(fx.trips(spark, sf), KEYS)
    truth = matching.classify_complete(matching.match_counts_by_year(rows, schedule, KEYS, YEARS), YEARS)
    return matching.masking_diagnostic(truth.filter(F.col("attributed_year").isNotNull()), schedule, KEYS,
                                       VOLATILE, YEARS)


@query("j22_station_hour_grid", """
WITH b AS (SELECT date_trunc('hour', min(ts))::TIMESTAMP AS lo, date_trunc('hour', max(ts))::TIMESTAMP AS hi FROM events)
SELECT station, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS prediction_at FROM (SELECT DISTINCT user_id % 4 AS station FROM events), b""")
def station_hour_grid(spark, sf):
    events = fx.table(spark, sf, "events")
    hour = F.col("ts").cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts"))
    bounds = events.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi"))
    grid = F.sequence(bounds.select("lo").scalar(), bounds.select("hi").scalar(), F.expr("INTERVAL 1 HOUR"))
    return events.select((F.col("user_id") % 4).alias("station")).distinct().select(
        "station", F.explode(grid).alias("prediction_at"))


@query("j23_expected_record_check", """
WITH rec AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN 'PLAT' || CAST(s_nationkey % 5 AS VARCHAR) END AS plat,
 'ID' || CAST(s_suppkey % 3 AS VARCHAR) AS ident FROM supplier)
SELECT s_suppkey, 'missing_platform' AS problem, 'PLAT' || CAST(s_suppkey % 5 AS VARCHAR) AS member FROM rec
 WHERE coalesce(plat, '') <> 'PLAT' || CAST(s_suppkey % 5 AS VARCHAR) AND 'PLAT' || CAST(s_suppkey % 5 AS VARCHAR) <> 'BASE'
UNION ALL SELECT s_suppkey, 'forbidden_platform', 'PLAT4' FROM rec WHERE plat = 'PLAT4'
UNION ALL SELECT s_suppkey, 'missing_identifier', 'ID0' FROM rec WHERE ident <> 'ID0'""")
def expected_record_check(spark, sf):
    from tripwright.sources import nested

    records = fx.table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS station_id",
        "array(named_struct('platform', 'BASE'), named_struct('platform',"
        " CASE WHEN s_suppkey % 7 <> 0 THEN 'PLAT' || CAST(s_nationkey % 5 AS STRING) END)) AS platforms",
        "array(named_struct('id', 'ID' || CAST(s_suppkey % 3 AS STRING))) AS identifiers")
    expected = records.select(
        "station_id", F.inline(F.array(
            F.struct(F.lit("require_platform").alias("rule"),
                     F.concat(F.lit("PLAT"), (F.col("station_id") % 5).cast("string")).alias("member")),
            F.struct(F.lit("forbid_platform").alias("rule"), F.lit("PLAT4").alias("member")),
            F.struct(F.lit("require_identifier").alias("rule"), F.lit("ID0").alias("member")))))
    return nested.expected_record_failures(records, expected).withColumnRenamed("station_id", "s_suppkey")


def _in_checked_months(sql: str) -> str:
    return sql.replace("FROM schedule", "FROM checked_schedule").replace("JOIN schedule", "JOIN checked_schedule")


@query("a42_year_attribution", f"""WITH {_in_checked_months(_MATCHED)}, {_in_checked_months(_PARTIAL)},
hits AS (SELECT *, CAST(n_{YEARS[0]} > 0 AS INT) + CAST(n_{YEARS[1]} > 0 AS INT) AS years FROM matched)
SELECT flight_id, CASE years WHEN 0 THEN 'complete_checked_no_candidate' WHEN 1 THEN 'complete_single_candidate_year' ELSE 'complete_multi_candidate_year' END AS status,
 years AS candidate_years, CAST(CASE WHEN years = 1 THEN CASE WHEN n_{YEARS[0]} > 0 THEN {YEARS[0]} ELSE {YEARS[1]} END END AS INT) AS attributed_year
 FROM hits WHERE {_ALL_KNOWN} AND mo <= {fx.SCHEDULE_MONTHS}
UNION ALL SELECT flight_id, CASE n_{YEARS[0]} + n_{YEARS[1]} WHEN 0 THEN 'missing_key_checked_no_candidate' WHEN 1 THEN 'missing_key_single_candidate_year'
  ELSE 'missing_key_multi_candidate_year' END, CAST(n_{YEARS[0]} > 0 AS INT) + CAST(n_{YEARS[1]} > 0 AS INT), NULL FROM partial JOIN trips USING (flight_id) WHERE mo <= {fx.SCHEDULE_MONTHS}
UNION ALL SELECT flight_id, 'not_checked_month_unavailable', NULL, NULL FROM trips WHERE mo > {fx.SCHEDULE_MONTHS}""", (*_VIEWS, "checked_schedule"))
def year_attribution(spark, sf):
    return matching.year_attribution(fx.trips(spark, sf), fx.checked_schedule(spark, sf), KEYS, VOLATILE, YEARS,
                                     number="airline")


# ---- set operations ---------------------------------------------------------

@query("u1_union_all", """
SELECT 'customer' AS role, c_custkey AS key, c_nationkey AS nation FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier""")
def union_all(spark, sf):
    customers = fx.table(spark, sf, "customer").selectExpr("'customer' AS role", "c_custkey AS key", "c_nationkey AS nation")
    suppliers = fx.table(spark, sf, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS key", "'supplier' AS role")
    return customers.unionByName(suppliers)


_DOUBLED = """raw AS (SELECT station, observed_at, value FROM reports UNION ALL
 SELECT station, observed_at, CASE WHEN value > 200 THEN value + 1 ELSE value END FROM reports WHERE value > 50)"""


@query("u2_distinct_dedup_conflict", f"""WITH {_DOUBLED}
SELECT station, observed_at, count(*) AS n_reports, count(DISTINCT value) AS n_versions, count(DISTINCT value) > 1 AS conflict
FROM raw GROUP BY station, observed_at""", ("reports",))
def distinct_dedup_conflict(spark, sf):
    base = _reports(spark, sf)
    again = base.filter("value > 50").withColumn("value", F.expr("CASE WHEN value > 200 THEN value + 1 ELSE value END"))
    found = asof.deduplicate_reports(base.unionByName(again))
    return found.select("station", "observed_at", "n_reports", "n_versions", (F.col("n_versions") > 1).alias("conflict"))


@query("u3_intersect_except", """
WITH l AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS s FROM customer WHERE c_acctbal > 5000),
r AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS s FROM customer WHERE c_acctbal < 0)
SELECT (SELECT count(*) FROM (SELECT * FROM l INTERSECT SELECT * FROM r)) AS shared,
 (SELECT count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM r)) AS only_left,
 (SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM l)) AS only_right""")
def intersect_except(spark, sf):
    customers = fx.table(spark, sf, "customer")
    return compare.set_difference_counts(customers.filter("c_acctbal > 5000"), customers.filter("c_acctbal < 0"),
                                         ["c_nationkey", "c_mktsegment"])


@query("u4_set_equality_check", """
WITH a AS (SELECT flight_id AS id, count(*) AS n FROM oof WHERE seed = 42 GROUP BY 1),
b AS (SELECT flight_id AS id, count(*) AS n FROM flights WHERE delay IS NOT NULL GROUP BY 1),
j AS (SELECT a.n AS n_old, b.n AS n_new FROM a FULL JOIN b USING (id))
SELECT CAST(sum(coalesce(n_old, 0)) AS BIGINT) AS rows_old, CAST(sum(coalesce(n_new, 0)) AS BIGINT) AS rows_new, count(*) FILTER (n_old > 1) AS repeated_old,
 count(*) FILTER (n_new > 1) AS repeated_new, count(*) FILTER (n_new IS NULL) AS only_old, count(*) FILTER (n_old IS NULL) AS only_new,
 count(*) FILTER (coalesce(n_old, 0) <> 1 OR coalesce(n_new, 0) <> 1) = 0 AS equal_sets FROM j""", ("flights", "oof"))
def set_equality_check(spark, sf):
    return compare.set_equality(fx.oof(spark, sf).filter("seed = 42"),
                                fx.flights(spark, sf).filter("delay IS NOT NULL"), "flight_id")
