"""Projections, filters and predicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.functions import text
from tripwright.operators import clean
from tripwright.plans.registry import query
from tripwright.schemas import TIERS

KEYS = ["mo", "dom", "tail", "origin", "dest", "distance", "carrier_code", "dep_hhmm", "arr_hhmm"]
_TIER_SQL = "CASE {c} % 6 WHEN 0 THEN '{1}' WHEN 1 THEN '{2}' WHEN 2 THEN '{3}' ELSE '{0}' END"


def tier_sql(column: str) -> str:
    return _TIER_SQL.format(*TIERS, c=column)


@query("p1_prune_columns", """
SELECT yr, mo, dep_hhmm, arr_hhmm, origin, dest, airline, distance, delay FROM flights""", ("flights",))
def prune_columns(spark, sf):
    return clean.prune_columns(fx.flights(spark, sf), "pruned", extra=("tail",))


@query("p2_split_labeled", """
SELECT flight_id, TRUE AS labeled, CASE WHEN delay = 'Delayed' THEN 1 ELSE 0 END AS y FROM flights
 WHERE delay IS NOT NULL
UNION ALL SELECT flight_id, FALSE, NULL FROM flights WHERE delay IS NULL""", ("flights",))
def split_labeled(spark, sf):
    # every second unlabeled row carries a blank text, which also means unlabeled
    blank = F.when(F.col("delay").isNull() & (F.col("flight_id") % 2 == 0), F.lit("  ")).otherwise(F.col("delay"))
    labeled, unlabeled = clean.split_labeled(fx.flights(spark, sf).withColumn("delay", blank))
    return (labeled.select("flight_id", F.lit(True).alias("labeled"), "y")
            .unionByName(unlabeled.select("flight_id", F.lit(False).alias("labeled"), F.lit(None).cast("int").alias("y"))))


@query("p3_normalize_keys", """
SELECT c_custkey, upper(trim(c_mktsegment)) AS segment, CAST(c_custkey % 97 AS BIGINT) AS carrier_id FROM customer""")
def normalize_keys(spark, sf):
    raw = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey", "'  ' || lower(c_mktsegment) || ' ' AS segment",
        "CAST(CAST(c_custkey % 97 AS DOUBLE) AS STRING) AS carrier_id")
    return clean.normalize_keys(raw, ["segment"], ["carrier_id"])


@query("p4_missing_flags", """
SELECT flight_id, CASE WHEN delay = 'Delayed' THEN 1 ELSE 0 END AS y_true, """ + ", ".join(
    f"CAST({c} IS NULL AS INT) AS raw_missing__{c}" for c in (
        "yr", "mo", "dom", "dep_hhmm", "arr_hhmm", "origin", "dest", "tail", "carrier_code", "airline", "distance"))
       + " FROM flights WHERE delay IS NOT NULL", ("flights",))
def missing_flags(spark, sf):
    return clean.missing_flags(fx.flights(spark, sf))


@query("p5_time_missing_pattern", """
SELECT flight_id, CASE WHEN dep_hhmm IS NOT NULL AND arr_hhmm IS NOT NULL THEN 'both_observed'
 WHEN dep_hhmm IS NULL AND arr_hhmm IS NOT NULL THEN 'departure_missing'
 WHEN dep_hhmm IS NOT NULL THEN 'arrival_missing' ELSE 'both_missing' END AS time_pattern FROM flights""", ("flights",))
def time_missing_pattern(spark, sf):
    return fx.flights(spark, sf).select("flight_id", text.time_pattern(
        F.col("dep_hhmm"), F.col("arr_hhmm")).alias("time_pattern"))


@query("p6_complete_incomplete_split", """
SELECT flight_id, dep_hhmm IS NOT NULL AND arr_hhmm IS NOT NULL AND carrier_code IS NOT NULL AS complete
FROM flights""", ("flights",))
def complete_incomplete_split(spark, sf):
    rows = fx.flights(spark, sf)
    return (clean.complete_rows(rows, KEYS).select("flight_id", F.lit(True).alias("complete"))
            .unionByName(clean.incomplete_rows(rows, KEYS).select("flight_id", F.lit(False).alias("complete"))))


@query("p7_observed_key_pattern", "SELECT flight_id, " + "concat_ws('+', " + ", ".join(
    f"CASE WHEN {k} IS NOT NULL THEN '{k}' END" for k in KEYS) + ") AS key_pattern, concat_ws('+', " + ", ".join(
    f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in KEYS) + ") AS missing_keys FROM flights", ("flights",))
def observed_key_pattern(spark, sf):
    return fx.flights(spark, sf).select("flight_id", text.key_pattern(KEYS).alias("key_pattern"),
                                        text.key_pattern(KEYS, present=False).alias("missing_keys"))


@query("p8_binary_label_flag", """
SELECT flight_id, CASE WHEN delay = 'Delayed' THEN 1 ELSE 0 END AS delayed FROM flights WHERE delay IS NOT NULL""",
       ("flights",))
def binary_label_flag(spark, sf):
    labeled = fx.flights(spark, sf).filter(text.is_labeled(F.col("delay")))
    return labeled.select("flight_id", text.checked_label(F.col("delay")).alias("delayed"))


@query("p9_explicit_missing_bucket", "SELECT flight_id, coalesce(airline, '(missing)') AS airline FROM flights",
       ("flights",))
def explicit_missing_bucket(spark, sf):
    return fx.flights(spark, sf).select("flight_id", text.category(F.col("airline")).alias("airline"))


@query("p10_forbidden_column_guard", """
SELECT flight_id, origin, dest, 'delay' AS found FROM flights""", ("flights",))
def forbidden_column_guard(spark, sf):
    rows = fx.flights(spark, sf)
    found = clean.forbidden_columns(rows)  # the guard names what it would refuse, and passes without it
    return clean.reject_forbidden_columns(rows.drop(*found)).select("flight_id", "origin", "dest", F.lit(",".join(found)).alias("found"))


@query("p11_worst_tier_eligibility", f"""WITH tiers AS (SELECT n_nationkey AS airport, {tier_sql('n_nationkey')} AS tier FROM nation),
ranked AS (SELECT airport, tier, CASE tier {" ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TIERS))} END AS rnk FROM tiers)
SELECT flight_id, CASE WHEN o.rnk >= d.rnk THEN o.tier ELSE d.tier END AS row_tier, o.rnk = 0 AND d.rnk = 0 AS eligible,
 CASE WHEN o.rnk = 0 AND d.rnk = 0 THEN '' ELSE 'origin=' || o.tier || ',destination=' || d.tier END AS ineligible_reason
FROM flights f JOIN ranked o ON f.origin = o.airport JOIN ranked d ON f.dest = d.airport""", ("flights",))
def worst_tier_eligibility(spark, sf):
    tiers = fx.table(spark, sf, "nation").selectExpr("n_nationkey AS airport", f"{tier_sql('n_nationkey')} AS tier")
    rows = (fx.flights(spark, sf)
            .join(tiers.selectExpr("airport AS origin", "tier AS origin_tier"), "origin", "left")
            .join(tiers.selectExpr("CAST(airport AS BIGINT) AS dest", "tier AS dest_tier"), "dest", "left"))
    return clean.worst_tier(rows, "origin_tier", "dest_tier").select(
        "flight_id", "row_tier", "eligible", "ineligible_reason")


@query("p12_role_prefix_projection", """
SELECT flight_id AS origin_flight_id, origin AS origin_origin, distance AS origin_distance FROM flights""", ("flights",))
def role_prefix_projection(spark, sf):
    return clean.prefixed(fx.flights(spark, sf).select("flight_id", "origin", "distance"), "origin_")


_LOG_SQL = """CASE WHEN regexp_matches(t, '\\b(http(/[0-9.]+)?\\s+|error:\\s*|status(\\s+code)?[:=]?\\s*)503\\b') THEN 'http_503'
 WHEN regexp_matches(t, '\\b(http(/[0-9.]+)?\\s+|error:\\s*|status(\\s+code)?[:=]?\\s*)429\\b') THEN 'http_429'
 WHEN regexp_matches(t, '\\b(http(/[0-9.]+)?\\s+|error:\\s*|status(\\s+code)?[:=]?\\s*)422\\b') THEN 'http_422'
 WHEN contains(t, 'interrupted mid-attempt') THEN 'interrupted_unknown'
 WHEN contains(t, 'timed out') OR contains(t, 'timeout') THEN 'timeout'
 WHEN contains(t, 'response exceeds bounded size') THEN 'response_size_cap'
 WHEN contains(t, 'response failed validation') THEN 'response_validation' ELSE 'other' END"""
_SUFFIX_SQL = """CASE doc_id % 9 WHEN 0 THEN ' HTTP/1.1 503' WHEN 1 THEN ' returned error: 429' WHEN 2 THEN ' status code=422'
 WHEN 3 THEN ' Timed Out' WHEN 4 THEN ' response exceeds bounded size' WHEN 5 THEN ' Interrupted mid-attempt'
 WHEN 6 THEN ' response failed validation' WHEN 7 THEN ' http 5031' ELSE '' END"""


@query("p13_text_log_classifier", f"""
SELECT doc_id, {_LOG_SQL} AS error_class FROM (SELECT doc_id, lower(text || {_SUFFIX_SQL}) AS t FROM documents)""")
def text_log_classifier(spark, sf):
    logs = fx.table(spark, sf, "documents").selectExpr("doc_id", f"text || {_SUFFIX_SQL} AS t")
    return logs.select("doc_id", text.first_rule(F.col("t"), text.ERROR_RULES, "other").alias("error_class"))


@query("p14_report_dims", """
SELECT flight_id, coalesce(airline, '(missing)') AS airline, coalesce(carrier_code, '(missing)') AS carrier_code,
 coalesce(dep_hhmm // 100, -1) AS dep_hour_order, coalesce(lpad(CAST(dep_hhmm // 100 AS VARCHAR), 2, '0'), 'missing') AS dep_hour_label,
 coalesce(arr_hhmm // 100, -1) AS arr_hour_order, coalesce(lpad(CAST(arr_hhmm // 100 AS VARCHAR), 2, '0'), 'missing') AS arr_hour_label,
 CASE WHEN dep_hhmm IS NOT NULL AND arr_hhmm IS NOT NULL THEN 'both_observed' WHEN arr_hhmm IS NOT NULL THEN 'departure_missing'
  WHEN dep_hhmm IS NOT NULL THEN 'arrival_missing' ELSE 'both_missing' END AS raw_time_pattern,
 CAST(origin AS VARCHAR) || '-' || CAST(dest AS VARCHAR) AS route, CAST(mo AS BIGINT) AS month FROM flights""", ("flights",))
def report_dims(spark, sf):
    return clean.report_dims(fx.flights(spark, sf)).select(
        "flight_id", "airline", "carrier_code", "dep_hour_order", "dep_hour_label", "arr_hour_order",
        "arr_hour_label", "raw_time_pattern", "route", "month")


@query("p15_eligibility_masked_requests", """
SELECT event_id, CASE WHEN station <> 3 AND event_id % 10 <> 0 THEN station END AS station,
 CASE WHEN event_id % 10 <> 0 THEN prediction_at END AS prediction_at FROM requests""", ("requests",))
def eligibility_masked_requests(spark, sf):
    rows = (fx.requests(spark, sf).withColumn("eligible", F.col("station") != 3)
            .withColumn("prediction_at", F.when(F.col("event_id") % 10 != 0, F.col("prediction_at"))))
    return clean.masked_requests(rows, "station", "eligible", "prediction_at").drop("eligible")
