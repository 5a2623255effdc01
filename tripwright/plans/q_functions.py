"""Scalar rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.functions import calendar, clock, geo, numeric, text
from tripwright.operators import clean
from tripwright.plans.registry import query

# Time zones given to station numbers 0..4 of the demonstration data.
ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Phoenix", "Pacific/Honolulu")
_ZONE_SQL = "CASE CAST(origin AS INT) % 5 " + " ".join(
    f"WHEN {i} THEN '{z}'" for i, z in enumerate(ZONES)) + " END"


def _zone(column: str):
    return F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col(column) % 5 + 1).cast("int"))


def _date():
    return F.make_date("yr", "mo", "dom")


TIME_SQL = """time_parts AS (
 SELECT *, CASE WHEN dep_hhmm IS NULL THEN -1 ELSE CAST(dep_hhmm // 100 AS INT) END AS dep_hour,
  CASE WHEN dep_hhmm IS NULL THEN -1 ELSE CAST(dep_hhmm % 100 AS INT) END AS dep_minute,
  CASE WHEN arr_hhmm IS NULL THEN -1 ELSE CAST(arr_hhmm // 100 AS INT) END AS arr_hour,
  CASE WHEN arr_hhmm IS NULL THEN -1 ELSE CAST(arr_hhmm % 100 AS INT) END AS arr_minute
 FROM flights),
timed AS (
 SELECT *, CASE WHEN dep_hour >= 0 AND arr_hour >= 0 THEN CAST(
   CASE WHEN arr_hour * 60 + arr_minute < dep_hour * 60 + dep_minute
        THEN arr_hour * 60 + arr_minute - dep_hour * 60 - dep_minute + 1440
        ELSE arr_hour * 60 + arr_minute - dep_hour * 60 - dep_minute END AS DOUBLE) END AS duration
 FROM time_parts)"""


@query("f1_parse_hhmm", """
SELECT flight_id, CASE WHEN v IS NULL OR v < 0 THEN -1 ELSE CAST(floor(v / 100) AS INT) END AS hour,
 CASE WHEN v IS NULL OR v < 0 THEN -1 ELSE CAST(v % 100 AS INT) END AS minute,
 CASE WHEN v IS NULL OR v < 0 OR floor(v / 100) > 23 OR v % 100 > 59 THEN -1 ELSE CAST(floor(v / 100) AS INT) END
  AS strict_hour
FROM (SELECT flight_id, CASE WHEN flight_id % 17 = 0 THEN dep_hhmm + 470 WHEN flight_id % 19 = 0 THEN -5
      ELSE dep_hhmm END AS v FROM flights)""", ("flights",))
def parse_hhmm(spark, sf):
    raw = fx.flights(spark, sf).selectExpr(
        "flight_id", "CASE WHEN flight_id % 17 = 0 THEN CAST(dep_hhmm + 470 AS STRING)"
                     " WHEN flight_id % 19 = 0 THEN '-5' ELSE coalesce(CAST(dep_hhmm AS STRING), 'n/a') END AS v")
    hour, minute = clock.hhmm_parts(F.col("v"))
    strict_hour, _ = clock.hhmm_parts(F.col("v"), strict=True)
    return raw.select("flight_id", hour.alias("hour"), minute.alias("minute"), strict_hour.alias("strict_hour"))


@query("f2_time_features", f"""WITH {TIME_SQL}
SELECT flight_id, dep_hour, dep_minute, arr_hour, arr_minute, duration FROM timed""", ("flights",))
def time_features(spark, sf):
    return clean.time_features(fx.flights(spark, sf), keep_minute=True).select(
        "flight_id", "dep_hour", "dep_minute", "arr_hour", "arr_minute", "duration")


_UTC_SQL = f"""WITH local AS (
 SELECT flight_id, {_ZONE_SQL} AS zone,
  make_timestamp(yr, mo, dom, 0, 0, 0) + to_minutes(CAST(dep_hhmm // 100 * 60 + dep_hhmm % 100 AS BIGINT)) AS naive
 FROM flights),
instants AS (SELECT *, timezone(zone, naive) AS u FROM local),
checked AS (SELECT *, timezone(zone, u) AS back, timezone(zone, u + INTERVAL 1 HOUR) AS later,
  timezone(zone, u - INTERVAL 1 HOUR) AS earlier FROM instants),
utc AS (SELECT flight_id, CASE WHEN back = naive AND later <> naive AND earlier <> naive
  THEN timezone('UTC', u) END AS departs_at,
  coalesce(back <> naive OR later = naive OR earlier = naive, FALSE) AS in_clock_change FROM checked)
"""


@query("f3_local_hhmm_to_utc", _UTC_SQL + "SELECT flight_id, departs_at FROM utc", ("flights",))
def local_hhmm_to_utc(spark, sf):
    return fx.flights(spark, sf).select("flight_id", clock.local_hhmm_to_utc(
        _date(), F.col("dep_hhmm"), _zone("origin")).alias("departs_at"))


@query("f4_prediction_cutoff",
       _UTC_SQL + "SELECT flight_id, departs_at - INTERVAL 60 MINUTE AS prediction_at FROM utc", ("flights",))
def prediction_cutoff(spark, sf):
    return fx.flights(spark, sf).select("flight_id", clock.prediction_cutoff(
        _date(), F.col("dep_hhmm"), _zone("origin")).alias("prediction_at"))


@query("f5_cyclic_hour", f"""WITH {TIME_SQL}
SELECT flight_id, CAST(dep_hour < 0 AS INT) AS dep_hour_missing,
 round(CASE WHEN dep_hour >= 0 THEN sin(2 * pi() * dep_hour / 24) END, 9) AS sin_dep_hour,
 round(CASE WHEN dep_hour >= 0 THEN cos(2 * pi() * dep_hour / 24) END, 9) AS cos_dep_hour,
 round(sin(2 * pi() * CASE WHEN arr_hour >= 0 THEN arr_hour ELSE 12 END / 24), 9) AS sin_arr_hour,
 round(cos(2 * pi() * CASE WHEN arr_hour >= 0 THEN arr_hour ELSE 12 END / 24), 9) AS cos_arr_hour
FROM timed""", ("flights",))
def cyclic_hour(spark, sf):
    out = clean.time_features(fx.flights(spark, sf))
    out = clean.cyclic_features(out, ("dep_hour",), add_missing_flag=True)
    out = clean.cyclic_features(out, ("arr_hour",), missing="noon")
    return out.select("flight_id", "dep_hour_missing", *[F.round(c, 9).alias(c) for c in (
        "sin_dep_hour", "cos_dep_hour", "sin_arr_hour", "cos_arr_hour")])


@query("f6_legacy_speed_ratio", f"""WITH {TIME_SQL}
SELECT flight_id, round(distance / (duration + 1e-5), 6) AS speed_ratio FROM timed""",
       ("flights",))
def legacy_speed_ratio(spark, sf):
    out = clean.speed_features(clean.time_features(fx.flights(spark, sf)))
    return out.select("flight_id", F.round("speed_ratio", 6).alias("speed_ratio"))


@query("f7_safe_ratio", f"""WITH {TIME_SQL}
SELECT flight_id, duration AS local_gap_minutes, CAST(coalesce(duration = 0, FALSE) AS INT) AS gap_zero,
 round(CASE WHEN duration > 0 AND distance >= 0 THEN distance / duration END, 9) AS distance_per_minute,
 CAST(NOT coalesce(duration > 0 AND distance >= 0, FALSE) AS INT) AS distance_per_minute_missing
FROM timed""", ("flights",))
def safe_ratio(spark, sf):
    out = clean.speed_features(clean.time_features(fx.flights(spark, sf)), safe=True)
    return out.select("flight_id", "local_gap_minutes", "gap_zero",
                      F.round("distance_per_minute", 9).alias("distance_per_minute"),
                      "distance_per_minute_missing")


@query("f8_route_key", """
SELECT flight_id, CAST(CASE WHEN flight_id % 23 <> 0 THEN origin END AS VARCHAR) || '_' || CAST(dest AS VARCHAR) AS route
FROM flights""", ("flights",))
def route_key(spark, sf):
    origin = F.when(F.col("flight_id") % 23 != 0, F.col("origin"))
    return fx.flights(spark, sf).select("flight_id", text.route_key(origin, F.col("dest")).alias("route"))


@query("f9_hour_bucket", """
SELECT flight_id, o AS hour_order, CASE WHEN o < 0 THEN 'missing' WHEN o = 24 THEN '24 (2400)'
 ELSE lpad(CAST(o AS VARCHAR), 2, '0') END AS hour_label
FROM (SELECT flight_id, CASE WHEN flight_id % 21 = 0 THEN 24 WHEN dep_hhmm IS NULL THEN -1 ELSE dep_hhmm // 100 END AS o
      FROM flights)""", ("flights",))
def hour_bucket(spark, sf):
    value = F.when(F.col("flight_id") % 21 == 0, F.lit(2400)).otherwise(F.col("dep_hhmm"))
    order = clock.hour_order(value)
    return fx.flights(spark, sf).select("flight_id", order.alias("hour_order"),
                                        clock.hour_label(order).alias("hour_label"))


@query("f10_midnight_distance", """
SELECT flight_id, CASE WHEN v IS NULL THEN NULL WHEN v >= 2400 THEN 0.0
 ELSE CAST(least(v // 100 * 60 + v % 100, 1440 - (v // 100 * 60 + v % 100)) AS DOUBLE) END AS minutes
FROM (SELECT flight_id, CASE WHEN flight_id % 21 = 0 THEN 2400 ELSE dep_hhmm END AS v FROM flights)""", ("flights",))
def midnight_distance(spark, sf):
    value = F.when(F.col("flight_id") % 21 == 0, F.lit(2400)).otherwise(F.col("dep_hhmm"))
    return fx.flights(spark, sf).select("flight_id", clock.midnight_distance(value).alias("minutes"))


@query("f11_clock_change_flag", _UTC_SQL + "SELECT flight_id, in_clock_change FROM utc", ("flights",))
def clock_change_flag(spark, sf):
    return fx.flights(spark, sf).select("flight_id", clock.clock_change_departure(
        _date(), F.col("dep_hhmm"), _zone("origin")).alias("in_clock_change"))


@query("f12_haversine_km", """
SELECT s_suppkey, n_nationkey, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2)
  + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))), 6) AS km
FROM (SELECT s_suppkey, n_nationkey, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 90 AS DOUBLE) - 45 END AS lat1,
  CAST(s_suppkey % 170 AS DOUBLE) AS lon1, CAST(n_nationkey * 3 AS DOUBLE) AS lat2, CAST(n_nationkey * 7 AS DOUBLE) AS lon2
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def haversine(spark, sf):
    pairs = fx.table(spark, sf, "supplier").join(
        fx.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lat1 = F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") % 90).cast("double") - 45)
    km = geo.haversine_km(lat1, (F.col("s_suppkey") % 170).cast("double"),
                          (F.col("n_nationkey") * 3).cast("double"), (F.col("n_nationkey") * 7).cast("double"))
    return pairs.select("s_suppkey", "n_nationkey", F.round(km, 6).alias("km"))


@query("f13_zone_offset_equivalence", """
WITH zones AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Denver'
   WHEN 2 THEN 'America/Phoenix' ELSE NULL END AS zone_a,
   CASE n_nationkey % 3 WHEN 0 THEN 'America/Detroit' WHEN 1 THEN 'America/Phoenix' ELSE 'America/Denver' END AS zone_b
  FROM nation),
bounds AS (SELECT date_trunc('day', min(o_orderdate)) AS lo, date_trunc('day', max(o_orderdate)) AS hi FROM orders),
instants AS (SELECT unnest(generate_series(lo, hi + INTERVAL 18 HOUR, INTERVAL 6 HOUR)) AS t FROM bounds)
SELECT n_nationkey, CASE WHEN max(zone_a) IS NULL THEN NULL ELSE
  bool_and(timezone(zone_a, timezone('UTC', t)) = timezone(zone_b, timezone('UTC', t))) END AS same_offset
FROM zones CROSS JOIN instants GROUP BY n_nationkey""")
def zone_offset_equivalence(spark, sf):
    nations = fx.table(spark, sf, "nation").selectExpr(
        "n_nationkey",
        "CASE n_nationkey % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Denver'"
        " WHEN 2 THEN 'America/Phoenix' END AS zone_a",
        "CASE n_nationkey % 3 WHEN 0 THEN 'America/Detroit' WHEN 1 THEN 'America/Phoenix'"
        " ELSE 'America/Denver' END AS zone_b")
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    bounds = fx.table(spark, sf, "orders").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    pairs = nations.select("zone_a", "zone_b").distinct()
    instants = F.sequence(bounds.select("lo").scalar(),
                          bounds.select("hi").scalar() + F.expr("INTERVAL 18 HOURS"), F.expr("INTERVAL 6 HOURS"))
    probed = pairs.withColumn("t", F.explode(instants))
    same = (F.convert_timezone(F.lit("UTC"), F.col("zone_a"), F.col("t"))
            == F.convert_timezone(F.lit("UTC"), F.col("zone_b"), F.col("t")))
    verdict = probed.groupBy("zone_a", "zone_b").agg(F.bool_and(same).alias("same_offset"))
    return nations.join(verdict, ["zone_a", "zone_b"], "left").select("n_nationkey", "same_offset")


@query("f14_movable_holidays", """
WITH yrs AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS yr FROM orders),
days AS (SELECT yr, CAST(unnest(generate_series(make_date(yr, 1, 1)::TIMESTAMP, make_date(yr, 12, 31)::TIMESTAMP,
  INTERVAL 1 DAY)) AS DATE) AS d FROM yrs),
ranked AS (SELECT yr, d, month(d) AS m, isodow(d) AS w,
  row_number() OVER (PARTITION BY yr, month(d), isodow(d) ORDER BY d) AS n,
  row_number() OVER (PARTITION BY yr, month(d), isodow(d) ORDER BY d DESC) AS n_last FROM days)
SELECT yr, 'thanksgiving' AS holiday, strftime(d, '%Y-%m-%d') AS holiday_date FROM ranked WHERE m = 11 AND w = 4 AND n = 4
UNION ALL SELECT yr, 'day_after_thanksgiving', strftime(d + 1, '%Y-%m-%d') FROM ranked WHERE m = 11 AND w = 4 AND n = 4
UNION ALL SELECT yr, 'labor_day', strftime(d, '%Y-%m-%d') FROM ranked WHERE m = 9 AND w = 1 AND n = 1
UNION ALL SELECT yr, 'memorial_day', strftime(d, '%Y-%m-%d') FROM ranked WHERE m = 5 AND w = 1 AND n_last = 1
UNION ALL SELECT yr, 'mlk_day', strftime(d, '%Y-%m-%d') FROM ranked WHERE m = 1 AND w = 1 AND n = 3
UNION ALL SELECT yr, 'presidents_day', strftime(d, '%Y-%m-%d') FROM ranked WHERE m = 2 AND w = 1 AND n = 3""")
def movable_holidays(spark, sf):
    years = (fx.table(spark, sf, "orders").select(F.year("o_orderdate").alias("yr")).distinct())
    dates = [F.struct(F.lit(name).alias("holiday"),
                      F.date_format(calendar.movable_holiday(F.col("yr"), m, w, n, shift), "yyyy-MM-dd")
                      .alias("holiday_date")) for name, m, w, n, shift in calendar.MOVABLE_HOLIDAYS]
    return years.select("yr", F.inline(F.array(*dates)))


@query("f14_common_year_alignments", """
SELECT CAST(isodow(make_date(yr, 1, 1)) - 1 AS INT) AS jan1_weekday, string_agg(CAST(yr AS VARCHAR), ',' ORDER BY yr) AS years
FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS yr FROM orders)
WHERE NOT (yr % 4 = 0 AND (yr % 100 <> 0 OR yr % 400 = 0)) GROUP BY 1""")
def common_year_alignments(spark, sf):
    years = fx.table(spark, sf, "orders").select(F.year("o_orderdate").alias("yr")).distinct()
    first = F.make_date(F.col("yr"), F.lit(1), F.lit(1))
    return (years.filter(calendar.is_common_year(F.col("yr")))
            .groupBy(calendar.monday_based_weekday(first).alias("jan1_weekday"))
            .agg(F.array_join(F.sort_array(F.collect_set("yr")).cast("array<string>"), ",").alias("years")))


@query("f15_day_of_common_year", """
SELECT flight_id, CAST(dayofyear(make_date(2019, mo, CASE WHEN mo = 2 AND dom = 29 THEN 28 ELSE dom END))
  + CASE WHEN mo = 2 AND dom = 29 THEN 1 ELSE 0 END AS INT) AS doy FROM flights""", ("flights",))
def day_of_common_year(spark, sf):
    return fx.flights(spark, sf).select(
        "flight_id", calendar.day_of_common_year(F.col("mo"), F.col("dom")).alias("doy"))


@query("f16_stable_hash_rank", "SELECT flight_id, sha256(CAST(flight_id AS VARCHAR)) AS hash_rank FROM flights",
       ("flights",))
def stable_hash_rank(spark, sf):
    return fx.flights(spark, sf).select("flight_id", numeric.stable_hash(F.col("flight_id")).alias("hash_rank"))


@query("f17_clipped_logit", """
SELECT flight_id, seed, round(ln(q / (1 - q)), 9) AS logit FROM (
 SELECT flight_id, seed, least(greatest(p, 1e-6::DOUBLE), 1::DOUBLE - 1e-6::DOUBLE) AS q FROM oof)""", ("flights", "oof"))
def clipped_logit(spark, sf):
    return fx.oof(spark, sf).select("flight_id", "seed",
                                    F.round(numeric.clipped_logit(F.col("p")), 9).alias("logit"))


@query("f18_geo_lookup_buckets", """
SELECT s_suppkey, CASE WHEN country <> 'US' THEN 'Non-contiguous territory' WHEN state = 'Texas' THEN 'South'
  WHEN state = 'Ohio' THEN 'Midwest' WHEN state = 'Alaska' THEN 'Alaska' WHEN state = 'Nevada' THEN 'West' ELSE 'Unknown' END AS region,
 CASE WHEN country <> 'US' THEN 'Non-contiguous territory' WHEN state = 'Alaska' THEN 'Alaska'
  ELSE CASE WHEN state = 'Texas' THEN 'South' WHEN state = 'Ohio' THEN 'Midwest' WHEN state = 'Nevada' THEN 'West' ELSE 'Unknown' END
   || ':' || coalesce(split_part(zone, '/', 2), 'unknown') END AS region_zone,
 CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m IN (3, 4, 5) THEN 'spring' WHEN m IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
 CASE state WHEN 'Texas' THEN 'TX_ASOS' WHEN 'Ohio' THEN 'OH_ASOS' WHEN 'Nevada' THEN 'NV_ASOS' WHEN 'Alaska' THEN 'AK_ASOS' END AS network
FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Texas' WHEN 1 THEN 'Ohio' WHEN 2 THEN 'Alaska' WHEN 3 THEN 'Nevada' ELSE 'Atlantis' END AS state,
  CASE WHEN s_suppkey % 7 = 0 THEN 'PR' ELSE 'US' END AS country,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'America/Chicago' ELSE 'America/New_York' END AS zone,
  s_suppkey % 12 + 1 AS m FROM supplier)""")
def geo_lookup_buckets(spark, sf):
    rows = fx.table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "CASE s_suppkey % 5 WHEN 0 THEN 'Texas' WHEN 1 THEN 'Ohio' WHEN 2 THEN 'Alaska'"
                     " WHEN 3 THEN 'Nevada' ELSE 'Atlantis' END AS state",
        "CASE WHEN s_suppkey % 7 = 0 THEN 'PR' ELSE 'US' END AS country",
        "CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'America/Chicago'"
        " ELSE 'America/New_York' END AS zone", "s_suppkey % 12 + 1 AS m")
    region = geo.census_region(F.col("state"), F.col("country"))
    networks = {"Texas": "TX_ASOS", "Ohio": "OH_ASOS", "Nevada": "NV_ASOS", "Alaska": "AK_ASOS"}
    return rows.select("s_suppkey", region.alias("region"),
                       geo.region_zone_bucket(region, F.col("zone"), ("Alaska", "Hawaii", geo.TERRITORY))
                       .alias("region_zone"),
                       geo.season(F.col("m")).alias("season"),
                       geo.lookup(F.col("state"), networks).alias("network"))


@query("f19_month_window", """
SELECT event_id, strftime(ts, '%Y-%m') AS month, date_trunc('month', ts)::TIMESTAMP AS window_start,
 (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP AS window_end FROM events""")
def month_window(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", clock.month_key(F.col("ts")).alias("month"))
    start, end = clock.month_window(F.col("month"))
    return events.select("event_id", "month", start.alias("window_start"), end.alias("window_end"))


@query("f20_interval_overlap", """
SELECT o_orderkey, CASE WHEN lo <= hi THEN lo END AS overlap_start, CASE WHEN lo <= hi THEN hi END AS overlap_end
FROM (SELECT o_orderkey, greatest(coalesce(b, TIMESTAMP '1997-01-01'), TIMESTAMP '1997-01-01') AS lo,
  least(coalesce(e, TIMESTAMP '1997-12-31'), TIMESTAMP '1997-12-31') AS hi
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS b,
   CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 90 DAY END AS e FROM orders))""")
def interval_overlap(spark, sf):
    rows = fx.table(spark, sf, "orders")
    begin = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    end = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    low, high = numeric.interval_overlap(begin, end, F.lit("1997-01-01").cast("timestamp_ntz"),
                                         F.lit("1997-12-31").cast("timestamp_ntz"))
    return rows.select("o_orderkey", low.alias("overlap_start"), high.alias("overlap_end"))


@query("f21_attributed_date", """
SELECT flight_id, CASE WHEN flight_id % 3 = 0 THEN strftime(make_date(yr, mo, dom), '%Y-%m-%d') END AS attributed_date
FROM flights""", ("flights",))
def attributed_date(spark, sf):
    adopted = F.col("flight_id") % 3 == 0
    return fx.flights(spark, sf).select(
        "flight_id", F.when(adopted, F.date_format(_date(), "yyyy-MM-dd")).alias("attributed_date"))


@query("f22_grid_edge_flag", """
SELECT seed, fold, max(threshold) AS chosen, CASE WHEN max(threshold) = 0.20::DOUBLE THEN 'low'
 WHEN max(threshold) = 0.24::DOUBLE THEN 'high' END AS edge FROM oof GROUP BY seed, fold""", ("flights", "oof"))
def grid_edge_flag(spark, sf):
    chosen = fx.oof(spark, sf).groupBy("seed", "fold").agg(F.max("threshold").alias("chosen"))
    axis = tuple((20 + k) / 100 for k in range(5))
    return chosen.withColumn("edge", numeric.grid_edge(F.col("chosen"), axis))
