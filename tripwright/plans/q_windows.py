"""Windows, rankings, intervals, sorts and limits."""
from __future__ import annotations

from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.functions import clock, geo
from tripwright.operators import calendar_signal, clean, intervals, sampling
from tripwright.plans.q_functions import TIME_SQL
from tripwright.plans.registry import query
from tripwright.storage import materialize

RESTORE_SQL = f"""{TIME_SQL},
routed AS (SELECT *, CAST(origin AS VARCHAR) || '_' || CAST(dest AS VARCHAR) AS route FROM timed),
route_medians AS (SELECT route, median(duration) AS m FROM routed GROUP BY route),
by_route AS (SELECT r.* REPLACE (coalesce(r.duration, m) AS duration), r.duration IS NULL AS gap_was_missing,
  r.duration IS NULL AND m IS NOT NULL AS by_route_median FROM routed r LEFT JOIN route_medians USING (route)),
filled AS (SELECT * REPLACE (coalesce(duration, (SELECT median(duration) FROM by_route)) AS duration) FROM by_route),
clocked AS (SELECT *, CAST(((arr_hour * 60 + arr_minute - duration) % 1440 + 1440) % 1440 AS INT) AS dep_calc,
  CAST((dep_hour * 60 + dep_minute + duration) % 1440 AS DOUBLE) AS arr_calc_d,
  ((arr_hour * 60 + arr_minute - duration) % 1440 + 1440) % 1440 AS dep_calc_d FROM filled),
restored AS (SELECT * REPLACE (
  CASE WHEN dep_hour = -1 AND arr_hour >= 0 THEN CAST(floor(dep_calc_d / 60) AS INT) ELSE dep_hour END AS dep_hour,
  CASE WHEN dep_hour = -1 AND arr_hour >= 0 THEN CAST(floor(dep_calc_d % 60) AS INT) ELSE dep_minute END AS dep_minute,
  CASE WHEN arr_hour = -1 AND dep_hour >= 0 THEN CAST(floor(arr_calc_d / 60) AS INT) ELSE arr_hour END AS arr_hour,
  CASE WHEN arr_hour = -1 AND dep_hour >= 0 THEN CAST(floor(arr_calc_d % 60) AS INT) ELSE arr_minute END AS arr_minute),
  dep_hour AS dep_hour_before, arr_hour AS arr_hour_before FROM clocked)"""


def restored_flights(spark, sf):
    rows = clean.with_route(materialize(fx.flights(spark, sf), "rows"))
    return clean.restore_times(clean.time_features(rows, keep_minute=True), settle=materialize)


@query("w1_group_median_fill", f"""WITH {RESTORE_SQL}
SELECT flight_id, dep_hour, dep_minute, arr_hour, arr_minute, duration FROM restored""", ("flights",))
def group_median_fill(spark, sf):
    return restored_flights(spark, sf).select("flight_id", "dep_hour", "dep_minute", "arr_hour", "arr_minute", "duration")


_SLOTS = f"""WITH {RESTORE_SQL}
SELECT flight_id, CAST(dep_hour = -1 AS INT) AS origin_hour_missing, CAST(arr_hour = -1 AS INT) AS dest_hour_missing,
 CASE WHEN dep_hour <> -1 THEN CAST(count(*) OVER (PARTITION BY mo, dom, origin, dep_hour) AS DOUBLE) END AS origin_traffic,
 CASE WHEN arr_hour <> -1 THEN CAST(count(*) OVER (PARTITION BY mo, dom, dest, arr_hour) AS DOUBLE) END AS dest_traffic
FROM restored"""


@query("w2_slot_counts", _SLOTS, ("flights",))
def slot_counts(spark, sf):
    return clean.traffic_features(restored_flights(spark, sf), settle=materialize).select(
        "flight_id", "origin_hour_missing", "dest_hour_missing", "origin_traffic", "dest_traffic")


@query("w2_slot_counts_missing_bucket", f"""WITH {TIME_SQL}
SELECT flight_id, CAST(count(*) OVER (PARTITION BY mo, dom, origin, dep_hour) AS DOUBLE) AS origin_traffic,
 CAST(count(*) OVER (PARTITION BY mo, dom, dest, arr_hour) AS DOUBLE) AS dest_traffic FROM timed""", ("flights",))
def slot_counts_missing_bucket(spark, sf):
    rows = clean.time_features(fx.flights(spark, sf))
    return clean.traffic_features(rows, exclude_missing_hour=False, add_missing_flag=False).select(
        "flight_id", "origin_traffic", "dest_traffic")


DAYS_SQL = """days AS (SELECT mo, dom, count(*) AS n, CAST(list_extract([0,31,59,90,120,151,181,212,243,273,304,334], mo) + dom AS INT) AS doy
 FROM flights GROUP BY mo, dom),
r AS (SELECT *, n - avg(n) OVER (PARTITION BY mo) AS residual, (doy - 1) % 7 AS cycle_class FROM days),
a AS (SELECT *, residual - avg(residual) OVER (PARTITION BY cycle_class) AS anomaly FROM r),
signal AS (SELECT *, anomaly / (SELECT stddev_samp(anomaly) FROM a) AS z FROM a)"""


@query("w3_two_stage_residual", f"""WITH {DAYS_SQL}
SELECT mo, dom, n, doy, cycle_class, round(residual, 6) AS residual, round(anomaly, 6) AS anomaly, round(z, 6) AS z FROM signal""", ("flights",))
def two_stage_residual(spark, sf):
    out = calendar_signal.decompose(calendar_signal.daily_counts(fx.flights(spark, sf)))
    return out.select("mo", "dom", "n", "doy", "cycle_class",
                      *[F.round(c, 6).alias(c) for c in ("residual", "anomaly", "z")])


@query("w4_row_rank", """
WITH roles AS (SELECT 'origin' AS role, CAST(origin AS BIGINT) AS airport FROM flights UNION ALL SELECT 'dest', dest FROM flights)
SELECT role, airport, count(*) AS n_rows, CAST(row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, airport) AS INT) AS rank
FROM roles GROUP BY role, airport""", ("flights",))
def row_rank(spark, sf):
    roles = fx.flights(spark, sf).select(F.inline(F.array(
        F.struct(F.lit("origin").alias("role"), F.col("origin").cast("bigint").alias("airport")),
        F.struct(F.lit("dest").alias("role"), F.col("dest").alias("airport")))))
    counts = roles.groupBy("role", "airport").agg(F.count(F.lit(1)).alias("n_rows"))
    return sampling.row_rank(counts, "role", "n_rows", "airport")


TERTILE_SQL = """freq AS (SELECT origin, count(*) AS n_rows FROM flights GROUP BY origin),
pct AS (SELECT origin, n_rows, (rank() OVER (ORDER BY n_rows) + (count(*) OVER (PARTITION BY n_rows) - 1) / 2) / count(*) OVER () AS percentile FROM freq),
tiers AS (SELECT *, CASE WHEN percentile > 2::DOUBLE / 3 THEN 'large' WHEN percentile > 1::DOUBLE / 3 THEN 'medium' ELSE 'small' END AS size_tier FROM pct)"""


@query("w5_percent_rank_tertile", f"""WITH {TERTILE_SQL}
SELECT origin, n_rows, round(percentile, 9) AS percentile, size_tier FROM tiers""", ("flights",))
def percent_rank_tertile(spark, sf):
    return sampling.size_tertiles(fx.flights(spark, sf), "origin").withColumn("percentile", F.round("percentile", 9))


@query("w6_first_per_group", """
SELECT yr, origin, flight_id, dep_hhmm FROM (SELECT *, row_number() OVER (PARTITION BY yr, origin ORDER BY flight_id) AS rn
 FROM flights WHERE dep_hhmm IS NOT NULL) WHERE rn = 1""", ("flights",))
def first_per_group(spark, sf):
    rows = fx.flights(spark, sf).filter("dep_hhmm IS NOT NULL").select("yr", "origin", "flight_id", "dep_hhmm")
    return sampling.first_per_group(rows, ["yr", "origin"], ["flight_id"])


@query("w7_top_n_per_group", """
SELECT mo, flight_id, CAST(rn AS INT) AS position FROM (SELECT mo, flight_id, row_number() OVER (PARTITION BY mo ORDER BY flight_id) AS rn FROM flights) WHERE rn <= 20""", ("flights",))
def top_n_per_group(spark, sf):
    return sampling.top_n_per_group(fx.flights(spark, sf).select("mo", "flight_id"), ["mo"], [F.col("flight_id")], 20)


@query("w8_boundary_tail_state", """
WITH m AS (SELECT station, observed_at, value, date_trunc('day', observed_at) AS d FROM reports)
SELECT station, observed_at, value FROM (SELECT *, row_number() OVER (PARTITION BY station, d ORDER BY observed_at DESC) AS rn FROM m)
WHERE observed_at >= d + INTERVAL 1 DAY - INTERVAL 90 MINUTE OR rn = 1""", ("reports",))
def boundary_tail_state(spark, sf):
    reports = fx.reports(spark, sf).select("station", "observed_at", "value")
    day = F.col("observed_at").cast("date")
    in_tail = F.col("observed_at") >= F.date_add(day, 1).cast("timestamp_ntz") - F.expr("INTERVAL 90 MINUTES")
    last = reports.groupBy("station", day.alias("d")).agg(
        F.max_by(F.struct("observed_at", "value"), "observed_at").alias("r")).select("station", "r.*")
    return reports.filter(in_tail).unionByName(last).distinct()


_STRATA_SQL = f"""{TERTILE_SQL},
pool AS (SELECT flight_id, yr, CASE WHEN mo IN (12, 1, 2) THEN 'winter' WHEN mo IN (3, 4, 5) THEN 'spring' WHEN mo IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
 'R' || CAST(origin % 5 AS VARCHAR) AS region, size_tier FROM flights JOIN tiers USING (origin)),
s0 AS (SELECT DISTINCT yr, season, region, size_tier FROM pool),
s1 AS (SELECT *, row_number() OVER (PARTITION BY yr, season, region ORDER BY size_tier) AS i3 FROM s0),
s2 AS (SELECT *, row_number() OVER (PARTITION BY yr, season ORDER BY i3, region) AS i2 FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY i2, season) AS i1 FROM s2),
visits AS (SELECT *, row_number() OVER (ORDER BY i1, yr) AS visit FROM s3),
picks AS (SELECT *, row_number() OVER (PARTITION BY yr, season, region, size_tier ORDER BY sha256(CAST(flight_id AS VARCHAR)), flight_id) AS pass_no FROM pool)"""


@query("w9_stratified_round_robin", f"""WITH {_STRATA_SQL}
SELECT yr, season, region, size_tier, flight_id, CAST(pass_no AS INT) AS pass_no, CAST(visit AS INT) AS visit
FROM picks JOIN visits USING (yr, season, region, size_tier) WHERE pass_no <= 2 ORDER BY pass_no, visit LIMIT 300""", ("flights",))
def stratified_round_robin(spark, sf):
    rows = fx.flights(spark, sf)
    tiers = sampling.size_tertiles(rows, "origin").select("origin", "size_tier")
    pool = rows.join(tiers, "origin").select(
        "flight_id", "yr", geo.season(F.col("mo")).alias("season"),
        F.concat(F.lit("R"), (F.col("origin") % 5).cast("string")).alias("region"), "size_tier")
    picked = sampling.stratified_round_robin(pool, ["yr", "season", "region", "size_tier"], "flight_id")
    return picked.select("yr", "season", "region", "size_tier", "flight_id", "pass_no", "visit")


# ---- intervals --------------------------------------------------------------

MERGE_SQL = """target AS (SELECT station, prediction_at - INTERVAL 6 HOUR AS a, prediction_at + INTERVAL 2 HOUR AS b FROM requests),
flagged AS (SELECT station, a, b, max(b) OVER (PARTITION BY station ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM target),
islands AS (SELECT station, a, b, sum(CASE WHEN reached IS NULL OR a > reached THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
merged AS (SELECT station, min(a) AS start, max(b) AS "end" FROM islands GROUP BY station, island)"""
# a narrower target keeps gaps between islands
_NARROW = MERGE_SQL.replace("INTERVAL 6 HOUR", "INTERVAL 40 MINUTE").replace("INTERVAL 2 HOUR", "INTERVAL 20 MINUTE")


def targets(spark, sf, before="40 MINUTES", after="20 MINUTES"):
    return fx.requests(spark, sf).selectExpr(
        "station", f"prediction_at - INTERVAL {before} AS start", f"prediction_at + INTERVAL {after} AS end")


@query("w10_merge_intervals", f"""WITH {_NARROW} SELECT station, start, "end" FROM merged""", ("requests",))
def merge_intervals(spark, sf):
    return intervals.merge_intervals(targets(spark, sf), "station")


@query("w11_subtract_intervals", f"""WITH {_NARROW},
covered AS (SELECT user_id % 4 AS station, ts AS c, ts + INTERVAL 20 MINUTE AS d FROM events WHERE event_type = 'click'),
points AS (SELECT station, a AS t FROM target UNION SELECT station, b FROM target UNION SELECT station, c FROM covered UNION SELECT station, d FROM covered),
segs AS (SELECT station, t AS s, lead(t) OVER (PARTITION BY station ORDER BY t) AS e FROM points),
kept AS (SELECT station, s, e FROM segs WHERE e IS NOT NULL AND EXISTS (SELECT 1 FROM target x WHERE x.station = segs.station AND x.a <= s AND x.b >= e)
  AND NOT EXISTS (SELECT 1 FROM covered x WHERE x.station = segs.station AND x.c <= s AND x.d >= e)),
k1 AS (SELECT *, max(e) OVER (PARTITION BY station ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM kept),
k2 AS (SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM k1)
SELECT station, min(s) AS start, max(e) AS "end" FROM k2 GROUP BY station, island""", ("requests",))
def subtract_intervals(spark, sf):
    covered = fx.table(spark, sf, "events").filter("event_type = 'click'").selectExpr(
        "user_id % 4 AS station", "ts AS start", "ts + INTERVAL 20 MINUTES AS end")
    return intervals.subtract_intervals(targets(spark, sf), covered, "station", settle=materialize)


@query("w12_split_intervals", f"""WITH {_NARROW},
sized AS (SELECT *, epoch_us("end") - epoch_us(start) AS us, CASE WHEN epoch_us("end") - epoch_us(start) > 5400000000
  THEN CAST(ceil((epoch_us("end") - epoch_us(start)) / 5400000000) AS BIGINT) ELSE 1 END AS pieces FROM merged),
cut AS (SELECT *, unnest(generate_series(0, pieces - 1)) AS k FROM sized)
SELECT station, CAST(k AS INT) AS piece, start + to_microseconds(us * k // pieces) AS start,
 start + to_microseconds(us * (k + 1) // pieces) AS "end" FROM cut""", ("requests",))
def split_intervals(spark, sf):
    merged = intervals.merge_intervals(targets(spark, sf), "station")
    return intervals.split_intervals(merged, 1.5)


@query("w13_batch_and_shard", """
WITH demand AS (SELECT DISTINCT user_id AS station, CASE WHEN user_id % 3 = 0 THEN 'NET_A' ELSE 'NET_B' END AS network,
  unnest([strftime(ts, '%Y-%m'), strftime(ts - INTERVAL 90 MINUTE, '%Y-%m')]) AS month FROM events WHERE event_type = 'purchase'),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY month, network ORDER BY station) - 1) // 7 AS batch FROM demand),
batches AS (SELECT month, network, batch, string_agg(CAST(station AS VARCHAR), ',' ORDER BY station) AS stations, count(*) AS n FROM numbered GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (ORDER BY month, network, batch) - 1 AS ordinal FROM batches)
SELECT ordinal, ordinal // 5 AS shard, month, network, stations, CAST(n AS INT) AS n_stations FROM ordered""")
def batch_and_shard(spark, sf):
    asked = fx.table(spark, sf, "events").filter("event_type = 'purchase'").selectExpr(
        "user_id AS station", "CASE WHEN user_id % 3 = 0 THEN 'NET_A' ELSE 'NET_B' END AS network", "ts")
    demand = intervals.month_demand(asked, "station", "ts", 90, "network")
    plan = intervals.batch_and_shard(demand, stations_per_request=7, shard_size=5)
    return plan.withColumn("stations", F.array_join(F.col("stations").cast("array<string>"), ","))


@query("w14_group_max_spread", """
SELECT flight_id, round(avg(p), 9) AS mean_probability, round(max(p) - min(p), 9) AS probability_spread,
 CAST(sum(CASE WHEN CAST(p >= threshold AS INT) <> y_true THEN 1 ELSE 0 END) AS BIGINT) AS wrong_seeds, CAST(max(y_true) AS INT) AS y_true
FROM oof GROUP BY flight_id""", ("flights", "oof"))
def group_max_spread(spark, sf):
    wrong = ((F.col("p") >= F.col("threshold")).cast("int") != F.col("y_true")).cast("bigint")
    return fx.oof(spark, sf).groupBy("flight_id").agg(
        F.round(F.avg("p"), 9).alias("mean_probability"), F.round(F.max("p") - F.min("p"), 9).alias("probability_spread"),
        F.sum(wrong).alias("wrong_seeds"), F.max("y_true").alias("y_true"))


@query("w15_day_groups", """
WITH roles AS (SELECT user_id % 4 AS station, ts FROM events WHERE event_type = 'purchase' UNION ALL
 SELECT 4 + user_id % 3, ts FROM events WHERE event_type = 'purchase')
SELECT station, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_requests, min(ts) AS first_at, max(ts) AS last_at FROM roles GROUP BY 1, 2""")
def day_groups(spark, sf):
    rows = fx.table(spark, sf, "events").filter("event_type = 'purchase'").selectExpr(
        "user_id % 4 AS origin_station", "4 + user_id % 3 AS dest_station", "ts")
    return intervals.day_groups(rows, ["origin_station", "dest_station"], "ts")


# ---- sorts and limits -------------------------------------------------------

@query("o1_worst_examples", """
WITH e AS (SELECT flight_id, seed, CASE WHEN y_true = 1 THEN 'false_negative' ELSE 'false_positive' END AS error_type, abs(p - y_true) AS error
 FROM oof WHERE CAST(p >= threshold AS INT) <> y_true)
SELECT seed, error_type, flight_id, round(error, 9) AS error, CAST(rn AS INT) AS position FROM
 (SELECT *, row_number() OVER (PARTITION BY seed, error_type ORDER BY error DESC, flight_id) AS rn FROM e) WHERE rn <= 10""", ("flights", "oof"))
def worst_examples(spark, sf):
    rows = fx.oof(spark, sf).filter((F.col("p") >= F.col("threshold")).cast("int") != F.col("y_true"))
    rows = rows.select("seed", F.expr("CASE WHEN y_true = 1 THEN 'false_negative' ELSE 'false_positive' END").alias("error_type"),
                       "flight_id", F.abs(F.col("p") - F.col("y_true")).alias("error"))
    top = sampling.top_n_per_group(rows, ["seed", "error_type"], [F.col("error").desc(), F.col("flight_id")], 10)
    return top.withColumn("error", F.round("error", 9))


@query("o2_multi_key_sort", """
SELECT o_orderdate, o_custkey, o_orderkey, o_orderpriority FROM orders ORDER BY o_orderdate, o_custkey DESC, o_orderkey""")
def multi_key_sort(spark, sf):
    return (fx.table(spark, sf, "orders").select("o_orderdate", "o_custkey", "o_orderkey", "o_orderpriority")
            .orderBy("o_orderdate", F.col("o_custkey").desc(), "o_orderkey"))


@query("o3_top_k_values", """
SELECT airline, count(*) AS n_rows FROM flights GROUP BY airline ORDER BY n_rows DESC, airline NULLS FIRST LIMIT 8""", ("flights",))
def top_k_values(spark, sf):
    return sampling.top_k(fx.flights(spark, sf), "airline", 8)


@query("flagship_delay_rate_by_origin_hour", f"""WITH {RESTORE_SQL},
slots AS (SELECT origin, dep_hour, delay, CASE WHEN dep_hour <> -1 THEN CAST(count(*) OVER (PARTITION BY mo, dom, origin, dep_hour) AS DOUBLE) END AS origin_traffic FROM restored),
labeled AS (SELECT origin, dep_hour, origin_traffic, CASE WHEN delay = 'Delayed' THEN 1 ELSE 0 END AS y FROM slots WHERE delay IS NOT NULL)
SELECT origin, dep_hour, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_delayed, count(*) - CAST(sum(y) AS BIGINT) AS n_not_delayed,
 round(sum(y) / count(*), 9) AS delay_rate, round(avg(origin_traffic), 9) AS mean_origin_traffic,
 round(count(*) / (SELECT count(*) FROM labeled), 9) AS share_of_population FROM labeled GROUP BY origin, dep_hour""", ("flights",))
def flagship(spark, sf):
    """Clean, restore, count slots, keep labeled rows, and report delay rates by origin and hour."""
    rows = clean.slot_counts(restored_flights(spark, sf), "origin_traffic", "origin", "dep_hour", settle=materialize)
    labeled = clean.labeled_rows(rows)
    table = materialize(labeled.groupBy("origin", "dep_hour").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("n_delayed"),
        F.round(F.avg("origin_traffic"), 9).alias("mean_origin_traffic")), "rates")
    total = table.agg(F.sum("n_rows").alias("n"))
    return table.select(
        "origin", "dep_hour", "n_rows", "n_delayed", (F.col("n_rows") - F.col("n_delayed")).alias("n_not_delayed"),
        F.round(F.col("n_delayed") / F.col("n_rows"), 9).alias("delay_rate"), "mean_origin_traffic",
        F.round(F.col("n_rows") / total.scalar(), 9).alias("share_of_population"))
