"""Trip-shaped views over the given star-schema tables.

``VIEW_SQL`` holds the text for the SQL side; the functions build the same rows
with the DataFrame API. Views that depend on others must be listed after them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SEEDS = (42, 1, 7)
LATENCIES = (0, 10, 30, 60)

_FLIGHT_COLUMNS = (
    ("flight_id", "o_orderkey"),
    ("yr", "CAST(year(o_orderdate) AS INT)"),
    ("mo", "CAST(month(o_orderdate) AS INT)"),
    ("dom", "CAST(day(o_orderdate) AS INT)"),
    ("dep_hhmm", "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey * 7 % 24) * 100 + o_custkey % 60 END"),
    ("arr_hhmm", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ((o_orderkey * 7 + o_custkey) % 24) * 100 + o_orderkey % 60 END"),
    ("origin", "c_nationkey"),
    ("dest", "(o_custkey * 3 + o_orderkey) % 25"),
    ("tail", "o_custkey % 200"),
    ("carrier_code", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'C' || CAST(o_custkey % 30 AS VARCHAR(9)) END"),
    ("airline", "CASE WHEN o_orderkey % 13 = 0 THEN NULL "
                "WHEN o_custkey % 30 < 10 AND o_orderkey % 2 = 0 THEN 'AIR' || CAST(o_custkey % 30 AS VARCHAR(9)) || 'X' "
                "ELSE 'AIR' || CAST(o_custkey % 30 AS VARCHAR(9)) END"),
    ("distance", "100 + (o_custkey % 40) * 25"),
    ("delay", "CASE WHEN o_orderkey % 4 <> 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Delayed' ELSE 'Not_Delayed' END"),
)
_OOF_COLUMNS = (
    ("flight_id", "flight_id"),
    ("seed", "seed"),
    ("fold", "CAST((flight_id * 31 + seed) % 5 AS INT)"),
    ("y_true", "CASE WHEN delay = 'Delayed' THEN 1 ELSE 0 END"),
    ("p", "CAST((flight_id * 7919 + seed * 104729) % 997 AS DOUBLE) / 997"),
    ("threshold", "CAST(20 + (flight_id * 31 + seed) % 5 AS DOUBLE) / 100"),
)
# Coarse fingerprints, so that rows match none, one or several schedule years.
_TRIP_COLUMNS = (
    ("flight_id", "flight_id"), ("yr", "yr"), ("mo", "mo"),
    ("tail", "tail % 20"), ("origin", "origin % 5"), ("carrier_code", "carrier_code"),
    ("dep_block", "CAST((dep_hhmm - dep_hhmm % 600) / 600 AS INT)"),
    ("arr_block", "CAST((arr_hhmm - arr_hhmm % 600) / 600 AS INT)"),
    ("airline", "airline"), ("distance", "distance"), ("dom", "dom"), ("dep_hhmm", "dep_hhmm"),
)
# All trips serve as the schedule, dealt to two years; a sixth have another tail, so that trips
# match none, one or both. Only the attribution query checks fewer months than there are.
SCHEDULE_YEARS = (1996, 1997)
SCHEDULE_MONTHS = 10
_SCHEDULE_COLUMNS = {"yr": "CAST(1996 + yr % 2 AS INT)", "tail": "CASE WHEN flight_id % 6 = 0 THEN tail + 100 ELSE tail END"}


def _select(columns) -> str:
    return ",\n ".join(f"{expr} AS {name}" for name, expr in columns)


VIEW_SQL = {
    "flights": f"SELECT {_select(_FLIGHT_COLUMNS)}\n FROM orders JOIN customer ON o_custkey = c_custkey",
    "oof": f"SELECT {_select(_OOF_COLUMNS)}\n FROM flights CROSS JOIN (VALUES (42),(1),(7)) AS s(seed)\n"
           " WHERE delay IS NOT NULL",
    "trips": f"SELECT {_select(_TRIP_COLUMNS)}\n FROM flights",
    "schedule": f"SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in _SCHEDULE_COLUMNS.items())}) FROM trips",
    "checked_schedule": f"SELECT * FROM schedule WHERE mo <= {SCHEDULE_MONTHS}",
    "requests": "SELECT event_id, user_id % 4 AS station, ts AS prediction_at FROM events"
                " WHERE event_type = 'purchase'",
    "reports": "SELECT user_id % 4 AS station, ts AS observed_at, ts + INTERVAL 10 MINUTE AS available_at,"
               " value FROM events WHERE event_type = 'view'",
    "latencies": "SELECT * FROM (VALUES (0),(10),(30),(60)) AS t(latency)",
    "years": "SELECT * FROM (VALUES (1995),(1996),(1997),(1998),(1999),(2000)) AS t(year)",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flights(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(*[f"{expr} AS {name}" for name, expr in _FLIGHT_COLUMNS])


def oof(spark: SparkSession, sf: str) -> DataFrame:
    labeled = flights(spark, sf).filter(F.col("delay").isNotNull())
    seeded = labeled.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    return seeded.selectExpr(*[f"{expr} AS {name}" for name, expr in _OOF_COLUMNS])


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "events").filter("event_type = 'purchase'")
            .selectExpr("event_id", "user_id % 4 AS station", "ts AS prediction_at"))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "events").filter("event_type = 'view'")
            .selectExpr("user_id % 4 AS station", "ts AS observed_at",
                        "ts + INTERVAL 10 MINUTE AS available_at", "value"))


def trips(spark: SparkSession, sf: str) -> DataFrame:
    return flights(spark, sf).selectExpr(*[f"{expr} AS {name}" for name, expr in _TRIP_COLUMNS])


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    return trips(spark, sf).withColumns({n: F.expr(e) for n, e in _SCHEDULE_COLUMNS.items()})


def checked_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return schedule(spark, sf).filter(F.col("mo") <= SCHEDULE_MONTHS)
