"""Column names, fixed values and explicit schemas."""
from __future__ import annotations

from pyspark.sql import types as T

# The column names of the source CSV and the names used here.
SOURCE_COLUMNS = {
    "ID": "flight_id",
    "Month": "mo",
    "Day_of_Month": "dom",
    "Estimated_Departure_Time": "dep_hhmm",
    "Estimated_Arrival_Time": "arr_hhmm",
    "Cancelled": "cancelled",
    "Diverted": "diverted",
    "Origin_Airport": "origin",
    "Origin_Airport_ID": "origin_id",
    "Origin_State": "origin_state",
    "Destination_Airport": "dest",
    "Destination_Airport_ID": "dest_id",
    "Destination_State": "dest_state",
    "Distance": "distance",
    "Airline": "airline",
    "Carrier_Code(IATA)": "carrier_code",
    "Carrier_ID(DOT)": "carrier_id",
    "Tail_Number": "tail",
    "Delay": "delay",
}
_INTEGER = {"Month", "Day_of_Month", "Cancelled", "Diverted", "Origin_Airport_ID", "Destination_Airport_ID"}
_DOUBLE = {"Estimated_Departure_Time", "Estimated_Arrival_Time", "Distance", "Carrier_ID(DOT)"}


def _source_type(name: str) -> T.DataType:
    if name in _INTEGER:
        return T.IntegerType()
    return T.DoubleType() if name in _DOUBLE else T.StringType()


SOURCE_SCHEMA = T.StructType([T.StructField(n, _source_type(n)) for n in SOURCE_COLUMNS])

# Label texts and the sentinel for an unknown hour.
TARGET_MAP = {"Not_Delayed": 0, "Delayed": 1}
MISSING_HOUR = -1

# Identifier and constant columns removed before modelling.
_IDENTIFIERS = ("flight_id", "cancelled", "diverted", "origin_id", "dest_id", "carrier_id")
_REDUNDANT = ("carrier_code", "origin_state", "dest_state", "dom")
DROP_PRESETS = {
    "baseline": _IDENTIFIERS,
    "pruned": _IDENTIFIERS + _REDUNDANT,
    "advanced": _IDENTIFIERS + _REDUNDANT + ("dep_minute", "arr_minute"),
}
CATEGORICAL = ("tail", "route", "origin", "dest", "airline")

# Station report fields.
REPORT_NUMERIC = ("tmpf", "dwpf", "relh", "sknt", "gust", "vsby", "p01i", "snowdepth")
REPORT_FIELDS = ("tmpf", "dwpf", "relh", "sknt", "gust", "vsby", "p01i", "skyc1", "wxcodes",
                 "snowdepth", "metar")
REPORT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("station", "valid", *REPORT_FIELDS)])

# Join settings, the null token of joined CSVs, and outcome columns no join may carry.
LATENCIES = (0, 10, 30, 60)
MAX_AGE_MINUTES = 90
CSV_NULL = "<NA>"
OUTCOME_COLUMNS = frozenset({
    "delay", "delayed", "not_delayed", "arrdelay", "depdelay",
    "actual_departure_time", "actual_arrival_time",
})
# Airport verification tiers from best to worst.
TIERS = ("confirmed_period", "confirmed_current_only", "tz_conflict_needs_resolution", "unconfirmed")
ELIGIBLE_TIER = "confirmed_period"
