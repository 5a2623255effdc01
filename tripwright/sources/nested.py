"""Nested JSON: station collections, attempt logs, JSON text columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

STATION_COLLECTION = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
])))])


def read_station_collections(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON files, one collection each, exploded to one row per station."""
    raw = spark.read.schema(STATION_COLLECTION).option("multiLine", True).json(path)
    return explode_stations(raw)


def explode_stations(collections: DataFrame) -> DataFrame:
    station = collections.select(F.explode("features").alias("s"))
    pair = F.size("s.geometry.coordinates") == 2
    return station.select(F.col("s.id").alias("station"), F.col("s.properties").alias("properties"),
                          F.when(pair, F.col("s.geometry.coordinates")[0]).alias("longitude"),
                          F.when(pair, F.col("s.geometry.coordinates")[1]).alias("latitude"))


def decode_list(text: Column) -> Column:
    """JSON text of numbers to an array."""
    return F.from_json(text, T.ArrayType(T.DoubleType()))


def decode_scores(text: Column) -> Column:
    """JSON text of {setting: score} to a map."""
    return F.from_json(text, T.MapType(T.StringType(), T.DoubleType()))


def explode_members(records: DataFrame, array: str, field: str, key: str = "station_id") -> DataFrame:
    return (records.select(key, F.explode(array).alias("m")).select(key, F.col(f"m.{field}").alias("member"))
            .filter("member IS NOT NULL").distinct())


def expected_record_failures(records: DataFrame, expected: DataFrame, key: str = "station_id") -> DataFrame:
    """Required platforms or identifiers a record lacks, and forbidden platforms it carries.

    ``expected`` has one row per (record, rule, member) with rules require_platform,
    forbid_platform and require_identifier.
    """
    platforms = explode_members(records, "platforms", "platform", key)
    identifiers = explode_members(records, "identifiers", "id", key)

    def rule(name: str) -> DataFrame:
        return expected.filter(F.col("rule") == name).select(key, "member")

    def problem(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(key, F.lit(name).alias("problem"), "member")

    on = [key, "member"]
    return (problem(rule("require_platform").join(platforms, on, "left_anti"), "missing_platform")
            .unionByName(problem(rule("forbid_platform").join(platforms, on, "left_semi"), "forbidden_platform"))
            .unionByName(problem(rule("require_identifier").join(identifiers, on, "left_anti"), "missing_identifier")))
