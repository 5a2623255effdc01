"""CSV sources and sinks with explicit schemas and an explicit null token."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tripwright.schemas import CSV_NULL, SOURCE_COLUMNS, SOURCE_SCHEMA

# A quote inside a quoted field is doubled; every file's header must name the schema's columns.
READ_OPTIONS = {"header": True, "quote": '"', "escape": '"', "enforceSchema": False}
WRITE_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


def read_trips(spark: SparkSession, path: str, *, schema: T.StructType = SOURCE_SCHEMA,
               columns: Sequence[str] | None = None, with_weather: bool = False, short_names: bool = True
               ) -> DataFrame:
    """Typed scan of the trip CSV. Columns get their type by header name (the same header in every
    file), a byte-order mark does no harm, and the weather-merged variant's stale hour is dropped."""
    raw = spark.read.schema(_header_schema(spark, path, schema)).options(**READ_OPTIONS).csv(path)
    if with_weather:
        raw = raw.drop("Dep_Hour")
    if columns is not None:
        raw = raw.select(*[F.col(f"`{c}`") for c in columns])
    numeric = [f.name for f in raw.schema if isinstance(f.dataType, T.DoubleType)]
    raw = raw.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in numeric})
    if not short_names:
        return raw
    return raw.select(*[F.col(f"`{c}`").alias(SOURCE_COLUMNS.get(c, c)) for c in raw.columns])


def _header_schema(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """The known types in the order of the header; unknown columns stay text. Reads the header only."""
    names = spark.read.options(**WRITE_OPTIONS).csv(path).columns
    known = {f.name: f.dataType for f in schema}
    clean = [n.removeprefix("﻿") for n in names]
    lost = sorted(set(known) - set(clean))
    if lost:
        raise ValueError(f"CSV lacks columns: {lost}")
    return T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in clean])


def text_with_null_token(df: DataFrame, token: str) -> DataFrame:
    """All-text CSV rows in which only ``token`` is null. The CSV reader itself turns an empty field
    into null, so a null read here is a blank."""
    return df.select(*[F.when(F.coalesce(F.col(f"`{c}`") != token, F.lit(True)),
                              F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in df.columns])


def read_null_token(spark: SparkSession, path: str, schema: T.StructType, *,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """CSV in which only the null token is null; blank text stays blank."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = text_with_null_token(spark.read.schema(texts).options(**READ_OPTIONS).csv(path), CSV_NULL)
    wanted = [f for f in schema if columns is None or f.name in columns]
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def reserved_token_count(df: DataFrame) -> DataFrame:
    """How many text values already equal the null token."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    hits = [F.count(F.when(F.col(c) == CSV_NULL, 1)) for c in texts] or [F.lit(0)]
    return df.agg(sum(hits[1:], hits[0]).alias("reserved_values"))


def write_null_token(df: DataFrame, path: str, *, order: str | None = None) -> None:
    """Write with the null token; a text value that equals it fails the job instead of being lost."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    guarded = df.withColumns({c: F.when(F.coalesce(F.col(c) != CSV_NULL, F.lit(True)), F.col(c)).otherwise(
        F.raise_error(F.lit(f"{c} holds the reserved null token")).cast("string")) for c in texts})
    if order is not None:
        guarded = guarded.sortWithinPartitions(order)
    guarded.write.options(**WRITE_OPTIONS).option("nullValue", CSV_NULL).option("emptyValue", "").csv(path)


def write_extract(df: DataFrame, path: str, *, order: Sequence[str]) -> DataFrame:
    """A small aggregated extract as one LF-only CSV file with ten significant digits.

    Returns the record of what was written, see ``extract_record``.
    """
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    shown = df.withColumns({c: F.when(F.col(c).isNotNull(), _short_decimal(F.col(c))) for c in doubles})
    (shown.orderBy(*order).coalesce(1).write.options(**WRITE_OPTIONS).option("lineSep", "\n").csv(path))
    return extract_record(df.sparkSession, path)


def extract_record(spark: SparkSession, path: str) -> DataFrame:
    """(n_rows, n_bytes, sha256) of an extract's one file as it lies there, for the log of a run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.csv").load(path)
    rows = spark.read.options(**WRITE_OPTIONS).csv(path).agg(F.count(F.lit(1)).alias("n"))
    return files.select(rows.scalar().alias("n_rows"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def _short_decimal(value):
    """Ten significant digits without trailing zeros."""
    digits = F.lit(9) - F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), F.when(value == 0, F.lit(0)).otherwise(digits))
    rounded = F.when(value == 0, F.lit(0.0)).otherwise(F.rint(value * scale) / scale)
    whole = rounded == F.floor(rounded)
    return F.when(whole & (F.abs(rounded) < 1e15), rounded.cast("bigint").cast("string")).otherwise(rounded.cast("string"))


def sample_prefix(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in a declared order: a bare limit would depend on partitioning."""
    return df.orderBy(order).limit(n)


def ordered_merge(parts: Sequence[DataFrame], ordinal: str) -> DataFrame:
    """Stack parts and restore the original order."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.orderBy(ordinal)


def ordinal_check(merged: DataFrame, expected: DataFrame, ordinal: str, identifier: str) -> DataFrame:
    """Ordinals run 0..n-1 once each and carry the expected identifier."""
    per = merged.groupBy(ordinal).agg(F.count(F.lit(1)).alias("n"), F.min(identifier).alias("_id"))
    joined = per.join(expected.select(F.col(ordinal), F.col(identifier).alias("_want")), ordinal, "full_outer")
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.min(ordinal).alias("first"), F.max(ordinal).alias("last"),
        F.count(F.when(F.col("n") > 1, 1)).alias("repeated"),
        F.count(F.when(~F.col("_id").eqNullSafe(F.col("_want")), 1)).alias("misplaced"))
