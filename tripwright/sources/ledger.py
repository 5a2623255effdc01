"""The run ledger: one row per (run, phase), replaced by writing a new version."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tripwright.operators.report import count_if


def ledger_violations(rows: DataFrame, run_id: str, expected: T.StructType | None = None) -> DataFrame:
    """Repeated phases, rows of another run, null cells and, if given, schema drift."""
    if expected is not None and [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in expected]:
        raise ValueError("ledger schema differs from the expected one")
    per_phase = rows.groupBy("phase_key").agg(
        F.count(F.lit(1)).alias("n"), count_if(~F.col("run_id").eqNullSafe(F.lit(run_id))).alias("foreign"),
        count_if(F.greatest(*[F.col(c).isNull() for c in rows.columns])).alias("malformed"))
    return per_phase.agg(F.sum("n").alias("n_rows"), count_if(F.col("n") > 1).alias("repeated_phases"),
                         F.sum("foreign").alias("foreign_runs"), F.sum("malformed").alias("malformed_rows"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace the old ones of the same (run, phase); all others stay."""
    if set(old.columns) != set(new.columns):
        raise ValueError("ledger and new rows have different columns")
    return old.join(new.select("run_id", "phase_key"), ["run_id", "phase_key"], "left_anti").unionByName(new)


def write_version(spark: SparkSession, rows: DataFrame, folder: str, version: int) -> str:
    """Write a complete version next to the earlier ones; readers pick the highest number."""
    path = f"{folder.rstrip('/')}/version={version}"
    rows.write.parquet(path)
    return path


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the newest version (the partition column prunes all others)."""
    versions = spark.read.parquet(folder)
    newest = versions.select("version").agg(F.max("version").alias("v"))
    return versions.filter(F.col("version") == newest.scalar()).drop("version")
