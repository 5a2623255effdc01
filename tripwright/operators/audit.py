"""Accounting of what cleaning restored, fingerprints and attempt logs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tripwright.functions import clock
from tripwright.functions.text import ERROR_RULES, first_rule
from tripwright.operators import clean
from tripwright.operators.report import count_if
from tripwright.schemas import MISSING_HOUR
from tripwright.storage import Settle, unsettled


def imputation_accounting(df: DataFrame, key: str = "carrier_code", value: str = "airline", *,
                          order: str = "flight_id", counted: Column | None = None) -> DataFrame:
    """original = restored + residual for the 'first' and 'unique' rules, residual split by reason.

    The mapping is fitted on all rows; ``counted`` selects the rows that are counted.
    """
    both = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    per_key = both.groupBy(key).agg(F.min_by(value, order).alias("_first"), F.min(value).alias("_lo"),
                                    F.max(value).alias("_hi"))
    joined = df.withColumn("_counted", F.lit(True) if counted is None else counted).join(per_key, key, "left")
    base = F.col("_counted") & F.col(value).isNull()
    single = F.col("_lo") == F.col("_hi")
    seen = F.col("_lo").isNotNull()
    counts = joined.agg(
        count_if(F.col("_counted")).alias("population_rows"), count_if(base).alias("original_missing"),
        count_if(base & seen).alias("first_restored"), count_if(base & ~seen).alias("first_residual"),
        count_if(base & seen & single).alias("unique_restored"),
        count_if(base & (~seen | ~single)).alias("unique_residual"),
        count_if(base & F.col(key).isNull()).alias("key_missing"),
        count_if(base & F.col(key).isNotNull() & ~seen).alias("key_never_observed"),
        count_if(base & seen & ~single).alias("key_ambiguous"))
    return counts.withColumn("identity_holds", (
        (F.col("original_missing") == F.col("first_restored") + F.col("first_residual"))
        & (F.col("original_missing") == F.col("unique_restored") + F.col("unique_residual"))
        & (F.col("unique_residual") == F.col("key_missing") + F.col("key_never_observed") + F.col("key_ambiguous"))))


def time_restore_accounting(df: DataFrame, counted: Column | None = None, *, settle: Settle = unsettled) -> DataFrame:
    """The same identity for hours and the clock gap, with the source of each restored gap."""
    marked = df.withColumn("_counted", F.lit(True) if counted is None else counted)
    before = clean.time_features(clean.with_route(marked), keep_minute=True).withColumns({
        "_dep0": F.col("dep_hour") == MISSING_HOUR, "_arr0": F.col("arr_hour") == MISSING_HOUR})
    before = before.withColumn("_gap0", F.col("duration").isNull()).withColumn("_raw_gap", F.col("duration"))
    counts = settle(clean.gap_counts(before), "gap-counts")
    medians = clean.group_medians(counts, name="_rm").drop("n_null")
    after = clean.restore_times(before, settle=lambda df, stem: counts).join(medians, "route", "left")
    c = F.col("_counted")
    dep1, arr1 = F.col("dep_hour") == MISSING_HOUR, F.col("arr_hour") == MISSING_HOUR

    def outside(column: str) -> Column:
        v = clock.number(F.col(column))
        return c & ((F.floor(v / 100) > 23) | (v % 100 > 59))

    def side(original: Column, post: Column, name: str) -> list[Column]:
        return [count_if(c & original).alias(f"{name}_original"), count_if(c & original & ~post).alias(f"{name}_restored"),
                count_if(c & post).alias(f"{name}_residual")]

    gap0 = F.col("_gap0")
    return after.agg(
        count_if(c).alias("population_rows"),
        *side(F.col("_dep0"), dep1, "dep_hour"), *side(F.col("_arr0"), arr1, "arr_hour"),
        *side(gap0, F.col("duration").isNull(), "gap"),
        count_if(c & gap0 & F.col("_rm").isNotNull()).alias("gap_by_route_median"),
        count_if(c & gap0 & F.col("_rm").isNull()).alias("gap_by_global_median"),
        count_if(c & gap0 & (F.col("duration") == 0)).alias("gap_restored_zero"),
        count_if(c & (F.col("_raw_gap") == 0)).alias("gap_zero_before"),
        count_if(outside("dep_hhmm")).alias("dep_outside_clock"), count_if(outside("arr_hhmm")).alias("arr_outside_clock"),
        F.median(F.coalesce("_raw_gap", "_rm")).alias("global_median_after_route_fill"),
        F.median("_raw_gap").alias("global_median_before_route_fill"))


def traffic_accounting(restored: DataFrame, year: str, counted: Column | None = None) -> DataFrame:
    """Null slots, smallest count, rows alone in their slot, and rows whose slot mixes years."""
    marked = restored.withColumn("_counted", F.lit(True) if counted is None else counted)
    out = None
    for name, airport, hour in (("origin_traffic", "origin", "dep_hour"), ("dest_traffic", "dest", "arr_hour")):
        keys = ["mo", "dom", airport, hour]
        valid = F.col(hour) != MISSING_HOUR
        slots = marked.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), count_if(F.col("_counted")).alias("_c"),
            F.min(year).alias("_lo"), F.max(year).alias("_hi"))
        known, c = F.when(valid, F.col("_n")), F.col("_c")
        part = slots.agg(
            F.lit(name).alias("feature"), F.sum(F.when(~valid, c).otherwise(0)).alias("null_rows"),
            F.min(F.when(c > 0, known)).alias("min_value"), F.sum(F.when(known == 1, c).otherwise(0)).alias("rows_alone"),
            F.sum(F.when(valid & (F.col("_lo") != F.col("_hi")), c).otherwise(0)).alias("rows_in_mixed_years"))
        out = part if out is None else out.unionByName(part)
    return out


def table_fingerprint(df: DataFrame, columns: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """Order-free fingerprint of the listed columns: row count and two sums of row hash parts.

    Each row's values as text, joined by bars (null as backslash N), are hashed by SHA-256;
    its first and next twelve hex digits are summed. Combinable, so no rows are collected, and
    any engine that writes the values alike gives the same text; doubles should be scaled to
    whole numbers first.
    """
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    hashed = df.select(F.sha2(row, 256).alias("h"))

    def part(start: int) -> Column:
        return F.sum(F.conv(F.substring("h", start, 12), 16, 10).cast("decimal(38,0)"))

    parts = hashed.agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(13).alias("b"))
    text = F.concat_ws(":", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("n", "a", "b")])
    return parts.select(F.col("n").alias("n_rows"), F.sha2(text, 256).alias(name))


def status_summary(df: DataFrame, keys: Sequence[str], statuses: Sequence[str], status: str = "status") -> DataFrame:
    """Rows per key and status; a status outside the list raises at run time."""
    known = F.when(F.col(status).isin(*statuses), F.lit(True)).otherwise(
        F.raise_error(F.lit("unknown status")).cast("boolean"))
    return df.filter(known).groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n_rows"))


def attempt_audit(requests: DataFrame, key: str, attempts: str = "attempts") -> DataFrame:
    """Totals over nested attempt records: successes, retries, unmeasured sizes, error classes, and
    whether each request's declared number of attempts is the real one."""
    per_request = requests.select(
        key, (F.col("declared_attempts") == F.size(attempts)).alias("_declared_ok"), F.explode_outer(attempts).alias("a"),
        F.size(attempts).alias("_n"))
    failed = F.col("a").isNotNull() & ~F.col("a.ok")
    error = F.when(failed, first_rule(F.col("a.error"), ERROR_RULES, "other"))
    classes = [name for _, name in ERROR_RULES] + ["other"]
    rows = per_request.withColumn("_error", error)
    return rows.agg(
        F.count("a").alias("attempts"), count_if(F.col("a.ok")).alias("succeeded"), count_if(failed).alias("failed"),
        count_if(F.col("a").isNotNull() & F.col("a.bytes").isNull()).alias("unmeasured"),
        F.coalesce(F.sum("a.bytes"), F.lit(0)).alias("bytes"),
        count_if(F.col("a").isNull()).alias("requests_without_attempts"),
        count_if(~F.col("_declared_ok")).alias("attempts_of_misdeclared_requests"),
        *[count_if(F.col("_error") == n).alias(f"error_{n}") for n in classes])
