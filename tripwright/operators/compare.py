"""Comparing two tables or two runs: keys first, then values, nothing skipped silently."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Verdicts by the largest gap.
IDENTICAL, NEAR, DIFFERENT = "identical", "near", "different"


def _count(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("bigint"))


def _sided(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{side}_{k}") for k in keys],
                     *[F.col(c).alias(f"{side}_v_{c}") for c in df.columns if c not in keys],
                     F.lit(True).alias(f"{side}_here"))


def full_align(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    a, b = _sided(left, keys, "l"), _sided(right, keys, "r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
    return a.join(b, same, "full_outer")


def run_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str], *,
             near: float = 1e-9) -> DataFrame:
    """Per measure: rows compared, rows differing, largest gap, one-sided nulls, verdict; with the
    numbers of keys found on one side only. A measure present on one side only is reported as drift."""
    common = [m for m in measures if m in left.columns and m in right.columns]
    drift = [m for m in measures if (m in left.columns) != (m in right.columns)]
    aligned = full_align(left, right, keys)
    both = F.col("l_here") & F.col("r_here")

    def of(measure: str) -> Column:
        x, y = F.col(f"l_v_{measure}").cast("double"), F.col(f"r_v_{measure}").cast("double")
        gap = F.when(x.isNull() & y.isNull(), 0.0).otherwise(F.abs(x - y))
        return F.struct(F.lit(measure).alias("measure"),
                        _count(both & (gap > 0)).alias("n_differing"),
                        F.max(F.when(both, gap)).alias("max_abs_diff"),
                        _count(both & (x.isNull() != y.isNull())).alias("one_sided_nulls"))

    wide = aligned.agg(_count(both).alias("compared"), _count(F.col("l_here") & F.col("r_here").isNull()).alias("left_only"),
                       _count(F.col("r_here") & F.col("l_here").isNull()).alias("right_only"),
                       *[of(m).alias(f"m_{m}") for m in common])
    rows = wide.select("compared", "left_only", "right_only",
                       F.inline(F.array(*[F.col(f"m_{m}") for m in common])))
    verdict = (F.when((F.col("one_sided_nulls") > 0) | F.col("max_abs_diff").isNull(), DIFFERENT)
               .when(F.col("max_abs_diff") == 0, IDENTICAL)
               .when(F.col("max_abs_diff") <= near, NEAR).otherwise(DIFFERENT))
    rows = rows.withColumn("verdict", verdict)
    for m in drift:
        rows = rows.unionByName(rows.limit(1).select(
            *[F.lit(m).alias(c) if c == "measure" else F.lit(DIFFERENT).alias(c) if c == "verdict"
              else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]))
    return rows


def structural_failures(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Row counts, repeated keys, one-sided keys and one-sided columns of two tables."""
    per_key = (old.groupBy(key).agg(F.count(F.lit(1)).alias("n_old"))
               .join(new.groupBy(key).agg(F.count(F.lit(1)).alias("n_new")), key, "full_outer"))
    return per_key.agg(
        F.sum(F.coalesce("n_old", F.lit(0))).alias("rows_old"),
        F.sum(F.coalesce("n_new", F.lit(0))).alias("rows_new"),
        _count(F.col("n_old") > 1).alias("repeated_old"), _count(F.col("n_new") > 1).alias("repeated_new"),
        _count(F.col("n_new").isNull()).alias("only_old"), _count(F.col("n_old").isNull()).alias("only_new"),
        F.lit(len(set(old.columns) - set(new.columns))).alias("columns_lost"),
        F.lit(len(set(new.columns) - set(old.columns))).alias("columns_added"))


def _differs(x: Column, y: Column, kind: str, tolerance: float) -> Column:
    if kind == "numeric":
        x, y = x.try_cast("double"), y.try_cast("double")
        return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    if kind == "datetime":
        return ~x.try_cast("timestamp_ntz").eqNullSafe(y.try_cast("timestamp_ntz"))
    return ~x.cast("string").eqNullSafe(y.cast("string"))


def typed_diff(old: DataFrame, new: DataFrame, key: str, kinds: dict[str, str], *,
               approved: dict[str, Column] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Per column: cells whose text differs, whose meaning differs, and of those the approved changes.

    ``approved`` conditions see the old row's columns as ``l_v_<name>`` and the new row's as ``r_v_<name>``.
    """
    approved = approved or {}
    joined = _sided(old, [key], "l").join(_sided(new, [key], "r"), F.col(f"l_{key}") == F.col(f"r_{key}"))

    def of(column: str, kind: str) -> Column:
        x, y = F.col(f"l_v_{column}"), F.col(f"r_v_{column}")
        raw = ~x.cast("string").eqNullSafe(y.cast("string"))
        meaning = _differs(x, y, kind, tolerance)
        allowed = meaning & approved.get(column, F.lit(False))
        return F.struct(F.lit(column).alias("column"), F.lit(kind).alias("kind"),
                        _count(raw).alias("raw_mismatch"), _count(meaning).alias("meaning_mismatch"),
                        _count(allowed).alias("approved_change"))

    wide = joined.agg(*[of(c, k).alias(f"c_{c}") for c, k in kinds.items()])
    rows = wide.select(F.inline(F.array(*[F.col(f"c_{c}") for c in kinds])))
    return rows.withColumn("unexpected", F.col("meaning_mismatch") - F.col("approved_change")).withColumn(
        "format_only", F.col("raw_mismatch") - F.col("meaning_mismatch"))


def paired_deltas(runs: DataFrame, unit: str, variant: str, baseline: str, metrics: Sequence[str], *,
                  same: Sequence[str] = ("n_rows", "fold_fingerprint")) -> DataFrame:
    """Metric minus the baseline's metric within each unit, in long form.

    Raises at run time when a unit's variants used other rows or folds.
    """
    base = runs.filter(F.col(variant) == baseline).select(
        F.col(unit).alias("_unit"), *[F.col(c).alias(f"_b_{c}") for c in (*same, *metrics)])
    others = runs.filter(F.col(variant) != baseline)
    joined = others.join(base, F.col(unit) == F.col("_unit"))
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    checked = F.when(equal, F.lit(True)).otherwise(
        F.raise_error(F.lit("variants used different rows or folds")).cast("boolean"))
    return joined.filter(checked).select(F.col(unit), F.col(variant), F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"_b_{m}").cast("double").alias("value_baseline"),
                 F.col(m).cast("double").alias("value_variant"),
                 (F.col(m) - F.col(f"_b_{m}")).cast("double").alias("delta")) for m in metrics])))


def summarize_by(long: DataFrame, keys: Sequence[str], value: str, unit: str) -> DataFrame:
    """Mean, sample deviation, range, values by unit and whether all share one strict sign.

    ``unit`` is the seed of a run: a handful of values per key.
    """
    v = F.col(value)
    by_unit = F.sort_array(F.collect_list(F.struct(F.col(unit), v.alias("v"))))
    return long.groupBy(*keys).agg(
        F.count(v).alias("n_units"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.map_from_entries(by_unit).alias("values_by_unit"),
        (F.bool_and(v > 0) | F.bool_and(v < 0)).alias("sign_consistent"))


def set_difference_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys shared, only left and only right, in one aggregation of the stacked keys."""
    stacked = (left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
               .unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))))
    present = stacked.groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return present.agg(_count((F.col("_l") == 1) & (F.col("_r") == 1)).alias("shared"),
                       _count(F.col("_r") == 0).alias("only_left"), _count(F.col("_l") == 0).alias("only_right"))


def set_equality(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Are two id sets equal and free of repeats? One row of counts and the verdict."""
    found = structural_failures(left.select(key), right.select(key), key)
    clean = ((F.col("repeated_old") == 0) & (F.col("repeated_new") == 0)
             & (F.col("only_old") == 0) & (F.col("only_new") == 0))
    return found.select("rows_old", "rows_new", "repeated_old", "repeated_new", "only_old", "only_new",
                        clean.alias("equal_sets"))
