"""Order-dependent work split so that no task ever holds a whole key.

Running totals, ranks and quantiles need an order. A plain window by key puts all
rows of a hot key into one task; a plain global window puts the whole table there.
Each helper here cuts a key's rows into buckets that follow the order, aggregates
one small row per (key, bucket), scans those small rows, and finishes inside each
bucket.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.storage import materialize

BUCKET = "_bucket"


def by_shuffle(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the rows, never broadcast: Spark sizes it by compressed files and
    short arrays, and leaves out what an explode adds, so it may look small to the planner and not fit the driver."""
    return side.hint("merge")


def join_null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null, keeping the left side's key columns."""
    renamed = right.select(*[F.col(n).alias(f"_right_{n}") for n in names],
                           *[c for c in right.columns if c not in names])
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"_right_{n}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{n}" for n in names])


def carry_in(df: DataFrame, keys: Sequence[str], carried: dict[str, Column], *, bucket: str = BUCKET,
             combine: str = "sum", backward: bool = False, many: bool = False) -> DataFrame:
    """Add to each row the combined value of all earlier (or later) buckets of its key.

    ``carried`` maps output names to the column aggregated per bucket. The scanned
    table has one row per (key, bucket), too many to broadcast where keys are ``many``. Null keys are
    keys like any other.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[combine]
    small = df.groupBy(*keys, bucket).agg(*[agg(c).alias(n) for n, c in carried.items()])
    order = F.col(bucket).desc() if backward else F.col(bucket)
    before = (Window.partitionBy(*keys).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    small = small.select(*keys, bucket, *[agg(n).over(before).alias(n) for n in carried])
    return join_null_safe(df, by_shuffle(small) if many else small, [*keys, bucket])


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   totals: dict[str, Column], *, bucket: str = BUCKET, many: bool = False) -> DataFrame:
    """Inclusive running sums over ``order``; ``bucket`` must be monotone in that order."""
    out = carry_in(df, keys, {f"_before_{n}": c for n, c in totals.items()}, bucket=bucket, many=many)
    inside = (Window.partitionBy(bucket, *keys).orderBy(*order)  # sorts compare the bucket first, which has most values
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for name, value in totals.items():
        out = out.withColumn(name, F.sum(value).over(inside) + F.coalesce(f"_before_{name}", F.lit(0)))
    return out.drop(*[f"_before_{n}" for n in totals])


def row_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, *,
              bucket: str = BUCKET, many: bool = False) -> DataFrame:
    """1-based row numbers over ``order`` within the keys."""
    out = carry_in(df, keys, {"_rows_before": F.lit(1)}, bucket=bucket, many=many)
    inside = Window.partitionBy(bucket, *keys).orderBy(*order)
    rank = F.row_number().over(inside) + F.coalesce("_rows_before", F.lit(0))
    return out.withColumn(name, rank.cast("bigint")).drop("_rows_before")


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based row numbers over ``order`` within the keys, for values of any kind and spacing.

    Rows are range-partitioned by keys and order and written once; each partition is a
    bucket, so no task scans more than one row per partition.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(BUCKET, F.spark_partition_id())
    return row_ranks(materialize(ranged, "ranged"), keys, order, name).drop(BUCKET)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value) with its count: ties collapse before any ordering."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("n")))


def exact_quantile_array(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], *,
                         buckets: int = 256) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without sorting a key in one task.

    Values are first counted, then cut into buckets at approximate quantiles of the distinct
    values, so that neither ties nor outliers fill a bucket; only buckets that hold a wanted
    rank are ordered. Returns the keys, ``n_values`` and the array ``quantiles`` in the order
    of ``probs``.
    """
    keys = list(keys)
    counted = value_counts(df, keys, value).select(*keys, F.col(value).cast("double").alias("_v"), "n")
    cuts = F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10_000)
    span = counted.groupBy(*keys).agg(cuts.alias("_cuts"), F.sum("n").alias("n_values"))
    if keys:
        placed = join_null_safe(counted, span, keys)
    else:  # two scalars instead of a join without a key
        placed = counted.withColumns({c: span.select(c).scalar() for c in ("_cuts", "n_values")})
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    placed = placed.select(*keys, "_v", "n", "n_values", bucket.alias(BUCKET))
    work = keys

    wanted_probs = F.array(*[F.lit(float(q)) for q in probs])

    def position(q: Column) -> Column:
        return (F.col("n_values") - 1) * q

    ranks = F.array_distinct(F.flatten(F.transform(
        wanted_probs, lambda q: F.array(F.floor(position(q)), F.ceil(position(q))))))
    small = placed.groupBy(*work, BUCKET).agg(F.sum("n").alias("_in"), F.any_value("n_values").alias("n_values"))
    before = Window.partitionBy(*work).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    small = small.filter(F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in"))))

    hot = join_null_safe(placed, small.select(*work, BUCKET, "_before"), [*work, BUCKET])
    inside = (Window.partitionBy(*work, BUCKET).orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hot = hot.withColumn("_end", F.sum("n").over(inside) + F.col("_before"))
    hits = hot.withColumn("_rank", F.explode(F.filter(
        ranks, lambda r: (r >= F.col("_end") - F.col("n")) & (r < F.col("_end")))))
    picked = hits.groupBy(*work, "n_values").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def interpolated(q: Column) -> Column:
        low = F.element_at("_at", F.floor(position(q)))
        high = F.element_at("_at", F.ceil(position(q)))
        return low + (high - low) * (position(q) - F.floor(position(q)))

    return picked.select(*keys, "n_values", F.transform(wanted_probs, interpolated).alias("quantiles"))


def values_at_shares(counted: DataFrame, keys: Sequence[str], value: str, n: str, shares: Sequence[float]) -> DataFrame:
    """The (keys, value) rows of ``counted`` that hold the value of 1-based rank ceil(share * total) for any share.

    ``counted`` has one row per (keys, value) with its count. Rows are range-partitioned and written once,
    so no task orders more than one partition.
    """
    ranged = counted.repartitionByRange(*[F.col(c) for c in (*keys, value)]).withColumn(BUCKET, F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    until = running_totals(ranged, keys, [F.col(value)], {"_until": F.col(n)})
    placed = join_null_safe(until, ranged.groupBy(*keys).agg(F.sum(n).alias("_total")), keys)
    ranks = F.transform(F.array(*[F.lit(float(q)) for q in shares]), lambda q: F.ceil(q * F.col("_total")))
    return placed.filter(F.exists(ranks, lambda r: (r > F.col("_until") - F.col(n)) & (r <= F.col("_until")))).select(*keys, value)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``exact_quantile_array`` with one named column per quantile."""
    arrays = exact_quantile_array(df, keys, value, list(probs.values()))
    return arrays.select(*keys, "n_values", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(probs)])
