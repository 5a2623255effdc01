"""Ranks, per-group picks and stratified samples."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.functions.numeric import stable_hash


def row_rank(df: DataFrame, group: str, size: str, tie: str, name: str = "rank") -> DataFrame:
    """Position by descending size with an explicit tie key (for grouped tables)."""
    order = Window.partitionBy(group).orderBy(F.col(size).desc(), tie)
    return df.withColumn(name, F.row_number().over(order))


def size_tertiles(df: DataFrame, key: str) -> DataFrame:
    """small / medium / large by the average percentile rank of each key's frequency.

    Ranks are taken over the distinct frequencies, weighted by how many keys share one.
    """
    freq = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    shared = freq.groupBy("n_rows").agg(F.count(F.lit(1)).alias("_ties"))
    below = Window.orderBy("n_rows").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    pct = ((F.coalesce(F.sum("_ties").over(below), F.lit(0)) + (F.col("_ties") + 1) / 2)
           / F.sum("_ties").over(everything))
    ranks = shared.select("n_rows", pct.alias("percentile"))
    tier = (F.when(F.col("percentile") > 2 / 3, "large").when(F.col("percentile") > 1 / 3, "medium")
            .otherwise("small"))
    return freq.join(ranks, "n_rows").select(key, "n_rows", "percentile", tier.alias("size_tier"))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest declared order per key: a combinable aggregate, no sort."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    name: str = "position") -> DataFrame:
    """First n rows per key; Spark trims each task's rows to n per key before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, position).filter(F.col(name) <= n)


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.col("n_rows").desc(), F.col(key)).limit(k)


def inclusion_order(strata: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Visit order of strata by nested round robin, broadest level first.

    Works on the distinct strata: positions among siblings are ranked from the innermost
    level outwards, each parent taking one stratum of each child in turn.
    """
    parents = list(levels[:-1])
    inner = Window.partitionBy(*parents).orderBy(levels[-1])
    out = strata.select(*levels).distinct().withColumn("_i", F.row_number().over(inner))
    for depth in range(len(levels) - 2, -1, -1):
        above = list(levels[:depth])
        ranked = (Window.partitionBy(*above) if above else Window.partitionBy()).orderBy("_i", levels[depth])
        out = out.withColumn("_i", F.row_number().over(ranked))
    return out.withColumnRenamed("_i", "visit")


def stratified_round_robin(df: DataFrame, levels: Sequence[str], identifier: str, *, per_stratum: int = 2,
                           max_rows: int = 300) -> DataFrame:
    """Up to ``per_stratum`` rows per stratum by hash rank, strata visited in inclusion order, pass by
    pass, until ``max_rows``."""
    visits = inclusion_order(df, levels)
    picks = top_n_per_group(df.withColumn("_hash", stable_hash(F.col(identifier))), levels,
                            [F.col("_hash"), F.col(identifier)], per_stratum, "pass_no")
    return (picks.join(visits, list(levels)).orderBy("pass_no", "visit").limit(max_rows).drop("_hash"))
