"""Interval sets per station: union, difference, splitting and request batches.

Sweeps run inside (station, time bucket) groups with carried state, so a station with
very many intervals is spread over its buckets.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.functions import clock
from tripwright.operators.skew import carry_in
from tripwright.storage import Settle, unsettled


def _days(ts: Column, days: int) -> Column:
    return F.floor(clock.hour_number(ts) / (24 * days))


def merge_intervals(df: DataFrame, by: str, start: str = "start", end: str = "end", *,
                    bucket_days: int = 1) -> DataFrame:
    """Union of overlapping or touching intervals per station."""
    rows = (df.filter(F.col(by).isNotNull()).groupBy(by, start).agg(F.max(end).alias(end))
            .withColumn("_bucket", _days(F.col(start), bucket_days)))
    rows = carry_in(rows, [by], {"_end_before": F.col(end)}, combine="max")
    inside = (Window.partitionBy(by, "_bucket").orderBy(start)
              .rowsBetween(Window.unboundedPreceding, -1))
    reached = F.greatest(F.max(end).over(inside), F.col("_end_before"))
    rows = rows.withColumn("_new", F.coalesce(F.col(start) > reached, F.lit(True)).cast("int")).drop("_end_before")
    rows = carry_in(rows, [by], {"_islands_before": F.col("_new")})
    so_far = (Window.partitionBy(by, "_bucket").orderBy(start)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    island = F.sum("_new").over(so_far) + F.coalesce("_islands_before", F.lit(0))
    return (rows.withColumn("_island", island).groupBy(by, "_island")
            .agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island"))


def _edges(df: DataFrame, by: str, start: str, end: str, side: str) -> DataFrame:
    return df.select(F.col(by), F.inline(F.array(
        F.struct(F.col(start).alias("_t"), F.lit(1).alias(side)),
        F.struct(F.col(end).alias("_t"), F.lit(-1).alias(side)))))


def subtract_intervals(target: DataFrame, covered: DataFrame, by: str, start: str = "start",
                       end: str = "end", *, bucket_days: int = 1, settle: Settle = unsettled) -> DataFrame:
    """Parts of the target union that no covered interval really overlaps, per station.

    One signed sweep: every edge opens (+1) or closes (-1) a target or a cover, and one carry
    brings both depths into each bucket. A part begins where the state turns to wanted (inside a
    target, under no cover) and ends where it turns back, so touching parts are one already.
    ``settle`` may write the edges once, summed by time; both sources are then read once.
    """
    edges = (_edges(target, by, start, end, "_target")
             .unionByName(_edges(covered, by, start, end, "_covered"), allowMissingColumns=True))
    points = settle(edges.filter(F.col(by).isNotNull()).groupBy(by, "_t")
                    .agg(F.coalesce(F.sum("_target"), F.lit(0)).alias("_target"),
                         F.coalesce(F.sum("_covered"), F.lit(0)).alias("_covered"))
                    .withColumn("_bucket", _days(F.col("_t"), bucket_days)), "edges")
    points = carry_in(points, [by], {"_target_before": F.col("_target"), "_covered_before": F.col("_covered")})
    order = Window.partitionBy(by, "_bucket").orderBy("_t")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def depth(side: str) -> Column:
        return F.sum(side).over(so_far) + F.coalesce(f"{side}_before", F.lit(0))

    depths = points.withColumns({"_targets": depth("_target"), "_covers": depth("_covered")})
    wanted = (F.col("_targets") > 0) & (F.col("_covers") == 0)
    wanted_before = (F.col("_targets") > F.col("_target")) & (F.col("_covers") == F.col("_covered"))
    turns = depths.filter(wanted != wanted_before).select(by, "_t", "_bucket", wanted.alias("_opens"))
    turns = carry_in(turns, [by], {"_t_after": F.col("_t")}, combine="min", backward=True)
    parts = turns.select(by, F.col("_t").alias(start), F.coalesce(F.lead("_t").over(order), F.col("_t_after")).alias(end), "_opens")
    return parts.filter("_opens").drop("_opens")


def split_intervals(df: DataFrame, max_hours: float, start: str = "start", end: str = "end") -> DataFrame:
    """Cut intervals longer than the cap into ceil(length / cap) equal pieces."""
    micros = clock.micros_between(F.col(start), F.col(end))
    pieces = F.when((micros > max_hours * 3.6e9) & F.lit(max_hours > 0),
                    F.ceil(micros / (max_hours * 3.6e9))).otherwise(F.lit(1)).cast("int")
    cut = (df.withColumn("_pieces", pieces).withColumn("_micros", micros)
           .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))))

    def at(position: Column) -> Column:
        offset = F.floor(F.col("_micros") * position / F.col("_pieces"))
        return F.col(start) + F.make_dt_interval(secs=offset.cast("decimal(18,0)").cast("decimal(24,6)") / 1000000)

    return cut.select(*[c for c in df.columns if c not in (start, end)], "piece",
                      at(F.col("piece")).alias(start), at(F.col("piece") + 1).alias(end))


def day_groups(df: DataFrame, stations: Sequence[str], cutoff: str) -> DataFrame:
    """Requests per (station, day) over both roles."""
    roles = F.explode(F.array(*[F.col(s) for s in stations]))
    long = df.select(roles.alias("station"), F.col(cutoff).alias("_at")).filter("station IS NOT NULL AND _at IS NOT NULL")
    return long.groupBy("station", F.date_format(F.col("_at").cast("date"), "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.min("_at").alias("first_at"), F.max("_at").alias("last_at"))


def month_demand(df: DataFrame, station: str, cutoff: str, back_minutes: int, network: str) -> DataFrame:
    """Distinct (station, network, month) needed: the cutoff's month and that of the look-back start."""
    earlier = F.col(cutoff) - F.make_dt_interval(mins=F.lit(back_minutes))
    months = F.explode(F.array(clock.month_key(F.col(cutoff)), clock.month_key(earlier)))
    return (df.filter(F.col(station).isNotNull() & F.col(cutoff).isNotNull())
            .select(F.col(station).alias("station"), F.col(network).alias("network"), months.alias("month"))
            .distinct())


def batch_and_shard(demand: DataFrame, *, stations_per_request: int, shard_size: int) -> DataFrame:
    """Batches of stations per (month, network), numbered in order, and cut into shards.

    The plan has one row per (month, network, station), a dimension-sized table; arrays hold
    at most ``stations_per_request`` stations.
    """
    in_month = Window.partitionBy("month", "network").orderBy("station")
    batches = (demand.select("month", "network", "station").distinct()
               .withColumn("_batch", F.floor((F.row_number().over(in_month) - 1) / stations_per_request))
               .groupBy("month", "network", "_batch")
               .agg(F.sort_array(F.collect_list("station")).alias("stations")))
    per_month = batches.groupBy("month", "network").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("month", "network").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_month.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ordinal = (F.col("_batch") + F.col("_offset")).cast("bigint")
    return (batches.join(offsets, ["month", "network"])
            .select(ordinal.alias("ordinal"), F.floor(ordinal / shard_size).alias("shard"), "month", "network",
                    "stations", F.size("stations").alias("n_stations")))
