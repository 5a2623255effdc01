"""Row cleaning: splits, order-free imputation, clock restoration, slot counts, feature columns."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tripwright.functions import clock, numeric, text
from tripwright.operators.skew import join_null_safe
from tripwright.storage import Settle, unsettled
from tripwright.schemas import DROP_PRESETS, MISSING_HOUR, OUTCOME_COLUMNS, TIERS, ELIGIBLE_TIER

IMPUTE_PAIRS = (("carrier_code", "airline"), ("origin", "origin_state"), ("dest", "dest_state"))


# ---- projections and splits -------------------------------------------------

def prune_columns(df: DataFrame, preset: str = "pruned", extra: Iterable[str] = ()) -> DataFrame:
    if preset not in DROP_PRESETS:
        raise ValueError(f"unknown preset {preset!r}; known: {sorted(DROP_PRESETS)}")
    return df.drop(*DROP_PRESETS[preset], *extra)


def labeled_rows(df: DataFrame, target: str = "delay", mapping: dict[str, int] | None = None) -> DataFrame:
    """Labeled rows with ``y`` in place of the label text; an unknown text raises."""
    return (df.filter(text.is_labeled(F.col(target)))
            .withColumn("y", text.checked_label(F.col(target), mapping)).drop(target))


def unlabeled_rows(df: DataFrame, target: str = "delay") -> DataFrame:
    return df.filter(~text.is_labeled(F.col(target))).drop(target)


def split_labeled(df: DataFrame, target: str = "delay", mapping: dict[str, int] | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    return labeled_rows(df, target, mapping), unlabeled_rows(df, target)


def normalize_keys(df: DataFrame, text_keys: Sequence[str], integer_keys: Sequence[str] = ()) -> DataFrame:
    fixed = {c: text.normal_text(F.col(c)) for c in text_keys}
    fixed |= {c: text.normal_integer(F.col(c)) for c in integer_keys}
    return df.withColumns(fixed)


def missing_flags(df: DataFrame, identifier: str = "flight_id", target: str = "delay") -> DataFrame:
    """Labeled rows as id, y_true and one ``raw_missing__<column>`` 0/1 per other column."""
    columns = [c for c in df.columns if c not in (identifier, target)]
    return df.filter(text.is_labeled(F.col(target))).select(
        F.col(identifier), text.checked_label(F.col(target)).alias("y_true"),
        *[F.col(c).isNull().cast("int").alias(f"raw_missing__{c}") for c in columns])


def complete_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def incomplete_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.filter(F.greatest(*[F.col(k).isNull() for k in keys]))


def forbidden_columns(df: DataFrame, forbidden: Iterable[str] = OUTCOME_COLUMNS) -> list[str]:
    return sorted(c for c in df.columns if c.casefold() in set(forbidden))


def reject_forbidden_columns(df: DataFrame, forbidden: Iterable[str] = OUTCOME_COLUMNS) -> DataFrame:
    found = forbidden_columns(df, forbidden)
    if found:
        raise ValueError(f"outcome columns may not enter a feature join: {found}")
    return df


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prefix every column but ``keep``; a name that already exists raises."""
    renamed = {c: c if c in keep else prefix + c for c in df.columns}
    clash = sorted(set(renamed.values()) & (set(df.columns) - set(keep)))
    if clash or len(set(renamed.values())) != len(renamed):
        raise ValueError(f"reserved output columns: {clash}")
    return df.select(*[F.col(c).alias(n) for c, n in renamed.items()])


def tier_rank(tier: Column) -> Column:
    rank = F.lit(None).cast("int")
    for position, name in enumerate(TIERS):
        rank = F.when(tier == name, F.lit(position)).otherwise(rank)
    return rank


def worst_tier(df: DataFrame, origin_tier: str, dest_tier: str) -> DataFrame:
    """Row tier = the worse of both airports; only rows good at both ends are eligible."""
    worst = F.greatest(tier_rank(F.col(origin_tier)), tier_rank(F.col(dest_tier)))
    unknown = F.col(origin_tier).isNull() | F.col(dest_tier).isNull()
    tier = F.when(~unknown, F.element_at(F.array(*[F.lit(t) for t in TIERS]), worst + 1))
    reason = F.concat(F.lit("origin="), F.col(origin_tier), F.lit(",destination="), F.col(dest_tier))
    return (df.withColumn("row_tier", tier)
            .withColumn("eligible", F.coalesce(F.col("row_tier") == ELIGIBLE_TIER, F.lit(False)))
            .withColumn("ineligible_reason", F.when(F.col("eligible"), "").otherwise(reason)))


def masked_requests(df: DataFrame, station: str, eligible: str, cutoff: str) -> DataFrame:
    """Null the station of rows that may not match, so they cannot match by accident."""
    usable = F.coalesce(F.col(eligible), F.lit(False)) & F.col(cutoff).isNotNull()
    return df.withColumn(station, F.when(usable, F.col(station)))


def report_dims(df: DataFrame) -> DataFrame:
    """All reporting dimensions in one projection."""
    dep, arr = clock.hour_order(F.col("dep_hhmm")), clock.hour_order(F.col("arr_hhmm"))
    return df.withColumns({
        "airline": text.category(F.col("airline")),
        "carrier_code": text.category(F.col("carrier_code")),
        "dep_hour_order": dep, "dep_hour_label": clock.hour_label(dep),
        "arr_hour_order": arr, "arr_hour_label": clock.hour_label(arr),
        "raw_time_pattern": text.time_pattern(F.col("dep_hhmm"), F.col("arr_hhmm")),
        "route": text.route_key(F.col("origin"), F.col("dest"), "-"),
        "month": F.col("mo").cast("bigint"),
    })


# ---- imputation -------------------------------------------------------------

def observed_mapping(df: DataFrame, key: str, value: str, conflict: str = "unique",
                     order: str | None = None) -> DataFrame:
    """(key, fill) from rows where both are observed.

    'unique' keeps keys with one value (smallest equals largest). 'first' takes the
    value of the smallest ``order``, which must be named: rows have no order of their own.
    """
    both = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    if conflict == "unique":
        lo_hi = both.groupBy(key).agg(F.min(value).alias("fill"), F.max(value).alias("_hi"))
        return lo_hi.filter(F.col("fill") == F.col("_hi")).drop("_hi")
    if conflict != "first":
        raise ValueError("conflict must be first or unique")
    if order is None:
        raise ValueError("conflict='first' needs an order column")
    return both.groupBy(key).agg(F.min_by(value, order).alias("fill"))


def _fill(df: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    return (df.join(mapping, key, "left")
            .withColumn(value, F.coalesce(F.col(value), F.col("fill"))).drop("fill"))


def impute_cross(df: DataFrame, pairs: Sequence[tuple[str, str]] = IMPUTE_PAIRS, *,
                 bidirectional: bool = False, conflict: str = "unique",
                 order: str | None = None, settle: Settle = unsettled) -> DataFrame:
    """Fill a value from its key (and back) using observed pairs; observed values never change."""
    out = df
    for key, value in pairs:
        if key not in df.columns or value not in df.columns:
            continue
        forward = settle(observed_mapping(out, key, value, conflict, order), "mapping")
        back = settle(observed_mapping(out, value, key, conflict, order), "mapping") if bidirectional else None
        out = _fill(out, forward, key, value)
        if back is not None:
            out = _fill(out, back, value, key)
    return out.select(*df.columns)


# ---- clock features ---------------------------------------------------------

def time_features(df: DataFrame, dep: str = "dep_hhmm", arr: str = "arr_hhmm", *,
                  keep_minute: bool = False, midnight_wrap: bool = True, strict: bool = False) -> DataFrame:
    dep_hour, dep_minute = clock.hhmm_parts(F.col(dep), strict)
    arr_hour, arr_minute = clock.hhmm_parts(F.col(arr), strict)
    out = df.withColumns({"dep_hour": dep_hour, "arr_hour": arr_hour,
                          "dep_minute": dep_minute, "arr_minute": arr_minute})
    gap = clock.clock_gap(*[F.col(c) for c in ("dep_hour", "dep_minute", "arr_hour", "arr_minute")],
                          midnight_wrap=midnight_wrap)
    out = out.withColumn("duration", gap)
    return out if keep_minute else out.drop("dep_minute", "arr_minute")


def with_route(df: DataFrame) -> DataFrame:
    return df.withColumn("route", text.route_key(F.col("origin"), F.col("dest")))


def gap_counts(df: DataFrame, group: str = "route", value: str = "duration") -> DataFrame:
    """Rows per (group, value), nulls included. Values are whole minutes of a day, so a group has
    at most 1441 entries; everything a median needs is in this small table."""
    return df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))


def group_medians(counts: DataFrame, group: str = "route", value: str = "duration", name: str = "group_median") -> DataFrame:
    """Exact median per group, and how many of the group's values are null."""
    return counts.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.percentile(value, F.lit(0.5), F.when(F.col(value).isNotNull(), F.col("n")).otherwise(F.lit(0))).alias(name),
        F.sum(F.when(F.col(value).isNull(), F.col("n")).otherwise(0)).alias("n_null"))


def filled_median(counts: DataFrame, medians: DataFrame, value: str = "duration", name: str = "group_median") -> DataFrame:
    """One row: the median of the column after the group medians were filled in."""
    known = counts.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"), "n")
    added = medians.filter(F.col(name).isNotNull()).select(F.col(name).alias("v"), F.col("n_null").alias("n"))
    return known.unionByName(added).agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("overall"))


def restore_times(df: DataFrame, group: str = "route", *, fill_duration: bool = True,
                  fill_hours: bool = True, settle: Settle = unsettled) -> DataFrame:
    """Fill the gap by route median, then by the median of the filled column; then work the
    one missing clock time out of the other. Rows missing both stay missing."""
    out = df
    if fill_duration:
        columns = out.columns
        if group in columns:
            counts = settle(gap_counts(out, group), "gap-counts")
            medians = group_medians(counts, group)
            overall = filled_median(counts, medians)
            out = out.join(medians.drop("n_null"), group, "left").withColumn(
                "duration", F.coalesce(F.col("duration"), F.col("group_median"), overall.scalar()))
        else:
            overall = out.agg(F.median("duration").alias("overall"))
            out = out.withColumn("duration", F.coalesce(F.col("duration"), overall.scalar()))
        out = out.select(*columns)
    if fill_hours:
        no_dep = (F.col("dep_hour") == MISSING_HOUR) & (F.col("arr_hour") >= 0)
        no_arr = (F.col("arr_hour") == MISSING_HOUR) & (F.col("dep_hour") >= 0)
        dep_from = F.pmod(F.col("arr_hour") * 60 + F.col("arr_minute") - F.col("duration"), F.lit(1440.0))
        arr_from = F.pmod(F.col("dep_hour") * 60 + F.col("dep_minute") + F.col("duration"), F.lit(1440.0))
        known = F.col("duration").isNotNull()

        def restored(name: str, missing: Column, value: Column) -> Column:
            return F.when(missing & known, value.cast("int")).otherwise(F.col(name))

        out = out.withColumns({
            "dep_hour": restored("dep_hour", no_dep, F.floor(dep_from / 60)),
            "dep_minute": restored("dep_minute", no_dep, F.floor(dep_from % 60)),
            "arr_hour": restored("arr_hour", no_arr, F.floor(arr_from / 60)),
            "arr_minute": restored("arr_minute", no_arr, F.floor(arr_from % 60)),
        })
    return out


def slot_counts(df: DataFrame, name: str, airport: str, hour: str, *,
                date_keys: Sequence[str] = ("mo", "dom"), exclude_missing_hour: bool = True,
                settle: Settle = unsettled) -> DataFrame:
    """Rows of the input in the same (date, airport, hour) slot, the row itself included.

    Counted by a combinable aggregate and joined back null-safely, so one crowded slot
    is never gathered into a single window partition.
    """
    keys = [*date_keys, airport, hour]
    counted = df.filter(F.col(hour) != MISSING_HOUR) if exclude_missing_hour else df
    slots = settle(counted.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(name)), name)
    return join_null_safe(df, slots, keys, "left").select(*df.columns, name)


def traffic_features(df: DataFrame, *, exclude_missing_hour: bool = True, add_missing_flag: bool = True,
                     date_keys: Sequence[str] = ("mo", "dom"), settle: Settle = unsettled) -> DataFrame:
    """Slot counts at both airports. Both roles are counted in one pass over the rows."""
    roles = (("origin_traffic", "origin_hour_missing", "origin", "dep_hour"),
             ("dest_traffic", "dest_hour_missing", "dest", "arr_hour"))
    entries = [F.struct(F.lit(name).alias("_role"), F.col(airport).cast("string").alias("_airport"),
                        F.col(hour).alias("_hour")) for name, _, airport, hour in roles]
    slots = df.select(*date_keys, F.inline(F.array(*entries)))
    if exclude_missing_hour:
        slots = slots.filter(F.col("_hour") != MISSING_HOUR)
    slots = settle(slots.groupBy("_role", *date_keys, "_airport", "_hour")
                   .agg(F.count(F.lit(1)).cast("double").alias("_n")), "slots")
    out = df
    for name, flag, airport, hour in roles:
        if add_missing_flag:
            out = out.withColumn(flag, (F.col(hour) == MISSING_HOUR).cast("int"))
        columns = out.columns
        mine = slots.filter(F.col("_role") == name).select(*date_keys, "_airport", "_hour", F.col("_n").alias(name))
        keyed = out.withColumn("_airport", F.col(airport).cast("string")).withColumn("_hour", F.col(hour))
        out = join_null_safe(keyed, mine, [*date_keys, "_airport", "_hour"], "left").select(*columns, name)
    return out


def cyclic_features(df: DataFrame, hours: Sequence[str] = ("dep_hour",), *, include_cos: bool = True,
                    missing: str = "nan", add_missing_flag: bool = False) -> DataFrame:
    added = {}
    for hour in hours:
        h = F.col(hour)
        if add_missing_flag:
            added[f"{hour}_missing"] = F.coalesce(h < 0, F.lit(True)).cast("int")
        sine, cosine = numeric.cyclic_hour(h, missing)
        added[f"sin_{hour}"] = sine
        if include_cos:
            added[f"cos_{hour}"] = cosine
    return df.withColumns(added)


def speed_features(df: DataFrame, *, safe: bool = False) -> DataFrame:
    """Distance per local-clock minute: the legacy epsilon ratio, or the guarded one with flags."""
    distance, gap = F.col("distance"), F.col("duration")
    if not safe:
        return df.withColumn("speed_ratio", numeric.legacy_speed_ratio(distance, gap))
    return (df.withColumns({
        "gap_zero": numeric.flag(gap == 0),
        "distance_per_minute": numeric.safe_ratio(distance, gap),
        "distance_per_minute_missing": (~numeric.ratio_is_valid(distance, gap)).cast("int"),
    }).withColumnRenamed("duration", "local_gap_minutes").drop("speed_ratio"))
