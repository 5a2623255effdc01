"""Data contracts as tables of violation counts: nothing is repaired, everything is counted."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripwright import fixtures as fx
from tripwright.functions import clock
from tripwright.operators.report import count_if
from tripwright.operators.skew import row_positions
from tripwright.schemas import ELIGIBLE_TIER, TIERS

BASE_COLUMNS = ("run_id", "phase_key", "seed", "source_row", "flight_id", "fold", "y_true", "probability",
                "threshold", "prediction", "n_estimators")

# What a flag column says: a source field or a built feature was missing (kind__column).
FLAG_KINDS = frozenset({"raw_missing", "feature_missing"})


def long_rules(rules: dict[str, Column], df: DataFrame) -> DataFrame:
    """One aggregation over ``df``, one output row per rule."""
    entries = [F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(0)).cast("bigint").alias("violations"))
               for n, c in rules.items()]
    return df.agg(F.array(*entries).alias("r")).select(F.inline("r"))


def repeats(df: DataFrame, keys: Sequence[str]) -> Column:
    """Number of keys that occur more than once, as a scalar."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(count_if(F.col("n") > 1).alias("n")).scalar()


# ---- prediction rows --------------------------------------------------------

def source_rows(df: DataFrame, identifier: str = "flight_id") -> DataFrame:
    """Zero-based position of every row in identifier order."""
    ranked = row_positions(df, [], [F.col(identifier)], "_rank")
    return ranked.withColumn("source_row", F.col("_rank") - 1).drop("_rank")


def prediction_rows(scores: DataFrame, flags: DataFrame, settings: DataFrame, *, run_id: str, phase_key: str,
                    identifier: str = "flight_id") -> DataFrame:
    """Row-level prediction table: scores with their fold's settings and the raw missing flags."""
    flag_columns = [c for c in flags.columns if c.partition("__")[0] in FLAG_KINDS]
    joined = scores.join(flags.select(identifier, "source_row", *flag_columns), identifier).join(settings, ["seed", "fold"])
    return joined.select(
        F.lit(run_id).alias("run_id"), F.lit(phase_key).alias("phase_key"), "seed", "source_row", identifier, "fold",
        "y_true", F.col("p").alias("probability"), "threshold",
        (F.col("p") >= F.col("threshold")).cast("int").alias("prediction"), "n_estimators", *flag_columns)


def prediction_rows_of_fixture(spark: SparkSession, sf: str) -> DataFrame:
    flights = source_rows(fx.flights(spark, sf).select("flight_id", "dep_hhmm", "arr_hhmm", "airline"))
    flags = flights.select("flight_id", "source_row", *[
        F.col(c).isNull().cast("int").alias(f"raw_missing__{c}") for c in ("dep_hhmm", "arr_hhmm", "airline")])
    oof = fx.oof(spark, sf)
    settings = oof.groupBy("seed", "fold").agg(F.max("threshold").alias("threshold")).withColumn(
        "n_estimators", 10 * (F.col("fold") + 1))
    return prediction_rows(oof.drop("threshold"), flags, settings, run_id="demo", phase_key="P6_clean")


def prediction_violations(rows: DataFrame, *, run_id: str, phase_key: str, seed: int, n_rows: Column,
                          n_splits: int) -> DataFrame:
    """All rules of a prediction table as (rule, violations)."""
    if tuple(rows.columns[:len(BASE_COLUMNS)]) != BASE_COLUMNS:
        raise ValueError("prediction table does not start with the base columns")
    extras = rows.columns[len(BASE_COLUMNS):]
    flags = {c for c in extras if c.partition("__")[0] in FLAG_KINDS}
    if strangers := set(extras) - flags:
        raise ValueError(f"not part of a prediction table: {sorted(strangers)}")
    if not flags:
        raise ValueError("a prediction table says which inputs were missing")
    any_null = F.greatest(*[F.col(c).isNull() for c in rows.columns])
    binary = ["y_true", "prediction", *extras]
    not_binary = F.greatest(*[~F.col(c).isin(0, 1) for c in binary])
    settings = rows.groupBy("fold").agg(F.min("threshold").alias("a"), F.max("threshold").alias("b"),
                                        F.min("n_estimators").alias("c"), F.max("n_estimators").alias("d"))
    mixed = settings.agg(count_if((F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).alias("n")).scalar()
    seen = settings.agg(F.abs(F.count(F.lit(1)) - n_splits).alias("n")).scalar()
    actual = (F.col("probability") >= F.col("threshold")).cast("int")
    return long_rules({
        "row_count": F.when(F.count(F.lit(1)) == n_rows, 0).otherwise(1),
        "null_values": count_if(any_null),
        "run_identity": count_if((F.col("run_id") != run_id) | (F.col("phase_key") != phase_key) | (F.col("seed") != seed)),
        "duplicate_id": F.max(repeats(rows, ["flight_id"])), "duplicate_source_row": F.max(repeats(rows, ["source_row"])),
        "negative_source_row": count_if(F.col("source_row") < 0),
        "fold_range": count_if(~F.col("fold").between(0, n_splits - 1)), "folds_present": F.max(seen),
        "tree_count": count_if(F.col("n_estimators") <= 0), "binary_values": count_if(not_binary),
        "probability_range": count_if(~F.col("probability").between(0, 1)),
        "threshold_range": count_if(~F.col("threshold").between(0, 1)),
        "prediction_rule": count_if(F.col("prediction") != actual), "fold_settings": F.max(mixed),
    }, rows)


# ---- recorded results -------------------------------------------------------

def reproduced_scores(recomputed: DataFrame, recorded: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                      tolerance: float) -> DataFrame:
    """'reproduced', 'differs', or which side lacks the key."""
    left = recomputed.withColumn("_l", F.lit(True))
    right = recorded.select(*keys, *[F.col(m).alias(f"_r_{m}") for m in metrics], F.lit(True).alias("_r"))
    joined = left.join(right, list(keys), "full_outer")
    differs = F.lit(False)
    for m in metrics:
        differs = differs | ~F.coalesce(F.abs(F.col(m) - F.col(f"_r_{m}")) <= tolerance, F.lit(False))
    return joined.select(*keys, F.when(F.col("_r").isNull(), "not recorded").when(F.col("_l").isNull(), "not recomputed")
                         .when(differs, "differs").otherwise("reproduced").alias("verdict"))


def summary_reconciliation(long: DataFrame, recorded: DataFrame, keys: Sequence[str], *, n_seeds: int, rows: Column,
                           positives: Column, tolerance: float = 1e-12) -> DataFrame:
    """Seeds complete, denominators equal, and means equal to the recorded summary, both ways."""
    have = long.groupBy(*keys).agg(
        F.count_distinct("seed").alias("_seeds"), F.avg("value").alias("_mean"),
        F.bool_and((F.col("n_rows") == rows) & (F.col("positives") == positives)).alias("_same"))
    joined = have.join(recorded, list(keys), "full_outer")
    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))
    return joined.select(
        *keys, yes(F.col("_seeds") == n_seeds).alias("seeds_complete"), yes(F.col("_same")).alias("denominators_equal"),
        yes(F.abs(F.col("_mean") - F.col("mean")) <= tolerance).alias("mean_reproduced"),
        F.col("mean").isNotNull().alias("recorded"))


def reliability_reconciliation(bins: DataFrame, recorded: DataFrame, keys: Sequence[str], *, rows: Column,
                               positives: Column, tolerance: float = 1e-9) -> DataFrame:
    """Bins cover every row once and their weighted gap is the recorded calibration error."""
    sums = bins.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.round(F.col("n") * F.coalesce("observed_rate", F.lit(0.0)))).cast("bigint").alias("n_delayed"),
        (F.sum(F.col("n") * F.coalesce("abs_gap", F.lit(0.0))) / F.sum("n")).alias("_ece"))
    return sums.join(recorded, list(keys), "left").select(
        *keys, "n_rows", "n_delayed", (F.col("n_rows") == rows).alias("rows_covered"),
        (F.col("n_delayed") == positives).alias("positives_covered"),
        F.coalesce(F.abs(F.col("_ece") - F.col("ece")) <= tolerance, F.lit(False)).alias("ece_reproduced"))


def extract_totals(tables: dict[str, DataFrame], n_rows: str = "n_rows", n_flagged: str = "n_delayed") -> DataFrame:
    """Each extract's sums next to the population it states."""
    out = None
    for name, table in tables.items():
        part = table.agg(F.lit(name).alias("extract"), F.sum(n_rows).alias("rows"), F.sum(n_flagged).alias("flagged"),
                         F.max("population_rows").alias("population_rows"),
                         F.max("population_delayed").alias("population_delayed"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("reconciled", (F.col("rows") == F.col("population_rows"))
                          & (F.col("flagged") == F.col("population_delayed")))


# ---- pool, manifest, joins --------------------------------------------------

def pool_violations(pool: DataFrame, mapping: DataFrame, *, identifier: str, position: str, tier: str,
                    airports: Sequence[str]) -> DataFrame:
    """Identity, positions, tiers, airport coverage and one network per station."""
    known = mapping.select(F.col("iata").alias("_iata"), F.col("verification_tier").alias("_tier"))
    unmapped = None
    for a in airports:
        lost = pool.join(known, pool[a] == known["_iata"], "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
        unmapped = lost if unmapped is None else unmapped + lost
    active = mapping.filter(F.col("verification_tier") == ELIGIBLE_TIER)
    networks = active.groupBy("candidate_sid").agg(F.min("matched_network").alias("a"), F.max("matched_network").alias("b"))
    split = networks.agg(count_if(F.col("a") != F.col("b")).alias("n")).scalar()
    no_station = active.agg(count_if(F.col("candidate_sid").isNull() | F.col("matched_network").isNull()).alias("n")).scalar()
    p = F.col(position)
    return long_rules({
        "null_id": count_if(F.col(identifier).isNull()), "repeated_id": F.max(repeats(pool, [identifier])),
        "bad_position": count_if(p.isNull() | (p < 0) | (p != F.floor(p))),
        "repeated_position": F.max(repeats(pool, [position])), "unknown_tier": count_if(~F.col(tier).isin(*TIERS)),
        "unmapped_airport": F.max(unmapped), "repeated_airport": F.max(repeats(mapping, ["iata"])),
        "station_without_network": F.max(no_station), "station_in_several_networks": F.max(split)}, pool)


def manifest_violations(entries: DataFrame) -> DataFrame:
    """Requests (request_id, cache_file, month, window_start, window_end, network, stations, n_rows)."""
    start, end = clock.month_window(F.col("month"))
    stations = entries.select("request_id", "month", "network", F.explode("stations").alias("station"))
    networks = stations.groupBy("station").agg(F.min("network").alias("a"), F.max("network").alias("b"))
    split = networks.agg(count_if(F.col("a") != F.col("b")).alias("n")).scalar()
    blank = stations.agg(count_if(F.col("station").isNull() | (F.trim("station") == "")).alias("n")).scalar()
    return long_rules({
        "repeated_request": F.max(repeats(entries, ["request_id"])),
        "repeated_file": F.max(repeats(entries, ["cache_file"])),
        "window_not_month": count_if(~F.coalesce(
            (F.col("window_start") == start) & (F.col("window_end") == end), F.lit(False))),
        "empty_batch": count_if(F.size("stations") <= 0), "blank_station": F.max(blank),
        "repeated_station_month": F.max(repeats(stations, ["station", "month"])),
        "station_in_several_networks": F.max(split), "negative_rows": count_if(F.col("n_rows") < 0)}, entries)


def join_invariants(joined: DataFrame, *, identifier: Sequence[str], station: str, cutoff: str, observed: str,
                    available: str, age: str, eligible: Column, max_age_minutes: int = 90,
                    matched_station: str | None = None, window: tuple[str, str] | None = None) -> DataFrame:
    """Zero is the only acceptable count: future use, bad age, ineligible or foreign matches, repeats."""
    m = F.col(observed).isNotNull()
    rules = {
        "future_observation": count_if(m & (F.col(observed) > F.col(cutoff))),
        "future_availability": count_if(m & (F.col(available) > F.col(cutoff))),
        "age_out_of_range": count_if(m & ~F.col(age).between(0, max_age_minutes)),
        "ineligible_match": count_if(m & ~eligible), "null_key_match": count_if(m & (F.col(station).isNull() | F.col(cutoff).isNull())),
        "repeated_row": F.max(repeats(joined, identifier))}
    if matched_station:
        rules["station_mismatch"] = count_if(m & (F.col(station) != F.col(matched_station)))
    if window:
        rules["out_of_window"] = count_if(m & ~F.col(observed).between(F.col(window[0]), F.col(window[1])))
    return long_rules(rules, joined)


def weather_feature_violations(features: DataFrame, roles: Sequence[str], numeric_fields: Sequence[str], *,
                               identifier: str, max_age_minutes: int = 90) -> DataFrame:
    """Age known exactly when matched, age in range, numbers finite, ids unique."""
    rules = {"null_id": count_if(F.col(identifier).isNull()), "repeated_id": F.max(repeats(features, [identifier]))}
    for role in roles:
        age, matched = F.col(f"weather_{role}_age_minutes"), F.col(f"weather_{role}_matched")
        rules[f"{role}_age_without_match"] = count_if(age.isNotNull() != (matched == 1))
        rules[f"{role}_age_out_of_range"] = count_if(~age.between(0, max_age_minutes))
        bad = F.lit(False)
        for f in numeric_fields:
            v = F.col(f"weather_{role}_{f}")
            bad = bad | F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
        rules[f"{role}_nonfinite"] = count_if(bad)
    return long_rules(rules, features)


def plan_result_mismatches(plan: DataFrame, results: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Every planned request has exactly one result with the same fields."""
    left = plan.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields], F.lit(True).alias("_p"))
    per_key = results.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*fields)).alias("_r"))
    joined = left.join(per_key, key, "full_outer")
    rules = {"missing_result": count_if(F.col("_n").isNull()), "unplanned_result": count_if(F.col("_p").isNull()),
             "several_results": count_if(F.col("_n") > 1)}
    both = F.col("_p") & F.col("_n").isNotNull()
    for f in fields:
        rules[f"different_{f}"] = count_if(both & ~F.col(f"_p_{f}").eqNullSafe(F.col(f"_r.{f}")))
    return long_rules(rules, joined)
