"""As-of joins: the latest report a request could have known.

Both sides are laid out on one time line and a single ordered pass finds each
request's report, so no request is ever paired with all reports of its station. The
line of a station is cut into time buckets: a task holds one (station, bucket), never
a whole station, however busy it is.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.functions import clock
from tripwright.schemas import LATENCIES, MAX_AGE_MINUTES

_NULL_KEY_SPREAD = 1024


def _bucket(ts: Column, hours: int) -> Column:
    return F.floor(clock.hour_number(ts) / hours)


def _request_line(requests: DataFrame, by: str, at: Column, hours: int) -> DataFrame:
    """Requests on the time line; rows with a null key are spread over buckets of their own,
    where no report exists, instead of meeting in one partition."""
    whole = F.struct(*requests.columns)
    spread = -1 - F.pmod(F.xxhash64(*requests.columns), F.lit(_NULL_KEY_SPREAD))
    keyed = F.col(by).isNotNull() & at.isNotNull()
    return requests.select(
        F.col(by).alias("_by"), F.when(keyed, _bucket(at, hours)).otherwise(spread).alias("_bucket"),
        at.alias("_ts"), F.lit(1).alias("_side"), whole.alias("_req"))


def _report_line(reports: DataFrame, by: str, at: str, payload: Sequence[str]) -> DataFrame:
    return reports.filter(F.col(by).isNotNull() & F.col(at).isNotNull()).select(
        F.col(by).alias("_by"), F.col(at).alias("_ts"), F.struct(*payload).alias("_rep"))


def _latest(line: DataFrame, *, unique: bool = False) -> DataFrame:
    """Request rows with the last report at or before them inside their bucket.

    Reports of one station and time come in the order of their content; with ``unique`` they
    fail the job where a request comes after them. The order is the one pass's own, so
    neither costs another shuffle.
    """
    order = Window.partitionBy("_by", "_bucket").orderBy("_ts", "_side", "_rep")
    seen = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("_rep", ignorenulls=True).over(seen)
    if unique:
        before = F.lag(F.struct("_ts", "_side")).over(order)
        repeated = (F.col("_side") == 0) & (before == F.struct("_ts", "_side"))
        line = line.withColumn("_repeated", F.coalesce(repeated, F.lit(False)))
        line = line.withColumn("_last", last).withColumn("_repeated", F.max("_repeated").over(seen))
        refused = F.raise_error(F.lit("two reports of one station become available at the same time"))
        shown = F.when(F.col("_repeated"), refused.cast(line.schema["_rep"].dataType)).otherwise(F.col("_last"))
        return line.filter("_side = 1").select("_req.*", shown.alias("_rep"))
    return line.withColumn("_last", last).filter("_side = 1").select("_req.*", F.col("_last").alias("_rep"))


def _merge(requests_line: DataFrame, report_line: DataFrame) -> DataFrame:
    empty = F.lit(None).cast(report_line.schema["_rep"].dataType)
    return (requests_line.withColumn("_rep", empty)
            .unionByName(report_line, allowMissingColumns=True))


def latest_within(requests: DataFrame, reports: DataFrame, *, by: str, request_at: Column, report_at: str,
                  payload: Sequence[str], max_age_minutes: int, bucket_hours: int = 6, unique: bool = False) -> DataFrame:
    """Latest report at or before each request, where older than ``max_age_minutes`` may go unseen.

    A report is laid into its own bucket and into every later one its age still reaches,
    so buckets stay independent and nothing is carried between them.
    """
    line = _report_line(reports, by, report_at, payload)
    reach = F.col("_ts") + F.make_dt_interval(mins=F.lit(max_age_minutes))
    line = line.withColumn("_bucket", F.explode(F.sequence(
        _bucket(F.col("_ts"), bucket_hours), _bucket(reach, bucket_hours)))).withColumn("_side", F.lit(0))
    return _latest(_merge(_request_line(requests, by, request_at, bucket_hours), line), unique=unique)


def latest_before(requests: DataFrame, reports: DataFrame, *, by: str, request_at: Column, report_at: str,
                  payload: Sequence[str], bucket_hours: int = 24) -> DataFrame:
    """Latest report at or before each request, however old.

    Each bucket starts from the last report of the earlier ones; that carry is worked out
    on one row per (station, bucket).
    """
    reqs = _request_line(requests, by, request_at, bucket_hours)
    line = (_report_line(reports, by, report_at, payload)
            .withColumn("_bucket", _bucket(F.col("_ts"), bucket_hours)))
    ends = line.groupBy("_by", "_bucket").agg(F.max_by("_rep", "_ts").alias("_rep"), F.max("_ts").alias("_ts"))
    wanted = reqs.filter("_bucket >= 0").select("_by", "_bucket").distinct().withColumn("_want", F.lit(True))
    earlier = (Window.partitionBy("_by").orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = (ends.join(wanted, ["_by", "_bucket"], "full_outer")
             .withColumn("_rep", F.last("_rep", ignorenulls=True).over(earlier))
             .withColumn("_ts", F.last("_ts", ignorenulls=True).over(earlier))
             .filter("_want AND _ts IS NOT NULL").select("_by", "_bucket", "_ts", "_rep"))
    reports_line = (line.withColumn("_side", F.lit(0))
                    .unionByName(carry.withColumn("_side", F.lit(-1))))
    return _latest(_merge(reqs, reports_line))


def asof_join(requests: DataFrame, observations: DataFrame, *, by: str = "station",
              cutoff: str = "prediction_at", observed: str = "observed_at", available: str = "available_at",
              max_age_minutes: int = MAX_AGE_MINUTES, bucket_hours: int = 6) -> DataFrame:
    """One row per request with its last *available* report and the report's age in minutes.

    The report with the greatest availability at or before the cutoff is taken; if it was
    observed more than ``max_age_minutes`` before the cutoff the row stays unmatched, with
    no fallback to another report. Rows with a null station or cutoff stay unmatched.

    Observations without a key or time, available before they were observed, or sharing
    station and availability fail the job.
    """
    if max_age_minutes <= 0:
        raise ValueError("max_age_minutes must be positive")
    shared = (set(requests.columns) & set(observations.columns)) - {by}
    if shared or "weather_age_minutes" in {*requests.columns, *observations.columns}:
        raise ValueError(f"request/observation column collision: {sorted(shared)}")
    payload = [c for c in observations.columns if c != by]
    sound = F.col(by).isNotNull() & F.col(observed).isNotNull() & (F.col(available) >= F.col(observed))
    refused = F.raise_error(F.lit("an observation lacks a key or is available before it is observed"))
    # inside the values, as a filter could be passed by another that drops null keys first
    checked = observations.withColumns({c: F.when(sound, F.col(c)).otherwise(refused.cast(observations.schema[c].dataType))
                                        for c in (by, available)})
    found = latest_within(requests, checked, by=by, request_at=F.col(cutoff), report_at=available, payload=payload,
                          max_age_minutes=max_age_minutes, bucket_hours=bucket_hours, unique=True)
    limit = max_age_minutes * 60_000_000
    age = clock.micros_between(F.col(f"_rep.{observed}"), F.col(cutoff))
    since_available = clock.micros_between(F.col(f"_rep.{available}"), F.col(cutoff))
    fresh = (age <= limit) & (since_available <= limit)
    found = found.withColumn("_rep", F.when(fresh, F.col("_rep")))
    return found.select(*requests.columns, *[F.col(f"_rep.{c}").alias(c) for c in payload],
                        F.when(F.col("_rep").isNotNull(),
                               clock.minutes_between(F.col(f"_rep.{observed}"), F.col(cutoff)))
                        .alias("weather_age_minutes"))


def observation_violations(observations: DataFrame, *, by: str = "station", observed: str = "observed_at",
                           available: str = "available_at") -> DataFrame:
    """Counts of null keys, repeated (station, available) and availability before observation."""
    keys = observations.groupBy(by, available).agg(F.count(F.lit(1)).alias("n"))
    repeated = keys.agg(F.coalesce(F.sum((F.col("n") > 1).cast("bigint")), F.lit(0)).alias("repeated_keys"))
    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))
    null_key = F.col(by).isNull() | F.col(observed).isNull() | F.col(available).isNull()
    return observations.agg(
        count(null_key).alias("null_keys"),
        count(F.col(available) < F.col(observed)).alias("available_before_observed"),
    ).withColumn("repeated_keys", repeated.scalar())


def latency_sweep(requests: DataFrame, reports: DataFrame, *, by: str = "station",
                  cutoff: str = "prediction_at", observed: str = "observed_at",
                  latencies: Sequence[int] = LATENCIES, max_age_minutes: int = MAX_AGE_MINUTES,
                  bucket_hours: int = 6) -> DataFrame:
    """Requests times assumed delays in one pass.

    A fixed delay L makes "available at or before the cutoff" the same as "observed at or
    before cutoff - L", so the reports are laid out once and only requests repeat.
    """
    delays = F.explode(F.array(*[F.lit(x) for x in latencies]))
    swept = requests.withColumn("latency", delays)
    payload = [c for c in reports.columns if c != by]
    effective = F.col(cutoff) - F.make_dt_interval(mins=F.col("latency"))
    found = latest_within(swept, reports, by=by, request_at=effective, report_at=observed, payload=payload,
                          max_age_minutes=max_age_minutes, bucket_hours=bucket_hours)
    limit = max_age_minutes * 60_000_000
    fresh = clock.micros_between(F.col(f"_rep.{observed}"), F.col(cutoff)) <= limit
    found = found.withColumn("_rep", F.when(fresh, F.col("_rep")))
    return found.select(
        *swept.columns, *[F.col(f"_rep.{c}").alias(c) for c in payload],
        (F.col(f"_rep.{observed}") + F.make_dt_interval(mins=F.col("latency"))).alias("available_at"),
        F.when(F.col("_rep").isNotNull(), clock.minutes_between(F.col(f"_rep.{observed}"), F.col(cutoff)))
        .alias("weather_age_minutes"))


def latest_report(requests: DataFrame, reports: DataFrame, *, by: str = "station",
                  cutoff: str = "prediction_at", observed: str = "observed_at",
                  name: str = "latest_observed_at", bucket_hours: int = 24) -> DataFrame:
    found = latest_before(requests, reports, by=by, request_at=F.col(cutoff), report_at=observed,
                          payload=[observed], bucket_hours=bucket_hours)
    return found.select(*requests.columns, F.col(f"_rep.{observed}").alias(name))


# Reasons why a row has no report.
MATCHED = "matched"
NOT_ELIGIBLE = "not_mapping_eligible"
UNRESOLVED = "unresolved_prediction_at"
NO_REPORT = "no_report_before_prediction_in_collected_windows"
STALE = "stale_beyond_90_minutes"
NOT_YET = "not_yet_available_under_latency_assumption"
NOT_COLLECTIBLE = "not_collectible_mapping"
COLLECTION_FAILED = "collection_failed_or_not_attempted"
NEVER_OBSERVED = "no_report_observed_before_prediction_time"
STALE_MAX_AGE = "stale_beyond_max_age"
UNEXPECTED = "unexpected_unmatched_despite_available_report"


def unmatched_reason(matched: Column, eligible: Column, cutoff: Column, latest: Column,
                     max_age_minutes: int = MAX_AGE_MINUTES) -> Column:
    """Why a row has no report, staleness tested before availability."""
    age = clock.micros_between(latest, cutoff)
    return (F.when(~eligible, NOT_ELIGIBLE).when(cutoff.isNull(), UNRESOLVED).when(matched, MATCHED)
            .when(latest.isNull(), NO_REPORT).when(age > max_age_minutes * 60_000_000, STALE)
            .otherwise(NOT_YET))


def collection_reason(matched: Column, eligible: Column, cutoff: Column, latest: Column, failed: Column,
                      latency_minutes: Column, max_age_minutes: int = MAX_AGE_MINUTES) -> Column:
    """Why a row has no report, availability tested first; knows failed (station, day) collections."""
    age = clock.micros_between(latest, cutoff)
    return (F.when(~eligible, NOT_COLLECTIBLE).when(cutoff.isNull(), UNRESOLVED).when(matched, MATCHED)
            .when(failed, COLLECTION_FAILED).when(latest.isNull(), NEVER_OBSERVED)
            .when(age < latency_minutes.cast("bigint") * 60_000_000, NOT_YET)
            .when(age > max_age_minutes * 60_000_000, STALE_MAX_AGE)
            .otherwise(UNEXPECTED))


def deduplicate_reports(reports: DataFrame, keys: Sequence[str] = ("station", "observed_at"), *,
                        refuse_conflicts: bool = False) -> DataFrame:
    """Exact duplicates collapse; ``n_reports`` and ``n_versions`` tell repeats from conflicts.

    Of conflicting versions the least is shown; with ``refuse_conflicts`` they fail the job.
    """
    content = [c for c in reports.columns if c not in keys]
    versions = reports.groupBy(*keys, *content).agg(F.count(F.lit(1)).alias("_n"))
    out = versions.groupBy(*keys).agg(F.min(F.struct(*content)).alias("_c"), F.sum("_n").alias("n_reports"),
                                      F.count(F.lit(1)).alias("n_versions"))
    if refuse_conflicts:
        refused = F.raise_error(F.lit("reports of one station and time differ")).cast("boolean")
        out = out.filter(F.when(F.col("n_versions") == 1, True).otherwise(refused))
    return out.select(*keys, "_c.*", "n_reports", "n_versions")
