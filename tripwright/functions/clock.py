"""Clock arithmetic on HHMM numbers, local time and UTC."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripwright.schemas import MISSING_HOUR

UTC = "UTC"


def number(value: Column) -> Column:
    """A double; text that does not parse and NaN become null."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def hhmm_parts(value: Column, strict: bool = False) -> tuple[Column, Column]:
    """(hour, minute) of an HHMM number; -1 where it is missing, junk or negative.

    ``strict`` also voids hours past 23 and minutes past 59; otherwise 2470 keeps (24, 70).
    """
    v = number(value)
    good = v >= 0
    if strict:
        good = good & (F.floor(v / 100) <= 23) & (v % 100 <= 59)
    hour = F.when(good, F.floor(v / 100)).otherwise(MISSING_HOUR).cast("int")
    minute = F.when(good, F.floor(v % 100)).otherwise(MISSING_HOUR).cast("int")
    return hour, minute


def clock_gap(dep_hour: Column, dep_minute: Column, arr_hour: Column, arr_minute: Column,
              midnight_wrap: bool = True) -> Column:
    """Arrival minus departure on the local clocks, null unless both hours are known."""
    gap = (arr_hour * 60 + arr_minute) - (dep_hour * 60 + dep_minute)
    if midnight_wrap:
        gap = F.when(gap < 0, gap + 1440).otherwise(gap)
    return F.when((dep_hour >= 0) & (arr_hour >= 0), gap.cast("double"))


def local_minutes(value: Column) -> Column:
    """Minutes after local midnight of a whole HHMM value; 2400 is the next midnight."""
    v = number(value)
    whole = v == F.floor(v)
    valid = whole & (((v >= 0) & (v < 2400) & (v % 100 < 60)) | (v == 2400))
    return F.when(valid, F.floor(v / 100) * 60 + v % 100).cast("int")


def local_naive(date: Column, value: Column) -> Column:
    return date.cast("timestamp_ntz") + F.make_dt_interval(mins=local_minutes(value))


def _to_utc(naive: Column, zone: Column) -> Column:
    return F.convert_timezone(zone, F.lit(UTC), naive)


def _to_local(instant: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit(UTC), zone, instant)


def local_time_state(naive: Column, zone: Column) -> Column:
    """'ok', 'nonexistent' (skipped by a clock change) or 'ambiguous' (repeated by one).

    Assumes one-hour changes: the repeated hour is the one that also appears an hour away.
    """
    hour = F.make_dt_interval(hours=F.lit(1))
    instant = _to_utc(naive, zone)
    repeated = (_to_local(instant + hour, zone) == naive) | (_to_local(instant - hour, zone) == naive)
    return (F.when(naive.isNull() | zone.isNull(), F.lit(None).cast("string"))
            .when(_to_local(instant, zone) != naive, "nonexistent")
            .when(repeated, "ambiguous").otherwise("ok"))


def local_hhmm_to_utc(date: Column, value: Column, zone: Column) -> Column:
    """UTC clock time (timestamp_ntz) of a local date and HHMM; null if invalid or not unique."""
    naive = local_naive(date, value)
    return F.when(local_time_state(naive, zone) == "ok", _to_utc(naive, zone))


def prediction_cutoff(date: Column, value: Column, zone: Column, lead_minutes: int = 60) -> Column:
    return local_hhmm_to_utc(date, value, zone) - F.make_dt_interval(mins=F.lit(lead_minutes))


def clock_change_departure(date: Column, value: Column, zone: Column) -> Column:
    """True when the local departure falls inside the clock change of that date and zone."""
    state = local_time_state(local_naive(date, value), zone)
    return F.coalesce(state.isin("nonexistent", "ambiguous"), F.lit(False))


def hour_order(value: Column) -> Column:
    """Hour of an HHMM number for sorting; -1 for missing, 24 kept for 2400."""
    return F.coalesce(F.floor(number(value) / 100), F.lit(-1)).cast("bigint")


def hour_label(order: Column) -> Column:
    return (F.when(order < 0, "missing").when(order == 24, "24 (2400)")
            .otherwise(F.lpad(order.cast("string"), 2, "0")))


def midnight_distance(value: Column) -> Column:
    """Minutes to the nearest midnight; 2400 and beyond count as midnight."""
    v = number(value)
    minutes = F.when(v < 2400, F.floor(v / 100) * 60 + v % 100).otherwise(F.lit(0.0))
    return F.when(v.isNotNull(), F.least(minutes, 1440 - minutes)).cast("double")


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds on the columns' own clock, whatever the session time zone is."""
    gap = end - start
    days, hours, minutes = [F.extract(F.lit(unit), gap).cast("bigint") for unit in ("DAY", "HOUR", "MINUTE")]
    seconds = (F.extract(F.lit("SECOND"), gap) * 1000000).cast("bigint")
    return ((days * 24 + hours) * 60 + minutes) * 60000000 + seconds


def minutes_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / 60e6


def hour_number(ts: Column) -> Column:
    """Whole hours since 1970 on the column's own clock: a monotone time bucket."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return days.cast("bigint") * 24 + F.hour(ts)


def month_start(month: Column) -> Column:
    return F.concat(month, F.lit("-01")).cast("timestamp_ntz")


def month_window(month: Column) -> tuple[Column, Column]:
    """[first instant, first instant of the next month) of a 'yyyy-MM' text."""
    start = F.concat(month, F.lit("-01")).cast("date")
    return start.cast("timestamp_ntz"), F.add_months(start, 1).cast("timestamp_ntz")


def month_key(ts: Column) -> Column:
    return F.date_format(ts.cast("date"), "yyyy-MM")
