"""Calendar arithmetic: movable weekdays and the 365-day year."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Days before each month of a 365-day year.
DAYS_BEFORE_MONTH = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
# Movable holidays as (name, month, weekday, n-th or None for last, days added).
MOVABLE_HOLIDAYS = (
    ("thanksgiving", 11, "THU", 4, 0),
    ("day_after_thanksgiving", 11, "THU", 4, 1),
    ("labor_day", 9, "MON", 1, 0),
    ("memorial_day", 5, "MON", None, 0),
    ("mlk_day", 1, "MON", 3, 0),
    ("presidents_day", 2, "MON", 3, 0),
)


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))


def last_weekday(year: Column, month: int, weekday: str) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), weekday)


def movable_holiday(year: Column, month: int, weekday: str, n: int | None, shift: int) -> Column:
    day = last_weekday(year, month, weekday) if n is None else nth_weekday(year, month, weekday, n)
    return F.date_add(day, shift)


def is_common_year(year: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return ~leap


def day_of_common_year(month: Column, day: Column) -> Column:
    offsets = F.array(*[F.lit(d) for d in DAYS_BEFORE_MONTH])
    return F.element_at(offsets, month.cast("int")) + day


def monday_based_weekday(date: Column) -> Column:
    """0 for Monday .. 6 for Sunday."""
    return F.weekday(date)
