"""Ratios, cyclic encodings, logits and small numeric rules."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed value: clipping distance of the logit.
LOGIT_EPS = 1e-6
# Fixed value: clipping distance of the log loss (double machine epsilon).
LOSS_EPS = 2.220446049250313e-16
# Fixed value: the legacy ratio's denominator shift.
LEGACY_SHIFT = 1e-5
_MISSING_MODES = ("nan", "noon", "keep")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def cyclic_hour(hour: Column, missing: str = "nan") -> tuple[Column, Column]:
    """(sin, cos) of the hour on a 24-hour circle; ``missing`` says what -1 becomes."""
    if missing not in _MISSING_MODES:
        raise ValueError(f"missing must be one of {_MISSING_MODES}: {missing!r}")
    h = hour.cast("double")
    if missing == "nan":
        h = F.when(h >= 0, h)
    elif missing == "noon":
        h = F.when(h >= 0, h).otherwise(F.lit(12.0))
    angle = h * (2.0 * math.pi) / 24.0
    return F.sin(angle), F.cos(angle)


def legacy_speed_ratio(distance: Column, gap: Column) -> Column:
    return distance / (gap + LEGACY_SHIFT)


def ratio_is_valid(distance: Column, gap: Column) -> Column:
    return F.coalesce(finite(gap) & (gap > 0) & finite(distance) & (distance >= 0), F.lit(False))


def safe_ratio(distance: Column, gap: Column) -> Column:
    return F.when(ratio_is_valid(distance, gap), distance / gap)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clipped_logit(p: Column) -> Column:
    q = clip(p, LOGIT_EPS, 1 - LOGIT_EPS)
    return F.ln(q / (1 - q))


def log_loss_term(y: Column, p: Column) -> Column:
    q = clip(p, LOSS_EPS, 1 - LOSS_EPS)
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def ratio_or(numerator: Column, denominator: Column, empty: float | None) -> Column:
    """numerator / denominator with ``empty`` where the denominator is zero."""
    filler = F.lit(empty).cast("double")
    return F.when(denominator != 0, numerator / denominator).otherwise(filler)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def stable_hash(identifier: Column) -> Column:
    """Seed-free order key: the SHA-256 text of the identifier."""
    return F.sha2(identifier.cast("string"), 256)


def interval_overlap(begin: Column, end: Column, period_start: Column, period_end: Column
                     ) -> tuple[Column, Column]:
    """Overlap of an open-ended validity window with a period; both null when disjoint."""
    low = F.greatest(F.coalesce(begin, period_start), period_start)
    high = F.least(F.coalesce(end, period_end), period_end)
    overlaps = low <= high
    return F.when(overlaps, low), F.when(overlaps, high)


def grid_edge(value: Column, axis: tuple[float, ...]) -> Column:
    """'low' / 'high' when the chosen value is the smallest / largest of its axis."""
    return F.when(value == min(axis), "low").when(value == max(axis), "high")
