"""Key normalisation, category buckets and free-text classification."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripwright.schemas import TARGET_MAP

MISSING_LABEL = "(missing)"

# How a transport error text names an HTTP status, and the error classes in order.
HTTP_STATUS_PATTERN = r"\b(http(/[0-9.]+)?\s+|error:\s*|status(\s+code)?[:=]?\s*){status}\b"
ERROR_RULES = (
    (HTTP_STATUS_PATTERN.replace("{status}", "503"), "http_503"),
    (HTTP_STATUS_PATTERN.replace("{status}", "429"), "http_429"),
    (HTTP_STATUS_PATTERN.replace("{status}", "422"), "http_422"),
    ("interrupted mid-attempt", "interrupted_unknown"),
    ("timed out|timeout", "timeout"),
    ("response exceeds bounded size", "response_size_cap"),
    ("response failed validation", "response_validation"),
)


def normal_text(key: Column) -> Column:
    return F.upper(F.trim(key))


def normal_integer(key: Column) -> Column:
    """Whole number or null; text that is not a whole number raises at run time."""
    value = F.trim(key.cast("string")).cast("double")
    whole = F.when(value == F.floor(value), value)
    return F.when(value.isNotNull(),
                  F.coalesce(whole, F.raise_error(F.lit("key is not a whole number")).cast("double"))
                  ).cast("bigint")


def is_labeled(label: Column) -> Column:
    """Unlabeled means null or blank; unlabeled is not negative."""
    return label.isNotNull() & (F.trim(label) != "")


def label_value(label: Column, mapping: dict[str, int] | None = None) -> Column:
    """0/1 for known texts, null for anything else."""
    value = F.lit(None).cast("int")
    for text, number in (mapping or TARGET_MAP).items():
        value = F.when(F.trim(label) == text, F.lit(number)).otherwise(value)
    return value


def checked_label(label: Column, mapping: dict[str, int] | None = None) -> Column:
    """Like ``label_value``, but an unlabeled or unknown text raises at run time."""
    failed = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))
    return F.coalesce(label_value(label, mapping), failed.cast("int"))


def category(value: Column, missing_label: str = MISSING_LABEL) -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing_label))


def route_key(origin: Column, dest: Column, separator: str = "_") -> Column:
    """Directional route; a null airport gives a null route."""
    return F.concat(origin.cast("string"), F.lit(separator), dest.cast("string"))


def time_pattern(dep: Column, arr: Column) -> Column:
    return (F.when(dep.isNotNull() & arr.isNotNull(), "both_observed")
            .when(dep.isNull() & arr.isNotNull(), "departure_missing")
            .when(dep.isNotNull() & arr.isNull(), "arrival_missing")
            .otherwise("both_missing"))


def key_pattern(keys: list[str], present: bool = True) -> Column:
    """'+'-joined names of the keys a row has (or, with present=False, lacks)."""
    def kept(name: str) -> Column:
        condition = F.col(name).isNotNull() if present else F.col(name).isNull()
        return F.when(condition, F.lit(name))
    return F.concat_ws("+", *[kept(k) for k in keys])


def first_rule(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """Label of the first pattern found in the lower-cased text."""
    lowered = F.lower(text)
    label = F.lit(default)
    for pattern, name in reversed(rules):
        label = F.when(F.coalesce(lowered.rlike(pattern), F.lit(False)), name).otherwise(label)
    return label
