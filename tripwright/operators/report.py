"""Reporting tables: rates with explicit denominators, bins, profiles, rollups."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.functions.text import MISSING_LABEL, category
from tripwright.operators.metrics import CELLS, class_metrics, confusion_counts
from tripwright.operators.skew import exact_quantiles

@dataclass(frozen=True)
class Bin:
    """An interval of measured values; a None bound is open-ended."""

    label: str
    low: float | None
    high: float | None
    kind: str = "value"
    left_open: bool = False
    right_closed: bool = False

    def holds(self, value: Column) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & ((value > self.low) if self.left_open else (value >= self.low))
        if self.high is not None:
            inside = inside & ((value <= self.high) if self.right_closed else (value < self.high))
        return inside


# The bins of each report field in their order; trace rain is 0.0001 inch.
FIELD_BINS: dict[str, tuple[Bin, ...]] = {
    "tmpf": (Bin("< 32 F", None, 32.0), Bin("[32, 50) F", 32.0, 50.0), Bin("[50, 68) F", 50.0, 68.0),
             Bin("[68, 86) F", 68.0, 86.0), Bin(">= 86 F", 86.0, None)),
    "sknt": (Bin("0 knot", 0.0, 0.0, "special", right_closed=True), Bin("(0, 6) knot", 0.0, 6.0, left_open=True),
             Bin("[6, 11) knot", 6.0, 11.0), Bin("[11, 16) knot", 11.0, 16.0), Bin("[16, 21) knot", 16.0, 21.0),
             Bin("[21, 31) knot", 21.0, 31.0), Bin(">= 31 knot", 31.0, None)),
    "vsby": (Bin("[0, 1) mile", 0.0, 1.0), Bin("[1, 3) mile", 1.0, 3.0), Bin("[3, 5) mile", 3.0, 5.0),
             Bin("[5, 10) mile", 5.0, 10.0), Bin(">= 10 mile", 10.0, None)),
    "p01i": (Bin("0 inch", 0.0, 0.0, "special", right_closed=True),
             Bin("trace", 0.0001, 0.0001, "special", right_closed=True),
             Bin("(0.0001, 0.05) inch", 0.0001, 0.05, left_open=True), Bin("[0.05, 0.1) inch", 0.05, 0.1),
             Bin(">= 0.1 inch", 0.1, None)),
    "age_minutes": (Bin("[0, 30) minute", 0.0, 30.0), Bin("[30, 60) minute", 30.0, 60.0),
                    Bin("[60, 90] minute", 60.0, 90.0, right_closed=True)),
}
# A measured value this close to a single-point bin is in it.
POINT_TOLERANCE = 1e-9
FIELD_MISSING, UNMATCHED = 800, 900
# Right-open probability bands.
BANDS = (0.0, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 1.01)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# ---- rates ------------------------------------------------------------------

def rate_table(df: DataFrame, by: Sequence[str], *, population: str, flag: str = "delayed") -> DataFrame:
    """Rows, positives, rate and share per key, with population totals. Null keys raise at run time."""
    complete = F.lit(True)
    for k in by:
        complete = complete & F.col(k).isNotNull()
    checked = F.when(complete, F.lit(True)).otherwise(F.raise_error(F.lit("null group key")).cast("boolean"))
    table = df.filter(checked).groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(flag).alias("n_delayed"))
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("d"))
    rows, positives = totals.select("n").scalar(), totals.select("d").scalar()
    return table.select(
        F.lit(population).alias("population"), rows.alias("population_rows"), positives.alias("population_delayed"),
        *by, "n_rows", "n_delayed", (F.col("n_rows") - F.col("n_delayed")).alias("n_not_delayed"),
        (F.col("n_delayed") / F.col("n_rows")).alias("delay_rate"),
        (F.col("n_rows") / rows).alias("share_of_population"))


def rollup_dimensions(df: DataFrame, dimensions: Sequence[str], flag: str) -> DataFrame:
    """Several one-dimension tables in one pass over the rows, stacked as (dimension, value)."""
    texts = df.select(*[category(F.col(d)).alias(d) for d in dimensions], flag)
    grouped = texts.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(
        *[F.grouping(d).alias(f"_g_{d}") for d in dimensions],
        F.count(F.lit(1)).alias("n_rows"), F.sum(flag).alias("n_flagged"))
    name = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dimensions])
    return grouped.select(name.alias("dimension"), F.coalesce(*[F.col(d) for d in dimensions]).alias("value"),
                          "n_rows", "n_flagged", (1 - F.col("n_flagged") / F.col("n_rows")).alias("unflagged_rate"))


# ---- bins -------------------------------------------------------------------

def _bin(label: str, order: int, kind: str, low: float | None = None, high: float | None = None) -> Column:
    return F.struct(F.lit(label).alias("bin_label"), F.lit(order).alias("bin_order"), F.lit(kind).alias("bin_kind"),
                    F.lit(low).cast("double").alias("bin_lower"), F.lit(high).cast("double").alias("bin_upper"))


def _refused(message: str) -> Column:
    """An expression of a bin's type that fails the job."""
    return F.when(F.raise_error(F.lit(message)).isNotNull(), _bin("", 0, ""))


def _starts(bins: Sequence[Bin], value: Column) -> list[Column]:
    """Whether the value has reached each bin; single-point bins above zero reach a tolerance to both sides."""
    def slack(b: Bin) -> float:
        return POINT_TOLERANCE if b.low == b.high and b.low else 0.0
    reached = [F.lit(True) if bins[0].low is None else value >= bins[0].low]
    for before, b in zip(bins, bins[1:]):
        low = F.lit(b.low + slack(before)) if b.left_open else F.lit(b.low - slack(b))
        reached.append(value > low if b.left_open else value >= low)
    return reached


def bin_number(feature: str, value: Column, matched: Column) -> Column:
    """The order of a row's one bin: how many edges its value has passed.

    A row is matched (1) or not (0): an unknown flag, a value on an unmatched row, and a value
    outside every bin fail the job. One condition checks all of that for a row.
    """
    bins = FIELD_BINS[feature]
    reached = _starts(bins, value)
    outside = ~reached[0]
    if bins[-1].high is not None:
        outside = outside | (value > bins[-1].high if bins[-1].right_closed else value >= bins[-1].high)
    for before, b, here in zip(bins, bins[1:], reached[1:]):
        if before.high < b.low:  # values between two bins
            outside = outside | ((value > before.high) & ~here)
    unknown = matched.isNull() | ~matched.isin(0, 1)
    stray = (matched == 0) & value.isNotNull()
    message = F.when(unknown, f"{feature}: unknown match flag").when(
        stray, f"{feature}: an unmatched row has a value").otherwise(f"{feature}: value outside every bin")
    number = F.when(matched == 0, F.lit(UNMATCHED)).when(value.isNull(), F.lit(FIELD_MISSING)).otherwise(
        sum((c.cast("int") for c in reached[1:]), F.lit(0)))
    bad = unknown | stray | F.coalesce(outside, F.lit(False))
    return F.when(bad, F.raise_error(message).cast("int")).otherwise(number)


def _bins_of(feature: str) -> list[tuple[str, int, str, float | None, float | None]]:
    """(label, order, kind, lower, upper) of every bin a row can be in."""
    measured = [(b.label, order, b.kind, b.low, b.high) for order, b in enumerate(FIELD_BINS[feature])]
    return measured + [("field missing", FIELD_MISSING, "field_missing", None, None), ("unmatched", UNMATCHED, "unmatched", None, None)]


def feature_bin(feature: str, value: Column, matched: Column) -> Column:
    """Exactly one bin per row as struct(label, order, kind, lower, upper); see ``bin_number``."""
    pairs = [item for b in _bins_of(feature) for item in (F.lit(b[1]), _bin(*b))]
    return F.element_at(F.create_map(*pairs), bin_number(feature, value, matched))


# Which airports have a report: label, order and kind by (origin, destination).
MATCH_BINS = {(1, 1): ("both airports", 0, "value"), (1, 0): ("origin only", 1, "partial"),
              (0, 1): ("destination only", 2, "partial"), (0, 0): ("neither", 3, "unmatched")}


def matched_status(origin: Column, dest: Column) -> Column:
    return reduce(lambda rest, item: F.when((origin == item[0][0]) & (dest == item[0][1]), _bin(*item[1])).otherwise(rest),
                  MATCH_BINS.items(), _refused("unknown match flag"))


def bins_long(weather: DataFrame, flag: str, *, population: str, roles: Sequence[str] = ("origin", "destination")
              ) -> DataFrame:
    """(role, feature, bin) counts and rates; every (role, feature) sums to the population.

    Each row yields the numbers of its eleven bins in the scan; one aggregate by two numbers
    follows, and names are looked up for its few groups.
    """
    numbers, names = [], []
    for role in roles:
        for f in FIELD_BINS:
            names += [(len(numbers), role, f, order, label, kind, low, high) for label, order, kind, low, high in _bins_of(f)]
            numbers.append(bin_number(f, F.col(f"weather_{role}_{f}"), F.col(f"weather_{role}_matched")))
    names += [(len(numbers), "both", "matched_status", order, label, kind, None, None) for label, order, kind in MATCH_BINS.values()]
    numbers.append(matched_status(*[F.col(f"weather_{r}_matched") for r in roles])["bin_order"])
    entries = [F.struct(F.lit(i).alias("_entry"), n.alias("bin_order")) for i, n in enumerate(numbers)]
    long = weather.select(F.col(flag), F.inline(F.array(*entries)))
    table = rate_table_of_groups(long, ["_entry", "bin_order"], weather, population=population, flag=flag)
    named = weather.sparkSession.createDataFrame(
        names, "_entry int, role string, feature string, bin_order int, bin_label string, bin_kind string, bin_lower double, bin_upper double")
    counted = [c for c in table.columns if c not in ("_entry", "bin_order", "population", "population_rows", "population_delayed")]
    return table.join(named, ["_entry", "bin_order"]).select(
        "population", "population_rows", "population_delayed", "role", "feature", "bin_order", "bin_label", "bin_kind",
        "bin_lower", "bin_upper", *counted)


def rate_table_of_groups(long: DataFrame, keys: Sequence[str], population_rows: DataFrame, *, population: str,
                         flag: str) -> DataFrame:
    totals = population_rows.agg(F.count(F.lit(1)).alias("n"), F.sum(flag).alias("d"))
    n, d = totals.select("n").scalar(), totals.select("d").scalar()
    table = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(flag).alias("n_delayed"))
    return table.select(
        F.lit(population).alias("population"), n.alias("population_rows"), d.alias("population_delayed"), *keys,
        "n_rows", "n_delayed", (F.col("n_delayed") / F.col("n_rows")).alias("delay_rate"),
        (F.col("n_rows") / n).alias("share_of_population"))


def probability_bands(df: DataFrame, group: str, p: str = "p", y: str = "y_true") -> DataFrame:
    """Share and observed rate in half-open bands per group; empty bands are not listed."""
    band = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(BANDS[:-1], BANDS[1:])):
        band = F.when((F.col(p) >= low) & (F.col(p) < high), F.lit(i)).otherwise(band)
    table = df.groupBy(group, band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("observed_rate"))
    lows = F.array(*[F.lit(b) for b in BANDS])
    return table.select(group, "band", F.element_at(lows, F.col("band") + 1).alias("lower"),
                        F.element_at(lows, F.col("band") + 2).alias("upper"), "n",
                        (F.col("n") / F.sum("n").over(Window.partitionBy(group))).alias("share"), "observed_rate")


# ---- errors -----------------------------------------------------------------

def error_table(df: DataFrame, by: str, *, population: str, seed: str = "seed") -> DataFrame:
    counts = confusion_counts(df, [seed, by])
    sized = class_metrics(counts, None).withColumn("n_rows", sum((F.col(c) for c in CELLS), F.lit(0)))
    per_seed = Window.partitionBy(seed)
    return sized.select(
        F.lit(population).alias("population"), F.lit(by).alias("dimension"), seed, F.col(by).alias("group"), *CELLS,
        "n_rows", (F.col("fn") + F.col("tp")).alias("n_delayed"), "precision_delayed", "recall_delayed",
        "false_positive_rate", "error_rate", F.sum("n_rows").over(per_seed).alias("seed_population_rows"))


def wrong_counts(df: DataFrame, identifier: str = "flight_id") -> DataFrame:
    return df.groupBy(identifier).agg(
        F.sum((F.col("prediction") != F.col("y_true")).cast("int")).cast("int").alias("wrong"))


def error_stability(per_row: DataFrame, by: str, *, seeds: int = 3) -> DataFrame:
    """Group x number of seeds that got the row wrong."""
    table = per_row.groupBy(F.col(by).alias("group")).agg(
        *[count_if(F.col("wrong") == k).alias(f"n_wrong_{k}") for k in range(seeds + 1)],
        F.count(F.lit(1)).alias("n_rows"))
    return (table.withColumn("share_wrong_all", F.col(f"n_wrong_{seeds}") / F.col("n_rows"))
            .withColumn("share_wrong_none", F.col("n_wrong_0") / F.col("n_rows")))


def fixed_group_recall(groups: DataFrame, dimension: str, group: str, seed: str = "seed") -> DataFrame:
    """Recall of one named group per seed, recomputed from counts, and its mean over seeds."""
    part = groups.filter((F.col("dimension") == dimension) & (F.col("group") == group))
    out = part.select(seed, "n", "positives", "tp", (F.col("tp") / F.col("positives")).alias("recall"))
    return out.withColumn("recall_mean_of_seeds", F.avg("recall").over(Window.partitionBy()))


def base_rate_tracking(df: DataFrame, attributes: Sequence[str], y: str = "y_true", p: str = "p", *,
                       min_rows: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(group rates next to mean predictions, correlation per attribute) over groups above a size floor."""
    tagged = df.select(y, p, F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), category(F.col(a)).alias("value")) for a in attributes])))
    groups = (tagged.groupBy("attribute", "value")
              .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("observed_rate"), F.avg(p).alias("mean_probability"))
              .filter(F.col("n") >= min_rows))
    spread = lambda c: F.max(c) - F.min(c)
    correlations = groups.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("groups"), F.corr("observed_rate", "mean_probability").alias("pearson_r"),
        spread("observed_rate").alias("observed_rate_range"),
        spread("mean_probability").alias("mean_probability_range")).filter("groups >= 3")
    return groups.join(correlations.select("attribute"), "attribute", "left_semi"), correlations


# ---- profiles ---------------------------------------------------------------

def _tag(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(c).alias("attribute"), category(F.col(c)).alias("value")) for c in columns])))


def group_profile(df: DataFrame, inside: Column, columns: Sequence[str], *, top: int = 8) -> DataFrame:
    """Most frequent values of a group with the share they have in the reference rows."""
    tagged = _tag(df.withColumn("_in", inside.cast("int")), columns, ["_in"])
    counts = tagged.groupBy("attribute", "value").agg(F.sum("_in").alias("n"), F.count(F.lit(1)).alias("_all"))
    per_attribute = Window.partitionBy("attribute")
    counts = (counts.withColumn("share", F.col("n") / F.sum("n").over(per_attribute))
              .withColumn("reference_share", (F.col("_all") - F.col("n"))
                          / F.sum(F.col("_all") - F.col("n")).over(per_attribute))
              .withColumn("position", F.row_number().over(
                  per_attribute.orderBy(F.col("n").desc(), F.col("value")))))
    return counts.filter(F.col("position") <= top).select(
        "attribute", "value", "n", "share", "reference_share",
        F.when(F.col("reference_share") > 0, F.col("share") / F.col("reference_share")).alias("share_ratio"))


def numeric_profile(df: DataFrame, inside: Column, columns: Sequence[str],
                    probs: dict[str, float] | None = None) -> DataFrame:
    """Quantiles and null rates of numeric columns inside and outside a group."""
    probs = probs or {"q25": 0.25, "median": 0.5, "q75": 0.75}
    long = df.select(inside.alias("in_group"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).cast("double").alias("v")) for c in columns])))
    keys = ["in_group", "attribute"]
    missing = long.groupBy(*keys).agg(F.avg(F.col("v").isNull().cast("int")).alias("null_rate"))
    return missing.join(exact_quantiles(long, keys, "v", probs), keys)


def missing_cooccurrence(flags: DataFrame, inside: Column, columns: Sequence[str]) -> DataFrame:
    """Missing rate of each column inside and outside a group, from one wide aggregate."""
    def rows(c: str) -> Column:
        f = F.col(c)
        return F.struct(F.lit(c).alias("column"), F.avg(F.when(inside, f)).alias("missing_rate"),
                        F.avg(F.when(~inside, f)).alias("reference_missing_rate"),
                        F.sum(F.when(inside, f).otherwise(0)).alias("n_missing"))
    return flags.agg(F.array(*[rows(c) for c in columns]).alias("r")).select(F.inline("r"))


def label_coverage(df: DataFrame, labeled: Column, positive: Column, columns: Sequence[str]
                   ) -> tuple[DataFrame, DataFrame]:
    """(category shares among labeled and unlabeled rows, one summary row per column)."""
    marked = df.withColumn("_lab", labeled.cast("int")).withColumn("_pos", F.coalesce(positive, F.lit(False)).cast("int"))
    counts = _tag(marked, columns, ["_lab", "_pos"]).groupBy("attribute", "value").agg(
        F.count(F.lit(1)).alias("total_n"), F.sum("_lab").alias("labeled_n"), F.sum("_pos").alias("positive_n"))
    whole = counts.groupBy("attribute").agg(F.sum("labeled_n").alias("_l"), F.sum("total_n").alias("_t"))
    groups = counts.join(whole, "attribute").withColumn("unlabeled_n", F.col("total_n") - F.col("labeled_n"))
    groups = groups.withColumn("labeled_share", F.col("labeled_n") / F.col("_l")).withColumn(
        "unlabeled_share", F.col("unlabeled_n") / (F.col("_t") - F.col("_l"))).withColumn(
        "delta_pp", 100 * (F.col("unlabeled_share") - F.col("labeled_share"))).withColumn(
        "observed_rate", F.try_divide(F.col("positive_n"), F.col("labeled_n"))).drop("_l", "_t")
    gap = F.abs(F.col("labeled_share") - F.col("unlabeled_share"))
    summary = groups.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("categories"), (F.sum(gap) / 2).alias("total_variation"),
        F.max(F.abs("delta_pp")).alias("max_share_gap_pp"),
        F.sum(F.when(F.col("labeled_n") == 0, F.col("unlabeled_n")).otherwise(0)).alias("unseen_rows"))
    return groups, summary


def missing_by_label(df: DataFrame, labeled: Column, columns: Sequence[str]) -> DataFrame:
    def rows(c: str) -> Column:
        return F.struct(F.lit(c).alias("column"), count_if(F.col(c).isNull() & labeled).alias("labeled_missing_n"),
                        count_if(F.col(c).isNull() & ~labeled).alias("unlabeled_missing_n"))
    wide = df.agg(F.array(*[rows(c) for c in columns]).alias("r"), count_if(labeled).alias("nl"),
                  count_if(~labeled).alias("nu"))
    long = wide.select("nl", "nu", F.inline("r"))
    out = long.withColumn("labeled_missing_pct", 100 * F.col("labeled_missing_n") / F.col("nl")).withColumn(
        "unlabeled_missing_pct", 100 * F.col("unlabeled_missing_n") / F.col("nu")).drop("nl", "nu")
    return out.withColumn("delta_pp", F.col("unlabeled_missing_pct") - F.col("labeled_missing_pct"))


def numeric_shift(df: DataFrame, labeled: Column, columns: Sequence[str]) -> DataFrame:
    """Standardized mean difference and quantiles by label status."""
    probs = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}
    long = df.select(labeled.alias("labeled"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    def side(value: bool, expr) -> Column:
        return expr(F.when(F.col("labeled") == value, F.col("v")))
    moments = long.groupBy("column").agg(
        side(True, F.count).alias("labeled_n"), side(False, F.count).alias("unlabeled_n"),
        side(True, F.avg).alias("_ml"), side(False, F.avg).alias("_mu"),
        side(True, F.var_samp).alias("_vl"), side(False, F.var_samp).alias("_vu"))
    pooled = F.sqrt((F.col("_vl") + F.col("_vu")) / 2)
    moments = moments.withColumn("standardized_mean_difference", F.when(
        pooled > 0, (F.col("_mu") - F.col("_ml")) / pooled).otherwise(F.lit(0.0))).drop("_ml", "_mu", "_vl", "_vu")
    q = exact_quantiles(long, ["labeled", "column"], "v", probs).drop("n_values")
    wide = q.groupBy("column").agg(*[
        F.max(F.when(F.col("labeled") == flag, F.col(n))).alias(f"{tag}_{n}")
        for flag, tag in ((True, "labeled"), (False, "unlabeled")) for n in probs])
    return moments.join(wide, "column")


def _value_text(name: str, kind: str) -> Column:
    """A text per distinct value: equal numbers and nested values have equal texts."""
    if kind in ("double", "float"):
        return (F.col(name) + F.lit(0.0).cast(kind)).cast("string")  # minus zero is zero
    if kind.startswith(("array", "struct", "map")):
        return F.when(F.col(name).isNotNull(), F.to_json(F.struct(F.col(name))))
    return F.hex(name) if kind == "binary" else F.col(name).cast("string")


def column_profile(df: DataFrame) -> DataFrame:
    """Type, nulls, distinct values and constancy of every column.

    One pass melts the rows to (column, value) and counts before the shuffle, so a value
    however frequent travels once per task; everything else comes from these counts. An
    empty table has one row per column with zero counts and no rate.
    """
    types = df.dtypes
    melted = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), _value_text(c, t).alias("_value")) for i, (c, t) in enumerate(types)])))
    counts = melted.groupBy("_i", "_value").agg(F.count(F.lit(1)).alias("_n"))
    per_column = counts.groupBy("_i").agg(
        F.sum(F.when(F.col("_value").isNull(), F.col("_n")).otherwise(0)).alias("null_count"),
        F.count("_value").alias("n_distinct"), F.sum("_n").alias("n_rows"))
    named = df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(types)], "_i int, column string, dtype string")
    whole = named.join(per_column, "_i", "left").drop("_i").fillna(0)
    return (whole.withColumn("null_rate", F.try_divide("null_count", "n_rows"))
            .withColumn("is_constant", (F.col("n_distinct") <= 1) & (F.col("null_count") == 0)))


def repeated_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``n``: how many rows repeat an earlier one in these columns, nulls being equal.

    Only two 64-bit hashes of each row are shuffled; rows whose hashes occur more than once
    are then grouped by their columns themselves, so equal hashes of different rows don't count.
    """
    names = [f"_{i}" for i in range(len(columns))]
    plain = df.select(*[F.col(c).alias(name) for c, name in zip(columns, names)])
    parts = [part for name in names for part in (F.col(name), F.col(name).isNull())]
    keyed = plain.withColumns({"_h": F.xxhash64(*parts), "_g": F.xxhash64(F.lit(1), *parts)})
    several = keyed.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_h", "_g")
    groups = keyed.join(several, ["_h", "_g"], "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))


def duplicate_counts(df: DataFrame, identifier: str) -> DataFrame:
    """Rows that repeat an earlier row exactly, with and without the identifier, and repeated ids."""
    ids = df.groupBy(identifier).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)))
    others = [c for c in df.columns if c != identifier]
    return (repeated_rows(df, df.columns).withColumnRenamed("n", "duplicate_rows")
            .withColumn("duplicate_rows_without_id", repeated_rows(df, others).scalar())
            .withColumn("duplicate_ids", ids.scalar()))


def functional_dependency(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Does a key determine a value? Groups, single-valued share, breaches, and the smallest breaching key."""
    complete = F.col(value).isNotNull()
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    per_key = df.filter(complete).groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    single = F.col("_lo") == F.col("_hi")
    label = F.concat_ws(" / ", *[F.col(k).cast("string") for k in keys])
    return per_key.agg(
        F.count(F.lit(1)).alias("groups"), count_if(single).alias("single_valued"), count_if(~single).alias("breaches"),
        F.avg(single.cast("int")).alias("share_single_valued"),
        F.min(F.when(~single, label)).alias("example_breach"))


# ---- report and archive diagnostics -----------------------------------------

def match_diagnostics(joined: DataFrame, keys: Sequence[str], fields: Sequence[str], reason: str = "reason",
                      age: str = "weather_age_minutes", matched: str = "matched") -> DataFrame:
    """Matches, nulls and blanks per field, and exact age quantiles per key (such as latency and role)."""
    m = F.col(matched)
    counts = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), count_if(m).alias("n_matched"),
        *[count_if(F.col(f).isNull()).alias(f"{f}_missing") for f in fields],
        *[count_if(F.col(f).isNull() & m).alias(f"{f}_missing_matched") for f in fields],
        *[count_if((F.col(f).cast("string") == "") & m).alias(f"{f}_blank_matched") for f in fields])
    ages = exact_quantiles(joined.filter(m), keys, age, {
        "age_min": 0, "age_p10": .1, "age_p25": .25, "age_median": .5, "age_p75": .75, "age_p90": .9,
        "age_p95": .95, "age_p99": .99, "age_max": 1}).drop("n_values")
    return counts.join(ages, list(keys), "left")


def role_coverage(joined: DataFrame, latency: str, identifier: str, role: str = "role",
                  matched: str = "matched") -> DataFrame:
    """Rows matched at both, one or no airport per delay; coverage must not rise with the delay."""
    per_row = joined.groupBy(latency, identifier).agg(F.sum(F.col(matched).cast("int")).alias("_m"))
    table = per_row.groupBy(latency).agg(
        F.count(F.lit(1)).alias("n_rows"), count_if(F.col("_m") == 2).alias("both_matched"),
        count_if(F.col("_m") == 1).alias("one_matched"), count_if(F.col("_m") == 0).alias("none_matched"))
    total = 2 * F.col("both_matched") + F.col("one_matched")
    previous = F.lag(total).over(Window.partitionBy().orderBy(latency))
    return table.withColumn("coverage_not_rising", F.coalesce(total <= previous, F.lit(True)))


def age_percentiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {"p10": .1, "p25": .25, "median": .5, "p75": .75, "p90": .9, "max": 1})


def field_quality(reports: DataFrame, fields: Sequence[str], trace_fields: Sequence[str] = (),
                  missing_token: str = "M", trace_token: str = "T") -> DataFrame:
    """Missing tokens, trace tokens and other texts that are not numbers, per raw text field."""
    def rows(f: str) -> Column:
        v = F.trim(F.col(f))
        missing = v.isNull() | (v == missing_token)
        trace = F.coalesce(v == trace_token, F.lit(False)) & F.lit(f in trace_fields)
        odd = ~missing & ~trace & (v != "") & v.try_cast("double").isNull()
        return F.struct(F.lit(f).alias("field"), F.count(F.lit(1)).alias("n_rows"), count_if(missing).alias("missing"),
                        count_if(trace).alias("trace"), count_if(odd).alias("other_non_numeric"))
    return reports.agg(F.array(*[rows(f) for f in fields]).alias("r")).select(F.inline("r"))


def source_inventory(reports: DataFrame, station: str, fields: Sequence[str]) -> DataFrame:
    return reports.groupBy(station).agg(
        F.count(F.lit(1)).alias("n_reports"),
        *[count_if(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")).alias(f"{f}_present") for f in fields])


def rate_based_sizing(windows: DataFrame, hours: str, size: str, needed_hours: Column, *,
                      min_hours: float = 0.5) -> DataFrame:
    """Size per hour (quartiles over long enough windows) times the hours needed: low, median, high."""
    long_enough = windows.filter(F.col(hours) >= min_hours).withColumn("_rate", F.col(size) / F.col(hours))
    rates = exact_quantiles(long_enough, [], "_rate", {"low": .25, "mid": .5, "high": .75})
    return rates.select(F.col("n_values").alias("n_windows"), *[F.col(c).alias(f"rate_{c}") for c in ("low", "mid", "high")],
                        *[(F.col(c) * needed_hours).alias(f"estimate_{c}") for c in ("low", "mid", "high")])


def selection_distribution(folds: DataFrame, keys: Sequence[str], params: str, edges: str, threshold: str,
                           recorded: str) -> tuple[DataFrame, DataFrame]:
    """(how often each configuration was chosen, fold-level summary per key).

    ``params`` and ``edges`` are JSON texts; ``edges`` maps axis to low/high/null.
    """
    chosen = folds.groupBy(*keys, params).agg(F.count(F.lit(1)).alias("n_folds"))
    flags = F.from_json(F.col(edges), "map<string,string>")
    at_edge = F.exists(F.map_values(flags), lambda v: v.isNotNull())
    summary = folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), count_if(at_edge).alias("folds_with_any_edge"),
        F.min(threshold).alias("threshold_min"), F.median(threshold).alias("threshold_median"),
        F.max(threshold).alias("threshold_max"),
        count_if(F.col(threshold) != F.col(recorded)).alias("thresholds_changed"))
    return chosen, summary
