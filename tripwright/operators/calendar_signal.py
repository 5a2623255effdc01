"""What day-level counts say about the calendar behind them. Inputs are one row per day."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.functions import calendar
from tripwright.storage import materialize


def daily_counts(df: DataFrame, month: str = "mo", day: str = "dom") -> DataFrame:
    counts = df.groupBy(month, day).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("doy", calendar.day_of_common_year(F.col(month), F.col(day)))


def decompose(counts: DataFrame, month: str = "mo") -> DataFrame:
    """Count minus month mean, minus the mean of its seven-day class, and the z of what is left."""
    in_month, in_class = Window.partitionBy(month), Window.partitionBy("cycle_class")
    out = (counts.withColumn("residual", F.col("n") - F.avg("n").over(in_month))
           .withColumn("cycle_class", (F.col("doy") - 1) % 7))
    out = out.withColumn("anomaly", F.col("residual") - F.avg("residual").over(in_class))
    spread = out.agg(F.stddev_samp("anomaly").alias("s"))
    return out.withColumn("z", F.col("anomaly") / spread.scalar())


def variance_explained(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Between-group share of the total sum of squares, from sums that combine map-side."""
    v = F.col(value).cast("double")
    parts = df.groupBy(*by, group).agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"), F.count(v).alias("_n"))
    total = parts.groupBy(*by).agg(
        F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.sum("_n").alias("_n"),
        F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_between"))
    centre = F.col("_s") * F.col("_s") / F.col("_n")
    return total.select(*by, ((F.col("_between") - centre) / (F.col("_q") - centre)).alias("share"))


def permutation_test(days: DataFrame, value: str, group: str, identifier: str, *, draws: int,
                     seed: int, quantile: float = 0.999) -> DataFrame:
    """Observed share, how often random relabelling reaches it, and the null's high quantile.

    Each draw re-pairs the days' values with their groups by a hash order of the identifiers,
    which must be unique; a draw holds one row per day of a year. Groups stand in the order of the
    identifiers in every draw, so the days are numbered once and only they are broadcast; the drawn
    rows are never a join's small side, though the planner takes them for one.
    """
    days = materialize(days.select(identifier, value, group), "days")
    drawn = days.select(identifier, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    shuffled = Window.partitionBy("draw").orderBy(F.sha2(F.concat_ws(":", "draw", identifier, F.lit(str(seed))), 256), identifier)
    dealt = drawn.select("draw", value, F.row_number().over(shuffled).alias("_at"))
    fixed = days.select(group, F.row_number().over(Window.orderBy(identifier)).alias("_at"))  # at most 366 rows
    relabelled = dealt.join(F.broadcast(fixed), "_at")
    null = variance_explained(relabelled, value, group, ["draw"])
    observed = variance_explained(days, value, group)
    return null.agg(F.avg((F.col("share") >= observed.scalar()).cast("double")).alias("p_value"),
                    F.percentile("share", F.lit(quantile)).alias("null_quantile"),
                    F.count(F.lit(1)).alias("draws")).withColumn("observed", observed.scalar())


def share_shift(df: DataFrame, category: str, special: dict[str, Column], *, min_rows: int = 400) -> DataFrame:
    """Binomial z of each category's share on special days against the other days.

    ``special`` names the conditions of the special days; a category separates when the z
    values of the first two have opposite signs and are both strong.
    """
    rows = df.filter(F.col(category).isNotNull())
    baseline = F.lit(True)
    for condition in special.values():
        baseline = baseline & ~condition

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    totals = rows.agg(n(baseline).alias("t_base"), *[n(c).alias(f"t_{k}") for k, c in special.items()])
    out = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n_rows"), n(baseline).alias("n_base"),
                                     *[n(c).alias(f"n_{k}") for k, c in special.items()])
    out = out.filter(F.col("n_rows") >= min_rows).withColumn(
        "baseline_share", F.col("n_base") / totals.select("t_base").scalar())
    share = F.col("baseline_share")
    for k in special:
        size = totals.select(f"t_{k}").scalar()
        error = F.sqrt(share * (1 - share) / size)
        out = out.withColumn(f"{k}_share", F.col(f"n_{k}") / size)
        out = out.withColumn(f"{k}_z", F.when(error > 0, F.round((F.col(f"{k}_share") - share) / error, 2)))
    a, b = [F.col(f"{k}_z") for k in list(special)[:2]]
    opposite = ((a <= -2) & (b >= 2)) | ((a >= 2) & (b <= -2))
    shown = [c for k in special for c in (f"{k}_share", f"{k}_z")]
    return out.select(category, "n_rows", "baseline_share", *shown,
                      F.coalesce(opposite, F.lit(False)).alias("separates"))


def holiday_mixture(decomposed: DataFrame, years: DataFrame, *, dip: float = -2.0,
                    month: str = "mo", day: str = "dom", year: str = "yr") -> DataFrame:
    """Thanksgiving dates of each weekday alignment, whether Thursday and Friday both dip, and the share
    each confirmed date would have if depth were proportional to it.

    A dip on the day after a confirmed date is that date's Friday and is marked, not counted.
    """
    first = F.make_date(F.col(year), F.lit(1), F.lit(1))
    classes = (years.filter(calendar.is_common_year(F.col(year)))
               .groupBy(calendar.monday_based_weekday(first).alias("jan1_weekday"))
               .agg(F.min(year).alias("_year")))
    thursday = calendar.nth_weekday(F.col("_year"), 11, "THU", 4)
    dates = classes.select("jan1_weekday", F.inline(F.array(*[
        F.struct(F.lit(n).alias("_which"), F.date_add(thursday, shift).alias("_date"))
        for n, shift in (("thursday", 0), ("friday", 1), ("wednesday", -1))])))
    z = decomposed.select(F.col(month).alias("_m"), F.col(day).alias("_d"), "z")
    found = dates.join(z, (F.month("_date") == F.col("_m")) & (F.dayofmonth("_date") == F.col("_d")), "left")

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("_which") == name, F.col(column)))

    table = found.groupBy("jan1_weekday").agg(
        of("thursday", "_m").alias("_m"), of("thursday", "_d").alias("holiday_day"),
        *[of(n, "z").alias(f"z_{n}") for n in ("thursday", "friday", "wednesday")])
    table = table.withColumn("dip_pair", F.coalesce(
        (F.col("z_thursday") <= dip) & (F.col("z_friday") <= dip), F.lit(False)))
    by_day = Window.partitionBy().orderBy("holiday_day")
    previous_day = F.lag("holiday_day").over(by_day) == F.col("holiday_day") - 1
    shadow = F.coalesce(previous_day & F.lag("dip_pair").over(by_day), F.lit(False))
    depth = F.when(F.col("dip_pair"), F.abs("z_thursday"))
    share = depth / F.sum(depth).over(Window.partitionBy())
    bound = F.when(~F.col("dip_pair") & ~F.col("after_confirmed"),
                   F.abs(F.lit(dip)) / F.sum(depth).over(Window.partitionBy()))
    return (table.withColumn("after_confirmed", shadow).withColumn("implied_share", share)
            .withColumn("share_upper_bound", bound)
            .select("jan1_weekday", "holiday_day", "z_thursday", "z_friday", "z_wednesday", "dip_pair",
                    "after_confirmed", "implied_share", "share_upper_bound"))


def daily_composition(df: DataFrame, years: Sequence[int], month: str = "mo", day: str = "dom",
                      year: str = "attributed_year") -> DataFrame:
    """Per day the rows resolved to each year, their share, and the month's share of the first year."""
    pivoted = df.filter(F.col(year).isNotNull()).groupBy(month, day).pivot(year, list(years)).count()
    counts = [F.coalesce(F.col(str(y)), F.lit(0)).alias(f"rows_{y}") for y in years]
    out = pivoted.select(month, day, *counts)
    total = sum((F.col(f"rows_{y}") for y in years), F.lit(0))
    first = f"rows_{years[0]}"
    in_month = Window.partitionBy(month)
    return (out.withColumn("resolved_rows", total)
            .withColumn("first_year_share", F.col(first) / F.col("resolved_rows"))
            .withColumn("month_share", F.sum(first).over(in_month) / F.sum("resolved_rows").over(in_month)))


def directional_check(composition: DataFrame, expected: dict[tuple[int, int], str], month: str = "mo",
                      day: str = "dom") -> DataFrame:
    """Compare the share on given dates with the month's median daily share: 'up' or 'down' as expected?"""
    medians = composition.groupBy(month).agg(F.median("first_year_share").alias("month_median"))
    which = F.lit(None).cast("string")
    for (m, d), direction in expected.items():
        which = F.when((F.col(month) == m) & (F.col(day) == d), direction).otherwise(which)
    rows = composition.withColumn("expected", which).filter("expected IS NOT NULL").join(medians, month)
    observed = (F.when(F.col("first_year_share") > F.col("month_median"), "up")
                .when(F.col("first_year_share") < F.col("month_median"), "down").otherwise("flat"))
    return rows.select(month, day, "first_year_share", "month_median", "expected", observed.alias("observed"),
                       (observed == F.col("expected")).alias("as_expected"))
