"""Fingerprint matching against yearly schedules.

Schedules are always aggregated to one row per key before the join, so a key shared
by many schedule rows (code shares) never multiplies the rows it matches. Subsets of
keys are handled by grouping sets in one pass over the schedule and one join.
"""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Attribution statuses.
COMPLETE_SINGLE = "complete_single_candidate_year"
COMPLETE_MULTI = "complete_multi_candidate_year"
COMPLETE_NONE = "complete_checked_no_candidate"
MISSING_SINGLE = "missing_key_single_candidate_year"
MISSING_MULTI = "missing_key_multi_candidate_year"
MISSING_NONE = "missing_key_checked_no_candidate"
NOT_CHECKED = "not_checked_month_unavailable"


def _known(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).isNotNull()
    return condition


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)


def group_size_and_distinct(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Rows and distinct ``number`` values per key; rows with a null key are dropped."""
    return (df.filter(_known(keys)).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(number).alias("n_numbers")))


def match_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "n_matches") -> DataFrame:
    counts = right.filter(_known(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return left.join(counts, list(keys), "left").select(*left.columns, _zero(name))


def match_counts_by_year(left: DataFrame, schedule: DataFrame, keys: Sequence[str], years: Sequence[int],
                         year: str = "yr") -> DataFrame:
    counts = schedule.filter(_known(keys)).groupBy(*keys).agg(
        *[F.count(F.when(F.col(year) == y, 1)).alias(f"n_{y}") for y in years])
    return left.join(counts, list(keys), "left").select(*left.columns, *[_zero(f"n_{y}") for y in years])


# ---- key subsets ------------------------------------------------------------

def subset_id(columns: Sequence[str], used: Sequence[str]) -> int:
    """The grouping id Spark gives the set ``used`` out of ``columns`` (bit set = not used)."""
    last = len(columns) - 1
    return sum(1 << (last - i) for i, c in enumerate(columns) if c not in used)


def subset_aggregate(df: DataFrame, columns: Sequence[str], subsets: Sequence[Sequence[str]],
                     aggregates: Sequence[Column], extra: Sequence[str] = ()) -> DataFrame:
    """Aggregate by every key subset at once, with ``subset`` naming the set.

    A null inside a used key never matches, so such groups are dropped; a null in an unused
    key only marks that it is unused.
    """
    sets = [[F.col(c) for c in (*extra, *s)] for s in subsets]
    grouped = df.groupingSets(sets, *[F.col(c) for c in (*extra, *columns)]).agg(
        F.grouping_id().alias("subset"), *[F.grouping(c).alias(f"_g_{c}") for c in columns], *aggregates)
    usable = F.lit(True)
    for c in columns:
        usable = usable & (F.col(c).isNotNull() | (F.col(f"_g_{c}") == 1))
    return grouped.filter(usable).drop(*[f"_g_{c}" for c in columns])


def _join_subsets(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in ("subset", *columns)],
                           *[c for c in right.columns if c not in ("subset", *columns)])
    same = F.col("subset") == F.col("_r_subset")
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, same, "left").drop("_r_subset", *[f"_r_{c}" for c in columns])


def volatile_subsets(keys: Sequence[str], volatile: Sequence[str]) -> list[list[str]]:
    """Key lists with every non-empty choice of volatile keys left out."""
    return [[k for k in keys if k not in hidden]
            for size in range(1, len(volatile) + 1) for hidden in combinations(volatile, size)]


def partial_key_match(incomplete: DataFrame, schedule: DataFrame, keys: Sequence[str],
                      volatile: Sequence[str], years: Sequence[int], *, number: str,
                      year: str = "yr") -> DataFrame:
    """Match each row on exactly the keys it has; counts and distinct numbers per year."""
    last = len(keys) - 1
    observed_set = sum((F.when(F.col(k).isNull(), 1 << (last - i)).otherwise(0)
                        for i, k in enumerate(keys)), F.lit(0)).cast("bigint")
    wanted = volatile_subsets(keys, volatile)
    counts = subset_aggregate(
        schedule, keys, wanted,
        [F.count(F.when(F.col(year) == y, 1)).alias(f"n_{y}") for y in years]
        + [F.count_distinct(F.when(F.col(year) == y, F.col(number))).alias(f"numbers_{y}") for y in years])
    joined = _join_subsets(incomplete.withColumn("subset", observed_set), counts, keys)
    totals = [_zero(f"n_{y}") for y in years]
    out = joined.select(*incomplete.columns, *totals, *[_zero(f"numbers_{y}") for y in years])
    return out.withColumns({
        "candidates_total": sum((F.col(f"n_{y}") for y in years), F.lit(0)).cast("bigint"),
        "candidate_years": sum(((F.col(f"n_{y}") > 0).cast("int") for y in years), F.lit(0)).cast("int"),
    })


def key_ladder(left: DataFrame, schedule: DataFrame, ladder: dict[str, Sequence[str]], years: Sequence[int],
               year: str = "yr") -> DataFrame:
    """Rows with a candidate at each declared key subset and year, for rows knowing those keys.

    Both sides are aggregated by all subsets first; the join sees distinct keys only.
    """
    columns = list(dict.fromkeys(k for keys in ladder.values() for k in keys))
    subsets = list(ladder.values())
    mine = subset_aggregate(left, columns, subsets, [F.count(F.lit(1)).alias("n_left")])
    theirs = subset_aggregate(schedule, columns, subsets,
                              [F.count(F.when(F.col(year) == y, 1)).alias(f"n_{y}") for y in years])
    joined = _join_subsets(mine, theirs, columns)
    found = joined.groupBy("subset").agg(
        F.sum("n_left").alias("rows_with_keys"),
        *[F.sum(F.when(F.col(f"n_{y}") > 0, F.col("n_left")).otherwise(0)).alias(str(y)) for y in years])
    names = F.create_map(*[F.lit(x) for level, keys in ladder.items()
                           for x in (subset_id(columns, keys), level)])
    long = found.select(F.element_at(names, F.col("subset").cast("int")).alias("level"), "rows_with_keys",
                        *[F.col(str(y)) for y in years])
    return (long.unpivot(["level", "rows_with_keys"], [str(y) for y in years], "year", "candidate_rows")
            .withColumn("year", F.col("year").cast("int"))
            .withColumn("candidate_rate", F.col("candidate_rows") / F.col("rows_with_keys")))


def masking_diagnostic(truth: DataFrame, schedule: DataFrame, keys: Sequence[str], volatile: Sequence[str],
                       years: Sequence[int], *, truth_year: str = "attributed_year", year: str = "yr"
                       ) -> DataFrame:
    """Hide every choice of volatile keys on rows of known year: right, wrong, several, none."""
    subsets = volatile_subsets(keys, volatile)
    hidden = subset_aggregate(truth, keys, subsets, [F.count(F.lit(1)).alias("n_left")], extra=[truth_year])
    counts = subset_aggregate(schedule, keys, subsets,
                              [F.count(F.when(F.col(year) == y, 1)).alias(f"n_{y}") for y in years])
    joined = _join_subsets(hidden, counts, keys)
    hits = sum((F.coalesce((F.col(f"n_{y}") > 0).cast("int"), F.lit(0)) for y in years), F.lit(0))
    picked = F.coalesce(*[F.when(F.col(f"n_{y}") > 0, F.lit(y)) for y in years])

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n_left")).otherwise(0))

    result = joined.withColumn("_hits", hits).withColumn("_picked", picked).groupBy("subset").agg(
        F.sum("n_left").alias("n_rows_tested"),
        rows((F.col("_hits") == 1) & (F.col("_picked") == F.col(truth_year))).alias("single_correct"),
        rows((F.col("_hits") == 1) & (F.col("_picked") != F.col(truth_year))).alias("single_wrong"),
        rows(F.col("_hits") > 1).alias("multi_year"), rows(F.col("_hits") == 0).alias("no_candidate"))
    names = F.create_map(*[F.lit(x) for s in subsets
                           for x in (subset_id(keys, s), "+".join(k for k in volatile if k not in s))])
    return result.select(F.element_at(names, F.col("subset").cast("int")).alias("masked_keys"),
                         "n_rows_tested", "single_correct", "single_wrong", "multi_year", "no_candidate")


# ---- year attribution -------------------------------------------------------

def classify_complete(matched: DataFrame, years: Sequence[int]) -> DataFrame:
    """One candidate year is adopted; several or none are only reported."""
    hits = sum(((F.col(f"n_{y}") > 0).cast("int") for y in years), F.lit(0)).cast("int")
    year = F.coalesce(*[F.when(F.col(f"n_{y}") > 0, F.lit(y)) for y in years])
    return matched.withColumns({
        "candidate_years": hits,
        "status": F.when(hits == 0, COMPLETE_NONE).when(hits == 1, COMPLETE_SINGLE).otherwise(COMPLETE_MULTI),
        "attributed_year": F.when(hits == 1, year).cast("int"),
    })


def classify_missing(matched: DataFrame) -> DataFrame:
    """Status by the total number of schedule rows; rows with hidden keys are never adopted."""
    total = F.col("candidates_total")
    return matched.withColumns({
        "status": F.when(total == 0, MISSING_NONE).when(total == 1, MISSING_SINGLE).otherwise(MISSING_MULTI),
        "attributed_year": F.lit(None).cast("int"),
    })


def year_attribution(rows: DataFrame, schedule: DataFrame, keys: Sequence[str], volatile: Sequence[str],
                     years: Sequence[int], *, number: str, identifier: str = "flight_id",
                     month: str = "mo", year: str = "yr") -> DataFrame:
    """Status and adopted year of every row; months the schedule lacks are not checked."""
    covered = schedule.select(month).distinct()
    checked = rows.join(covered, month, "left_semi").select(identifier, *keys)
    unchecked = rows.join(covered, month, "left_anti")
    complete = classify_complete(
        match_counts_by_year(checked.filter(_known(keys)), schedule, keys, years, year), years)
    partial = classify_missing(partial_key_match(
        checked.filter(~_known(keys)), schedule, keys, volatile, years, number=number, year=year))
    shown = [identifier, "status", "candidate_years", "attributed_year"]
    skipped = unchecked.select(identifier, F.lit(NOT_CHECKED).alias("status"),
                               F.lit(None).cast("int").alias("candidate_years"),
                               F.lit(None).cast("int").alias("attributed_year"))
    return complete.select(*shown).unionByName(partial.select(*shown)).unionByName(skipped)


# ---- candidates -------------------------------------------------------------

def nearest_candidate(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str,
                      fields: Sequence[str]) -> DataFrame:
    """The right row of the same keys whose clock value is closest, with field deltas.

    Both sides shrink to one row per (keys, clock value) before they meet, so a key holds at
    most one row per minute of the day, and the closest value is the last one before or the
    first one after. Ties go to the earlier value.
    """
    rows = _known([*keys, at])
    known = (right.filter(rows).groupBy(*keys, at)
             .agg(F.min(F.struct(*fields)).alias("_rep")).withColumn("_is_right", F.lit(1)))
    line = (known.select(*keys, at, F.struct(F.col(at).alias("_at"), F.col("_rep")).alias("_cand"))
            .unionByName(left.filter(rows).select(*keys, at).distinct(), allowMissingColumns=True))
    to_here = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    from_here = Window.partitionBy(*keys).orderBy(at).rangeBetween(0, Window.unboundedFollowing)
    sided = (line.withColumn("_prev", F.last("_cand", True).over(to_here))
             .withColumn("_next", F.first("_cand", True).over(from_here)).filter("_cand IS NULL"))
    back, ahead = F.col(at) - F.col("_prev._at"), F.col("_next._at") - F.col(at)
    take_prev = F.col("_prev").isNotNull() & (F.col("_next").isNull() | (back <= ahead))
    best = sided.withColumn("_best", F.when(take_prev, F.col("_prev")).otherwise(F.col("_next")))
    best = best.filter("_best IS NOT NULL").select(*keys, at, "_best")
    joined = left.join(best, [*keys, at])
    return joined.select(*left.columns, (F.col("_best._at") - F.col(at)).alias(f"{at}_delta"),
                         *[F.col(f"_best._rep.{f}").alias(f"{f}_candidate") for f in fields])


def tie_break_compare(left: DataFrame, schedule: DataFrame, keys: Sequence[str], fields: Sequence[str],
                      years: tuple[int, int], *, year: str = "yr") -> DataFrame:
    """For rows matching both years: does a field differ between the years, does it equal the source?"""
    first, second = years
    per_key = schedule.filter(_known(keys)).groupBy(*keys).agg(
        *[F.min(F.when(F.col(year) == y, F.struct(*fields))).alias(f"_c{y}") for y in years])
    both = (left.join(per_key, list(keys)).filter(F.col(f"_c{first}").isNotNull() & F.col(f"_c{second}").isNotNull()))

    def count(condition: Column) -> Column:
        return F.sum(condition.cast("bigint"))

    aggregates = [F.count(F.lit(1)).alias("rows")]
    for f in fields:
        a, b = F.col(f"_c{first}.{f}"), F.col(f"_c{second}.{f}")
        aggregates.append(F.struct(
            count(~a.eqNullSafe(b)).alias("differs_between_years"),
            count(a.eqNullSafe(F.col(f))).alias("matches_source_first"),
            count(b.eqNullSafe(F.col(f))).alias("matches_source_second")).alias(f))
    wide = both.agg(*aggregates)
    return wide.select("rows", F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"{f}.differs_between_years"),
                 F.col(f"{f}.matches_source_first"), F.col(f"{f}.matches_source_second")) for f in fields])))


def membership_agreement(left: DataFrame, schedule: DataFrame, keys: Sequence[str], code: str,
                         years: Sequence[int], *, schedule_code: str | None = None, year: str = "yr") -> DataFrame:
    """Per year: rows with a match, those with a code, and those whose code is among the matched rows' codes.

    Membership is a join on distinct (key, code) pairs; no set of codes is collected per key.
    """
    theirs = schedule_code or code
    known = schedule.filter(_known(keys))
    flags = [F.max((F.col(year) == y).cast("int")) for y in years]
    by_key = known.groupBy(*keys).agg(*[f.alias(f"_hit_{y}") for f, y in zip(flags, years)])
    by_code = (known.filter(F.col(theirs).isNotNull()).groupBy(*keys, F.col(theirs).alias("_code"))
               .agg(*[f.alias(f"_code_{y}") for f, y in zip(flags, years)]))
    rows = left.filter(_known(keys)).withColumn("_code", F.col(code))
    joined = rows.join(by_key, list(keys)).join(by_code, [*keys, "_code"], "left")
    wide = joined.agg(*[F.struct(
        F.lit(y).alias("year"),
        F.sum(F.col(f"_hit_{y}")).alias("matched_rows"),
        F.sum(F.when(F.col(code).isNotNull(), F.col(f"_hit_{y}")).otherwise(0)).alias("rows_with_code"),
        F.sum(F.coalesce(F.col(f"_code_{y}"), F.lit(0))).alias("code_agrees")).alias(f"y{y}") for y in years])
    return wide.select(F.inline(F.array(*[F.col(f"y{y}") for y in years]))).withColumn(
        "agreement_rate", F.try_divide(F.col("code_agrees"), F.col("rows_with_code")))


# ---- identity joins ---------------------------------------------------------

def unique_by(df: DataFrame, key: str) -> DataFrame:
    """The same rows, raising at run time when a key repeats."""
    others = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*others)).alias("_row"))
    ok = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast(
            grouped.schema["_row"].dataType))
    return grouped.select(key, ok.alias("_row")).select(key, "_row.*")


def align_by_id(raw: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``raw`` for the listed ids, with the list's columns; a missing or repeated id raises."""
    marked = unique_by(raw.withColumn("_found", F.lit(True)), key)
    joined = unique_by(ids, key).join(marked, key, "left")
    found = F.coalesce(F.col("_found"), F.raise_error(F.lit(f"{key} missing from the source")).cast("boolean"))
    return joined.filter(found).drop("_found")


def attach_features(rows: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left join on a unique key: no row is lost or repeated, no column is overwritten."""
    clash = sorted((set(rows.columns) & set(features.columns)) - {key})
    if clash:
        raise ValueError(f"feature columns already present: {clash}")
    return rows.join(unique_by(features, key), key, "left")
