"""Scores of predictions: confusion counts, losses, AUC, calibration bins, thresholds.

All functions take a list of grouping keys (possibly empty) and score every group in
the same pass. Nothing orders a whole group in one task: AUC and quantile bins work on
distinct probabilities spread over probability buckets.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.functions import numeric
from tripwright.operators.skew import BUCKET, exact_quantile_array, join_null_safe, running_totals

CELLS = ("tn", "fp", "fn", "tp")
# Cell -> (actual class, predicted class).
CELL_CLASSES = {"tn": ("Not_Delayed", "Not_Delayed"), "fp": ("Not_Delayed", "Delayed"),
                "fn": ("Delayed", "Not_Delayed"), "tp": ("Delayed", "Delayed")}
# Bin numbers of the two calibration tables.
EQUAL_WIDTH, EQUAL_FREQUENCY = 10, 15
# Candidate thresholds 0.10, 0.11, ... 0.70.
THRESHOLDS = tuple(round(0.10 + 0.01 * k, 10) for k in range(61))


# ---- counts -----------------------------------------------------------------

def cell_sums(y: Column, prediction: Column) -> list[Column]:
    wanted = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return [F.count(F.when((y == a) & (prediction == b), 1)).alias(c) for c, (a, b) in wanted.items()]


def confusion_counts(df: DataFrame, keys: Sequence[str], y: str = "y_true",
                     prediction: str = "prediction") -> DataFrame:
    return df.groupBy(*keys).agg(*cell_sums(F.col(y), F.col(prediction)))


def with_prediction(df: DataFrame, p: str = "p", threshold: str = "threshold") -> DataFrame:
    return df.withColumn("prediction", (F.col(p) >= F.col(threshold)).cast("int"))


def class_metrics(df: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """Per-class precision, recall and F1 from tn/fp/fn/tp.

    ``empty`` fills a ratio with a zero denominator: 0.0 scores it, None leaves it null.
    """
    tn, fp, fn, tp = [F.col(c) for c in CELLS]

    def ratio(a: Column, b: Column) -> Column:
        return numeric.ratio_or(a, b, empty)

    out = df.withColumns({
        "precision_delayed": ratio(tp, tp + fp), "recall_delayed": ratio(tp, tp + fn),
        "f1_delayed": ratio(2 * tp, 2 * tp + fp + fn),
        "precision_not_delayed": ratio(tn, tn + fn), "recall_not_delayed": ratio(tn, tn + fp),
        "f1_not_delayed": ratio(2 * tn, 2 * tn + fn + fp),
        "false_positive_rate": ratio(fp, fp + tn),
        "error_rate": ratio(fp + fn, tn + fp + fn + tp),
    })
    return out.withColumn("macro_f1", (F.col("f1_delayed") + F.col("f1_not_delayed")) / 2)


def confusion_long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per confusion cell with the size of its actual class."""
    total = sum((F.col(c) for c in CELLS), F.lit(0))
    sized = df.withColumn("_n", total).withColumn("_pos", F.col("fn") + F.col("tp"))
    cells = [F.struct(F.lit(c.upper()).alias("cell"), F.lit(a).alias("actual"), F.lit(b).alias("predicted"),
                      F.col(c).alias("n"),
                      (F.col("_pos") if a == "Delayed" else F.col("_n") - F.col("_pos")).alias("actual_class_rows"))
             for c, (a, b) in CELL_CLASSES.items()]
    return (sized.select(*keys, F.col("_n").alias("n_rows"), F.inline(F.array(*cells)))
            .withColumn("share_of_rows", F.col("n") / F.col("n_rows")))


def metrics_long(df: DataFrame, keys: Sequence[str], recorded: Sequence[str], derived: Sequence[str]) -> DataFrame:
    """Recorded and derived metrics as (metric, value, source) rows."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                     F.lit("recorded" if m in recorded else "derived from tn/fp/fn/tp").alias("source"))
            for m in (*recorded, *derived)]
    return df.select(*keys, F.inline(F.array(*rows)))


# ---- calibration bins -------------------------------------------------------

def _complete_bins(binned: DataFrame, keys: Sequence[str], n_bins: int, carried: Sequence[str] = ()) -> DataFrame:
    """Per key all bins 0..n_bins-1; empty ones keep n = 0 and null means."""
    stats = F.struct(F.col("bin"), F.struct("n", "mean_probability", "observed_rate"))
    per_key = binned.groupBy(*keys).agg(F.map_from_entries(F.collect_list(stats)).alias("_bins"),
                                        *[F.any_value(c).alias(c) for c in carried])
    rows = per_key.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    rows = rows.withColumn("_s", F.try_element_at(F.col("_bins"), F.col("bin")))
    return rows.select(*keys, "bin", F.coalesce(F.col("_s.n"), F.lit(0)).cast("bigint").alias("n"),
                       F.col("_s.mean_probability").alias("mean_probability"),
                       F.col("_s.observed_rate").alias("observed_rate"),
                       F.abs(F.col("_s.mean_probability") - F.col("_s.observed_rate")).alias("abs_gap"), *carried)


def equal_width_bins(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "p",
                     n_bins: int = EQUAL_WIDTH) -> DataFrame:
    index = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")
    binned = df.groupBy(*keys, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg(y).alias("observed_rate"))
    full = _complete_bins(binned, keys, n_bins)
    return full.withColumn("lower", F.col("bin") / n_bins).withColumn("upper", (F.col("bin") + 1) / n_bins)


def equal_frequency_bins(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "p",
                         n_bins: int = EQUAL_FREQUENCY) -> DataFrame:
    """Quantile bins; equal probabilities always share one, so ties can leave bins empty."""
    keys = list(keys)
    edges = exact_quantile_array(df, keys, p, [k / n_bins for k in range(n_bins + 1)])
    edges = edges.select(*keys, F.col("quantiles").alias("_edges"))
    values = df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos"))
    joined = join_null_safe(values, edges, keys) if keys else values.withColumn("_edges", edges.scalar())
    interior = F.slice(F.col("_edges"), 2, n_bins - 1)
    index = F.size(F.filter(interior, lambda e: e <= F.col(p)))
    binned = joined.groupBy(*keys, index.alias("bin")).agg(
        F.sum("_n").alias("n"), (F.sum(F.col(p) * F.col("_n")) / F.sum("_n")).alias("mean_probability"),
        (F.sum("_pos") / F.sum("_n")).alias("observed_rate"), F.any_value("_edges").alias("_edges"))
    full = _complete_bins(binned, keys, n_bins, ["_edges"])
    return (full.withColumn("lower", F.col("_edges")[F.col("bin")])
            .withColumn("upper", F.col("_edges")[F.col("bin") + 1]).drop("_edges"))


def expected_calibration_error(bins: DataFrame, keys: Sequence[str], name: str = "ece") -> DataFrame:
    return bins.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.coalesce("abs_gap", F.lit(0.0))) / F.sum("n")).alias(name))


def weighted_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row-weighted mean probability and rate of each bin over the seeds."""
    n = F.col("n")
    return bins.groupBy(*keys, "bin").agg(
        F.sum(n).alias("n"),
        F.try_divide(F.sum(n * F.col("mean_probability")), F.sum(n)).alias("mean_probability"),
        F.try_divide(F.sum(n * F.col("observed_rate")), F.sum(n)).alias("observed_rate"))


# ---- ranking and losses -----------------------------------------------------

def roc_auc(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "p",
            name: str = "roc_auc") -> DataFrame:
    """Tie-aware AUC per group, null where a class is absent. Probabilities lie in [0, 1]."""
    keys = list(keys)
    work = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    counts = base.groupBy(*work, p).agg(F.count(F.when(F.col(y) == 1, 1)).alias("_pos"),
                                        F.count(F.when(F.col(y) == 0, 1)).alias("_neg"))
    counts = counts.withColumn(BUCKET, F.floor(F.col(p) * 1024))
    ranked = running_totals(counts, work, [F.col(p)], {"_cum_neg": F.col("_neg")})
    below = F.col("_cum_neg") - F.col("_neg") / 2
    pairs = F.sum("_pos") * F.sum("_neg")
    return ranked.groupBy(*work).agg(
        F.when(pairs > 0, F.sum(F.col("_pos") * below) / pairs).alias(name)).select(*keys, name)


def probability_aggregates(y: Column, p: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.avg(y).alias("positive_rate"),
            F.avg(p).alias("mean_probability"), (F.avg(p) - F.avg(y)).alias("calibration_bias"),
            F.avg(numeric.log_loss_term(y, p)).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier")]


def score_metrics(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "p",
                  prediction: str = "prediction", *, ranking: bool = True) -> DataFrame:
    """The full score row of each group; ``ranking`` adds AUC and the equal-width ECE."""
    base = df.groupBy(*keys).agg(*probability_aggregates(F.col(y), F.col(p)),
                                 *cell_sums(F.col(y), F.col(prediction)))
    out = class_metrics(base, None)
    # the macro average scores an undefined class as 0, the ratios stay null
    out = out.withColumn("macro_f1", (F.coalesce("f1_delayed", F.lit(0.0)) + F.coalesce("f1_not_delayed", F.lit(0.0))) / 2)
    out = out.withColumn("fnr", numeric.ratio_or(F.col("fn"), F.col("fn") + F.col("tp"), None))
    out = out.select(*keys, "n", "positives", "positive_rate", "mean_probability", "calibration_bias", "macro_f1",
                     "log_loss", "brier", *CELLS, F.col("precision_delayed").alias("precision"),
                     F.col("recall_delayed").alias("recall"), F.col("false_positive_rate").alias("fpr"), "fnr",
                     "error_rate")
    if not ranking:
        return out
    auc = roc_auc(df, keys, y, p)
    ece = expected_calibration_error(equal_width_bins(df, keys, y, p), keys, "ece_10")
    if not keys:
        return out.withColumn("roc_auc", auc.scalar()).withColumn("ece_10", ece.scalar())
    return join_null_safe(join_null_safe(out, auc, keys), ece, keys)


def overlapping_group_metrics(df: DataFrame, keys: Sequence[str], groups: dict[str, Column],
                              expected: Sequence[tuple[str, str]], y: str = "y_true", p: str = "p",
                              prediction: str = "prediction") -> DataFrame:
    """Scores for groups that overlap: each row is tagged with one group per dimension, one scan for all.

    ``groups`` maps a dimension to the row's group label (null: in none); ``expected`` lists
    (dimension, group) pairs reported with n = 0 when they are empty.
    """
    tags = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("group")),
                   *[F.struct(F.lit(d).alias("dimension"), g.cast("string").alias("group"))
                     for d, g in groups.items()])
    tagged = df.select(*keys, y, p, prediction, F.inline(tags)).filter(F.col("group").isNotNull())
    scores = score_metrics(tagged, [*keys, "dimension", "group"], y, p, prediction, ranking=False)
    seen = scores.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.lit(g).alias("group")) for d, g in expected]))).distinct()
    filled = seen.join(scores, [*keys, "dimension", "group"], "full_outer")
    return filled.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("positives", F.coalesce("positives", F.lit(0)))


def score_with_fold_thresholds(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], *, fold: str = "fold",
                               y: str = "y_true", p: str = "p") -> DataFrame:
    """Pooled scores when every fold has its own threshold; adds the mean within-fold AUC."""
    joined = join_null_safe(df.drop("threshold"), thresholds, [*keys, fold])
    pooled = score_metrics(with_prediction(joined, p), keys, y, p)
    within = roc_auc(df, [*keys, fold], y, p).groupBy(*keys).agg(F.avg("roc_auc").alias("roc_auc_within_fold_mean"))
    return join_null_safe(pooled, within, keys)


# ---- thresholds -------------------------------------------------------------

def thresholds_reached(p: Column) -> Column:
    """How many candidate thresholds are at or below p, without scanning the list."""
    values = F.array(*[F.lit(t) for t in THRESHOLDS])
    guess = F.least(F.greatest(F.floor((p - THRESHOLDS[0]) * 100).cast("int"), F.lit(-1)), F.lit(len(THRESHOLDS) - 1))
    above = F.try_element_at(values, guess + 2)
    here = F.try_element_at(values, F.greatest(guess + 1, F.lit(1)))
    return (guess + 1 + F.when(p >= above, 1).otherwise(0)
            - F.when((guess >= 0) & (p < here), 1).otherwise(0)).cast("int")


def threshold_counts(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "p") -> DataFrame:
    """Rows per (keys, thresholds reached): at most 62 rows per key replace the 61 sweeps."""
    return df.groupBy(*keys, thresholds_reached(F.col(p)).alias("reached")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg"))


def _macro_f1() -> Column:
    tn, fp, fn, tp = [F.col(c) for c in CELLS]
    one = numeric.ratio_or(2 * tp, 2 * tp + fp + fn, 0.0)
    zero = numeric.ratio_or(2 * tn, 2 * tn + fp + fn, 0.0)
    return (one + zero) / 2


def sweep(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro F1 at every threshold from ``threshold_counts`` rows (or sums of them)."""
    entry = F.struct(F.col("reached"), F.struct("pos", "neg"))
    summed = counts.groupBy(*keys, "reached").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    per_key = summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    rows = per_key.withColumn("reached", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS)))))
    found = F.try_element_at(F.col("_m"), F.col("reached"))
    rows = rows.select(*keys, "reached", F.coalesce(found["pos"], F.lit(0)).alias("pos"),
                       F.coalesce(found["neg"], F.lit(0)).alias("neg"))
    at_or_above = Window.partitionBy(*keys).orderBy("reached").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    rows = (rows.withColumn("tp", F.coalesce(F.sum("pos").over(at_or_above), F.lit(0)))
            .withColumn("fp", F.coalesce(F.sum("neg").over(at_or_above), F.lit(0)))
            .withColumn("fn", F.sum("pos").over(whole) - F.col("tp"))
            .withColumn("tn", F.sum("neg").over(whole) - F.col("fp")))
    values = F.array(*[F.lit(t) for t in THRESHOLDS])
    return rows.filter(F.col("reached") < len(THRESHOLDS)).select(
        *keys, F.element_at(values, F.col("reached") + 1).alias("threshold"), *CELLS, _macro_f1().alias("macro_f1"))


def best_threshold(swept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest threshold with the largest macro F1 per key."""
    rank = F.struct(F.col("macro_f1"), (-F.col("threshold")).alias("negated"))
    best = swept.groupBy(*keys).agg(F.max(rank).alias("_b"))
    return best.select(*keys, (-F.col("_b.negated")).alias("threshold"), F.col("_b.macro_f1").alias("macro_f1"))


def cross_fold_thresholds(df: DataFrame, keys: Sequence[str], fold: str = "fold", y: str = "y_true",
                          p: str = "p") -> tuple[DataFrame, DataFrame]:
    """(per fold threshold chosen on the other folds, summary per key).

    Rows are read once, into at most 62 counts per fold; the choice works on those counts.
    """
    keys = list(keys)
    counts = threshold_counts(df, [*keys, fold], y, p)
    # each fold's counts serve every other fold of its key
    every = Window.partitionBy(*keys)
    others = counts.withColumn("_folds", F.collect_set(fold).over(every)).withColumn("_for", F.explode("_folds"))
    others = others.filter(F.col(fold) != F.col("_for")).drop(fold, "_folds").withColumnRenamed("_for", fold)
    chosen = best_threshold(sweep(others, [*keys, fold]), [*keys, fold]).drop("macro_f1")
    naive = best_threshold(sweep(counts, keys), keys).select(
        *keys, F.col("threshold").alias("naive_threshold"), F.col("macro_f1").alias("naive_f1"))
    own = join_null_safe(sweep(counts, [*keys, fold]), chosen, [*keys, fold, "threshold"])
    nested = own.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in CELLS],
                                    F.median("threshold").alias("deployment_threshold"))
    nested = nested.withColumn("nested_f1", _macro_f1()).drop(*CELLS)
    if keys:
        summary = join_null_safe(nested, naive, keys)
    else:
        summary = nested.withColumns({c: naive.select(c).scalar() for c in ("naive_threshold", "naive_f1")})
    return chosen, summary.withColumn("optimism", F.col("naive_f1") - F.col("nested_f1"))
