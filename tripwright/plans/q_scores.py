"""Scores, calibration, thresholds, folds, encodings and run comparisons."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.functions import text
from tripwright.operators import clean, compare, contracts, encode, metrics, report, slots
from tripwright.operators.metrics import CELLS, THRESHOLDS
from tripwright.plans.registry import query
from tripwright.storage import materialize

V = ("flights", "oof")
PRED_SQL = "pred AS (SELECT *, CAST(p >= threshold AS INT) AS prediction FROM oof)"
_CELLS_SQL = ("count(*) FILTER (y_true = 0 AND prediction = 0) AS tn, count(*) FILTER (y_true = 0 AND prediction = 1) AS fp,"
              " count(*) FILTER (y_true = 1 AND prediction = 0) AS fn, count(*) FILTER (y_true = 1 AND prediction = 1) AS tp")
_EPS = "2.220446049250313e-16::DOUBLE"
_LOSS = (f"avg(-CASE WHEN y_true = 1 THEN ln(least(greatest(p, {_EPS}), 1::DOUBLE - {_EPS}))"
         f" ELSE ln(1 - least(greatest(p, {_EPS}), 1::DOUBLE - {_EPS})) END)")
_DIMS_SQL = "dims AS (SELECT *, flight_id % 10 AS grp FROM pred)"


def predicted(spark, sf):
    return metrics.with_prediction(fx.oof(spark, sf))


def grouped(spark, sf):
    return predicted(spark, sf).withColumn("grp", F.col("flight_id") % 10)


def rounded(df, columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("a6_confusion_counts", f"WITH {PRED_SQL}, {_DIMS_SQL} SELECT seed, grp, {_CELLS_SQL} FROM dims GROUP BY seed, grp", V)
def confusion_counts(spark, sf):
    return metrics.confusion_counts(grouped(spark, sf), ["seed", "grp"])


@query("a6_error_table", f"""WITH {PRED_SQL}, {_DIMS_SQL}, c AS (SELECT seed, grp, {_CELLS_SQL} FROM dims GROUP BY seed, grp)
SELECT 'oof' AS population, 'grp' AS dimension, seed, grp AS "group", tn, fp, fn, tp, tn + fp + fn + tp AS n_rows, fn + tp AS n_delayed,
 round(tp / nullif(tp + fp, 0), 9) AS precision_delayed, round(tp / nullif(tp + fn, 0), 9) AS recall_delayed,
 round(fp / nullif(fp + tn, 0), 9) AS false_positive_rate, round((fp + fn) / (tn + fp + fn + tp), 9) AS error_rate,
 CAST(sum(tn + fp + fn + tp) OVER (PARTITION BY seed) AS BIGINT) AS seed_population_rows FROM c""", V)
def error_table(spark, sf):
    out = report.error_table(grouped(spark, sf), "grp", population="oof")
    return rounded(out, ["precision_delayed", "recall_delayed", "false_positive_rate", "error_rate"])


_RUNS_SQL = f"{PRED_SQL}, runs AS (SELECT seed, {_CELLS_SQL} FROM pred GROUP BY seed)"
_LONG_CELLS = " UNION ALL ".join(
    f"SELECT seed, tn + fp + fn + tp AS n_rows, '{c.upper()}' AS cell, '{a}' AS actual, '{b}' AS predicted, {c} AS n,"
    f" {'fn + tp' if a == 'Delayed' else 'tn + fp'} AS actual_class_rows, round({c} / (tn + fp + fn + tp), 9) AS share_of_rows FROM runs"
    for c, (a, b) in metrics.CELL_CLASSES.items())


@query("a7_confusion_long", f"WITH {_RUNS_SQL} {_LONG_CELLS}", V)
def confusion_long(spark, sf):
    runs = metrics.confusion_counts(predicted(spark, sf), ["seed"])
    return rounded(metrics.confusion_long(runs, ["seed"]), ["share_of_rows"])


_CLASS_SQL = """coalesce(tp / nullif(tp + fp, 0), {e}) AS precision_delayed, coalesce(tp / nullif(tp + fn, 0), {e}) AS recall_delayed,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), {e}) AS f1_delayed, coalesce(tn / nullif(tn + fn, 0), {e}) AS precision_not_delayed,
 coalesce(tn / nullif(tn + fp, 0), {e}) AS recall_not_delayed, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), {e}) AS f1_not_delayed,
 coalesce(fp / nullif(fp + tn, 0), {e}) AS false_positive_rate, (fp + fn) / (tn + fp + fn + tp) AS error_rate"""
_CLASS_COLUMNS = ["precision_delayed", "recall_delayed", "f1_delayed", "precision_not_delayed", "recall_not_delayed",
                  "f1_not_delayed", "false_positive_rate", "error_rate", "macro_f1"]


def _class_sql(empty: str) -> str:
    shown = ", ".join(f"round({c}, 9) AS {c}" for c in _CLASS_COLUMNS)
    # single-row groups make zero denominators common
    return f"""WITH {PRED_SQL}, cells AS (SELECT seed, flight_id % 500 AS grp, {_CELLS_SQL} FROM pred GROUP BY 1, 2),
m AS (SELECT *, {_CLASS_SQL.format(e=empty)} FROM cells), f AS (SELECT *, (f1_delayed + f1_not_delayed) / 2 AS macro_f1 FROM m)
SELECT seed, grp, {shown} FROM f"""


def _small_groups(spark, sf):
    rows = predicted(spark, sf).withColumn("grp", F.col("flight_id") % 500)
    return metrics.confusion_counts(rows, ["seed", "grp"])


@query("a8_class_metrics_zero", _class_sql("0::DOUBLE"), V)
def class_metrics_zero(spark, sf):
    out = metrics.class_metrics(_small_groups(spark, sf), 0.0)
    return rounded(out, _CLASS_COLUMNS).select("seed", "grp", *_CLASS_COLUMNS)


@query("a8_class_metrics_null", _class_sql("NULL"), V)
def class_metrics_null(spark, sf):
    out = metrics.class_metrics(_small_groups(spark, sf), None)
    return rounded(out, _CLASS_COLUMNS).select("seed", "grp", *_CLASS_COLUMNS)


@query("a9_metrics_long", f"""WITH {PRED_SQL}, runs AS (SELECT seed, {_LOSS} AS log_loss, avg((p - y_true) * (p - y_true)) AS brier, {_CELLS_SQL} FROM pred GROUP BY seed)
SELECT seed, 'log_loss' AS metric, round(log_loss, 9) AS value, 'recorded' AS source FROM runs UNION ALL SELECT seed, 'brier', round(brier, 9), 'recorded' FROM runs
UNION ALL SELECT seed, 'recall_delayed', round(tp / (tp + fn), 9), 'derived from tn/fp/fn/tp' FROM runs
UNION ALL SELECT seed, 'error_rate', round((fp + fn) / (tn + fp + fn + tp), 9), 'derived from tn/fp/fn/tp' FROM runs""", V)
def metrics_long(spark, sf):
    runs = predicted(spark, sf).groupBy("seed").agg(
        *metrics.probability_aggregates(F.col("y_true"), F.col("p")),
        *metrics.cell_sums(F.col("y_true"), F.col("prediction")))
    runs = metrics.class_metrics(runs, None)
    return rounded(metrics.metrics_long(runs, ["seed"], ["log_loss", "brier"], ["recall_delayed", "error_rate"]), ["value"])


@query("a10_error_stability", f"""WITH {PRED_SQL}, per_row AS (SELECT flight_id, CAST(sum(CAST(prediction <> y_true AS INT)) AS INT) AS wrong FROM pred GROUP BY flight_id)
SELECT flight_id % 10 AS "group", count(*) FILTER (wrong = 0) AS n_wrong_0, count(*) FILTER (wrong = 1) AS n_wrong_1, count(*) FILTER (wrong = 2) AS n_wrong_2,
 count(*) FILTER (wrong = 3) AS n_wrong_3, count(*) AS n_rows, round(count(*) FILTER (wrong = 3) / count(*), 9) AS share_wrong_all,
 round(count(*) FILTER (wrong = 0) / count(*), 9) AS share_wrong_none FROM per_row GROUP BY 1""", V)
def error_stability(spark, sf):
    per_row = report.wrong_counts(predicted(spark, sf)).withColumn("grp", F.col("flight_id") % 10)
    return rounded(report.error_stability(per_row, "grp"), ["share_wrong_all", "share_wrong_none"])


_AUC_SQL = """auc_{n} AS (SELECT {k}, sum(CASE WHEN y_true = 1 THEN below END) / nullif(count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0), 0) AS roc_auc
 FROM (SELECT {k}, y_true, sum(1 - y_true) OVER (PARTITION BY {k} ORDER BY p RANGE UNBOUNDED PRECEDING)
  - sum(1 - y_true) OVER (PARTITION BY {k}, p) / 2 AS below FROM pred) GROUP BY {k})"""
_EW_SQL = """ew AS (SELECT {k}, b, count(*) AS n, avg(p) AS mp, avg(y_true) AS rate FROM (SELECT *, least(CAST(floor(p * 10) AS INT), 9) AS b FROM pred) GROUP BY {k}, b),
ece AS (SELECT {k}, sum(n * abs(mp - rate)) / sum(n) AS ece_10 FROM ew GROUP BY {k})"""


@query("a11_score_metrics", f"""WITH {PRED_SQL}, {_AUC_SQL.format(n='s', k='seed')}, {_EW_SQL.format(k='seed')},
b AS (SELECT seed, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS positives, avg(y_true) AS positive_rate, avg(p) AS mean_probability, avg(p) - avg(y_true) AS calibration_bias,
 {_LOSS} AS log_loss, avg((p - y_true) * (p - y_true)) AS brier, {_CELLS_SQL} FROM pred GROUP BY seed)
SELECT seed, n, positives, round(positive_rate, 9) AS positive_rate, round(mean_probability, 9) AS mean_probability, round(calibration_bias, 9) AS calibration_bias,
 round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) AS macro_f1, round(log_loss, 9) AS log_loss, round(brier, 9) AS brier, tn, fp, fn, tp,
 round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(fp / (fp + tn), 9) AS fpr, round(fn / (fn + tp), 9) AS fnr, round((fp + fn) / n, 9) AS error_rate,
 round(roc_auc, 9) AS roc_auc, round(ece_10, 9) AS ece_10 FROM b JOIN auc_s USING (seed) JOIN ece USING (seed)""", V)
def score_metrics(spark, sf):
    out = metrics.score_metrics(predicted(spark, sf), ["seed"])
    return rounded(out, [c for c, t in out.dtypes if t == "double"])


@query("a12_log_loss", f"SELECT seed, fold, round({_LOSS}, 9) AS log_loss FROM oof GROUP BY seed, fold", V)
def log_loss(spark, sf):
    from tripwright.functions.numeric import log_loss_term

    return fx.oof(spark, sf).groupBy("seed", "fold").agg(
        F.round(F.avg(log_loss_term(F.col("y_true"), F.col("p"))), 9).alias("log_loss"))


@query("a13_roc_auc", f"""WITH {PRED_SQL}, {_AUC_SQL.format(n='f', k='seed, fold')}, {_AUC_SQL.format(n='s', k='seed')}
SELECT seed, round(auc_s.roc_auc, 9) AS roc_auc, round(w, 9) AS roc_auc_within_fold_mean FROM auc_s JOIN (SELECT seed, avg(roc_auc) AS w FROM auc_f GROUP BY seed) USING (seed)""", V)
def roc_auc(spark, sf):
    rows = fx.oof(spark, sf)
    within = metrics.roc_auc(rows, ["seed", "fold"]).groupBy("seed").agg(
        F.round(F.avg("roc_auc"), 9).alias("roc_auc_within_fold_mean"))
    return rounded(metrics.roc_auc(rows, ["seed"]), ["roc_auc"]).join(within, "seed")


@query("a14_equal_width_bins", f"""WITH {PRED_SQL}, {_EW_SQL.format(k='seed')},
grid AS (SELECT seed, CAST(b AS INT) AS bin FROM (SELECT DISTINCT seed FROM pred) CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS b))
SELECT g.seed, bin, coalesce(n, 0) AS n, round(mp, 9) AS mean_probability, round(rate, 9) AS observed_rate, round(abs(mp - rate), 9) AS abs_gap,
 bin / 10 AS lower, (bin + 1) / 10 AS upper FROM grid g LEFT JOIN ew ON g.seed = ew.seed AND g.bin = ew.b""", V)
def equal_width_bins(spark, sf):
    return rounded(metrics.equal_width_bins(predicted(spark, sf), ["seed"]), ["mean_probability", "observed_rate", "abs_gap"])


_EF_SQL = """edges AS (SELECT seed, quantile_cont(p, [""" + ", ".join(f"{k}::DOUBLE / 15" for k in range(16)) + """]) AS e FROM pred GROUP BY seed),
placed AS (SELECT pred.*, CAST(len(list_filter(e[2:15], lambda x: x <= p)) AS INT) AS b FROM pred JOIN edges USING (seed)),
ef AS (SELECT seed, b, count(*) AS n, avg(p) AS mp, avg(y_true) AS rate FROM placed GROUP BY seed, b)"""


@query("a15_equal_frequency_bins_ece", f"""WITH {PRED_SQL}, {_EF_SQL},
grid AS (SELECT seed, e, CAST(b AS INT) AS bin FROM edges CROSS JOIN (SELECT unnest(generate_series(0, 14)) AS b))
SELECT g.seed, bin, coalesce(n, 0) AS n, round(mp, 9) AS mean_probability, round(rate, 9) AS observed_rate, round(abs(mp - rate), 9) AS abs_gap,
 round(e[bin + 1], 9) AS lower, round(e[bin + 2], 9) AS upper FROM grid g LEFT JOIN ef ON g.seed = ef.seed AND g.bin = ef.b""", V)
def equal_frequency_bins(spark, sf):
    return rounded(metrics.equal_frequency_bins(predicted(spark, sf), ["seed"]),
                   ["mean_probability", "observed_rate", "abs_gap", "lower", "upper"])


@query("a15_ece", f"""WITH {PRED_SQL}, {_EF_SQL}
SELECT seed, round(sum(n * abs(mp - rate)) / sum(n), 9) AS ece_ef15 FROM ef GROUP BY seed""", V)
def ece(spark, sf):
    bins = metrics.equal_frequency_bins(predicted(spark, sf), ["seed"])
    return rounded(metrics.expected_calibration_error(bins, ["seed"], "ece_ef15"), ["ece_ef15"])


_PATTERN_SQL = ("CASE WHEN dep_hhmm IS NOT NULL AND arr_hhmm IS NOT NULL THEN 'both_observed' WHEN arr_hhmm IS NOT NULL THEN 'departure_missing'"
                " WHEN dep_hhmm IS NOT NULL THEN 'arrival_missing' ELSE 'both_missing' END")
_FLAGGED_SQL = f"""{PRED_SQL}, flagged AS (SELECT pred.*, CAST(dep_hhmm IS NULL AS INT) AS dep_m, CAST(arr_hhmm IS NULL AS INT) AS arr_m, CAST(airline IS NULL AS INT) AS air_m,
 {_PATTERN_SQL} AS pattern FROM pred JOIN flights USING (flight_id))"""
_LEVELS = (("raw_missing__dep_hhmm", "dep_m"), ("raw_missing__arr_hhmm", "arr_m"), ("raw_missing__airline", "air_m"))


def flagged(spark, sf):
    flags = fx.flights(spark, sf).select(
        "flight_id", F.col("dep_hhmm").isNull().cast("int").alias("dep_m"), F.col("arr_hhmm").isNull().cast("int").alias("arr_m"),
        F.col("airline").isNull().cast("int").alias("air_m"), text.time_pattern(F.col("dep_hhmm"), F.col("arr_hhmm")).alias("pattern"))
    return predicted(spark, sf).join(flags, "flight_id")


def overlapping_groups():
    groups = {name: F.when(F.col(c) == 0, "observed").otherwise("missing") for name, c in _LEVELS}
    groups["raw_missing_count"] = F.col("dep_m") + F.col("arr_m") + F.col("air_m")
    groups["raw_time_pattern"] = F.col("pattern")
    expected = [(n, g) for n, _ in _LEVELS for g in ("observed", "missing")]
    expected += [("raw_time_pattern", g) for g in ("both_observed", "departure_missing", "arrival_missing", "both_missing", "invalid")]
    return groups, expected


@query("a16_overlapping_group_metrics", f"""WITH {_FLAGGED_SQL},
tagged AS (SELECT *, 'overall' AS dimension, 'all' AS "group" FROM flagged
 {" ".join(f"UNION ALL SELECT *, '{n}', CASE WHEN {c} = 0 THEN 'observed' ELSE 'missing' END FROM flagged" for n, c in _LEVELS)}
 UNION ALL SELECT *, 'raw_missing_count', CAST(dep_m + arr_m + air_m AS VARCHAR) FROM flagged UNION ALL SELECT *, 'raw_time_pattern', pattern FROM flagged)
SELECT seed, dimension, "group", count(*) AS n, CAST(sum(y_true) AS BIGINT) AS positives, {_CELLS_SQL}, round({_LOSS}, 9) AS log_loss FROM tagged GROUP BY ALL
UNION ALL SELECT DISTINCT seed, 'raw_time_pattern', 'invalid', 0, 0, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM flagged""", V)
def overlapping_group_metrics(spark, sf):
    groups, expected = overlapping_groups()
    out = metrics.overlapping_group_metrics(flagged(spark, sf), ["seed"], groups, expected)
    return out.select("seed", "dimension", "group", "n", "positives", *CELLS, F.round("log_loss", 9).alias("log_loss"))


@query("a17_score_with_fold_thresholds", f"""WITH th AS (SELECT seed, fold, max(threshold) + 0.05::DOUBLE AS threshold FROM oof GROUP BY seed, fold),
pred AS (SELECT oof.* EXCLUDE (threshold), CAST(p >= th.threshold AS INT) AS prediction FROM oof JOIN th USING (seed, fold)), {_AUC_SQL.format(n='f', k='seed, fold')},
c AS (SELECT seed, {_CELLS_SQL} FROM pred GROUP BY seed)
SELECT seed, tn, fp, fn, tp, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) AS macro_f1, round(w, 9) AS roc_auc_within_fold_mean
FROM c JOIN (SELECT seed, avg(roc_auc) AS w FROM auc_f GROUP BY seed) USING (seed)""", V)
def score_with_fold_thresholds(spark, sf):
    rows = fx.oof(spark, sf)
    chosen = rows.groupBy("seed", "fold").agg((F.max("threshold") + 0.05).alias("threshold"))
    out = metrics.score_with_fold_thresholds(rows, chosen, ["seed"])
    return rounded(out, ["macro_f1", "roc_auc_within_fold_mean"]).select("seed", *CELLS, "macro_f1", "roc_auc_within_fold_mean")


_BYFOLD_SQL = f"by_fold AS (SELECT seed, fold, {_LOSS} AS log_loss, avg((p - y_true) * (p - y_true)) AS brier FROM oof GROUP BY seed, fold)"


@query("a18_seed_summary", f"""WITH per_seed AS (SELECT seed, {_LOSS} AS log_loss FROM oof GROUP BY seed)
SELECT 'log_loss' AS metric, count(*) AS n_units, round(avg(log_loss), 9) AS mean, round(stddev_samp(log_loss), 9) AS std, round(min(log_loss), 9) AS min, round(max(log_loss), 9) AS max,
 string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds FROM per_seed""", V)
def seed_summary(spark, sf):
    runs = metrics.score_metrics(predicted(spark, sf), ["seed"], ranking=False)
    long = metrics.metrics_long(runs, ["seed"], ["log_loss"], [])
    out = compare.summarize_by(long, ["metric"], "value", "seed")
    seeds = F.array_join(F.map_keys("values_by_unit").cast("array<string>"), ",")
    return rounded(out, ["mean", "std", "min", "max"]).select("metric", "n_units", "mean", "std", "min", "max", seeds.alias("seeds"))


_TWO_SQL = f"""two AS (SELECT seed, 'base' AS model, CAST(p >= threshold AS INT) AS prediction, y_true, p FROM oof
 UNION ALL SELECT seed, 'squared', CAST(p * p >= threshold AS INT), y_true, p * p FROM oof),
runs AS (SELECT seed, model, count(*) AS n_rows, {_LOSS} AS log_loss, avg((p - y_true) * (p - y_true)) AS brier, {_CELLS_SQL} FROM two GROUP BY seed, model),
scored AS (SELECT *, (fp + fn) / n_rows AS error_rate FROM runs),
deltas AS (SELECT v.seed, m.metric, m.b AS value_baseline, m.v AS value_variant, m.v - m.b AS delta FROM scored v JOIN scored b ON v.seed = b.seed AND v.model = 'squared' AND b.model = 'base',
 LATERAL (SELECT unnest(['log_loss', 'brier', 'error_rate']) AS metric, unnest([b.log_loss, b.brier, b.error_rate]) AS b, unnest([v.log_loss, v.brier, v.error_rate]) AS v) m)"""


def two_models(spark, sf):
    base = predicted(spark, sf).withColumn("model", F.lit("base"))
    squared = metrics.with_prediction(fx.oof(spark, sf).withColumn("p", F.col("p") * F.col("p"))).withColumn("model", F.lit("squared"))
    runs = metrics.score_metrics(base.unionByName(squared), ["seed", "model"], ranking=False)
    return runs.withColumn("n_rows", F.col("n")).withColumn("fold_fingerprint", F.concat(F.lit("f"), F.col("seed").cast("string")))


_METRICS = ["log_loss", "brier", "error_rate"]


@query("j20_paired_condition_self_join", f"""WITH {_TWO_SQL}
SELECT seed, 'squared' AS model, metric, round(value_baseline, 9) AS value_baseline, round(value_variant, 9) AS value_variant, round(delta, 9) AS delta FROM deltas""", V)
def paired_condition_self_join(spark, sf):
    paired = compare.paired_deltas(two_models(spark, sf), "seed", "model", "base", _METRICS)
    return rounded(paired, ["value_baseline", "value_variant", "delta"])


@query("a19_paired_delta_summary", f"""WITH {_TWO_SQL}
SELECT 'squared' AS model, metric, count(*) AS n_units, round(avg(delta), 9) AS mean, round(stddev_samp(delta), 9) AS std, bool_and(delta > 0) OR bool_and(delta < 0) AS sign_consistent
FROM deltas GROUP BY metric""", V)
def paired_delta_summary(spark, sf):
    paired = compare.paired_deltas(two_models(spark, sf), "seed", "model", "base", _METRICS)
    out = compare.summarize_by(paired, ["model", "metric"], "delta", "seed")
    return rounded(out, ["mean", "std"]).select("model", "metric", "n_units", "mean", "std", "sign_consistent")


@query("j18_full_outer_run_diff", f"""WITH l AS (SELECT seed, fold, {_LOSS} AS log_loss, avg(p) AS mean_p FROM oof WHERE NOT (seed = 7 AND fold = 4) GROUP BY seed, fold),
r AS (SELECT seed, fold, {_LOSS} + CASE WHEN fold = 2 THEN 0.001::DOUBLE ELSE 0 END AS log_loss, avg(p) AS mean_p FROM oof WHERE NOT (seed = 1 AND fold < 2) GROUP BY seed, fold),
j AS (SELECT l.seed AS ls, r.seed AS rs, l.log_loss AS a, r.log_loss AS b, l.mean_p AS c, r.mean_p AS d FROM l FULL JOIN r ON l.seed = r.seed AND l.fold = r.fold),
s AS (SELECT count(*) FILTER (ls IS NOT NULL AND rs IS NOT NULL) AS compared, count(*) FILTER (rs IS NULL) AS left_only, count(*) FILTER (ls IS NULL) AS right_only,
 count(*) FILTER (abs(a - b) > 1e-4) AS n1, round(max(abs(a - b)), 6) AS m1, count(*) FILTER (abs(c - d) > 1e-4) AS n2, round(max(abs(c - d)), 6) AS m2 FROM j)
SELECT compared, left_only, right_only, 'log_loss' AS measure, m1 AS max_abs_diff, CAST(0 AS BIGINT) AS one_sided_nulls, 'different' AS verdict FROM s
UNION ALL SELECT compared, left_only, right_only, 'mean_p', m2, 0, CASE WHEN m2 = 0 THEN 'same' ELSE 'different' END FROM s""", V)
def full_outer_run_diff(spark, sf):
    from tripwright.functions.numeric import log_loss_term

    runs = fx.oof(spark, sf).groupBy("seed", "fold").agg(
        F.avg(log_loss_term(F.col("y_true"), F.col("p"))).alias("log_loss"), F.avg("p").alias("mean_p"))
    left = runs.filter("NOT (seed = 7 AND fold = 4)")
    right = runs.filter("NOT (seed = 1 AND fold < 2)").withColumn(
        "log_loss", F.col("log_loss") + F.when(F.col("fold") == 2, 0.001).otherwise(0.0))
    out = compare.run_diff(left, right, ["seed", "fold"], ["log_loss", "mean_p"], near=1e-9)
    same = F.when(F.col("verdict").isin("identical", "near"), "same").otherwise(F.col("verdict"))
    return out.select("compared", "left_only", "right_only", "measure", F.round("max_abs_diff", 6).alias("max_abs_diff"),
                      "one_sided_nulls", same.alias("verdict"))


# ---- thresholds -------------------------------------------------------------

_GRID = "grid AS (SELECT round(0.10::DOUBLE + 0.01::DOUBLE * k, 10) AS th FROM (SELECT unnest(generate_series(0, 60)) AS k))"
_F1 = "(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2"
_SWEEP_CELLS = ("count(*) FILTER (y_true = 0 AND p < th) AS tn, count(*) FILTER (y_true = 0 AND p >= th) AS fp,"
                " count(*) FILTER (y_true = 1 AND p < th) AS fn, count(*) FILTER (y_true = 1 AND p >= th) AS tp")


@query("m14_threshold_sweep", f"""WITH {_GRID}, c AS (SELECT seed, th AS threshold, {_SWEEP_CELLS} FROM oof CROSS JOIN grid GROUP BY seed, th)
SELECT seed, threshold, tn, fp, fn, tp, round({_F1}, 9) AS macro_f1 FROM c""", V)
def threshold_sweep(spark, sf):
    counts = metrics.threshold_counts(fx.oof(spark, sf), ["seed"])
    return rounded(metrics.sweep(counts, ["seed"]), ["macro_f1"])


@query("m14_best_threshold", f"""WITH {_GRID}, c AS (SELECT seed, th, {_SWEEP_CELLS} FROM oof CROSS JOIN grid GROUP BY seed, th), f AS (SELECT *, {_F1} AS f1 FROM c)
SELECT seed, th AS threshold, round(f1, 9) AS macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY f1 DESC, th) AS rn FROM f) WHERE rn = 1""", V)
def best_threshold(spark, sf):
    counts = metrics.threshold_counts(fx.oof(spark, sf), ["seed"])
    return rounded(metrics.best_threshold(metrics.sweep(counts, ["seed"]), ["seed"]), ["macro_f1"])


_CROSS = f"""WITH {_GRID}, per_fold AS (SELECT seed, fold, th, {_SWEEP_CELLS} FROM oof CROSS JOIN grid GROUP BY seed, fold, th),
tot AS (SELECT seed, th, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp)::BIGINT AS tp FROM per_fold GROUP BY seed, th),
others AS (SELECT p.seed, p.fold, p.th, t.tn - p.tn AS tn, t.fp - p.fp AS fp, t.fn - p.fn AS fn, t.tp - p.tp AS tp FROM per_fold p JOIN tot t USING (seed, th)),
chosen AS (SELECT seed, fold, th FROM (SELECT *, row_number() OVER (PARTITION BY seed, fold ORDER BY {_F1} DESC, th) AS rn FROM others) WHERE rn = 1)"""


@query("m15_cross_fold_threshold", _CROSS + " SELECT seed, fold, th AS threshold FROM chosen", V)
def cross_fold_threshold(spark, sf):
    return metrics.cross_fold_thresholds(fx.oof(spark, sf), ["seed"])[0]


@query("m15_threshold_optimism", _CROSS + f""",
nested AS (SELECT seed, {_F1} AS nested_f1, d AS deployment_threshold FROM (SELECT seed, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp, median(th) AS d FROM per_fold JOIN chosen USING (seed, fold, th) GROUP BY seed)),
naive AS (SELECT seed, th AS naive_threshold, f1 AS naive_f1 FROM (SELECT *, {_F1} AS f1, row_number() OVER (PARTITION BY seed ORDER BY {_F1} DESC, th) AS rn FROM tot) WHERE rn = 1)
SELECT seed, deployment_threshold, round(nested_f1, 9) AS nested_f1, naive_threshold, round(naive_f1, 9) AS naive_f1, round(naive_f1 - nested_f1, 9) AS optimism FROM nested JOIN naive USING (seed)""", V)
def threshold_optimism(spark, sf):
    _, summary = metrics.cross_fold_thresholds(fx.oof(spark, sf), ["seed"])
    return rounded(summary, ["nested_f1", "naive_f1", "optimism"])


# ---- folds and encodings ----------------------------------------------------

_LABELED_SQL = "labeled AS (SELECT *, CASE WHEN delay = 'Delayed' THEN 1 ELSE 0 END AS y FROM flights WHERE delay IS NOT NULL)"
FOLD_SQL = f"""{_LABELED_SQL}, folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY sha256(CAST(flight_id AS VARCHAR) || ':fold:42'), flight_id) - 1) % 5 AS INT) AS fold FROM labeled)"""


def folded(spark, sf):
    return encode.stratified_folds(clean.labeled_rows(fx.flights(spark, sf)))


@query("m1_stratified_folds", f"WITH {FOLD_SQL} SELECT flight_id, y, fold FROM folded", ("flights",))
def stratified_folds(spark, sf):
    return folded(spark, sf).select("flight_id", "y", "fold")


@query("m2_inner_holdout_split", f"""WITH {FOLD_SQL},
train AS (SELECT flight_id, y, CAST(o AS INT) AS outer_fold FROM folded CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS o) WHERE o <> fold),
ranked AS (SELECT *, row_number() OVER (PARTITION BY outer_fold, y ORDER BY sha256(CAST(flight_id AS VARCHAR) || ':holdout'), flight_id) AS rn, count(*) OVER (PARTITION BY outer_fold, y) AS n FROM train)
SELECT outer_fold, flight_id, y, rn <= round(n * 0.2::DOUBLE) AS is_holdout FROM ranked""", ("flights",))
def inner_holdout_split(spark, sf):
    train = encode.outer_training_rows(folded(spark, sf)).select("outer_fold", "flight_id", "y")
    return encode.inner_holdout(train, ["outer_fold"])


_OUTER_SQL = (f"{FOLD_SQL}, fit AS (SELECT f.*, CAST(o AS INT) AS outer_fold FROM folded f, generate_series(0, 4) AS s(o) WHERE fold <> o), "
              "g AS (SELECT outer_fold, avg(y) AS g FROM fit GROUP BY outer_fold)")


def outer_folds(spark, sf, encoded):
    """``encoded(training rows, validation rows)`` of every outer fold, stacked with its number."""
    rows = materialize(folded(spark, sf), "folded")
    parts = [encoded(rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)).withColumn("outer_fold", F.lit(k))
             for k in range(5)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("m3_smoothed_target_encode", f"""WITH {_OUTER_SQL}, s AS (SELECT outer_fold, tail, count(*) AS n, sum(y) AS s FROM fit GROUP BY ALL)
SELECT outer_fold, flight_id, tail, round(coalesce((s + 20 * g) / (n + 20), g), 9) AS te_tail
FROM (SELECT *, fold AS outer_fold FROM folded) LEFT JOIN s USING (outer_fold, tail) JOIN g USING (outer_fold)""", ("flights",))
def smoothed_target_encode(spark, sf):
    out = outer_folds(spark, sf, lambda train, valid: encode.smoothed_target_encode(train, valid, "tail"))
    return rounded(out, ["te_tail"]).select("outer_fold", "flight_id", "tail", "te_tail")


def every_fold_encoded(spark, sf, part, mean=None):
    """Rows of one part of all outer folds, encoded from one cube of label counts."""
    rows = materialize(clean.labeled_rows(fx.flights(spark, sf)).select("flight_id", "y", "airline"), "labeled")
    entries = slots.nested_slots(rows, [42], fraction=0)
    return slots.encode_slots(rows, entries, ["airline"], mean=mean).filter(F.col("part") == part)


@query("m4_oof_target_encode", f"""WITH {_OUTER_SQL},
inner_folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY outer_fold, y ORDER BY sha256(CAST(flight_id AS VARCHAR) || ':fold:42'), flight_id) - 1) % 5 AS INT) AS inner_fold FROM fit)
SELECT a.outer_fold, a.flight_id, round(any_value(gm.g), 9) AS fold_mean, round((coalesce(sum(b.y), 0) + 20 * any_value(gm.g)) / (count(b.y) + 20), 9) AS te_airline
FROM inner_folds a LEFT JOIN inner_folds b ON a.outer_fold = b.outer_fold AND a.airline = b.airline AND a.inner_fold <> b.inner_fold
JOIN (SELECT f.outer_fold, f.inner_fold, avg(y) AS g FROM (SELECT DISTINCT outer_fold, inner_fold FROM inner_folds) f
      JOIN inner_folds o ON o.outer_fold = f.outer_fold AND o.inner_fold <> f.inner_fold GROUP BY ALL) gm ON gm.outer_fold = a.outer_fold AND gm.inner_fold = a.inner_fold
GROUP BY a.outer_fold, a.flight_id""", ("flights",))
def oof_target_encode(spark, sf):
    encoded = every_fold_encoded(spark, sf, "train", mean="fold_mean")
    return rounded(encoded, ["fold_mean", "te_airline"]).select("outer_fold", "flight_id", "fold_mean", "te_airline")


@query("m4_outer_fold_encode", f"""WITH {_OUTER_SQL}, s AS (SELECT outer_fold, airline, count(*) AS n, sum(y) AS s FROM fit WHERE airline IS NOT NULL GROUP BY ALL)
SELECT outer_fold, flight_id, round(coalesce((s + 20 * g) / (n + 20), g), 9) AS te_airline
FROM (SELECT *, fold AS outer_fold FROM folded) LEFT JOIN s USING (outer_fold, airline) JOIN g USING (outer_fold)""", ("flights",))
def outer_fold_encode(spark, sf):
    return rounded(every_fold_encoded(spark, sf, "valid"), ["te_airline"]).select("outer_fold", "flight_id", "te_airline")


@query("m5_pseudo_label_select", """WITH c AS (SELECT seed, quantile_cont(p, 0.10) AS lo, quantile_cont(p, 0.98) AS hi FROM oof GROUP BY seed)
SELECT seed, flight_id, p, 1 AS pseudo_y FROM oof JOIN c USING (seed) WHERE p >= hi
UNION ALL SELECT seed, flight_id, p, 0 FROM oof JOIN c USING (seed) WHERE p <= lo""", V)
def pseudo_label_select(spark, sf):
    return encode.pseudo_labels(fx.oof(spark, sf).select("seed", "flight_id", "p"), keys=["seed"])


@query("m6_categorical_codes", """WITH t AS (SELECT flight_id, coalesce(airline, 'MISSING') AS a, CAST(tail AS VARCHAR) AS t FROM flights)
SELECT flight_id, CAST(dense_rank() OVER (ORDER BY a) - 1 AS INT) AS airline, CAST(dense_rank() OVER (ORDER BY t) - 1 AS INT) AS tail FROM t""", ("flights",))
def categorical_codes(spark, sf):
    return encode.categorical_codes(fx.flights(spark, sf).select("flight_id", "airline", "tail"))


# ---- prediction rows and their contract -------------------------------------

@query("m20_prediction_rows", """WITH labeled AS (SELECT *, CAST(row_number() OVER (ORDER BY flight_id) - 1 AS BIGINT) AS source_row FROM flights)
SELECT 'demo' AS run_id, 'P6_clean' AS phase_key, seed, source_row, flight_id, fold, y_true, p AS probability, threshold, CAST(p >= threshold AS INT) AS prediction, 10 * (fold + 1) AS n_estimators,
 CAST(dep_hhmm IS NULL AS INT) AS raw_missing__dep_hhmm, CAST(arr_hhmm IS NULL AS INT) AS raw_missing__arr_hhmm, CAST(airline IS NULL AS INT) AS raw_missing__airline
FROM oof JOIN labeled USING (flight_id)""", V)
def prediction_rows(spark, sf):
    return contracts.prediction_rows_of_fixture(spark, sf)


@query("m21_prediction_contract_check", """WITH bad AS (SELECT * REPLACE (CASE WHEN flight_id % 100 = 0 THEN 1.5 ELSE p END AS p, CASE WHEN flight_id % 60 = 0 THEN 2 ELSE y_true END AS y_true) FROM oof),
seeds AS (SELECT DISTINCT seed FROM oof)
SELECT seed, 'probability_range' AS rule, count(*) FILTER (p > 1) AS violations FROM bad GROUP BY seed
UNION ALL SELECT seed, 'binary_values', count(*) FILTER (y_true NOT IN (0, 1)) FROM bad GROUP BY seed
UNION ALL SELECT seed, unnest(['null_values', 'run_identity', 'duplicate_id', 'duplicate_source_row', 'negative_source_row', 'threshold_range', 'fold_range', 'tree_count', 'prediction_rule', 'fold_settings', 'row_count', 'folds_present']), 0 FROM seeds""", V)
def prediction_contract_check(spark, sf):
    rows = contracts.prediction_rows_of_fixture(spark, sf)
    rows = rows.withColumn("probability", F.when(F.col("flight_id") % 100 == 0, 1.5).otherwise(F.col("probability")))
    rows = rows.withColumn("prediction", (F.col("probability") >= F.col("threshold")).cast("int"))
    rows = rows.withColumn("y_true", F.when(F.col("flight_id") % 60 == 0, 2).otherwise(F.col("y_true")))
    n = fx.flights(spark, sf).filter("delay IS NOT NULL").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "predictions")
    checked = [contracts.prediction_violations(rows.filter(F.col("seed") == seed), run_id="demo", phase_key="P6_clean", seed=seed,
                                               n_rows=n.scalar(), n_splits=5).withColumn("seed", F.lit(seed)) for seed in fx.SEEDS]
    return reduce(lambda a, b: a.unionByName(b), checked)


# ---- recorded scores --------------------------------------------------------

@query("c7_score_reproduction", f"""WITH r AS (SELECT seed, fold, round({_LOSS}, 9) AS log_loss FROM oof GROUP BY seed, fold)
SELECT seed, fold, CASE WHEN fold = 3 THEN 'differs' WHEN seed = 7 AND fold = 0 THEN 'not recorded' ELSE 'reproduced' END AS verdict FROM r""", V)
def score_reproduction(spark, sf):
    scores = metrics.score_metrics(predicted(spark, sf), ["seed", "fold"], ranking=False).select("seed", "fold", "log_loss", "brier")
    recorded = scores.filter("NOT (seed = 7 AND fold = 0)").withColumn(
        "log_loss", F.col("log_loss") + F.when(F.col("fold") == 3, 1e-3).otherwise(0.0))
    return contracts.reproduced_scores(scores, recorded, ["seed", "fold"], ["log_loss", "brier"], 1e-9)


_LEVEL_SQL = f"per_seed AS (SELECT seed, count(*) AS n_rows, CAST(sum(y_true) AS BIGINT) AS positives, {_LOSS} AS log_loss FROM oof GROUP BY seed)"


@query("c3_summary_reconciliation", """SELECT 'log_loss' AS metric, TRUE AS seeds_complete, TRUE AS denominators_equal, TRUE AS mean_reproduced, TRUE AS recorded
UNION ALL SELECT 'brier', TRUE, TRUE, FALSE, TRUE UNION ALL SELECT 'error_rate', TRUE, TRUE, FALSE, FALSE UNION ALL SELECT 'fpr', FALSE, FALSE, FALSE, TRUE""")
def summary_reconciliation(spark, sf):
    runs = metrics.score_metrics(predicted(spark, sf), ["seed"], ranking=False)
    runs = runs.withColumn("n_rows", F.col("n"))
    long = metrics.metrics_long(runs, ["seed", "n_rows", "positives"], ["log_loss", "brier", "error_rate"], [])
    recorded = long.groupBy("metric").agg(F.avg("value").alias("mean")).filter("metric <> 'error_rate'")
    recorded = recorded.withColumn("mean", F.when(F.col("metric") == "brier", F.col("mean") + 0.1).otherwise(F.col("mean")))
    extra = recorded.filter("metric = 'brier'").withColumn("metric", F.lit("fpr"))
    totals = fx.flights(spark, sf).filter("delay IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("delay") == "Delayed").cast("int")).alias("d"))
    return contracts.summary_reconciliation(long, recorded.unionByName(extra), ["metric"], n_seeds=3,
                                            rows=totals.select("n").scalar(), positives=totals.select("d").scalar())


@query("c4_reliability_reconciliation", f"""WITH {PRED_SQL}, {_EW_SQL.format(k='seed')}, s AS (SELECT seed, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(round(n * rate)) AS BIGINT) AS n_delayed FROM ew GROUP BY seed)
SELECT seed, n_rows, n_delayed, n_rows = (SELECT count(*) FROM flights WHERE delay IS NOT NULL) AS rows_covered, n_delayed = (SELECT count(*) FROM flights WHERE delay = 'Delayed') AS positives_covered, seed <> 1 AS ece_reproduced FROM s""", V)
def reliability_reconciliation(spark, sf):
    rows = predicted(spark, sf)
    bins = metrics.equal_width_bins(rows, ["seed"])
    recorded = metrics.score_metrics(rows, ["seed"]).select(
        "seed", (F.col("ece_10") + F.when(F.col("seed") == 1, 1e-6).otherwise(0.0)).alias("ece"))
    totals = fx.flights(spark, sf).filter("delay IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("delay") == "Delayed").cast("int")).alias("d"))
    return contracts.reliability_reconciliation(bins, recorded, ["seed"], rows=totals.select("n").scalar(),
                                                positives=totals.select("d").scalar())


@query("a45_cross_seed_weighted_bins", f"""WITH {PRED_SQL}, {_EW_SQL.format(k='seed')}
SELECT CAST(b AS INT) AS bin, CAST(sum(n) AS BIGINT) AS n, round(sum(n * mp) / sum(n), 9) AS mean_probability, round(sum(n * rate) / sum(n), 9) AS observed_rate FROM ew GROUP BY b""", V)
def cross_seed_weighted_bins(spark, sf):
    bins = metrics.equal_width_bins(predicted(spark, sf), ["seed"])
    return rounded(metrics.weighted_bins(bins, []), ["mean_probability", "observed_rate"])


_SELECT_SQL = """sel AS (SELECT seed, fold, max(threshold) AS threshold, '{"depth":' || CAST(fold % 3 AS VARCHAR) || '}' AS params, fold % 3 = 0 OR fold % 3 = 2 AS edge,
 max(threshold) + CASE WHEN fold = 1 THEN 0.01::DOUBLE ELSE 0 END AS recorded FROM oof GROUP BY seed, fold)"""


def _selections(spark, sf):
    depth = (F.col("fold") % 3).cast("string")
    edge = F.when(F.col("fold") % 3 == 0, '"low"').when(F.col("fold") % 3 == 2, '"high"').otherwise("null")
    return fx.oof(spark, sf).groupBy("seed", "fold").agg(F.max("threshold").alias("threshold")).select(
        "seed", "fold", "threshold", F.concat(F.lit('{"depth":'), depth, F.lit("}")).alias("params"),
        F.concat(F.lit('{"depth":'), edge, F.lit(',"leaves":null}')).alias("edges"),
        (F.col("threshold") + F.when(F.col("fold") == 1, 0.01).otherwise(0.0)).alias("recorded"))


@query("a49_selection_distribution", f"WITH {_SELECT_SQL} SELECT seed, params, count(*) AS n_folds FROM sel GROUP BY seed, params", V)
def selection_distribution(spark, sf):
    return report.selection_distribution(_selections(spark, sf), ["seed"], "params", "edges", "threshold", "recorded")[0]


@query("a49_selection_shift", f"""WITH {_SELECT_SQL} SELECT seed, count(*) AS n_folds, count(*) FILTER (edge) AS folds_with_any_edge, min(threshold) AS threshold_min, median(threshold) AS threshold_median,
 max(threshold) AS threshold_max, count(*) FILTER (threshold <> recorded) AS thresholds_changed FROM sel GROUP BY seed""", V)
def selection_shift(spark, sf):
    return report.selection_distribution(_selections(spark, sf), ["seed"], "params", "edges", "threshold", "recorded")[1]


@query("a50_fixed_group_recall", f"""WITH {_FLAGGED_SQL}, g AS (SELECT seed, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS positives, count(*) FILTER (y_true = 1 AND prediction = 1) AS tp FROM flagged WHERE pattern = 'both_missing' GROUP BY seed)
SELECT seed, n, positives, tp, round(tp / positives, 9) AS recall, round(avg(tp / positives) OVER (), 9) AS recall_mean_of_seeds FROM g""", V)
def fixed_group_recall(spark, sf):
    groups, expected = overlapping_groups()
    table = metrics.overlapping_group_metrics(flagged(spark, sf), ["seed"], groups, expected)
    return rounded(report.fixed_group_recall(table, "raw_time_pattern", "both_missing"), ["recall", "recall_mean_of_seeds"])


_BAND_CASE = "CASE " + " ".join(f"WHEN p >= {a}::DOUBLE AND p < {b}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(report.BANDS[:-1], report.BANDS[1:]))) + " END"
_BAND_LOW = "CASE b " + " ".join(f"WHEN {i} THEN {a}::DOUBLE" for i, a in enumerate(report.BANDS[:-1])) + " END"
_BAND_HIGH = "CASE b " + " ".join(f"WHEN {i} THEN {a}::DOUBLE" for i, a in enumerate(report.BANDS[1:])) + " END"


@query("a29_probability_bands", f"""WITH {_FLAGGED_SQL}, banded AS (SELECT seed || ':' || pattern AS pattern, CAST({_BAND_CASE} AS INT) AS b, y_true FROM flagged)
SELECT pattern, b AS band, {_BAND_LOW} AS lower, {_BAND_HIGH} AS upper, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pattern), 9) AS share, round(avg(y_true), 9) AS observed_rate
FROM banded GROUP BY pattern, b""", V)
def probability_bands(spark, sf):
    rows = flagged(spark, sf).withColumn("pattern", F.concat_ws(":", F.col("seed").cast("string"), "pattern"))
    return rounded(report.probability_bands(rows, "pattern"), ["share", "observed_rate"])


_TRACK_SQL = """tagged AS (SELECT 'mo_' || seed AS attribute, CAST(mo AS VARCHAR) AS value, y_true, p FROM oof JOIN flights USING (flight_id)
 UNION ALL SELECT 'airline_' || seed, coalesce(airline, '(missing)'), y_true, p FROM oof JOIN flights USING (flight_id)),
g AS (SELECT attribute, value, count(*) AS n, avg(y_true) AS observed_rate, avg(p) AS mean_probability FROM tagged GROUP BY ALL HAVING count(*) >= 100)"""


def _tracking(spark, sf):
    rows = fx.oof(spark, sf).join(fx.flights(spark, sf).select("flight_id", "mo", "airline"), "flight_id")
    tables = []
    for seed in fx.SEEDS:
        named = rows.filter(F.col("seed") == seed).withColumnsRenamed({c: f"{c}_{seed}" for c in ("mo", "airline")})
        tables.append(report.base_rate_tracking(named, [f"mo_{seed}", f"airline_{seed}"], min_rows=100))
    return [reduce(lambda a, b: a.unionByName(b), part) for part in zip(*tables)]


@query("a26_base_rate_groups", f"WITH {_TRACK_SQL} SELECT attribute, value, n, round(observed_rate, 9) AS observed_rate, round(mean_probability, 9) AS mean_probability FROM g", V)
def base_rate_groups(spark, sf):
    return rounded(_tracking(spark, sf)[0], ["observed_rate", "mean_probability"])


@query("a26_base_rate_tracking", f"""WITH {_TRACK_SQL} SELECT attribute, count(*) AS groups, round(corr(observed_rate, mean_probability), 6) AS pearson_r, round(max(observed_rate) - min(observed_rate), 9) AS observed_rate_range,
 round(max(mean_probability) - min(mean_probability), 9) AS mean_probability_range FROM g GROUP BY attribute""", V)
def base_rate_tracking(spark, sf):
    out = rounded(_tracking(spark, sf)[1], ["observed_rate_range", "mean_probability_range"])
    return out.withColumn("pearson_r", F.round("pearson_r", 6))
