"""Model queries over all labeled rows and all five outer folds.

Each ``_result`` query returns what its operator computes: scores, tree counts, losses, chosen
parameters and thresholds. Trees differ from the published runs, so SQL can't repeat those of
the tree learners; the calibrated scores of ``m16`` and ``m17`` are compared number for number.
The query of the same name without ``_result`` holds what SQL can say about any fit: every
labeled row is scored exactly once, in its own fold, by a probability, and a search keeps the
first minimum of the losses it recorded. Results come for every split seed, with all
declared tree counts and forests of the declared size; the claims are made for one seed.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.functions import text
from tripwright.operators import boosting, calibrate, clean, encode, metrics, models, slots
from tripwright.operators.matching import attach_features
from tripwright.plans.phases import PHASES, build_features
from tripwright.plans.q_scores import FOLD_SQL
from tripwright.plans.registry import query
from tripwright.storage import materialize

SEED, FOLDS = 42, 5
TREES = models.TREE_COUNTS
FOREST_SIZE = {"trees": models.FOREST_TREES, "depth": 12}
PARAMS = {"depth": 3, "learning_rate": 0.1, "min_leaf": 20}
# Declared tuning axes; trees of 31, 63 and 127 leaves are trees of depth 5, 6 and 7 here. The last six sets bag rows.
RATES = (0.03, 0.05, 0.1)
TUNING_GRID = (*({"learning_rate": rate, "depth": depth, "min_leaf": leaf, "row_share": 1.0} for rate in RATES for depth in (5, 6, 7) for leaf in (20, 100)),
               *({"learning_rate": rate, "depth": depth, "min_leaf": 20, "row_share": 0.8} for rate in RATES for depth in (6, 7)))
SPEC = PHASES["P6_clean"]
V = ("flights",)


def feature_rows(spark, sf):
    """All rows with the feature set, written once for the fits of one query."""
    return materialize(build_features(fx.flights(spark, sf), SPEC, keep=("flight_id",)), "features")


def labeled_features(spark, sf):
    """The labeled rows with the feature set, whose fitted parts come from all rows, written once."""
    return materialize(clean.labeled_rows(build_features(fx.flights(spark, sf), SPEC, keep=("flight_id",))), "features")


def probabilities(scored, *keys):
    """The keys of scored rows and whether the score is a probability."""
    return scored.select(*keys, F.coalesce(F.col("p").between(0, 1), F.lit(False)).alias("is_probability"))


EACH_ROW_ONCE = f"WITH {FOLD_SQL} SELECT fold, flight_id, true AS is_probability FROM folded"


def union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def choice_summary(rows):
    """Per fold: parameter sets tried, how many are marked, and whether the first minimum is."""
    best = F.min(F.struct("log_loss", "place"))["place"]
    return rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("tried"), F.count(F.when(F.col("chosen"), 1)).alias("chosen"),
        (best == F.min(F.when(F.col("chosen"), F.col("place")))).alias("first_minimum"),
        (F.min("threshold").between(0, 1) & (F.min("log_loss") > 0)).alias("in_range"))


def choice_sql(tried):
    return f"SELECT CAST(f AS INT) AS fold, CAST({tried} AS BIGINT) AS tried, CAST(1 AS BIGINT) AS chosen, true AS first_minimum, true AS in_range FROM range(0, {FOLDS}) AS s(f)"


def boosted_rows(labeled, seeds, *, fraction=0.2, encoded=True, entries=None):
    """Labeled rows in every (seed, fold) slot, ready to be boosted together."""
    entries = slots.packed_slots(labeled, seeds, k=FOLDS, fraction=fraction) if entries is None else entries
    return models.learning_rows(labeled, entries, SPEC.categories if encoded else ())


def named(df, *columns):
    return df.select("seed", F.col("outer_fold").alias("fold"), *columns)


BOOSTED = {**PARAMS, "trees": TREES[-1]}


def fold_teacher_of(spark, sf, seeds):
    rows = feature_rows(spark, sf)
    scored = models.fold_teachers(boosted_rows(clean.labeled_rows(rows), seeds, fraction=0, encoded=False), BOOSTED, clean.unlabeled_rows(rows), FOLDS)
    return named(scored, "flight_id", "p")


@query("m7_fold_teacher_result")
def fold_teacher_result(spark, sf):
    return fold_teacher_of(spark, sf, fx.SEEDS)


@query("m7_fold_teacher", f"SELECT CAST(f AS INT) AS fold, flight_id, true AS is_probability FROM flights, range(0, {FOLDS}) AS s(f) WHERE delay IS NULL", V)
def fold_teacher(spark, sf):
    return probabilities(fold_teacher_of(spark, sf, [SEED]), "fold", "flight_id")


@query("m5_teacher_pseudo_labels")
def teacher_pseudo_labels(spark, sf):
    return encode.pseudo_labels(materialize(fold_teacher_result(spark, sf), "teacher-scores"), keys=["seed", "fold"])


def early_stopped_fit_of(spark, sf, seeds):
    _, scored = models.early_stopped(boosted_rows(labeled_features(spark, sf), seeds, encoded=False), BOOSTED)
    return named(scored, "flight_id", "y", "n_trees", "p")


@query("m8_early_stopped_fit_result")
def early_stopped_fit_result(spark, sf):
    return early_stopped_fit_of(spark, sf, fx.SEEDS)


@query("m8_early_stopped_fit", EACH_ROW_ONCE, V)
def early_stopped_fit(spark, sf):
    return probabilities(early_stopped_fit_of(spark, sf, [SEED]), "fold", "flight_id")


def nested_tree_count_select_of(spark, sf, seeds):
    chosen = models.select_trees(boosted_rows(labeled_features(spark, sf), seeds), [PARAMS], TREES)
    return named(chosen.valid, "flight_id", "y", "n_trees", "threshold", "p")


@query("m9_nested_tree_count_select_result")
def nested_tree_count_select_result(spark, sf):
    return nested_tree_count_select_of(spark, sf, fx.SEEDS)


@query("m9_nested_tree_count_select", EACH_ROW_ONCE, V)
def nested_tree_count_select(spark, sf):
    return probabilities(nested_tree_count_select_of(spark, sf, [SEED]), "fold", "flight_id")


def slot_names(learning):
    """(slot, seed, fold): a row for each model."""
    return named(learning.coded, "slot").distinct()


def prefix_model_scoring_of(spark, sf, seeds):
    learning = boosted_rows(labeled_features(spark, sf), seeds)
    losses = models.losses_at(boosting.fit_models(learning.coded, learning.coding, [BOOSTED]))
    return losses.join(slot_names(learning), "slot").select("seed", "fold", "n_trees", "log_loss")


@query("m10_prefix_model_scoring_result")
def prefix_model_scoring_result(spark, sf):
    return prefix_model_scoring_of(spark, sf, fx.SEEDS)


@query("m10_prefix_model_scoring", f"SELECT CAST(f AS INT) AS fold, CAST(t AS INT) AS n_trees, true AS is_loss FROM range(0, {FOLDS}) AS a(f), range(1, {TREES[-1] + 1}) AS b(t)")
def prefix_model_scoring(spark, sf):
    return prefix_model_scoring_of(spark, sf, [SEED]).select("fold", "n_trees", (F.col("log_loss") > 0).alias("is_loss"))


def tuned_rows(spark, sf, seeds, configs, counts):
    """A row per seed, fold, parameter set and tree count: the loss, whether it was chosen, and the threshold."""
    learning = boosted_rows(labeled_features(spark, sf), seeds)
    chosen = models.select_trees(learning, configs, counts)
    texts = F.array(*[F.lit(",".join(f"{k}={v}" for k, v in sorted(c.items()))) for c in configs])
    best = chosen.choices.select("slot", F.col("config").alias("_config"), F.col("n_trees").alias("_n"), "threshold")
    place = F.col("config") * len(counts) + F.array_position(F.array(*map(F.lit, sorted(counts))), F.col("n_trees")) - 1
    return (chosen.losses.join(best, "slot").join(slot_names(learning), "slot")
            .select("seed", "fold", place.cast("int").alias("place"), F.get(texts, "config").alias("params"), "n_trees", "log_loss",
                    ((F.col("config") == F.col("_config")) & (F.col("n_trees") == F.col("_n"))).alias("chosen"), "threshold"))


@query("m11_param_grid_select_result")
def param_grid_select_result(spark, sf):
    return tuned_rows(spark, sf, fx.SEEDS, TUNING_GRID, TREES)


@query("m11_param_grid_select", choice_sql(4))
def param_grid_select(spark, sf):
    return choice_summary(tuned_rows(spark, sf, [SEED], [{**PARAMS, "depth": depth} for depth in (2, 4)], TREES[:2]))


def search_rows(losses, choices, names, configs):
    """A row per seed, fold and parameter set: the loss, whether it was chosen, and the threshold."""
    texts = F.array(*[F.lit(",".join(f"{k}={v}" for k, v in sorted(c.items()))) for c in configs])
    best = choices.select("slot", F.col("config").alias("_config"), "threshold")
    return losses.join(best, "slot").join(names, "slot").select(
        "seed", "fold", F.col("config").alias("place"), F.get(texts, "config").alias("params"), "log_loss", (F.col("config") == F.col("_config")).alias("chosen"), "threshold")


def logistic_model_of(spark, sf, seeds):
    labeled = labeled_features(spark, sf)
    entries = slots.nested_slots(labeled, seeds, k=FOLDS)
    losses, choices, _ = models.select_logistic(labeled, entries, SPEC.categories)
    return search_rows(losses, choices, named(entries, "slot").distinct(), models.LOGISTIC_GRID)


@query("m12_logistic_model_result")
def logistic_model_result(spark, sf):
    return logistic_model_of(spark, sf, fx.SEEDS)


@query("m12_logistic_model", choice_sql(len(models.LOGISTIC_GRID)))
def logistic_model(spark, sf):
    return choice_summary(logistic_model_of(spark, sf, [SEED]))


def random_forest_model_of(spark, sf, seeds):
    learning = boosted_rows(labeled_features(spark, sf), seeds)
    grid = [{**p, **FOREST_SIZE} for p in models.FOREST_GRID]
    losses, choices, _ = models.select_forest(learning, grid)
    return search_rows(losses, choices, slot_names(learning), grid)


@query("m13_random_forest_model_result")
def random_forest_model_result(spark, sf):
    return random_forest_model_of(spark, sf, fx.SEEDS)


@query("m13_random_forest_model", choice_sql(len(models.FOREST_GRID)))
def random_forest_model(spark, sf):
    return choice_summary(random_forest_model_of(spark, sf, [SEED]))


EACH_SEED_ONCE = "SELECT seed, fold, flight_id, true AS is_probability FROM oof"


def calibrated(spark, sf, kind):
    """Every row by a calibrator fitted on its seed's other folds."""
    rows = materialize(fx.oof(spark, sf).withColumnRenamed("y_true", "y"), "oof")
    if kind == "platt":
        return calibrate.crossfit_platt(rows, ["seed"]).select("seed", "fold", "flight_id", "p")
    parts = []
    for seed in fx.SEEDS:
        of_seed = rows.filter(F.col("seed") == seed)
        for fold in range(FOLDS):
            fitted = calibrate.fit_calibrator(kind, of_seed.filter(F.col("fold") != fold))
            parts.append(fitted.apply(of_seed.filter(F.col("fold") == fold)))
    return union(parts).select("seed", "fold", "flight_id", "p")


def to_compare(scored):
    """Scores to 6 digits; 12 come first, so that sums in another order fall on the same side."""
    return scored.withColumn("p", F.round(F.round("p", 12), 6))


# Newton's steps from 0, one fit per seed and left-out fold, under the penalty b * b / 2.
NEWTON_STEPS = 12
_STEP = """k{i} AS MATERIALIZED (
 SELECT seed, fold, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM (
  SELECT seed, fold, a, b, sum(q - y) AS g0, sum((q - y) * z) + b AS g1, sum(q * (1 - q)) AS h00, sum(q * (1 - q) * z) AS h01, sum(q * (1 - q) * z * z) + 1 AS h11
  FROM (SELECT k.*, d.y, d.z, 1 / (1 + exp(-(k.a + k.b * d.z))) AS q FROM k{before} k JOIN d ON d.seed = k.seed AND d.fold <> k.fold) GROUP BY seed, fold, a, b))"""
PLATT_SQL = f"""WITH d AS MATERIALIZED (SELECT seed, fold, flight_id, y, ln(q / (1 - q)) AS z FROM (
  SELECT seed, fold, flight_id, y_true AS y, least(greatest(p, 1e-6::DOUBLE), 1::DOUBLE - 1e-6::DOUBLE) AS q FROM oof)),
k0 AS (SELECT DISTINCT seed, CAST(f AS INT) AS fold, 0::DOUBLE AS a, 0::DOUBLE AS b FROM oof, range(0, {FOLDS}) AS s(f)),
{", ".join(_STEP.format(i=i + 1, before=i) for i in range(NEWTON_STEPS))}
SELECT d.seed, d.fold, flight_id, round(round(1 / (1 + exp(-(a + b * z))), 12), 6) AS p FROM d JOIN k{NEWTON_STEPS} k ON d.seed = k.seed AND d.fold = k.fold"""

# A monotone fit is, at each value, the largest of the least means of runs that hold it; between
# the fitted values it is a straight line and beyond them constant.
ISOTONIC_SQL = f"""WITH t AS (SELECT seed, CAST(f AS INT) AS fold, p AS x, sum(y_true) AS s, count(*) AS w FROM oof, range(0, {FOLDS}) AS s(f) WHERE fold <> f GROUP BY ALL),
c AS MATERIALIZED (SELECT *, row_number() OVER g AS i, sum(s) OVER g AS cs, sum(w) OVER g AS cw FROM t WINDOW g AS (PARTITION BY seed, fold ORDER BY x)),
m AS (SELECT b.seed, b.fold, b.x, min(CAST(b.cs - a.cs + a.s AS DOUBLE) / CAST(b.cw - a.cw + a.w AS DOUBLE)) OVER (PARTITION BY a.seed, a.fold, a.i ORDER BY b.i DESC) AS v
      FROM c a JOIN c b ON a.seed = b.seed AND a.fold = b.fold AND a.i <= b.i),
fit AS MATERIALIZED (SELECT seed, fold, x, max(v) AS v FROM m GROUP BY ALL),
r AS (SELECT o.seed, o.fold, o.flight_id, CASE WHEN lo.x IS NULL THEN hi.v WHEN hi.x IS NULL OR lo.x = hi.x THEN lo.v ELSE lo.v + (hi.v - lo.v) * (o.p - lo.x) / (hi.x - lo.x) END AS p
      FROM oof o ASOF LEFT JOIN fit lo ON o.seed = lo.seed AND o.fold = lo.fold AND o.p >= lo.x
                 ASOF LEFT JOIN fit hi ON o.seed = hi.seed AND o.fold = hi.fold AND o.p <= hi.x)
SELECT seed, fold, flight_id, round(round(least(greatest(p, 1e-6::DOUBLE), 1::DOUBLE - 1e-6::DOUBLE), 12), 6) AS p FROM r"""


@query("m16_platt_calibration_result", PLATT_SQL, ("flights", "oof"))
def platt_calibration_result(spark, sf):
    return to_compare(calibrated(spark, sf, "platt"))


@query("m16_platt_calibration", EACH_SEED_ONCE, ("flights", "oof"))
def platt_calibration(spark, sf):
    return probabilities(calibrated(spark, sf, "platt"), "seed", "fold", "flight_id")


@query("m17_isotonic_calibration_result", ISOTONIC_SQL, ("flights", "oof"))
def isotonic_calibration_result(spark, sf):
    return to_compare(calibrated(spark, sf, "isotonic"))


@query("m17_isotonic_calibration", EACH_SEED_ONCE, ("flights", "oof"))
def isotonic_calibration(spark, sf):
    return probabilities(calibrated(spark, sf, "isotonic"), "seed", "fold", "flight_id")


def crossfit_scores_of(spark, sf, seeds):
    labeled = labeled_features(spark, sf)
    entries = slots.crossfit_slots(labeled, seeds, k=FOLDS, parts=3)
    scored = models.crossfit_scores(models.learning_rows(labeled, entries, SPEC.categories), BOOSTED)
    return named(scored, "flight_id", F.col("part_of").alias("part"), "y", "p")


@query("m18_crossfit_scores_result")
def crossfit_scores_result(spark, sf):
    return crossfit_scores_of(spark, sf, fx.SEEDS)


@query("m18_crossfit_scores", f"WITH {FOLD_SQL} SELECT CAST(o AS INT) AS fold, flight_id, true AS is_probability FROM folded, range(0, {FOLDS}) AS s(o) WHERE fold <> o", V)
def crossfit_scores(spark, sf):
    return probabilities(crossfit_scores_of(spark, sf, [SEED]), "fold", "flight_id")


@query("m22_feature_importance")
def feature_importance(spark, sf):
    learning = boosted_rows(labeled_features(spark, sf), fx.SEEDS)
    gains = boosting.feature_gains(boosting.fit_models(learning.coded, learning.coding, [BOOSTED]), learning.coding.features)
    return gains.join(slot_names(learning), "slot").groupBy("seed", "feature").agg(F.avg("importance").alias("importance"))


@query("m24_weather_on_off_pair")
def weather_on_off_pair(spark, sf):
    """Same rows and folds, without and with report columns; the scores of both side by side."""
    rows = labeled_features(spark, sf)
    reports = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("flight_id"), (F.col("o_totalprice") % 100).alias("weather_origin_tmpf"),
        (F.col("o_totalprice") % 40).alias("weather_origin_sknt"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") % 10).alias("weather_destination_vsby"),
        (F.col("o_orderkey") % 5 != 0).cast("int").alias("weather_destination_matched"))
    scored, entries = [], slots.packed_slots(rows, fx.SEEDS, k=FOLDS)
    tables = {"weather_off": rows, "weather_on": attach_features(rows, reports, "flight_id")}
    chosen = models.select_each([boosted_rows(table, fx.SEEDS, entries=entries) for table in tables.values()], [PARAMS], TREES)
    for condition, own in zip(tables, chosen):
        scored.append(named(own.valid, F.lit(condition).alias("condition"), F.col("y").alias("y_true"), "p", "threshold"))
    return metrics.score_metrics(metrics.with_prediction(materialize(union(scored), "scored")), ["seed", "condition"])


@query("m25_calibration_arm_experiment")
def calibration_arm_experiment(spark, sf):
    patterns = fx.flights(spark, sf).select("flight_id", text.time_pattern(F.col("dep_hhmm"), F.col("arr_hhmm")).alias("pattern"))
    chosen = models.select_trees(boosted_rows(labeled_features(spark, sf), fx.SEEDS), [PARAMS], TREES)
    arms = calibrate.joint_calibration_arms(chosen.holdout, materialize(chosen.valid.drop("threshold"), "valid"), {"shared": 0.0, "split": 0.5})
    rows = materialize(arms.withColumnRenamed("y", "y_true").join(patterns, "flight_id"), "arms")
    expected = [("raw_time_pattern", g) for g in ("both_observed", "departure_missing", "arrival_missing", "both_missing")]
    return metrics.overlapping_group_metrics(rows, ["seed", "arm", "calibrator"], {"raw_time_pattern": F.col("pattern")}, expected)
