"""One experiment from raw rows to the run ledger: features, folds, encodings, search, thresholds, scores, record."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tripwright.operators import clean, metrics, models, slots
from tripwright.plans.phases import Lattice, Variant
from tripwright.sources import ledger
from tripwright.storage import materialize

PREDICTION_KEYS = ("phase_key", "seed", "fold", "flight_id")


def nested_predictions(raw: DataFrame, variants: Mapping[str, Variant], seeds: Sequence[int], configs: Sequence[dict],
                       counts: Sequence[int], *, k: int = 5) -> DataFrame:
    """Every labeled row once per variant and seed, scored by its own fold's chosen model: (phase_key, seed,
    fold, flight_id, y_true, p, n_trees, threshold, prediction).

    All variants share one lattice of features and one set of folds, so their rows are paired.
    A variant must average labels out of fold and may not declare pseudo labels, whose teacher
    would have to be fitted per fold first.
    """
    for name, spec in variants.items():
        how = spec.encoding
        if not how.targets or not how.inner_folds or not how.codes_too or how.pseudo_labels:
            raise ValueError(f"{name} does not average labels out of fold beside its codes")
    lattice = Lattice(raw, list(variants.values()))
    labels = materialize(clean.labeled_rows(lattice.rows).select("flight_id", "y"), "labels")
    entries = slots.packed_slots(labels, seeds, k=k)
    learnings = [models.learning_rows(clean.labeled_rows(lattice.features(spec, keep=("flight_id",))), entries, spec.categories)
                 for spec in variants.values()]
    scored = []
    for name, chosen in zip(variants, models.select_each(learnings, configs, counts)):
        scored.append(chosen.valid.select(F.lit(name).alias("phase_key"), "seed", F.col("outer_fold").alias("fold"), "flight_id",
                                          F.col("y").alias("y_true"), "p", "n_trees", "threshold"))
    rows = metrics.with_prediction(reduce(lambda a, b: a.unionByName(b), scored))
    return materialize(rows, "predictions")


def ledger_rows(predictions: DataFrame, run_id: str) -> DataFrame:
    """One row per variant and seed: its scores, mean tree count and threshold, and a fingerprint of its folds.

    Equal fingerprints mean equal rows in equal folds, which paired comparisons ask for.
    """
    keys = ["phase_key", "seed"]
    scores = metrics.score_metrics(predictions, keys)
    fitted = predictions.groupBy(*keys, "fold").agg(
        F.first("n_trees").alias("n_trees"), F.first("threshold").alias("threshold"),  # one of each per fold
        F.bit_xor(F.xxhash64("flight_id", "fold")).alias("x"), F.sum(F.xxhash64("fold", "flight_id").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
    settings = fitted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("n_trees").alias("mean_trees"), F.avg("threshold").alias("mean_threshold"),
        F.concat_ws("-", F.hex(F.bit_xor("x")), F.hex(F.sum("s"))).alias("fold_fingerprint"))
    named = scores.join(settings, keys).withColumn("run_id", F.lit(run_id))
    named = named.withColumn("phase_key", F.concat_ws("_seed", "phase_key", F.col("seed").cast("string")))
    return named.select("run_id", "phase_key", *[c for c in named.columns if c not in ("run_id", "phase_key")])


def record(rows: DataFrame, folder: str, version: int) -> DataFrame:
    """Put an experiment's rows into the ledger's next version and read that version back; the rows of
    the same run and phases are replaced, all others stay. Repeated phases are refused."""
    repeated = rows.groupBy("run_id", "phase_key").count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError("an experiment has several rows for one phase")
    spark = rows.sparkSession
    old = ledger.latest_version(spark, folder) if version > 1 else rows.limit(0)
    ledger.write_version(spark, ledger.upsert(old, rows), folder, version)
    return ledger.latest_version(spark, folder)
