"""Model fitting by nested validation.

Models of all seeds and folds are fitted together (``boosting``, ``forests``, ``logistic``) from
rows that are split, encoded and coded once.
Decisions (tree count, parameters, threshold) only see the inner holdout; the outer
validation rows are scored once, without their labels.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from tripwright.functions.numeric import log_loss_term
from tripwright.operators import boosting, forests, logistic, metrics, slots
from tripwright.operators.skew import by_shuffle
from tripwright.schemas import CATEGORICAL
from tripwright.storage import materialize

# Columns a linear model takes as levels, the level size floor, and codes it drops.
ONEHOT_COLUMNS = ("airline", "mo", "dep_hour", "arr_hour")
ONEHOT_MIN_FREQUENCY = 20
TARGET_ENCODED_ONLY = ("tail", "route", "origin", "dest")
# Declared search grids.
TREE_COUNTS = (10, 25, 50, 75, 100, 150, 300, 600)
LOGISTIC_GRID = tuple({"C": c} for c in (0.001, 0.01, 0.1, 1.0, 10.0))
FOREST_GRID = tuple({"min_leaf": leaf, "features": f} for leaf in (5, 25, 100) for f in ("sqrt", "0.5"))
FOREST_TREES = 300

STOPPING_ROUNDS = 40
SLOT_KEYS = ("slot", "seed", "outer_fold", "part_of", "part")
NOT_FEATURES = frozenset({"flight_id", "y", "fold", "part", "delay", "yr", "is_holdout", "seed", "inner", *SLOT_KEYS})


def feature_columns(df: DataFrame) -> tuple[str, ...]:
    return tuple(f.name for f in df.schema
                 if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES)


# ---- joint boosted fits -------------------------------------------------------

@dataclass(frozen=True)
class Learning:
    """Coded rows of all slots (slot, seed, outer_fold, part, flight_id, y, codes) and how they were coded."""
    coded: DataFrame
    coding: boosting.Coding

    @property
    def width(self) -> int:
        return len(self.coding.features)

    def part(self, name: str) -> DataFrame:
        return self.coded.filter(F.col("part") == name)


def learning_rows(rows: DataFrame, entries: DataFrame, cols: Sequence[str], *, m: float = 20.0, prefix: str = "te_") -> Learning:
    """Encode every slot from one cube, bin features by training rows and write the codes once.

    Rows meet their entries once and are coded once: what a row has in all slots is the same. An encoding
    depends on key, slot and inner fold only, so these are binned, and an entry picks its byte by its key.
    """
    present = [c for c in cols if c in rows.columns]
    if any(c.startswith(prefix) for c in rows.columns):
        raise ValueError("encoded columns are not allowed before the split")
    joined = materialize(rows.drop("y").join(by_shuffle(slots.packed(entries)), "flight_id"), "learning")
    common, encoded = feature_columns(joined), [f"{prefix}{c}" for c in present]
    trained = F.size(F.filter("entries", lambda e: e["part"] == "train"))
    counts = boosting.value_counts(joined, common, trained).withColumn("slot", F.lit(None).cast("int"))
    if present:
        views, keyed, whole = _slot_encodings(joined, present, m)
        counts = counts.unionByName(_encoded_counts(keyed, whole, present, views, prefix))
    coding = boosting.coding_of(counts, (*common, *encoded), [c for c in common if c in CATEGORICAL], encoded)
    out, parts = joined.withColumn("_codes", boosting.shared_codes(coding)), [F.col("_codes")]
    if present:
        codes = materialize(boosting.key_codes(keyed, coding, views, prefix), "key-codes")
        unseen = np.array([whole.first()["unseen"]], np.float64)
        for c in present:
            of_column = codes.filter(F.col("column") == c).select(F.col("key").alias("_key"), F.col("codes").alias(f"_of_{c}"))
            out = out.join(of_column, F.col(c).cast("string") == F.col("_key"), "left").drop("_key")
            other = F.lit(bytearray(boosting.view_codes(unseen, coding.of_slot[f"{prefix}{c}"], views).tobytes()))
            parts.append(F.substring(F.coalesce(f"_of_{c}", other), slots.place_of(views).cast("int") + 1, F.lit(1)))
    each = out.select("flight_id", "y", "_codes", *[f"_of_{c}" for c in present], F.inline("entries"))
    keys = [c for c in (*SLOT_KEYS, "flight_id", "y") if c in each.columns]
    return Learning(materialize(each.select(*keys, F.concat(*parts).alias("codes")), "coded"), coding)


def _slot_encodings(joined: DataFrame, cols: Sequence[str], m: float) -> tuple[int, DataFrame, DataFrame]:
    """The number of views of a slot and what ``slots.encodings`` gives for rows with their entries."""
    train = joined.select("y", *cols, F.inline(F.filter("entries", lambda e: e["part"] == "train")))
    cube = slots.counted_labels(train, cols, "y")
    slot, inner = joined.agg(*[F.max(F.array_max(f"entries.{c}")) for c in ("slot", "inner")]).first()
    views = (-1 if inner is None else inner) + 2
    return views, *slots.encodings(cube, views, ((slot or 0) + 1) * views - 1, m)


def _encoded_counts(keyed: DataFrame, whole: DataFrame, cols: Sequence[str], views: int, prefix: str) -> DataFrame:
    """(feature, slot, value, n): how many training entries have each encoding. Entries without a key are
    those that no key counts."""
    def each(df: DataFrame, value: str) -> DataFrame:
        return df.select("column", F.posexplode(F.arrays_zip(F.col(value).alias("value"), F.col("own").alias("n"))).alias("at", "e")).select("column", "at", "e.value", "e.n")

    found = each(keyed, "values").filter("n IS NOT NULL")
    every = each(whole.withColumn("column", F.explode(F.array(*map(F.lit, cols)))), "unseen").filter("n IS NOT NULL")
    rest = every.join(found.groupBy("column", "at").agg(F.sum("n").alias("_known")), ["column", "at"], "left")
    rest = rest.withColumn("n", F.col("n") - F.coalesce("_known", F.lit(0))).filter("n > 0").select("column", "at", "value", "n")
    slot = F.floor(F.col("at") / views).cast("int").alias("slot")
    return (found.unionByName(rest).filter("value IS NOT NULL").groupBy(F.concat(F.lit(prefix), "column").alias("feature"), slot, "value")
            .agg(F.sum("n").alias("n")))


def losses_at(models: DataFrame, counts: Sequence[int] | None = None) -> DataFrame:
    """(slot, config, n_trees, log_loss) from the losses a fit recorded after each tree."""
    long = models.select("slot", "config", F.posexplode("losses").alias("_at", "log_loss")).withColumn("n_trees", (F.col("_at") + 1).cast("int")).drop("_at")
    return long if counts is None else long.filter(F.col("n_trees").isin(*counts))


def first_minimum(losses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The (config, n_trees) of least loss per key, the first in declared order among equals."""
    best = F.min(F.struct("log_loss", "config", "n_trees")).alias("_b")
    return losses.groupBy(*keys).agg(best).select(*keys, "_b.config", "_b.n_trees")


def slot_thresholds(holdout: DataFrame) -> DataFrame:
    """(slot, threshold) of best macro F1 on holdout scores."""
    return metrics.best_threshold(metrics.sweep(metrics.threshold_counts(holdout, ["slot"], "y", "p"), ["slot"]), ["slot"]).select("slot", "threshold")


@dataclass(frozen=True)
class Chosen:
    """Per slot the chosen configuration and tree count, with scored holdout and validation rows."""
    losses: DataFrame
    choices: DataFrame
    holdout: DataFrame
    valid: DataFrame


def select_trees(learning: Learning, configs: Sequence[dict], counts: Sequence[int], **fit) -> Chosen:
    """Every parameter set at every tree count from one fit a set; minimal holdout loss decides.

    Validation rows are scored once, with the chosen model; the threshold comes from the
    holdout scores of the same model.
    """
    return select_each([learning], configs, counts, **fit)[0]


def select_each(learnings: Sequence[Learning], configs: Sequence[dict], counts: Sequence[int], **fit) -> list[Chosen]:
    """``select_trees`` of several tables, whose models are fitted side by side."""
    grid = sorted(counts)
    fitted = boosting.fit_each([(own.coded, own.coding) for own in learnings], [{**c, "trees": grid[-1]} for c in configs], **fit)
    return [_chosen(own, models, grid) for own, models in zip(learnings, fitted)]


def _chosen(learning: Learning, fitted: DataFrame, grid: Sequence[int]) -> Chosen:
    losses = losses_at(fitted, grid)
    best = materialize(first_minimum(losses, ["slot"]), "choices")
    of_slot = {r["slot"]: r["n_trees"] for r in best.collect()}  # a row for each slot
    winners = fitted.join(best.select("slot", "config"), ["slot", "config"])
    keep = (*SLOT_KEYS, "flight_id", "y")
    held = materialize(boosting.prefix_scores(learning.part("holdout"), winners, of_slot, learning.width, keep), "held")
    valid = boosting.prefix_scores(learning.part("valid"), winners, of_slot, learning.width, keep)
    choices = materialize(best.join(slot_thresholds(held), "slot"), "thresholds")
    return Chosen(losses, choices, held, valid.join(choices.select("slot", "threshold"), "slot"))


def early_stopped(learning: Learning, params: dict, rounds: int = STOPPING_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Models cut where their holdout loss was least when it had not improved for ``rounds`` trees, and the
    validation rows they score."""
    fitted = boosting.fit_models(learning.coded, learning.coding, [{**params, "stopping_rounds": rounds}])
    of_slot = {r["slot"]: r["trees"] for r in fitted.select("slot", "trees").collect()}  # a row for each slot
    return fitted, boosting.prefix_scores(learning.part("valid"), fitted, of_slot, learning.width, (*SLOT_KEYS, "flight_id", "y"))


def fold_teachers(learning: Learning, params: dict, unlabeled: DataFrame, n_folds: int) -> DataFrame:
    """Unlabeled rows scored by each fold's model, which never saw that fold's labels."""
    if n_folds < 2:
        raise ValueError("a teacher must not see every label")
    fitted = boosting.fit_models(learning.coded, learning.coding, [params])
    names = learning.coded.select("slot", "seed", "outer_fold").distinct()  # a row for each slot
    scored = boosting.every_score(unlabeled, learning.coding, fitted)
    return scored.join(F.broadcast(names), "slot")  # as many rows as models


def crossfit_scores(learning: Learning, params: dict) -> DataFrame:
    """Out-of-fold scores inside the training rows of each outer fold, by slots of ``crossfit_slots``."""
    fitted = boosting.fit_models(learning.coded, learning.coding, [params])
    of_slot = {r["slot"]: r["trees"] for r in fitted.select("slot", "trees").collect()}  # a row for each slot
    return boosting.prefix_scores(learning.part("valid"), fitted, of_slot, learning.width, (*SLOT_KEYS, "flight_id", "y"))


# ---- joint forests ---------------------------------------------------------------

def select_forest(learning: Learning, configs: Sequence[dict], **fit) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every parameter set of every slot; (losses, choices, scored validation rows)."""
    scored = forests.forest_scores(learning.coded, learning.coding, configs, **fit)
    held = scored.filter("part = 'holdout'")
    losses = materialize(held.groupBy("slot", "config").agg(F.avg(log_loss_term(F.col("y"), F.col("p"))).alias("log_loss")), "losses")
    best = losses.groupBy("slot").agg(F.min(F.struct("log_loss", "config")).alias("_b")).select("slot", "_b.config")
    choices = materialize(best.join(slot_thresholds(held.join(best, ["slot", "config"])), "slot"), "thresholds")
    return losses, choices, scored.filter("part = 'valid'").join(choices, ["slot", "config"])


# ---- joint logistic fits --------------------------------------------------------

def select_logistic(rows: DataFrame, entries: DataFrame, cols: Sequence[str], grid: Sequence[dict] = LOGISTIC_GRID) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every C of every slot; (losses, choices, scored validation rows) as a boosted search gives them.

    Columns whose raw codes are dropped must have an encoding.
    """
    encoded = materialize(slots.encode_slots(rows, entries, [c for c in cols if c in rows.columns]), "encoded")
    features = feature_columns(encoded)
    for c in TARGET_ENCODED_ONLY:
        if c in features and f"te_{c}" not in features:
            raise ValueError(f"raw {c} is dropped but te_{c} is missing")
    levels = [c for c in ONEHOT_COLUMNS if c in features]
    numeric = [c for c in features if c not in levels and c not in TARGET_ENCODED_ONLY]
    design, widths = logistic.prepared(encoded, numeric, levels, ONEHOT_MIN_FREQUENCY, (*SLOT_KEYS, "flight_id", "y"))
    weights = logistic.fit_weights(design.filter("part = 'train'"), widths, [p["C"] for p in grid])
    holdout = design.filter("part = 'holdout'")
    found = [(s, i, float(x)) for s, losses in logistic.mean_losses(holdout, weights).items() for i, x in enumerate(losses)]
    spark = rows.sparkSession
    losses = spark.createDataFrame(found, "slot int, config int, log_loss double")
    best = {s: min(i for i, x in enumerate(own) if x == min(own)) for s, own in
            ((s, [x for t, _, x in found if t == s]) for s in weights)}
    chosen = {s: weights[s][i] for s, i in best.items()}
    choices = spark.createDataFrame(list(best.items()), "slot int, config int")
    choices = materialize(choices.join(slot_thresholds(logistic.scored(holdout, chosen)), "slot"), "thresholds")
    return losses, choices, logistic.scored(design.filter("part = 'valid'"), chosen)
