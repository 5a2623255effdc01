"""A whole experiment on few rows against plain recomputation."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwright import fixtures as fx
from tripwright.plans.experiment import ledger_rows, nested_predictions, record
from tripwright.plans.phases import PHASES
from tripwright.storage import fresh_path

SF = "/root/testdata/sf0.001"


def test_experiment_from_rows_to_ledger(spark):
    raw = fx.flights(spark, SF)
    pair = {n: PHASES[n] for n in ("P4", "P6_clean")}
    predictions = nested_predictions(raw, pair, [42, 7], [{"depth": 2, "learning_rate": 0.3, "min_leaf": 5}], (2, 5))
    pdf = predictions.toPandas()
    labeled = raw.filter("delay IS NOT NULL").count()
    assert (pdf.groupby(["phase_key", "seed"]).flight_id.nunique() == labeled).all() and len(pdf) == 4 * labeled
    assert set(pdf.n_trees) <= {2, 5} and pdf.groupby(["phase_key", "seed", "fold"]).threshold.nunique().max() == 1

    rows = ledger_rows(predictions, "r1")
    folder = fresh_path(spark, "ledger")
    first = record(rows, folder, 1).toPandas().set_index("phase_key")
    assert len(first) == 4 and (first.n_folds == 5).all()
    for (phase, seed), part in pdf.groupby(["phase_key", "seed"]):
        told = first.loc[f"{phase}_seed{seed}"]
        y, p, hat = part.y_true.to_numpy(), part.p.to_numpy(), (part.p >= part.threshold).to_numpy()
        assert told.n == len(part) and told.log_loss == pytest.approx(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))
        f1 = [2 * np.sum((hat == c) & (y == c)) / (np.sum(hat == c) + np.sum(y == c)) for c in (0, 1)]
        assert told.macro_f1 == pytest.approx(np.mean(f1))
    prints = first.reset_index().groupby("seed").fold_fingerprint.nunique()
    assert (prints == 1).all() and first.fold_fingerprint.nunique() == 2  # paired variants, different seeds

    again = rows.filter("seed = 7").withColumn("log_loss", F.lit(9.0))
    second = record(again, folder, 2).toPandas()
    assert len(second) == 4 and sorted(second.log_loss == 9.0) == [False, False, True, True]
    with pytest.raises(ValueError):
        record(rows.unionByName(rows), folder, 3)


def test_variants_with_other_encodings_are_refused(spark):
    for name in ("P2", "P3", "P4_te0", "P5_honest"):
        with pytest.raises(ValueError):
            nested_predictions(fx.flights(spark, SF), {name: PHASES[name]}, [42], [{}], (2,))
