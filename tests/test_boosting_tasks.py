"""Boosting in barrier tasks: the trees of the other ways, without a Spark job a level."""
import numpy as np
import pandas as pd
import pytest

from tripwright.operators import boosting

CODING = boosting.Coding(("a", "b", "c"), (False, False, True), {}, {})


@pytest.fixture(scope="module")
def coded(spark):
    rng, frames = np.random.default_rng(2), []
    for slot, n in ((0, 900), (3, 3)):  # some tasks have no row of the second slot
        codes, ids = rng.integers(0, 9, (n, 3)).astype(np.uint8), np.arange(n)
        y = (rng.random(n) < np.where(codes[:, 0] > 4, 0.7, 0.3)).astype(int)
        frames.append(pd.DataFrame({"slot": slot, "part": np.where(ids % 5 == 0, "holdout", "train"), "flight_id": ids, "y": y, "codes": [c.tobytes() for c in codes]}))
    return spark.createDataFrame(pd.concat(frames), "slot int, part string, flight_id long, y int, codes binary").repartition(3).cache()


@pytest.mark.parametrize("share, rounds", [(1.0, None), (0.6, None), (1.0, 2)])
def test_three_ways_give_the_same_trees(coded, share, rounds, monkeypatch):
    used = []
    for name in ("_boost_groups", "_boost_tasks", "_boost_levels"):
        monkeypatch.setattr(boosting, name, lambda *a, _plain=getattr(boosting, name), _name=name: used.append(_name) or _plain(*a))
    configs = [{"trees": 4, "depth": d, "learning_rate": 0.5, "min_leaf": 10, "row_share": share, "stopping_rounds": rounds} for d in (1, 3)]
    ways = ({}, {"local_rows": 10}, {"local_rows": 10, "held_rows": 1})
    packed = [sorted((tuple(r)[:9], [round(x, 12) for x in r.losses]) for r in boosting.fit_models(coded, CODING, configs, **w).collect()) for w in ways]
    assert used == ["_boost_groups", "_boost_tasks", "_boost_levels"]
    assert packed[0] == packed[1] == packed[2] and len(packed[0]) == 4


def test_a_fit_in_tasks_starts_no_job_a_tree(spark, coded):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fit", "fit")
    boosting.fit_models(coded, CODING, [{"trees": 30, "depth": 2, "learning_rate": 0.1, "min_leaf": 10}], local_rows=10)
    assert len(tracker.getJobIdsForGroup("fit")) < 10
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
