"""Scores of all models at once, models of several tables side by side, and packed joint codes."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tripwright.operators import boosting
from tripwright.storage import materialize

PARAMS = {"depth": 3, "learning_rate": 0.2, "min_leaf": 5, "trees": 6}


def coded(spark, slots, width=4, seed=0):
    rng = np.random.default_rng(seed)
    frames = []
    for slot in slots:
        codes = rng.integers(0, 9, (400, width)).astype(np.uint8)
        y = (codes[:, 0] + rng.integers(0, 9, 400) > 8 + slot % 2).astype(int)
        part = np.where(np.arange(400) % 5 == 0, "holdout", np.where(np.arange(400) % 5 == 1, "valid", "train"))
        frames.append(pd.DataFrame({"slot": np.int32(slot), "part": part, "flight_id": np.arange(400), "y": y.astype(np.int32), "codes": [c.tobytes() for c in codes]}))
    schema = "slot int, part string, flight_id long, y int, codes binary"
    return materialize(spark.createDataFrame(pd.concat(frames), schema), "coded")


def coding(width, values=range(1, 8)):
    names = tuple(f"f{i}" for i in range(width))
    return boosting.Coding(names, (False,) * width, {n: list(map(float, values)) for n in names}, {})


def models(df):
    return sorted((r.slot, r.config, bytes(r.feature), bytes(r.mask), bytes(r.value), tuple(r.losses)) for r in df.collect())


def test_a_row_meets_all_models_at_once(spark):
    """The scores are those of each model by itself, and the rows that reach Python are not repeated."""
    table, own = coded(spark, [0, 1, 4]), coding(4)
    fitted = boosting.fit_models(table, own, [PARAMS])
    rows = spark.range(300).select(F.col("id").alias("flight_id"), *[
        F.when(F.col("id") % 11 != i, (F.col("id") * (i + 3) % 9).cast("double")).alias(f"f{i}") for i in range(4)])
    scored = boosting.every_score(rows, own, fitted)
    got = {(r.slot, r.flight_id): r.p for r in scored.collect()}
    each = boosting.coded_rows(rows, own, ("flight_id",)).withColumn("slot", F.explode(F.array(*map(F.lit, (0, 1, 4)))))
    want = {(r.slot, r.flight_id): r.p for r in boosting.prefix_scores(each, fitted, {0: 6, 1: 6, 4: 6}, 4, ("flight_id", "slot")).collect()}
    assert got == want and len(got) == 900
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInPandas")  # rows are repeated behind Python only


def test_models_of_several_tables_share_their_tasks(spark):
    tables = [(coded(spark, [0, 1, 2]), coding(4)), (coded(spark, [1, 3], width=6, seed=1), coding(6))]
    configs = [PARAMS, {**PARAMS, "depth": 2}]
    together = boosting.fit_each(tables, configs)
    assert [models(df) for df in together] == [models(boosting.fit_models(*t, configs)) for t in tables]
    assert [len(models(df)) for df in together] == [6, 4]
    dealt = boosting._boost_groups(tables, configs, 4)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    rows = dealt.select("of", "slot", "config", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in rows}) == len(rows) == 10  # no task fits two models while others have none


def test_features_that_say_the_same_share_a_joint_code():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 60, 20_000).astype(np.uint8)
    codes = np.stack([base, base // 2, base // 3, 59 - base, rng.integers(0, 60, 20_000).astype(np.uint8)], axis=1)
    cells = boosting.Cells(boosting.columns_of(codes))
    g, h = rng.integers(-99, 99, 20_000).astype(float), rng.integers(0, 99, 20_000).astype(float)
    got = cells.sums(g, h, None)
    assert len(cells.groups) == 1
    for j in range(5):
        assert (got[0, j] == np.bincount(codes[:, j], g, boosting.BINS)).all() and (got[2, j] == np.bincount(codes[:, j], minlength=boosting.BINS)).all()


def test_leaf_values_step_by_step():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 64, (3_000, 3)).astype(np.uint8)
    for depth in (1, 3, 4, 6):
        nodes = 2 ** (depth + 1)
        feature = np.where((np.arange(nodes) < nodes // 2) & (rng.random(nodes) < 0.9), rng.integers(0, 3, nodes), -1).astype(np.int16)
        feature[0] = -1
        for n in range(2, nodes):
            if feature[n // 2] < 0:
                feature[n] = -1
        mask = rng.integers(1, 2 ** 63, nodes).astype(np.uint64)
        mask[::2] = np.uint64(2 ** 20 - 2 ** 4)
        value = rng.normal(size=nodes)
        want = value[boosting.leaves(feature, mask, codes, depth)]
        assert (boosting.leaf_values(feature, mask, value, boosting.columns_of(codes), depth) == want).all()


def test_tasks_that_score_many_rows_hold_many(spark, monkeypatch):
    monkeypatch.setattr(boosting, "SCORED_ROWS", 10)
    monkeypatch.setattr(boosting, "FEW_TASKS", 4)
    monkeypatch.setattr(boosting, "MOST_SCORES", 100)
    assert boosting.spread_rows(spark.range(20).withColumnRenamed("id", "flight_id"), 1).rdd.getNumPartitions() == 2
    assert boosting.spread_rows(spark.range(100).withColumnRenamed("id", "flight_id"), 10).rdd.getNumPartitions() == 10
