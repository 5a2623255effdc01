"""The joint booster against a plain one, its two ways against each other, and encodings from the cube."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tripwright.operators import boosting, calibrate, encode, models, slots


def plain_boost(codes, y, params, categorical):
    """Trees one split at a time, by trying every cut of every feature in every node."""
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(params["trees"]):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * 2.0 ** 24), np.rint(p * (1 - p) * 2.0 ** 24)

        def grow(own, depth):
            best = (1e-9 * 2.0 ** 24, None)
            if depth < params["depth"] and len(own) >= 2 * params["min_leaf"]:
                for variant in (0, 1):
                    for f in range(codes.shape[1]):
                        if variant and categorical[f]:
                            continue
                        bins = list(range(64))
                        if categorical[f]:
                            def score(b):
                                mine = own[codes[own, f] == b]
                                return g[mine].sum() / (h[mine].sum() + 10 * 2.0 ** 24) if len(mine) else np.inf
                            bins.sort(key=score)
                        for cut in range(63):
                            chosen = bins[1:cut + 1] if variant else bins[:cut + 1]
                            left = np.isin(codes[own, f], chosen)
                            n, hl, hr = left.sum(), h[own[left]].sum(), h[own[~left]].sum()
                            if n < params["min_leaf"] or len(own) - n < params["min_leaf"] or min(hl, hr) < 1e-3 * 2.0 ** 24:
                                continue
                            gain = g[own[left]].sum() ** 2 / hl + g[own[~left]].sum() ** 2 / hr - g[own].sum() ** 2 / h[own].sum()
                            if gain > best[0]:
                                best = (gain, left)
            if best[1] is None:
                margin[own] += -params["learning_rate"] * g[own].sum() / h[own].sum()
                return
            grow(own[best[1]], depth + 1)
            grow(own[~best[1]], depth + 1)

        grow(np.arange(len(y)), 0)
    return margin


def toy(n, seed):
    rng = np.random.default_rng(seed)
    codes = np.stack([rng.integers(0, 8, n), rng.integers(1, 30, n), rng.integers(0, 6, n)], axis=1).astype(np.uint8)
    signal = 0.2 * codes[:, 0] - 0.05 * codes[:, 1] + np.isin(codes[:, 2], (1, 4)) - 0.3
    return codes, (rng.random(n) < 1 / (1 + np.exp(-signal))).astype(float), np.arange(n)


def test_equals_a_plain_booster():
    codes, y, ids = toy(2000, 1)
    params, categorical = {"trees": 4, "depth": 3, "learning_rate": 0.3, "min_leaf": 20}, np.array([False, False, True])
    prior, trees, _ = boosting.boost(codes, y, ids, codes[:0], y[:0], params, categorical)
    margin = np.full(len(y), prior)
    for tree in trees:
        margin += tree.value[boosting.leaves(tree.feature, tree.mask, codes, tree.depth)]
    assert margin == pytest.approx(plain_boost(codes, y, params, categorical), abs=1e-12)


@pytest.fixture(scope="module")
def coded(spark):
    frames = []
    for slot in (0, 1):
        codes, y, ids = toy(700, slot)
        part = np.where(ids % 5 == 0, "holdout", np.where(ids % 7 == 0, "valid", "train"))
        frames.append(pd.DataFrame({"slot": slot, "part": part, "flight_id": ids, "y": y.astype(int), "codes": [c.tobytes() for c in codes]}))
    return spark.createDataFrame(pd.concat(frames), "slot int, part string, flight_id long, y int, codes binary").repartition(5).cache()


CODING = boosting.Coding(("a", "b", "c"), (False, False, True), {}, {})


@pytest.mark.parametrize("share, rounds", [(1.0, None), (0.6, None), (1.0, 2)])
def test_spark_aggregates_give_the_trees_of_groups_in_memory(coded, share, rounds):
    configs = [{"trees": 5, "depth": 2, "learning_rate": 0.5, "min_leaf": 15, "row_share": share, "stopping_rounds": rounds}]
    packed = [sorted((tuple(r)[:9], [round(x, 12) for x in r.losses]) for r in boosting.fit_models(coded, CODING, configs, local_rows=most, snapshot=2).collect())
              for most in (10_000, 10)]
    assert packed[0] == packed[1] and len(packed[0]) == 2


@pytest.mark.parametrize("share", [1.0, 0.6])
def test_first_trees_of_a_long_fit_are_the_short_fit(coded, share):
    params = {"depth": 2, "learning_rate": 0.5, "min_leaf": 15, "row_share": share}
    long, short = (boosting.fit_models(coded, CODING, [{**params, "trees": n}]) for n in (6, 3))
    valid = coded.filter("part = 'valid'")
    two = [rows(boosting.prefix_scores(valid, m, [3], 3, ("slot", "flight_id"))) for m in (long, short)]
    assert two[0] == two[1] and two[0]
    kept = short.select("slot", F.explode("losses").alias("x"))
    assert rows(kept) == rows(long.select("slot", F.explode(F.slice("losses", 1, 3)).alias("x")))


def test_stopping_replays_from_the_losses(coded):
    free, cut = (boosting.fit_models(coded, CODING, [{"trees": 25, "depth": 3, "learning_rate": 0.9, "min_leaf": 5, "stopping_rounds": r}]) for r in (None, 3))
    losses = {r.slot: r.losses for r in free.collect()}
    for r in cut.collect():
        best, n = 0, len(losses[r.slot])
        for i, x in enumerate(losses[r.slot]):
            best = i if x < losses[r.slot][best] else best
            if i - best >= 3:
                n = i + 1
                break
        assert (r.trees, r.losses) == (best + 1, losses[r.slot][:n])


def test_first_minimum_is_taken_among_equal_losses(spark):
    losses = spark.createDataFrame([(0, 0, 10, 0.5), (0, 1, 10, 0.4), (0, 0, 25, 0.4), (0, 1, 25, 0.4)], "slot int, config int, n_trees int, log_loss double")
    assert rows(models.first_minimum(losses, ["slot"])) == [(0, 0, 25)]


def test_rows_are_coded_by_edges_frequency_and_missing(spark):
    df = spark.createDataFrame([(i, 0, float(i % 10), i % 3 if i % 4 else None, 0.1 * i) for i in range(100)],
                               "flight_id int, slot int, x double, tail int, te_tail double")
    coding = boosting.fit_coding(df, ["x", "tail", "te_tail"], ["tail"], ["te_tail"])
    new = spark.createDataFrame([(1, 0, None, None, None), (2, 0, 3.0, 77, 5.0), (3, 9, -5.0, 1, 5.0)], df.schema)
    got = {r.flight_id: list(r.codes) for r in boosting.coded_rows(new, coding, ("flight_id", "slot")).collect()}
    assert got[1] == [0, 0, 0] and got[2][1] == 63 and got[3][:2] == [1, 2] and got[3][2] == 1
    assert got[2][0] == 1 + sum(e < 3 for e in coding.shared["x"])


def test_settings_out_of_range_are_refused(coded):
    for wrong in ({"row_share": 0.0}, {"trees": 0}, {"depth": 20}):
        with pytest.raises(ValueError):
            boosting.fit_models(coded, CODING, [{"trees": 2, "depth": 2, "learning_rate": 0.1, "min_leaf": 5, **wrong}])


@pytest.fixture(scope="module")
def labeled(spark):
    data = [(i, int(i % 3 == 0), i % 4 if i % 9 else None, f"t{i % 11}") for i in range(240)]
    return spark.createDataFrame(data, "flight_id long, y int, tail int, airline string")


def test_cube_encodings_equal_those_of_single_folds(labeled):
    entries = slots.nested_slots(labeled, [42, 7], k=3, fraction=0.25)
    got = slots.encode_slots(labeled, entries, ["tail", "airline"]).cache()
    for seed, fold in ((42, 0), (7, 2)):
        mine = got.filter((F.col("seed") == seed) & (F.col("outer_fold") == fold))
        folded = encode.stratified_folds(labeled, k=3, seed=seed)
        split = encode.inner_holdout(folded.filter(F.col("fold") != fold).drop("fold"), [], fraction=0.25, salt=f"holdout:{seed + fold}")
        inner, held = split.filter("NOT is_holdout").drop("is_holdout"), split.filter("is_holdout").drop("is_holdout")
        train, (held, valid) = encode.oof_target_encode(inner, [held, folded.filter(F.col("fold") == fold).drop("fold")], ["tail", "airline"], seed=seed)
        for part, df in (("train", train), ("holdout", held), ("valid", valid)):
            names = ["flight_id", "y", "te_tail", "te_airline"]
            mapped = [[(r[0], r[1], round(r[2], 12), round(r[3], 12)) for r in rows(x, *names)] for x in (mine.filter(F.col("part") == part), df)]
            assert mapped[0] == mapped[1] and mapped[0]


def test_no_label_of_a_held_out_row_changes_a_training_row(labeled):
    entries = slots.nested_slots(labeled, [1], k=3).cache()
    flipped = entries.withColumn("y", F.when(F.col("part") == "train", F.col("y")).otherwise(1 - F.col("y")))
    one, two = (rows(slots.encode_slots(labeled, e, ["airline"]).select("slot", "flight_id", "part", "te_airline")) for e in (entries, flipped))
    assert one == two
    with pytest.raises(ValueError):
        slots.encode_slots(labeled.withColumn("te_tail", F.lit(1.0)), entries, ["tail"])


def test_crossfit_slots_score_each_training_row_once(labeled):
    entries = slots.crossfit_slots(labeled, [42], k=3, parts=2).cache()
    scored = rows(entries.filter("part = 'valid'").groupBy("outer_fold", "flight_id").count())
    assert len(scored) == 240 * 2 and all(n == 1 for *_, n in scored)
    assert entries.select("slot").distinct().count() == 6


def test_joint_calibrators_equal_single_ones(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(0.02, 0.98, 600), 3)
    df = spark.createDataFrame([(i % 2, "a", int(rng.random() < x ** 2), float(x)) for i, x in enumerate(p)], "slot int, arm string, y int, p double").cache()
    platt, isotonic = calibrate.joint_platt(df, ("slot", "arm")), calibrate.joint_isotonic(df, ("slot", "arm"))
    for slot in (0, 1):
        own = df.filter(F.col("slot") == slot)
        info = calibrate.fit_calibrator("platt", own).info
        assert platt[slot, "a"] == pytest.approx((info["coef"], info["intercept"]), abs=1e-6)
        grid = spark.createDataFrame([(float(x),) for x in np.linspace(0, 1, 41)], "p double").withColumn("x", F.col("p"))
        curve = [(r.x, r.p) for r in calibrate.fit_calibrator("isotonic", own).apply(grid).collect()]
        mine = np.clip(np.interp([x for x, _ in curve], *isotonic[slot, "a"]), 1e-6, 1 - 1e-6)
        assert mine == pytest.approx([v for _, v in curve], abs=1e-9)
