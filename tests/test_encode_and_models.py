"""Leak guards: own labels must not matter; folds balanced; calibrators and contracts."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tripwright.operators import audit, calibrate, compare, contracts, encode


@pytest.fixture(scope="module")
def labeled(spark):
    rng = np.random.default_rng(0)
    data = [(i, str(rng.choice(list("abcde"))), int(rng.random() < 0.3), float(rng.normal())) for i in range(600)]
    return spark.createDataFrame(data, "flight_id int, tail string, y int, x double").cache()


def test_folds_are_balanced_per_class_and_order_free(labeled):
    folds = encode.stratified_folds(labeled)
    sizes = [r["count"] for r in folds.groupBy("y", "fold").count().filter("y = 1").collect()]
    assert max(sizes) - min(sizes) <= 1
    again = encode.stratified_folds(labeled.orderBy(F.desc("x")).repartition(9))
    assert rows(folds, "flight_id", "fold") == rows(again, "flight_id", "fold")


def test_holdout_takes_only_eligible_rows(labeled):
    out = encode.inner_holdout(labeled, [], eligible=F.col("flight_id") % 2 == 0)
    assert out.filter("is_holdout AND flight_id % 2 = 1").count() == 0
    assert 110 <= out.filter("is_holdout").count() <= 125


def test_own_label_does_not_change_own_encoding(labeled):
    inner = encode.stratified_folds(labeled, name="f").cache()
    flipped = inner.withColumn("y", F.when(F.col("f") == 2, 1 - F.col("y")).otherwise(F.col("y")))
    a = encode.out_of_fold_encode(inner, "f", ["tail"]).filter("f = 2")
    b = encode.out_of_fold_encode(flipped, "f", ["tail"]).filter("f = 2")
    left, right = rows(a, "flight_id", "te_tail"), rows(b, "flight_id", "te_tail")
    assert [r[0] for r in left] == [r[0] for r in right]
    assert np.allclose([r[1] for r in left], [r[1] for r in right])


def test_encoding_equals_direct_formula_and_unseen_keys_get_the_mean(spark, labeled):
    apply = spark.createDataFrame([(1, "a"), (2, "new"), (3, None)], "flight_id int, tail string")
    got = dict(rows(encode.smoothed_target_encode(labeled, apply, "tail"), "flight_id", "te_tail"))
    data = labeled.select("tail", "y").collect()
    mean = np.mean([r["y"] for r in data])
    own = [r["y"] for r in data if r["tail"] == "a"]
    assert got[1] == pytest.approx((sum(own) + 20 * mean) / (len(own) + 20))
    assert got[2] == pytest.approx(mean) and got[3] == pytest.approx(mean)


def test_inner_splits_of_one_is_refused(labeled):
    with pytest.raises(ValueError):
        encode.oof_target_encode(labeled, [labeled], ["tail"], inner_splits=1)


def test_platt_equals_newton_and_isotonic_is_monotone(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.uniform(0.02, 0.98, 400), 3)
    y = (rng.random(400) < p ** 2).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    fitted = calibrate.fit_calibrator("platt", df)
    z, w = np.log(p / (1 - p)), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-(w[0] * z + w[1])))
        grad = np.array([np.sum((q - y) * z) + w[0], np.sum(q - y)])
        r = q * (1 - q)
        hess = np.array([[np.sum(r * z * z) + 1, np.sum(r * z)], [np.sum(r * z), np.sum(r)]])
        w -= np.linalg.solve(hess, grad)
    assert fitted.info["coef"] == pytest.approx(w[0], abs=1e-4)
    assert fitted.info["intercept"] == pytest.approx(w[1], abs=1e-4)
    grid = spark.createDataFrame([(float(x),) for x in np.linspace(0, 1, 50)], "p double").withColumn("x", F.col("p"))
    curve = [r["p"] for r in calibrate.fit_calibrator("isotonic", df).apply(grid).orderBy("x").collect()]
    assert all(a <= b for a, b in zip(curve, curve[1:])) and min(curve) >= 1e-6
    with pytest.raises(ValueError):
        calibrate.fit_calibrator("platt", df.filter("y = 1"))


def test_fingerprint_ignores_row_order_but_not_content(labeled):
    one = audit.table_fingerprint(labeled, ["flight_id", "y"]).first()
    two = audit.table_fingerprint(labeled.orderBy("x").repartition(3), ["flight_id", "y"]).first()
    three = audit.table_fingerprint(labeled.withColumn("y", 1 - F.col("y")), ["flight_id", "y"]).first()
    assert one == two and one != three


def test_paired_deltas_refuse_other_rows(spark):
    runs = spark.createDataFrame([(1, "a", 10, "f", 0.5), (1, "b", 11, "f", 0.6)], "seed int, model string, n_rows int, fold_fingerprint string, loss double")
    with pytest.raises(Exception, match="different rows"):
        compare.paired_deltas(runs, "seed", "model", "a", ["loss"]).collect()


def test_schema_of_prediction_rows_is_checked(labeled):
    with pytest.raises(ValueError):
        contracts.prediction_violations(labeled, run_id="r", phase_key="p", seed=1, n_rows=F.lit(1), n_splits=5)


def test_every_declared_variant_builds_and_encodes(spark):
    from tripwright import fixtures as fx
    from tripwright.plans.phases import PHASES, build_features, encode_variant

    sf = "/root/testdata/sf0.001"
    labels = fx.flights(spark, sf).filter("delay IS NOT NULL").selectExpr("flight_id", "CAST(delay = 'Delayed' AS INT) AS y").limit(60)
    built = {}
    for key in ("P1", "P2", "P3", "P4_te0", "P5_honest", "P6_legacy"):
        rows = build_features(fx.flights(spark, sf), PHASES[key], keep=("flight_id",)).join(labels, "flight_id")
        extra = rows.filter("flight_id % 5 = 1").withColumn("flight_id", -rows["flight_id"]) if key == "P5_honest" else None
        train, (valid,) = encode_variant(rows.filter("flight_id % 3 <> 0"), [rows.filter("flight_id % 3 = 0")], PHASES[key], seed=42, extra=extra)
        built[key] = set(train.columns)
        assert valid.count() + train.count() == 60 + (extra.count() if extra is not None else 0)
    assert not any(c.startswith("te_") for c in built["P1"] | built["P2"])
    assert "te_airline" in built["P3"] and "airline" not in built["P3"]
    assert {"te_airline", "airline"} <= built["P4_te0"] & built["P5_honest"] & built["P6_legacy"]
    with pytest.raises(ValueError):
        encode_variant(rows, [], PHASES["P5_honest"], seed=42)
