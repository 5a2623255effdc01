"""Order-dependent helpers against brute force, including one key with most of the rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tripwright.operators import intervals, metrics, sampling
from tripwright.operators.skew import exact_quantiles, row_ranks, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(4000) < 0.7, "hot", rng.choice(list("abc"), 4000))
    values = np.round(rng.exponential(30, 4000), 2)
    data = [(i, str(k), float(v)) for i, (k, v) in enumerate(zip(keys, values))]
    return data, spark.createDataFrame(data, "id int, k string, v double").repartition(7).cache()


def test_quantiles_equal_linear_interpolation(skewed):
    data, df = skewed
    probs = {"a": 0.0, "b": 0.1, "c": 0.333, "d": 0.5, "e": 0.98, "f": 1.0}
    for r in exact_quantiles(df, ["k"], "v", probs).collect():
        mine = [v for _, k, v in data if k == r["k"]]
        assert np.allclose([r[n] for n in probs], np.quantile(mine, list(probs.values())))
        assert r["n_values"] == len(mine)
    whole = exact_quantiles(df, [], "v", probs).first()
    assert np.allclose([whole[n] for n in probs], np.quantile([v for _, _, v in data], list(probs.values())))


def test_quantiles_of_constant_and_null_keys(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 3.0), ("x", 5.0), ("x", None)], "k string, v double")
    assert rows(exact_quantiles(df, ["k"], "v", {"m": 0.5}), "k", "m") == [("x", 5.0), (None, 3.0)]


def test_running_totals_and_ranks_equal_a_plain_window(skewed):
    data, df = skewed
    placed = df.withColumn("_bucket", F.floor(F.col("id") / 100))
    got = dict(rows(running_totals(placed, ["k"], [F.col("id")], {"s": F.col("v")}), "id", "s"))
    ranks = dict(rows(row_ranks(placed, ["k"], [F.col("id")], "r"), "id", "r"))
    total, n = {}, {}
    for i, k, v in data:
        total[k], n[k] = total.get(k, 0.0) + v, n.get(k, 0) + 1
        assert got[i] == pytest.approx(total[k])
        assert ranks[i] == n[k]


def _merge(items):
    out = []
    for a, b in sorted(items):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_interval_union_and_difference_equal_brute_force(spark):
    from datetime import datetime, timedelta

    rng = np.random.default_rng(5)
    base = datetime(2019, 1, 1)

    def make(n, longest):
        starts = rng.integers(0, 20_000, n)
        return [("A", base + timedelta(minutes=int(s)), base + timedelta(minutes=int(s + rng.integers(1, longest)))) for s in starts]

    schema = "station string, start timestamp_ntz, end timestamp_ntz"
    target, covered = make(150, 90), make(120, 60)
    t, c = spark.createDataFrame(target, schema), spark.createDataFrame(covered, schema)
    want = _merge([(a, b) for _, a, b in target])
    assert sorted(list(r) for r in rows(intervals.merge_intervals(t, "station"), "start", "end")) == want
    blocks, pieces = _merge([(a, b) for _, a, b in covered]), []
    for a, b in want:
        for x, y in blocks:
            if y > a and x < b:
                if x > a:
                    pieces.append([a, x])
                a = max(a, y)
                if a >= b:
                    break
        if a < b:
            pieces.append([a, b])
    assert sorted(list(r) for r in rows(intervals.subtract_intervals(t, c, "station"), "start", "end")) == pieces
    cut = intervals.split_intervals(t, 0.5)
    longest = cut.agg(F.max(F.timestamp_diff("SECOND", "start", "end"))).first()[0]
    assert longest <= 1800


def test_visit_order_equals_nested_queues(spark):
    rng = np.random.default_rng(3)
    strata = sorted({tuple(int(x) for x in rng.integers(0, n, 1)[:1]) + tuple(int(x) for x in rng.integers(0, 3, 3)) for n in [2] * 40})

    def robin(queues):
        queues, out = [list(q) for q in queues if q], []
        while queues:
            queues = [q for q in queues if q]
            for q in queues:
                out.append(q.pop(0))
            queues = [q for q in queues if q]
        return out

    def order(items, depth):
        if depth == 3:
            return sorted(items)
        groups = {}
        for s in sorted(items):
            groups.setdefault(s[depth], []).append(s)
        return robin([order(groups[k], depth + 1) for k in sorted(groups)])

    df = spark.createDataFrame(strata, "a int, b int, c int, d int")
    got = sampling.inclusion_order(df, ["a", "b", "c", "d"]).orderBy("visit").collect()
    assert [tuple(r)[:4] for r in got] == order(strata, 0)


def test_auc_counts_ties_as_half(spark):
    data = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 1.0), (0, 0.0)]
    df = spark.createDataFrame(data, "y_true int, p double")
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, []).first()[0] == pytest.approx(want)
    assert metrics.roc_auc(df.filter("y_true = 1"), []).first()[0] is None


def test_thresholds_reached_equals_counting(spark):
    ps = sorted({*metrics.THRESHOLDS, 0.0, 0.0999999, 0.29, 0.57, 0.7000001, 1.0, *[t + 1e-12 for t in metrics.THRESHOLDS], *[t - 1e-12 for t in metrics.THRESHOLDS]})
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for p, n in df.select("p", metrics.thresholds_reached(F.col("p"))).collect():
        assert n == sum(t <= p for t in metrics.THRESHOLDS), p


def test_cross_fold_thresholds_without_keys_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    data = [(int(rng.random() < 0.3), float(np.round(rng.random(), 3)), int(i % 4)) for i in range(800)]
    df = spark.createDataFrame(data, "y_true int, p double, fold int")

    def f1(part, th):
        tp = sum(y == 1 and p >= th for y, p, _ in part)
        fp = sum(y == 0 and p >= th for y, p, _ in part)
        fn = sum(y == 1 and p < th for y, p, _ in part)
        tn = sum(y == 0 and p < th for y, p, _ in part)
        return ((2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0) + (2 * tn / (2 * tn + fp + fn) if tn + fp + fn else 0)) / 2

    chosen, summary = metrics.cross_fold_thresholds(df, [])
    got = dict(rows(chosen, "fold", "threshold"))
    for fold in range(4):
        rest = [r for r in data if r[2] != fold]
        assert got[fold] == max(metrics.THRESHOLDS, key=lambda t: (f1(rest, t), -t))
    assert summary.first()["naive_f1"] == pytest.approx(max(f1(data, t) for t in metrics.THRESHOLDS))
