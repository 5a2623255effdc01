"""Joint Newton fits against a plain one, and the design against direct formulas."""
import numpy as np
import pandas as pd
import pytest

from tripwright.operators import logistic


@pytest.fixture(scope="module")
def encoded(spark):
    rng = np.random.default_rng(5)
    n = 600
    frame = pd.DataFrame({"slot": np.arange(n) % 2, "part": np.where(np.arange(n) % 5 == 0, "holdout", "train"), "flight_id": np.arange(n),
                          "a": rng.normal(3, 2, n), "b": rng.uniform(0, 1, n), "nothing": np.nan, "mo": rng.integers(1, 5, n)})
    frame.loc[rng.random(n) < 0.2, "a"] = np.nan
    frame.loc[frame.index[:6], "mo"] = 9  # a rare level
    frame["y"] = (rng.random(n) < 1 / (1 + np.exp(-(frame.a.fillna(3) - 3) + (frame.mo == 2)))).astype(int)
    types = "slot int, part string, flight_id long, a double, b double, nothing double, mo int, y int"
    return frame, spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.itertuples(index=False)], types).repartition(4).cache()


def plain_design(train, frame):
    parts = [np.ones(len(frame))]
    for c in ("a", "b"):
        median = np.sort(train[c].dropna())[(train[c].notna().sum() + 1) // 2 - 1]
        for values in ([lambda f: f[c].fillna(median)] + ([lambda f: f[c].isna().astype(float)] if train[c].isna().any() else [])):
            parts.append((values(frame) - values(train).mean()) / values(train).std(ddof=1))
    kept = [v for v in sorted(train.mo.astype(str).unique()) if (train.mo.astype(str) == v).sum() >= 20]
    parts += [(frame.mo.astype(str) == v).astype(float) for v in kept] + [(~frame.mo.astype(str).isin(kept)).astype(float)]
    return np.stack([np.asarray(p, float) for p in parts], axis=1)


def plain_fit(x, y, c):
    w, ridge = np.zeros(x.shape[1]), np.append(0, np.full(x.shape[1] - 1, 1 / c))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.lstsq((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w, rcond=None)[0]
    return w


def test_equals_a_plain_fit_of_each_slot_and_penalty(encoded):
    frame, df = encoded
    rows, widths = logistic.prepared(df, ["a", "b", "nothing"], ["mo"], 20, ("slot", "part", "flight_id", "y"))
    weights = logistic.fit_weights(rows.filter("part = 'train'"), widths, [0.01, 10.0])
    losses = logistic.mean_losses(rows.filter("part = 'holdout'"), weights)
    scores = {r.flight_id: r.p for r in logistic.scored(rows.filter("part = 'holdout'"), {s: w[1] for s, w in weights.items()}).collect()}
    for slot in (0, 1):
        own = frame[frame.slot == slot]
        train, held = own[own.part == "train"], own[own.part == "holdout"]
        assert widths[slot] == 1 + 3 + 5
        for i, c in enumerate((0.01, 10.0)):
            w = plain_fit(plain_design(train, train), train.y.to_numpy(), c)
            assert weights[slot][i] == pytest.approx(w, abs=1e-7)
            p = 1 / (1 + np.exp(-plain_design(train, held) @ w))
            assert losses[slot][i] == pytest.approx(-np.mean(np.where(held.y == 1, np.log(p), np.log(1 - p))), abs=1e-9)
        assert [scores[i] for i in held.flight_id] == pytest.approx(list(p), abs=1e-7)


def test_a_step_that_raises_the_loss_is_halved():
    newton = logistic.Newton(2, 1.0)
    newton.take(1.0, np.array([1.0, 0.0]), np.eye(2))
    first = newton.at.copy()
    newton.take(50.0, np.array([1.0, 0.0]), np.eye(2))
    assert newton.at == pytest.approx(first / 2) and newton.loss == 1.0


def test_hessians_by_level_equal_those_of_the_whole_design():
    rng = np.random.default_rng(1)
    n, wide, levels = 50, 3, ((3, 7), (7, 9))
    dense = np.column_stack([np.full(n, wide), rng.normal(size=(n, wide - 1))])
    at = np.column_stack([rng.integers(a, b, n) for a, b in levels])
    x = logistic.Rows(pd.Series([r.tobytes() for r in np.column_stack([dense, at]).astype(float)]))
    plain = np.zeros((n, 9))
    plain[:, :wide] = np.column_stack([np.ones(n), dense[:, 1:]])
    plain[np.arange(n)[:, None], at] = 1
    w, r = rng.normal(size=9), rng.random(n)
    assert x.probability(w) == pytest.approx(1 / (1 + np.exp(-plain @ w)))
    assert x.gradient(r, 9) == pytest.approx(r @ plain)
    assert x.hessian(r, 9) == pytest.approx((plain * r[:, None]).T @ plain)


def test_hessians_are_summed_in_few_passes_only(encoded, monkeypatch):
    _, df = encoded
    rows, widths = logistic.prepared(df, ["a", "b", "nothing"], ["mo"], 20, ("slot", "part", "flight_id", "y"))
    taken, plain = [], logistic.Newton.take
    monkeypatch.setattr(logistic.Newton, "take", lambda self, loss, gradient, hessian: taken.append(hessian is not None) or plain(self, loss, gradient, hessian))
    logistic.fit_weights(rows.filter("part = 'train'"), widths, [0.01, 10.0])
    assert 0 < sum(taken) < len(taken) < 4 * 15
