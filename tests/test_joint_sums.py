"""Joint codes, split sets and leaf values of the booster against plain ones, and the spread of scoring."""
import numpy as np
import pandas as pd
import pytest

from tripwright.operators import boosting


def table(n, seed, bins=(64, 64, 2, 17, 30, 64, 1)):
    random = np.random.default_rng(seed)
    codes = np.stack([random.integers(64 - b, 64, n) for b in bins], axis=1).astype(np.uint8)
    return codes, *(random.integers(-2 ** 24, 2 ** 24, (2, n)).astype(float))


@pytest.mark.parametrize("rows", [0, 1, 300, 9_000, None])
def test_joint_sums_equal_plain_ones(rows, monkeypatch):
    monkeypatch.setattr(boosting, "CHUNK", 4_000)
    codes, g, h = table(20_000, 1)
    own = None if rows is None else np.arange(20_000)[::2][:rows]
    got = boosting.Cells(boosting.columns_of(codes)).sums(g, h, own)
    picked = slice(None) if own is None else own
    for j in range(codes.shape[1]):
        for i, v in enumerate((g, h, np.ones(20_000))):
            assert (got[i, j] == np.bincount(codes[picked, j], v[picked], boosting.BINS)).all()


def test_sets_of_bins_send_the_same_codes_left():
    random, codes = np.random.default_rng(2), np.arange(64, dtype=np.uint8)
    masks = [1, 2 ** 64 - 1, 2 ** 63, *(2 ** k - 1 for k in range(1, 64)), *(2 ** k - 2 for k in range(2, 64)), *map(int, random.integers(1, 2 ** 63, 50))]
    for mask in masks:
        assert boosting.goes_left(mask, codes).tolist() == [bool(mask >> c & 1) for c in range(64)]


@pytest.mark.parametrize("depth, n", [(2, 6_000), (4, 6_000), (7, 6_000), (7, 50)])
def test_leaf_values_equal_stepping_down(depth, n):
    codes, g, h = table(n, depth)
    tree, rows = boosting.Tree(depth, 0.1, 5), {1: np.arange(n)}
    cells, categorical, parents = boosting.Cells(boosting.columns_of(codes)), np.arange(codes.shape[1]) % 2 == 0, {}
    while len(tree.active):
        active = tree.active.tolist()
        hist = cells.level(g, np.abs(h), rows, None, tree.active, parents)
        parents = {k: hist[:, i] for i, k in enumerate(active)}
        tree.split(hist, categorical)
        for k in active:
            if tree.feature[k] >= 0:
                rows[2 * k], rows[2 * k + 1] = boosting.halves(tree.feature, tree.mask, cells.columns, k, rows.pop(k))
    want = tree.value[boosting.leaves(tree.feature, tree.mask, codes, depth)]
    assert (boosting.leaf_values(tree.feature, tree.mask, tree.value, cells.columns, depth) == want).all()


def test_scoring_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(boosting, "SCORED_ROWS", 100)
    codes = table(1_000, 3, (4, 4))[0]
    coded = spark.createDataFrame(pd.DataFrame({"slot": 0, "flight_id": range(1_000), "codes": [r.tobytes() for r in codes]})).coalesce(1)
    tree = boosting.Tree(1, 0.1, 1)
    model = spark.createDataFrame(pd.DataFrame([boosting.packed_model(0, 0, 0.25, 1, [tree], [0.5], False)]), boosting.MODEL)
    scored = boosting.prefix_scores(coded, model, {0: 1}, 2, ("flight_id",))
    assert scored.rdd.getNumPartitions() == 10 and scored.count() == 1_000
