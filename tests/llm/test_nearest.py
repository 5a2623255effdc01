"""Nearest neighbours against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwright.llm import nearest


def inner(a, b):
    total = 0.0
    for x, y in zip(a, b):  # sum() would compensate rounding
        total += x * y
    return total


def brute(rows, k):
    """(query, rank, id, score) of an exact search over usable (id, vector) rows."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = []
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        own = min((tuple(v) for i, v in rows if i == q))
        score = np.array([inner(own, v) for v in x.tolist()])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out += [(q, r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return out


def found(spark, rows, k=20, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return [tuple(r) for r in nearest.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k, **kw).collect()]


def recall(got, want):
    return len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)


def test_chi_squared_quantiles():
    assert nearest.chi_squared_quantile(0.95, 8) == pytest.approx(15.507, abs=0.02)
    assert nearest.chi_squared_quantile(0.97, 1) == pytest.approx(4.709, abs=0.02)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_scores(spark, monkeypatch, scaled):
    monkeypatch.setattr(nearest, "CELL_ROWS", 150)
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 200)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 30)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24))
    x[:500] = x[0] + 0.05 * rng.standard_normal((500, 24))  # a third of all rows in one place
    if scaled:
        x *= rng.uniform(0.5, 2, (1500, 1))
    rows = [(int(i), v, 0) for i, v in enumerate(x.tolist())]
    got, want = found(spark, rows), brute([(i, v) for i, v, _ in rows], 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    assert len({(q, r) for q, r, _, _ in got}) == len(got)
    for q, _, i, s in got:
        assert s == inner(x[q].tolist(), x[i].tolist())


def test_ties_unusable_rows_and_few_candidates(spark):
    one = [1.0, 0.0]
    rows = [(0, one, 0), (5, one, 0), (3, one, 0), (3, one, 0), (7, [0.0, 0.0], 0), (8, None, 0), (9, [float("nan"), 1.0], 0),
            (11, [None, 1.0], 0), (12, [1.0], 0), (None, one, 0), (20, [-1.0, 2.0], 0), (20, [9.0, 9.0], 0), (40, [float("inf"), 0.0], 0)]
    got = sorted(found(spark, rows))
    usable = [(0, one), (5, one), (3, one), (3, one), (20, [-1.0, 2.0]), (20, [9.0, 9.0])]
    assert got == brute(usable, 20)
    assert found(spark, []) == []
    assert found(spark, [(20, one, 0)]) == []


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = [tuple(r) for r in nearest.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()]
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9
