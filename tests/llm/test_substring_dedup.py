"""Repeated word windows against a plain scan."""
import random

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, awkward, empty, frame
from tripwright.llm import substring_dedup as sd


def plain(rows, window):
    """(doc_id, n_words, n_removed, kept) by looking at every window."""
    ids = [float("inf") if r[0] is None else r[0] for r in rows]
    words = [(r[1] or "").encode().split() for r in rows]
    first = {}
    for i, w in zip(ids, words):
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (doc_id, *_), i, w in zip(rows, ids, words):
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p:p + window])] < i for q in range(p, p + window)}
        out.append((doc_id, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    return sorted(out, key=repr)


def story(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 40
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in rng.sample(range(10_000), n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(passages), rng.choice(["", rng.choice(passages)])]
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts) if rng.random() < 0.9 else rng.choice(passages), "en", "a", 1))
    rows += [(rows[0][0], rows[0][1], "en", "a", 1), (rows[1][0], rows[2][1], "en", "b", 1), (None, rows[3][1], None, None, 1)]
    return rows


@pytest.mark.parametrize("group,batch", [(2_000_000, 8 << 20), (300, 700), (40, 1)])
def test_equals_a_plain_scan(spark, group, batch):
    rows = [*story(), *AWKWARD]
    got = sd.remove_repeats(frame(spark, rows).repartition(5), 13, group, batch).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 13)


def test_short_windows_and_empty(spark):
    rows = [(2, "a b a b a b", "en", "a", 1), (1, "b a", "en", "a", 1), (3, "x a b", "en", "a", 1), (4, None, None, None, None)]
    got = sd.remove_repeats(frame(spark, rows), 2, 3, 5).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 2)
    assert sd.remove_repeats(empty(spark)).count() == 0
    assert len(sd.remove_repeats(awkward(spark)).collect()) == len(AWKWARD)


def test_frequent_prefixes_get_longer():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2 ** 60, 50, dtype=np.uint64)[np.minimum(rng.geometric(0.3, 40_000), 49)]
    starts = np.arange(len(codes) - 12)
    sample = codes[starts[:, None] + np.arange(13)]
    fitted = sd.Prefixes.fit(sample, len(sample), 13, 1000)
    assert len(fitted.frequent) > 2
    assert np.bincount(fitted.parts(codes, starts)).max() < 4000  # one word alone starts 30 % of them


def test_packing_round_trip():
    values = np.sort(np.random.default_rng(2).integers(0, 2 ** 63, 1000, dtype=np.uint64))
    assert (np.cumsum(sd.unpacked(sd.packed(sd.steps(values), np.uint64), np.uint64), dtype=np.uint64) == values).all()
    assert len(sd.unpacked(sd.packed(np.zeros(0, np.uint32), np.uint32), np.uint32)) == 0
