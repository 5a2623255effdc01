"""Near duplicates against all pairs of full sets."""
import random

import pytest

from tests.llm.helpers import AWKWARD, awkward, empty, frame, words
from tripwright.llm import minhash_dedup as md
from tripwright.llm.components import components


def shingles(text, size):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(rows, size, percent):
    """Sorted (doc_id, n, component, kept): links between all pairs, smallest id reachable."""
    sets = [shingles(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        component = least.get(top(i)) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return sorted(out, key=repr)


def family(rng, base, n, changes, first):
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        out.append((first + k, " ".join(w), "en", "a", 1))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    rows = []
    for f in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 30, 80, 150]))]
        rows += family(rng, base, rng.randint(1, 9), 6, 100 * f)
    hot = [f"h{rng.randrange(300)}" for _ in range(120)]
    rows += family(rng, hot, 90, 7, 5000)  # a third of all, chained by small steps
    rows += [(7000 + i, " ".join(hot[:60]) + f" own{i} " * 9, "en", "b", 1) for i in range(20)]
    rows += [(9000 + i, rows[i][1].upper(), "en", "b", 1) for i in range(10)]
    return rows


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, size, percent, small):
    if small:  # long lists and families meet block by block
        for name, value in (("LIST_BLOCK", 8), ("FAMILY_BLOCK", 10), ("GROUP_ROWS", 30), ("GROUP_SHINGLES", 500), ("STRIPE", 64)):
            monkeypatch.setattr(md, name, value)
    rows = [*corpus(), *AWKWARD]
    got = md.near_duplicates(frame(spark, rows).repartition(4), size, percent).drop("mark").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, size, percent)


def test_awkward_and_empty(spark):
    got = md.near_duplicates(awkward(spark), 3, 85).drop("mark").collect()
    assert sorted(map(tuple, got), key=repr) == plain(AWKWARD, 3, 85)
    assert md.near_duplicates(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [*corpus(), *((None if r[0] is None else r[0] + 20_000, *r[1:]) for r in AWKWARD)]
    docs = frame(spark, rows)
    left = md.drop_near_copies(docs)
    assert left.columns == docs.columns
    want = [i for i, _, _, kept in plain(rows, 5, 80) if kept]
    assert sorted((r[0] for r in left.collect()), key=repr) == sorted(want, key=repr)


def test_least_matches():
    assert md.least_matches(48, 100) == 48
    assert 20 < md.least_matches(48, 80) < md.least_matches(48, 85) < 48 * 0.85


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300), (7, 3)]
    parent = {n: n for e in edges for n in e}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
