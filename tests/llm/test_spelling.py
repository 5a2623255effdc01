"""Spelling variants against a plain version over all pairs of a small vocabulary."""
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tests.llm.helpers import AWKWARD, awkward, empty, frame
from tripwright.llm import spelling


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def plain(rows, min_length=6, min_count=5, one_in=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % one_in else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], form.get(w), root, len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def corpus(seed, docs=60, alphabet="abÀé"):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(12)]
    words = []
    for s in stems:
        for times in (60, 12, 2):
            i = rng.randrange(len(s) + 1)
            edited = rng.choice([s, s[:i] + rng.choice(alphabet) + s[i:], s[:i] + rng.choice(alphabet) + s[i + 1:], s[:i] + s[i + 1:]])
            words += [edited] * times
            s = edited
    rng.shuffle(words)
    return [(i, " ".join(words[i::docs]).title() if i % 7 else " ".join(words[i::docs])) for i in range(docs)]


def found(spark, rows, **options):
    docs = frame(spark, [(i, t, None, None, 0) for i, t in rows])
    return sorted(map(tuple, spelling.spelling_variants(docs, **options).collect()))


@pytest.mark.parametrize("seed, group_words, one_in", [(1, 4000, 199), (2, 2, 3), (3, 3, 5)])
def test_equals_the_plain_version_with_windows_halved_down_to_single_places(spark, seed, group_words, one_in):
    rows = corpus(seed)
    assert found(spark, rows, group_words=group_words, one_in=one_in) == plain(rows, one_in=one_in)


def test_forms_lead_on_to_the_root_and_ties_go_to_the_smaller_word(spark):
    rows = [(1, "letters " * 250 + "letterz " * 50 + "letterzz " * 10), (2, "bananas " * 25 + "bananes " * 25 + "bananis " * 5 + "apart")]
    got = {r[0]: r[1:] for r in found(spark, rows, one_in=10 ** 9)}
    assert got["letterzz"] == (10, "letterz", "letters", 1, 50)
    assert got["letterz"] == (50, "letters", "letters", 2, 250)
    assert got["bananis"] == (5, "bananas", "bananas", 2, 25)
    assert got["bananas"] == (25, None, "bananas", 2, None)


def test_acceptor_shares_states_and_accepts_each_pair_once():
    acceptor = spelling.Acceptor()
    words = sorted({"aabb", "aab", "abab", "bbab", "b", "", "aabbb", "babb"})
    initial = acceptor.add(words)
    pairs = list(acceptor.one_edit(initial, 6))
    plain_pairs = {frozenset((u, v)) for u in words for v in words if u < v and one_edit(u, v)}
    assert len(pairs) == len(plain_pairs) and {frozenset(p) for p in pairs} == plain_pairs
    assert acceptor.add(words) == initial
    assert len(acceptor.states) < sum(len(w) for w in words)


def test_awkward_and_empty_tables(spark):
    rows = [(r[0], r[1]) for r in AWKWARD]
    assert sorted(map(tuple, spelling.spelling_variants(awkward(spark), min_count=1).collect())) == plain(rows, min_count=1)
    assert spelling.spelling_variants(empty(spark)).collect() == []


def test_very_long_words(spark):
    long = "x" * 3000
    rows = [(1, " ".join([long] * 30 + [long[1:]] * 6 + [long + "y"] * 5))]
    assert found(spark, rows, one_in=10 ** 9, group_words=2) == plain(rows, one_in=10 ** 9)


def test_a_form_needs_a_ratio_above_one(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty(spark), ratio=1)
