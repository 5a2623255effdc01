"""SpotSigs fingerprints, edited texts and the search against plain versions."""
import random
import re
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, awkward, empty, frame
from tripwright.llm import spot_signatures as spots

WORDS = re.compile(r"[^\W_]+")


def plain_set(text, chain=2, anchors=spots.COMMON_WORDS):
    words = WORDS.findall((text or "").lower())
    found = set()
    for i, w in enumerate(words):
        chain_words = [x for x in words[i + 1:] if x not in anchors][:chain]
        if w in anchors and len(chain_words) == chain:
            found.add(" ".join([w, *chain_words]))
    if not found:
        found = {" ".join(words)} if 0 < len(words) <= chain else {" ".join(words[i:i + chain + 1]) for i in range(len(words) - chain)}
    return {md5(s.encode()).hexdigest()[:8] for s in found}


def printed(text, **options):
    return "".join(sorted(plain_set(text, **options)))


def jaccard(a, b):
    a, b = plain_set(a), plain_set(b)
    return 1.0 if a == b else len(a & b) / len(a | b)


def plain(rows):
    """Rows with distinct doc_ids in descending order, each with the next one."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, onward = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + onward[:third]
        out.append((doc_id, len(text), edited, printed(text), printed(edited), round(jaccard(text, edited), 9), round(jaccard(text, onward), 9)))
    return out


def compared(df):
    return [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, df.collect())]


def prose(seed, count):
    rng = random.Random(seed)
    vocabulary = ["rally", "Über", "señor", "tree", "42", "x1", *("the a of und la les").split()]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(count)]


@pytest.mark.parametrize("seed, count", [(1, 40), (2, 1), (3, 2)])
def test_equals_the_plain_version(spark, seed, count):
    rows = [(i * 3 - 20, t) for i, t in enumerate(prose(seed, count))][::-1]
    docs = frame(spark, [(i, t, None, None, 0) for i, t in rows]).repartition(4)
    assert sorted(compared(spots.compare_edited(docs))) == sorted(plain(rows))


def test_the_known_example_and_other_chains(spark):
    text = "At a rally to kick off a weeklong campaign for the South Carolina primary"
    rows = frame(spark, [(1, text, None, None, 0)])
    for chain in (1, 2, 3):
        got = spots.fingerprints(rows, chain=chain).select(spots.printed("print")).head()[0]
        assert got == printed(text, chain=chain)
    few = spots.fingerprints(rows, anchors=("for", "a")).select(spots.printed("print")).head()[0]
    assert few == printed(text, anchors=("for", "a"))


def test_awkward_rows_repeated_ids_and_an_empty_table(spark):
    got = compared(spots.compare_edited(awkward(spark)))
    texts = [(r[0], r[1] or "") for r in AWKWARD]
    assert sorted((r[0] or -1, r[3]) for r in got) == sorted((i or -1, printed(t)) for i, t in texts)
    by_id = {r[0]: r for r in got if r[0] not in (None, 8)}
    ordered = sorted(((i, t) for i, t in texts if i is not None), key=lambda r: -r[0])
    for i, (doc_id, text) in enumerate(ordered[:-1]):
        if doc_id != 8:
            third = len(text) // 3
            assert by_id[doc_id][2] == text[:len(text) - third] + ordered[i + 1][1][:third]
    assert sum(r[0] == 8 for r in got) == 2 and sum(r[0] is None for r in got) == 2
    assert by_id[3][3] == "" and by_id[3][5] == 1.0 and by_id[4][6] == 1.0
    assert spots.compare_edited(empty(spark)).collect() == []


def test_a_long_run_of_anchors_is_read_once(spark):
    text = "of the " * 60_000 + "great divide"
    got = spots.fingerprints(frame(spark, [(1, text, None, None, 0)])).select(spots.printed("print")).head()[0]
    assert got == "".join(sorted(md5(f"{w} great divide".encode()).hexdigest()[:8] for w in ("of", "the")))


@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_search_finds_all_links_of_different_fingerprints(spark, least):
    rng = random.Random(7)
    texts = []
    for stem in prose(11, 12):
        words = stem.split() + [f"u{rng.randrange(9)}" for _ in range(30)]
        for _ in range(5):
            words = [w if rng.random() < 0.97 else "changed" for w in words]
            texts.append("the ".join(f"{w} " for w in words))
    texts += texts[:3] + [None, ""]
    docs = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    links, membership = spots.near_pairs(spots.fingerprints(docs), least)
    member = {r["doc_id"]: r["class"] for r in membership.collect()}
    got = {frozenset((r.left, r.right)): round(r.likeness, 9) for r in links.collect()}
    wanted = {}
    for i in member:
        for j in member:
            if i < j and plain_set(texts[i]) != plain_set(texts[j]) and jaccard(texts[i], texts[j]) >= least - 1e-12:
                wanted[frozenset((member[i], member[j]))] = round(jaccard(texts[i], texts[j]), 9)
    assert got == wanted and (least == 1.0 or wanted)
    assert set(member) == {i for i, t in enumerate(texts) if t} and member[0] == member[60]


def test_search_refuses_a_limit_outside_zero_and_one(spark):
    with pytest.raises(ValueError):
        spots.near_pairs(spots.fingerprints(empty(spark)), 0)
