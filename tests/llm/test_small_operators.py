"""Exact copies, mixing, token counts and byte-level BPE against plain versions."""
import hashlib
import re
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import AWKWARD, awkward, empty, frame, words
from tripwright.llm import byte_bpe, exact_dedup, mixing, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_copies(spark, counters):
    got = exact_dedup.exact_dedup(awkward(spark), counters).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in AWKWARD:
        groups[normal(text)].append(doc_id)
    assert len(got) == len(AWKWARD)
    want = {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids))
            for t, ids in groups.items()}
    assert all(want[r.text_sha256] == (r.keep_id, r.group_size) for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_copies_dropped(spark):
    docs = awkward(spark)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0) for r in left.collect()) == [
        (False, 1), (False, 3), (False, 5), (False, 6), (False, 7), (False, 9), (False, 10), (True, 0)]
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_one_hot_text(spark):
    docs = frame(spark, [(i, "the same" if i % 3 else f"own {i}", "en", "a", 1) for i in range(300)])
    got = exact_dedup.exact_dedup(docs, counters=4).collect()
    assert {r.keep_id for r in got if r.doc_id % 3} == {1} and sum(r.kept for r in got) == 101


def test_mix_targets_and_takes(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "abcdefg"[min(i % 11, 6)], 1) for i in range(3000)]
    rows += [(5000 + i, None, "en", None, 1) for i in range(10)] + [(6000, "x y", "en", None, 1)]
    docs = frame(spark, rows)
    got = mixing.mix_sources(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes, names = defaultdict(int), {}
    for doc_id, text, _, source, _ in rows:
        sizes[source] += len(words(text))
        names[doc_id] = source
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:  # share again until no target is above three times its source
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    taken = defaultdict(int)
    for r in got:
        source = names[r.doc_id]
        want = 3 * sizes[source] if source in capped else level * weight[source]
        assert r.target == pytest.approx(want) and r.source_size == sizes[source]
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[source] += r.taken
    assert sum(taken.values()) <= total
    for source in order:
        want = 3 * sizes[source] if source in capped else level * weight[source]
        assert abs(taken[source] - want) <= 8
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_mix_awkward_and_applied(spark):
    docs = awkward(spark)
    decided = mixing.mix_sources(docs).collect()
    assert len(decided) == len(AWKWARD) and all(r.taken == 0 for r in decided if r.size == 0)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r[1])) for r in mixed.collect()) == sum(r.taken for r in decided)
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert {r.target for r in mixing.mix_sources(frame(spark, [(1, None, None, None, 1), (2, "", None, "a", 1)])).collect()} == {0.0}


def test_token_counts(spark):
    processor = token_counts.model(PIECES)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(awkward(spark), PIECES).collect()}
    want = {(i, len((t or "").encode()), n := len(processor.encode(t or "")), n > 4096) for i, t, *_ in AWKWARD}
    assert got == want
    assert token_counts.token_counts(empty(spark), PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab. \t\n▁　é你\x00<s>/"), max_size=30), max_size=5), st.integers(1, 40))
def test_pieces_count_as_whole_texts(texts, batch):
    assert token_counts.count_tokens(texts, PIECES, batch) == [len(token_counts.model(PIECES).encode(t)) for t in texts]


@pytest.mark.parametrize("chunk,overlap", [(32768, 512), (400, 60), (50, 20), (7, 3)])
def test_bpe_equals_whole_texts(spark, chunk, overlap):
    bpe = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    rows = [*AWKWARD, (20, "it's 12,345  \n\n\n  words   they've " * 40 + " " * 100 + "end", None, None, 1)]
    want = []
    for doc_id, text, *_ in rows:
        ids = bpe.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    got = byte_bpe.encode_documents(frame(spark, rows), RANKS, public_tokenizers.PATTERN, chunk, overlap)
    digests = byte_bpe.encoding_digests(got).collect()
    assert sorted(map(repr, map(tuple, digests))) == sorted(map(repr, want))
    texts = byte_bpe.decode_ids(got, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(repr, map(tuple, texts))) == sorted(repr((i, t or "")) for i, t, *_ in rows)


def test_bpe_empty(spark):
    assert byte_bpe.encode_documents(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 '\n.s　é"), max_size=120), st.integers(5, 30), st.integers(1, 9))
def test_stitched_pieces_are_matches(text, chunk, overlap):
    """Cutting at the stitches changes no match of the pattern."""
    scan = byte_bpe.matcher(public_tokenizers.PATTERN)
    whole = [m.end() for m in scan.finditer(text)]
    heads, tails = [], []
    for s in range(0, len(text), chunk):
        part = text[s:s + chunk + overlap]
        ends = [0, *(m.end() for m in scan.finditer(part))]
        if s + chunk < len(text):
            ends = [e for e in ends if e < len(part)]
        heads.append([s + e for e in ends if e <= overlap])
        tails.append([s + e for e in ends if e >= chunk])
    assert set(byte_bpe.stitches(heads, tails)) <= {0, *whole}
