"""Fill-in-the-middle against plain string work, with frames of a few bytes."""
import random
import re
from hashlib import sha256

import pytest
import zstandard

from tests.llm.helpers import AWKWARD, awkward, empty, frame
from tripwright.llm import fill_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def random_texts(seed, count=120):
    rng = random.Random(seed)
    pieces = ["word", "é", "你好", "\U0001F600", " ", "  ", "\n", "\t", "<", "P>", "<S", ">", "x" * 40, "\u0085", ""]
    return [(i, "".join(rng.choices(pieces, k=rng.randint(0, 60)))) for i in range(count)]


def key(row):
    return tuple((v is None, v) for v in row)


def same(spark, docs, rows, frame_bytes):
    outputs = fim.fill_in_middle(docs, frame_bytes=frame_bytes)
    expected = sorted((plain(*r) for r in rows), key=key)
    assert sorted(map(tuple, fim.output_texts(outputs).collect()), key=key) == expected
    texts = {(r[0], sha256((r[1] or "").encode()).hexdigest()) for r in rows}
    for row in fim.digests(outputs).collect():
        assert (row.doc_id, row.restored_sha256) in texts
    digests = sorted((r.doc_id or -1, r.output_sha256) for r in fim.digests(outputs).collect())
    assert digests == sorted((r[0] or -1, sha256(r[5].encode()).hexdigest()) for r in expected)


@pytest.mark.parametrize("frame_bytes", [4, 7, 1 << 16])
def test_equals_plain_string_work_whatever_the_frames(spark, frame_bytes):
    rows = random_texts(frame_bytes)
    same(spark, frame(spark, [(i, t, None, None, 0) for i, t in rows]).repartition(3), rows, frame_bytes)


def test_awkward_and_empty_tables(spark):
    rows = [(r[0], r[1]) for r in AWKWARD]
    same(spark, awkward(spark), rows, 1000)
    assert fim.digests(fim.fill_in_middle(empty(spark))).collect() == []


def test_only_frames_with_a_cut_are_opened():
    text = " ".join(f"w{i}" for i in range(4000)).encode()
    press, unpress = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    units, chars, frames = fim.to_frames(text, 256, press)
    opened = []
    parts, prefix, middle = fim.parts_of(1000, 3000, units, chars, frames, press, lambda f: opened.append(f) or unpress(f))
    assert len(frames) > 50 and len(opened) == 2
    assert b"".join(map(unpress, parts["prefix"])) == b" ".join(text.split()[:1000])
    assert (prefix, middle) == (len(b" ".join(text.split()[:1000])), len(b" " + b" ".join(text.split()[1000:3000])))


def test_cumulative_units_of_frames_count_a_unit_where_it_ends():
    press, unpress = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    text = ("x" * 50 + " é" * 9 + "  ").encode()
    units, chars, frames = fim.to_frames(text, 8, press)
    for total, points, i in zip(units, chars, range(len(frames))):
        head = b"".join(map(unpress, frames[:i + 1])).decode()
        ends, at = 0, 0
        for unit in UNIT.findall(text.decode()):
            at += len(unit)
            ends += at <= len(head)
        assert (total, points) == (ends, len(head))


def test_output_without_its_markers_is_refused():
    press, unpress = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    with pytest.raises(ValueError):
        fim.output_digests([press(b"no markers")], "psm", unpress)


def test_markers_are_found_across_frames():
    press, unpress = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    output = b"<P>one <<S>> three<M> two"
    frames = [press(output[i:i + 1]) for i in range(len(output))]
    assert fim.output_digests(frames, "psm", unpress) == (sha256(output).hexdigest(), sha256(b"one < two> three").hexdigest())
