"""Quality, language and secrets: held-out results, plain versions, awkward tables."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, awkward, empty, frame
from tripwright.llm import language_id, quality, secrets

SF = "/root/testdata/sf0.1"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_on_held_out_rows(spark):
    labels = table(spark, "labels").where("quality is not null")
    scored = quality.score_quality(table(spark, "documents"), labels)
    assert scored.count() == 10_000
    held = scored.filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.9
    assert held[held.quality == 1].predicted.mean() > 0.95 and held[held.quality == 0].predicted.mean() < 0.35


def test_quality_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (8, None, None), (None, 1, 0), (7, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {(r.doc_id, r.held_out) for r in got} == {
        (i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, *_ in AWKWARD}
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty(spark), labels).count() == 0
    assert quality.drop_low_quality(docs, labels.limit(0)).columns == docs.columns
    assert quality.drop_low_quality(docs, labels.limit(0)).count() == len(AWKWARD)


def test_additive_model_finds_an_interaction():
    x = np.random.default_rng(1).random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_language_on_held_out_rows(spark):
    scored = language_id.language_id(table(spark, "documents"))
    both = scored.join(table(spark, "documents").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert (both.lang == both.lang_pred).mean() > 0.98 and both.score.between(0, 1).all()


def test_language_awkward(spark):
    got = language_id.language_id(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    texts = dict((i, t) for i, t, *_ in AWKWARD if i is not None)
    for r in got:
        letters = r.doc_id is None or any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language_id.language_id(empty(spark)).count() == 0


def test_gram_counts_in_slices(monkeypatch):
    text = "Ab, abc ab! ÉÉ 你好" * 9
    whole = language_id.gram_counts(language_id.codes(text))
    points = language_id.codes(text).tolist()
    plain = {}
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            part = points[i:i + n]
            if (n == 1 and part[0] == 1) or (n == 3 and part[1] == 1):
                continue
            key = sum(c << (21 * k) for k, c in enumerate(part))
            plain[key] = plain.get(key, 0) + 1
    assert dict(zip(*map(np.ndarray.tolist, whole))) == plain
    monkeypatch.setattr(language_id, "SLICE", 7)
    sliced = language_id.gram_counts(language_id.codes(text))
    assert all((a == b).all() for a, b in zip(whole, sliced))


BASE = [("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|"""
                              r"""(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
         lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def secret_rows():
    rng = random.Random(3)
    keys = ["password: hunter22", "API_KEY='abc.def-1'", "token=abc", "secret: token: abcdefgh", "AKIA" + "Z9" * 8, "AKIA123",
            "é\U0001F600 " + "0a" * 12, "f" * 23, "passwd = \"x+/=yz9\"", "AKIAAKIA" + "0" * 15]
    texts = [" ".join(rng.choices([*keys, "plain", "words", "\n"], k=12)) for _ in range(60)]
    return [(100 + i, t, "en", "a", 1) for i, t in enumerate(texts)]


def test_base_spans_equal_a_plain_scan(spark):
    rows = [*AWKWARD, *secret_rows()]
    got = secrets.span_digests(secrets.scan_secrets(frame(spark, rows).repartition(4))).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows if i is not None}
    for r in got:
        spans = base_spans(texts.get(r.doc_id, "")) if r.doc_id is not None else []
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == spans
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))
    assert secrets.scan_secrets(empty(spark)).count() == 0


def test_base_spans_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in secrets.span_digests(secrets.scan_secrets(docs)).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(base_spans(texts[r.doc_id])).encode()).hexdigest()


def test_random_strings_are_told_from_words(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secret = ["".join(rng.choices(alphabet, k=44)) for _ in range(60)]
    dull = ["section-" + "-".join(["chapter", "one", "two", "part", "page"]) + f"-{i}" for i in range(60)]
    rows = [(i, f"see {w} here", "en", "a", 1) for i, w in enumerate(secret + dull)]
    found = {r.doc_id: r.spans for r in secrets.span_digests(secrets.scan_secrets(frame(spark, rows))).collect()}
    assert sum("random:4:48" in found[i] for i in range(60)) >= 54
    assert sum("random" in found[i] for i in range(60, 120)) <= 6


def test_random_strings_are_found_where_other_text_is_glued_to_them(spark):
    rng = random.Random(6)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = [upper + upper.lower() + "0123456789", upper + "234567", upper + upper.lower() + "0123456789+/"]
    before = ["aws_secret_access_key=", "CLIENT_KEY=", "some/host/path/with/words/", "https://host/path-of-many-words_", "0123456789abcdef01234567-"]
    rows, tokens = [], []
    for i in range(90):
        tokens.append("".join(rng.choices(alphabets[i % 3], k=(20, 32, 40)[i % 3])))
        rows.append((i, f"see {before[i % 5]}{tokens[i]} here", "en", "a", 1))
    letters = ["".join(rng.choices(upper + upper.lower(), k=40)) for _ in range(20)]
    dull = ["some/host/path/with/words/and/more/words/in/it", "CLIENT_NAME=section-chapter-one-two-part-page"] * 20
    rows += [(100 + i, f"see {w}", "en", "a", 1) for i, w in enumerate(letters + dull)]
    found = {r.doc_id: r.spans for r in scanned(spark, rows)}
    assert sum(any(s.kind == "random" and s.start <= 4 + len(before[i % 5]) and s.stop >= 4 + len(before[i % 5]) + len(tokens[i]) for s in found[i])
               for i in range(90)) >= 72
    assert sum(any(s.kind == "random" for s in found[100 + i]) for i in range(20)) >= 15
    assert sum(any(s.kind == "random" for s in found[120 + i]) for i in range(40)) <= 4


def scanned(spark, rows):
    return secrets.scan_secrets(frame(spark, rows)).collect()


@pytest.mark.parametrize("text", ["0123456789abcdef" * 4, "aaaaaaaaaaaaaaaaaaaa1"])
def test_p_values_are_probabilities(spark, text):
    from pyspark.sql import functions as F

    rows = secrets.with_numbers(spark.range(1).select(F.lit(text).alias("t")), "t")
    p = rows.select(secrets.randomness("numbers", "base").alias("p")).first().p
    assert 0 <= p <= 1
