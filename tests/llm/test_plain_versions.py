"""Quality, language and secrets against plain versions of their methods, and secrets' precision and recall."""
import base64
import math
import random
import statistics
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, awkward, frame
from tripwright.llm import language_id, quality, secrets

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


# ---- op4: rank-order profiles ---------------------------------------------------

def grams(text):
    """Counts of 1- to 3-grams; a run of non-letters is one boundary, written \\x01 here."""
    spelled = "\x01"
    for c in (text or "").lower():
        if c.isalpha():
            spelled += c
        elif spelled[-1] != "\x01":
            spelled += "\x01"
    spelled += "" if spelled[-1] == "\x01" else "\x01"
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(spelled) - n + 1):
            part = spelled[i:i + n]
            if part != "\x01" and not (n == 3 and part[1] == "\x01"):
                found[part] += 1
    return found


def ranked(counts, size):
    """The most frequent first; of equals the one whose third place is smallest, then the second, then the first."""
    return sorted(counts, key=lambda g: (-counts[g], *(ord(c) for c in reversed(g.ljust(3, "\0")))))[:size]


def plain_languages(rows, size=400, document_size=300):
    """(doc_id, held_out, lang, score) by looking up every n-gram's place in every profile."""
    counts = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if remainder(doc_id, 4) != 2 and lang is not None and text is not None:
            counts[lang].update(grams(text))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c, size))} for lang, c in counts.items()}
    out = []
    for doc_id, text, _ in rows:
        own = ranked(grams(text), document_size)
        if not profiles or not any(c.isalpha() for c in (text or "").lower()):
            out.append((doc_id, remainder(doc_id, 4) == 2, "und", 0.0))
            continue
        far = {lang: sum(abs(places[g] - i) if g in places else size for i, g in enumerate(own)) for lang, places in profiles.items()}
        best = min(sorted(far), key=far.get)
        out.append((doc_id, remainder(doc_id, 4) == 2, best, 1 - far[best] / (size * len(own))))
    return out


@pytest.mark.parametrize("source", ["documents", "awkward"])
def test_languages_equal_a_plain_version(spark, source):
    docs = documents(spark) if source == "documents" else awkward(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] if source == "documents" else [r[:3] for r in AWKWARD]
    want = plain_languages(rows)
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in language_id.language_id(docs).collect()]
    assert [r[:3] for r in sorted(got, key=repr)] == [r[:3] for r in sorted(want, key=repr)]
    assert sorted(r[3] for r in got) == pytest.approx(sorted(r[3] for r in want))


# ---- op2: additive model --------------------------------------------------------

def plain_features(text):
    words = (text or "").split()
    if not words:
        return [0.0] * 13
    lines, letters = text.split("\n"), "".join(words)
    capitals = [c for c in letters if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×")]
    odd = [w for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?!"]

    def share(of, whole):
        return sum(c in of for c in text) / whole
    return [math.log(1 + len(words)), len(letters) / len(words), len(set(words)) / len(words), max(words.count(w) for w in set(words)) / len(words),
            share("#$%&*@^~|<>{}[]=+_\\/", len(text)), len(capitals) / len(letters), share("0123456789", len(text)), share(".,;:?", len(words)),
            share("!", len(words)), len(set(lines)) / len(lines), math.log(1 + len(words) / len(lines)),
            sum(a == b for a, b in zip(words, words[1:])) / len(words), len(odd) / len(words)]


def test_features_equal_a_plain_version(spark):
    texts = [r.text for r in documents(spark).select("text").collect()] + [t for _, t, *_ in AWKWARD if t is None or len(t) < 9000]
    assert len(texts) > 100
    for text in texts:
        assert quality.features(text) == pytest.approx(plain_features(text))


def best_cut(g, h):
    """The first cut of largest gain, trying each."""
    def value(a, b):
        return sum(g[a:b]) ** 2 / (sum(h[a:b]) + 5.0)
    return max(range(1, len(g)), key=lambda c: value(0, c) + value(c, len(g)))


def test_trees_and_tables_equal_plain_ones():
    rng = np.random.default_rng(4)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        first = best_cut(list(g), list(h))
        assert quality.split(g, h)[0] == first
        values = quality.three_leaves(g, h)
        edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), 9]
        assert first in edges and len(edges) <= 4
        for a, b in zip(edges, edges[1:]):
            assert values[a] == pytest.approx(sum(g[a:b]) / (sum(h[a:b]) + 5.0))


def test_scores_are_lookups_one_row_at_a_time(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    quality_of = {r.doc_id: r.quality for r in labels.filter("quality is not null").collect()}
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    learned = sorted(i for i in texts if i in quality_of and remainder(i, 5) != 0)
    x = np.array([plain_features(texts[i]) for i in learned])
    scored = quality.score_quality(documents(spark), labels).collect()
    # the fit sees the same rows in another order, so sums differ by rounding only
    model = quality.fit(x, np.array([float(quality_of[i] > 0) for i in learned]))
    wrong = 0
    for r in scored:
        own, total = plain_features(texts[r.doc_id]), model.intercept
        bins = [sum(v >= e for e in edges) for v, edges in zip(own, model.edges)]
        total += sum(table[b] for table, b in zip(model.tables, bins))
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += table[bins[i] * 8 // (len(model.edges[i]) + 1), bins[j] * 8 // (len(model.edges[j]) + 1)]
        p = 1 / (1 + math.exp(-total))
        wrong += abs(p - r.score) > 1e-6
        assert r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.3)
    assert len(scored) == len(texts) and wrong <= 0.02 * len(scored)


# ---- op6: randomness battery ----------------------------------------------------

def tail(z):
    z = min(abs(z), 12.0)
    return 2 / (1 + math.exp(1.5976 * z + 0.070566 * z ** 3))


def plain_battery(token):
    """Chi-squared uniformity, runs and serial correlation of a string in its inferred alphabet, combined by Fisher's sum."""
    bare = token.rstrip("=")
    if all(c in "0123456789abcdef" for c in bare) or all(c in "0123456789ABCDEF" for c in bare):
        bare, alphabet = bare.lower(), "0123456789abcdef"
    elif all(c in secrets.BASE32 for c in bare):
        alphabet = secrets.BASE32
    elif all(c in secrets.ALNUM for c in bare):
        alphabet = secrets.ALNUM
    else:
        bare, alphabet = bare.replace("-", "+").replace("_", "/"), secrets.BASE64
    v, k, n = [alphabet.index(c) for c in bare], len(alphabet), len(bare)
    chi = sum((v.count(s) - n / k) ** 2 / (n / k) for s in range(k))
    uniform = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    turns = sum((a < k / 2) != (b < k / 2) for a, b in zip(v, v[1:]))
    serial = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(v, v[1:])) / ((k * k - 1) / 12) / math.sqrt(n - 1)
    half = -sum(math.log(tail(z)) for z in (uniform, (turns - (n - 1) / 2) / math.sqrt((n - 1) / 4), serial))
    return math.exp(-half) * (1 + half + half ** 2 / 2)


def test_battery_equals_a_plain_version(spark):
    rng = random.Random(8)
    tokens = ["".join(rng.choices(alphabet, k=n)) for alphabet in (secrets.BASE16, secrets.BASE16.upper(), secrets.BASE32, secrets.ALNUM, secrets.BASE64, secrets.ALNUM + "-_")
              for n in (20, 33, 64, 200)]
    tokens += ["a" * 20 + "1", "chapterOneOfTheLongBook", "Zm9vYmFyZm9vYmFyZm9v==", "0123456789abcdef" * 3]
    rows = secrets.with_numbers(spark.createDataFrame([(t,) for t in tokens], "t string"), "t")
    got = {r.t: r.p for r in rows.select("t", secrets.randomness("numbers", "base").alias("p")).collect()}
    for token in tokens:
        assert got[token] == pytest.approx(plain_battery(token), rel=1e-9, abs=1e-300)


def test_thresholds_equal_a_plain_discovery_control(spark):
    rng = random.Random(9)
    spans = [(3, c, min(secrets.BINS, int(rng.expovariate(0.1) if rng.random() < 0.5 else rng.expovariate(0.004)))) for c in (0, 0, 1, 2) for _ in range(150)]
    df = spark.createDataFrame(spans, "kind int, length_class int, bin int")
    got = {r.length_class: r.dismissed_from for r in secrets.dismissal_bins(df).collect()}
    want = {}
    for c in {s[1] for s in spans}:
        ordered = sorted((math.exp(-b / secrets.BINS_PER_UNIT), b) for _, k, b in spans if k == c)
        passing = [b for i, (p, b) in enumerate(ordered) if p <= secrets.RATE * max(j + 1 for j, (q, _) in enumerate(ordered) if q == p) / len(ordered)]
        if passing:
            want[c] = min(passing)
    assert got == want


def planted(rng):
    """(text, is a secret, class of length) of secrets and of what only looks like them."""
    out = []
    for n, name in ((24, 0), (40, 1), (56, 2), (80, 3)):
        for _ in range(60):
            out.append(("".join(rng.choices(rng.choice([secrets.ALNUM, secrets.BASE64]), k=n - 1)) + "a", True, name))
        words = ["request", "Handler", "Factory", "chapter", "Section", "Window", "index", "Service", "Builder", "table", "Order", "Client"]
        for i in range(60):
            if i % 3 == 0:
                text = "".join(rng.choices(words, k=n // 6 + 1))[:n]
            elif i % 3 == 1:
                text = "/".join(rng.choices(words, k=n // 7 + 1)).lower()[:n].rstrip("/") + "s"
            else:
                text = base64.b64encode(" ".join(rng.choices(words, k=n)).encode()).decode()[:n]
            out.append((text, False, name))
    return out


def test_precision_and_recall_on_planted_secrets(spark):
    cases = planted(random.Random(12))
    found = secrets.scan_secrets(frame(spark, [(i, f"see {t} there", "en", "a", 1) for i, (t, *_) in enumerate(cases)])).collect()
    told = {r.doc_id: any(s.kind == "random" for s in r.spans) for r in found}
    figures = {}
    for name in range(4):
        own = [(told[i], secret) for i, (_, secret, c) in enumerate(cases) if c == name]
        hit = sum(t and s for t, s in own)
        figures[name] = (hit / max(1, sum(t for t, _ in own)), hit / sum(s for _, s in own))
    print("precision and recall by class of length", {k: tuple(round(x, 2) for x in v) for k, v in figures.items()})
    assert all(recall >= 0.85 for _, recall in figures.values())
    assert figures[0][0] >= 0.6 and all(figures[k][0] >= 0.75 for k in (1, 2, 3))
    assert statistics.mean(p for p, _ in figures.values()) >= 0.8
    ids = [str(uuid.UUID(int=random.Random(i).getrandbits(128))) for i in range(20)]
    assert secrets.scan_secrets(frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(ids)])).filter(F.exists("spans", lambda s: s["kind"] != "random")).count() == 0
