"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are cut into quantile bins. Boosting goes round the features;
each turn fits a tree of three leaves to one feature's gradient histogram and adds it to
that feature's lookup table. Then the pairs whose joint bins explain most of what is left
get tables of their own, boosted the same way with four leaves. A score is the intercept
plus one table entry per feature and pair, through the logistic function.

The model is fitted on at most ``FIT_ROWS`` labelled rows (those with the smallest hash of
doc_id); features and scores cover every document.

Nulls and edges: a null text counts as empty; an empty text has all features 0 and gets a
score like any other; null labels teach nothing; every label row of a document counts;
without labels every score is 0.5, with one class it is near that class; texts are read
whole; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripwright.llm.common import by_shuffle, doc_remainder, pick, place, positional
from tripwright.storage import materialize

FEATURES = ("log_words", "mean_word", "distinct_words", "top_word", "symbols", "capitals", "digits", "stops",
            "calls", "distinct_lines", "line_words", "echoes", "odd_words")
SYMBOLS = "#$%&*@^~|<>{}[]=+_\\/"
FIT_ROWS = 40_000
BINS, COARSE, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SHRINK = 200, 80, 0.1, 5.0
THRESHOLD = 0.3


def features(text: str | None) -> list[float]:
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, count = len(text), Counter(words)
    lines = text.split("\n")
    letters = sum(map(len, words))
    capitals = letters - sum(map(len, text.translate(_NO_CAPITALS).split()))
    return [
        float(np.log1p(len(words))), letters / len(words), len(count) / len(words), max(count.values()) / len(words),
        sum(map(text.count, SYMBOLS)) / n, capitals / letters, sum(map(text.count, "0123456789")) / n,
        sum(map(text.count, ".,;:?")) / len(words), text.count("!") / len(words), len(set(lines)) / len(lines),
        float(np.log1p(len(words) / len(lines))), sum(map(str.__eq__, words, words[1:])) / len(words),
        sum(k for w, k in count.items() if not w[-1].isalnum() and w[-1] not in ".,;:?!") / len(words),
    ]


_NO_CAPITALS = {c: None for c in range(65, 91)} | {c: None for c in range(0xC0, 0xDF) if c != 0xD7}


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        for table, b in zip(self.tables, bins):
            total += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse(bins[i], self.edges[i]), coarse(bins[j], self.edges[j])]
        return 1 / (1 + np.exp(-total))


def coarse(bins: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return bins * COARSE // (len(edges) + 1)


def gain(g, h):
    return g * g / (h + SHRINK)


def split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best cut of a histogram in two (left has the first bins) and what it gains."""
    if len(g) < 2:
        return 0, 0.0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = gain(left_g, left_h) + gain(g.sum() - left_g, h.sum() - left_h) - gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return at + 1, float(gains[at])


def leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + SHRINK))


def three_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with two cuts."""
    first, _ = split(g, h)
    (a, gain_a), (b, gain_b) = split(g[:first], h[:first]), split(g[first:], h[first:])
    cuts = sorted({0, first, a if gain_a >= gain_b else first + b, len(g)})
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = leaf(g[lo:hi], h[lo:hi])
    return out


def four_leaves(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of a tree that cuts one axis, then each side along the other."""
    best, best_gain = np.zeros(g.shape), 0.0
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(gg)):
            out, total = np.zeros(gg.shape), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                at, won = split(sg, sh)
                total += won + gain(sg.sum(), sh.sum())
                out[rows, :at], out[rows, at:] = leaf(sg[:at], sh[:at]), leaf(sg[at:], sh[at:])
            if total - gain(g.sum(), h.sum()) > best_gain:
                best, best_gain = (out if axis == 0 else out.T), total - gain(g.sum(), h.sum())
    return best, best_gain


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost the lookup tables on (rows, features) and 0/1 labels."""
    if len(y) == 0:
        return AdditiveModel()
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(prior / (1 - prior))))
    if y.min() == y.max():
        return model
    grid = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], grid)) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def histogram(where, n):
        p = 1 / (1 + np.exp(-total))
        return np.bincount(where, y - p, n), np.bincount(where, p * (1 - p), n)

    for _ in range(ROUNDS):
        for table, b in zip(model.tables, bins):
            step = RATE * three_leaves(*histogram(b, len(table)))
            table += step
            total += step[b]
    cells = [coarse(b, e) for b, e in zip(bins, model.edges)]
    ranked = []
    for i, j in combinations(range(x.shape[1]), 2):
        g, h = histogram(cells[i] * COARSE + cells[j], COARSE * COARSE)
        ranked.append((-four_leaves(g.reshape(COARSE, COARSE), h.reshape(COARSE, COARSE))[1], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(ranked)[:PAIRS]]
    model.pair_tables = [np.zeros((COARSE, COARSE)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = histogram(cells[i] * COARSE + cells[j], COARSE * COARSE)
            step = RATE * four_leaves(g.reshape(COARSE, COARSE), h.reshape(COARSE, COARSE))[0]
            table += step
            total += step[cells[i], cells[j]]
    return model


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every document, written once: the only pass for learning."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return materialize(rows.mapInArrow(measure, "doc_id long, x array<double>"), "features")


def learn(measured: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0,
          fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Fit on the labelled rows outside the held-out fold, ``fit_rows`` at most."""
    marked = pick(labels, "doc_id", "quality").filter("quality is not null and doc_id is not null")
    rows = (measured.filter(doc_remainder(modulus) != held_out).join(by_shuffle(marked), "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(fit_rows).select("x", "quality").collect())
    x = np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r.quality > 0) for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (1 from ``threshold`` on)."""
    measured = feature_rows(docs)
    model = learn(measured, labels, modulus, held_out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = measured.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (doc_remainder(modulus) == held_out).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with the columns of ``docs``; no shuffle."""
    model = learn(feature_rows(docs), labels)
    flat = positional(docs)
    text = flat.columns.index(place(docs, "text"))

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(text)], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return flat.mapInArrow(accept, flat.schema).toDF(*docs.columns)
