"""Language identification by rank-order profiles of character n-grams.

Learning counts the 1- to 3-grams of all training texts per language and keeps each
language's ``profile_size`` most frequent as its profile, in rank order. A document's own
``document_size`` most frequent n-grams are compared with each profile by out-of-place
distance: the difference of ranks, or ``profile_size`` where the profile lacks the n-gram.
Texts are lower-cased; a run of non-letters is one word boundary.

Nulls and edges: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if nothing could be learned; ties go to the smaller language name, ties of
n-gram counts to the smaller n-gram; a null doc_id counts as the empty text in the split; texts
of any length are counted whole, in slices; repeated rows each get a row; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tripwright.llm.common import doc_remainder, pick

PROFILE_SIZE, DOCUMENT_SIZE = 400, 300
NO_LANGUAGE = "und"
BOUNDARY = 1
SLICE = 1 << 18
HELD = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters as one boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(letters()[points], points, BOUNDARY)
    points = np.concatenate(([BOUNDARY], points, [BOUNDARY]))
    return points[np.concatenate(([True], (points[1:] != BOUNDARY) | (points[:-1] != BOUNDARY)))]


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, counts, len(distinct)).astype(np.int64)


def gram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as numbers of 21 bits a place, and their counts."""
    found = []
    for start in range(0, len(points), SLICE):
        part = points[start:start + SLICE + 2]
        own = len(part) - 2 if start + SLICE < len(points) else len(part)
        one, two = part[:own], part[:own][: len(part) - 1] + (part[1:own + 1] << 21)
        three = two[: len(part) - 2] + (part[2:own + 2] << 42)
        inner = part[1:len(three) + 1] != BOUNDARY
        found.append(np.unique(np.concatenate((one[one != BOUNDARY], two, three[inner])), return_counts=True))
    if len(found) == 1:
        return found[0]
    return merge(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """The most frequent n-grams of each language over all rows of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                parts = held.setdefault(lang.as_py(), [])
                parts.append(gram_counts(codes(text.as_py())))
                if sum(len(k) for k, _ in parts[1:]) > HELD:
                    parts[:] = [merge(*(np.concatenate(x) for x in zip(*parts)))]
        for lang, parts in held.items():
            keys, counts = merge(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    rows = pick(docs, "text", "lang").filter("text is not null and lang is not null")
    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    profiles: dict[str, np.ndarray] = {}
    for row in top.orderBy("lang", "place").collect():  # ``size`` rows for each language
        profiles.setdefault(row.lang, []).append(row.gram)
    return {lang: np.array(grams, np.int64) for lang, grams in profiles.items()}


def rank_table(profiles: dict[str, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the profiles, and their rank in each language; the last column: none."""
    grams = np.unique(np.concatenate(list(profiles.values()))) if profiles else np.zeros(0, np.int64)
    ranks = np.full((len(profiles), len(grams) + 1), -1, np.int64)
    for i, own in enumerate(profiles.values()):
        ranks[i, np.searchsorted(grams, own)] = np.arange(len(own))
    return grams, ranks


def classify(text: str | None, names: list[str], grams: np.ndarray, ranks: np.ndarray,
             size: int, document_size: int) -> tuple[str, float]:
    points = codes(text or "")
    if not names or len(points) <= 1:
        return NO_LANGUAGE, 0.0
    keys, counts = gram_counts(points)
    keys = keys[np.lexsort((keys, -counts))[:document_size]]
    at = np.searchsorted(grams, keys)
    at[(at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] != keys)] = len(grams)
    known = ranks[:, at]
    distance = np.where(known < 0, size, np.abs(known - np.arange(len(keys)))).sum(axis=1)
    best = int(np.argmin(distance))
    return names[best], float(1 - distance[best] / (size * len(keys)))


def identify_languages(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE_SIZE,
                       document_size: int = DOCUMENT_SIZE) -> DataFrame:
    """Per document: doc_id, lang_pred and score (1: the ranks agree, 0: no n-gram in common)."""
    names = sorted(profiles)
    grams, ranks = rank_table({n: profiles[n] for n in names}, size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(t.as_py(), names, grams, ranks, size, document_size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """Learn from the documents outside one fold and predict every document."""
    rows = pick(docs, "doc_id", "text", "lang")
    profiles = learn_profiles(rows.filter(doc_remainder(modulus) != held_out))
    scored = identify_languages(rows, profiles)
    return scored.select("doc_id", (doc_remainder(modulus) == held_out).alias("held_out"), "lang_pred", "score")
