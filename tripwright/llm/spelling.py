"""Spelling variants: one-edit neighbours of a corpus vocabulary by finite-state composition.

Runs of letters are counted over whole texts (partial counts leave each task). The
vocabulary V is then composed with a transducer E that copies and edits at most once, and
with V again: an accepted pair of V o E o V is a pair of words that differ by one inserted,
deleted or replaced code point.

Partitions by initial state: as long as nothing is edited, both sides of the composition
stand in one state of V, reached by the common prefix. A pair is therefore dealt by a
window of the shorter word's places: all in front of the window and all behind it is shared
by both words and is the key, the edit lies inside. At first each word has two windows
(its halves); a key with more than ``group_words`` words has its windows halved again, down
to a single place, where a group is bounded by the alphabet. Every pair is accepted in one
window only, the one that holds the end of its common prefix. Inside a task the groups'
inner strings form one minimised acceptor with an initial state for each group, and the
composition's accepted pairs are enumerated from these.

Nulls and edges: a null text has no runs; a null doc_id is hashed as the empty text; texts
and words of any length are read whole; repeated rows count as often as they occur; ties
in n go to the smaller word in code-point order; an empty table gives no rows; other columns are
ignored.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tripwright.llm.common import pick, text_or_empty, utf8_slices
from tripwright.storage import materialize

MIN_LENGTH, MIN_COUNT, DELETE_ONE_IN, RATIO = 6, 5, 199, 5
GROUP_WORDS, TASK_WORDS = 4_000, 20_000
BATCH_BYTES, HELD_WORDS = 4 << 20, 200_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# ---- vocabulary ---------------------------------------------------------------

def without_point(run: str, doc_id: int | None, one_in: int) -> str:
    """The run, or the run less one code point where the hash of document and run says so."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % one_in else run[:h % len(run)] + run[h % len(run) + 1:]


def vocabulary(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, one_in: int = DELETE_ONE_IN) -> DataFrame:
    """(word, n) of every word of the corpus that is long and frequent enough, written once."""
    # a shorter run can't become long enough, so only runs of this length are looked at
    run = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in source:
            for a, b in utf8_slices(pc.binary_length(batch.column(1)).to_pylist(), BATCH_BYTES):
                for doc_id, text in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b]):
                    lowered = text.as_buffer().to_pybytes().translate(LOWER).decode()
                    for word, n in Counter(run.findall(lowered)).items():
                        held[without_point(word, doc_id, one_in)] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").filter(F.length("word") >= min_length)
    return materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "vocabulary")


# ---- windows ------------------------------------------------------------------

def window_key() -> Column:
    """What is shared outside of the window ``low`` <= place < ``high`` of a shorter word of length ``size``."""
    behind = F.greatest(F.col("size") - F.col("high"), F.lit(0))
    return F.xxhash64("size", "low", "high", F.expr("substring(word, 1, low)"), F.when(behind > 0, F.right("word", behind)).otherwise(""))


def windows(words: DataFrame, *, min_length: int = MIN_LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n, size, low, high, key) of all groups that can hold a pair, each of bounded size."""
    size = F.explode(F.expr(f"filter(array(length(word), length(word) - 1), s -> s >= {min_length} - 1)")).alias("size")
    open_rows = words.select("word", "n", size)
    half = F.expr("(size + 1) div 2").cast("int")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("low"), half.alias("high")),
                               F.struct(half.alias("low"), (F.col("size") + 1).alias("high"))))
    open_rows = open_rows.select("word", "n", "size", halves.alias("w")).select("word", "n", "size", "w.low", "w.high")
    settled = None
    while True:
        rows = materialize(open_rows.withColumn("key", window_key()), "spelling-windows")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.length("word") == F.col("size")).alias("shorter"))
        sized = rows.join(sizes.filter("members > 1 AND shorter > 0"), "key")
        large = (F.col("members") > group_words) & (F.col("high") - F.col("low") > 1)
        fine = sized.filter(~large).select(*rows.columns)
        settled = fine if settled is None else settled.unionByName(fine)
        middle = F.expr("(low + high) div 2").cast("int")
        open_rows = sized.filter(large).select("word", "n", "size", F.explode(F.array(
            F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))).alias("w"))
        open_rows = open_rows.select("word", "n", "size", "w.low", "w.high")
        if open_rows.isEmpty():
            return settled


# ---- automata -----------------------------------------------------------------

class Acceptor:
    """A minimised acceptor of several word lists: equal right languages are one state."""

    def __init__(self):
        self.states: list[tuple[bool, dict[str, int]]] = []
        self._known: dict[tuple, int] = {}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        signature = (final, tuple(arcs.items()))
        if signature not in self._known:
            self._known[signature] = len(self.states)
            self.states.append((final, arcs))
        return self._known[signature]

    def add(self, words: list[str]) -> int:
        """The initial state of a list of sorted distinct words; states freeze from the end of a word on."""
        path: list[list] = [[False, {}]]  # open states along the last word
        last = ""

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1][last[len(path) - 1]] = self._state(final, arcs)

        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            freeze(shared)
            path.extend([False, {}] for _ in word[shared:])
            path[-1][0] = True
            last = word
        freeze(0)
        return self._state(*path[0])

    def common(self, x: int, y: int) -> Iterator[str]:
        """Words accepted from both states, step by step along shared labels."""
        level = [(x, y, "")]
        while level:
            onward = []
            for p, q, word in level:
                (final_p, arcs_p), (final_q, arcs_q) = self.states[p], self.states[q]
                if final_p and final_q:
                    yield word
                if len(arcs_q) < len(arcs_p):
                    arcs_p, arcs_q = arcs_q, arcs_p
                onward += [(to, arcs_q[label], word + label) for label, to in arcs_p.items() if label in arcs_q]
            level = onward

    def one_edit(self, initial: int, places: int) -> Iterator[tuple[str, str]]:
        """Accepted pairs of V o E o V whose edit lies in the first ``places`` places.

        Before the edit both sides stand in one state. Replacing reads two labels, inserting
        one on one side only; behind the edit both read the same. An insertion that could
        as well come later is left to the later place. The shorter word comes first.
        """
        level = [(initial, "")]
        for _ in range(places):
            onward = []
            for state, prefix in level:
                arcs = self.states[state][1]
                for (a, to_a), (b, to_b) in combinations(arcs.items(), 2):
                    yield from ((prefix + a + rest, prefix + b + rest) for rest in self.common(to_a, to_b))
                for a, to in arcs.items():
                    yield from ((prefix + rest, prefix + a + rest) for rest in self.common(to, state) if rest[:1] != a)
                onward += [(to, prefix + a) for a, to in arcs.items()]
            level = onward


def group_pairs(acceptor: Acceptor, words: list[str], size: int, low: int, high: int) -> Iterator[tuple[str, str]]:
    """Near pairs of one group; pairs of two longer words belong to the groups of their own length."""
    behind = max(size - high, 0)
    head, tail = words[0][:low], words[0][len(words[0]) - behind:]
    inner = sorted({w[low:len(w) - behind] for w in words if w[:low] == head and w[len(w) - behind:] == tail})
    for short, other in acceptor.one_edit(acceptor.add(inner), high - low):
        if len(short) == size - low - behind:
            yield head + short + tail, head + other + tail


def near_words(words: DataFrame, *, min_length: int = MIN_LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best): how many near words, and the most frequent as (-n, word)."""
    rows = materialize(windows(words, min_length=min_length, group_words=group_words), "spelling-groups")
    tasks = max(1, -(-rows.count() // TASK_WORDS))

    def enumerate_pairs(part: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(part["word"], part["n"]))
        acceptor, near, best = Acceptor(), Counter(), {}
        for (_, size, low, high), group in part.groupby(["key", "size", "low", "high"], sort=False):
            for pair in group_pairs(acceptor, group["word"].tolist(), size, low, high):
                for word, other in (pair, pair[::-1]):
                    near[word] += 1
                    best[word] = min(best.get(word, (0, "")), (-counts[other], other))
        return pd.DataFrame({"word": list(near), "n_near": list(near.values()), "minus": [best[w][0] for w in near],
                             "other": [best[w][1] for w in near]}).astype({"n_near": "int64", "minus": "int64"})

    dealt = rows.withColumn("_task", F.pmod("key", F.lit(tasks)))
    found = dealt.groupBy("_task").applyInPandas(enumerate_pairs, "word string, n_near long, minus long, other string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "other")).alias("best"))


# ---- forms --------------------------------------------------------------------

def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): the last form reached. Counts grow along forms, so there are no circles and
    paths are short; each round doubles the steps taken."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = materialize(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                       F.col("further").isNotNull().alias("moved")), "spelling-roots")
        roots = joined.drop("moved")
        if joined.filter("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, one_in: int = DELETE_ONE_IN,
                      ratio: int = RATIO, group_words: int = GROUP_WORDS) -> DataFrame:
    """Per word of the vocabulary: word, n, form, root, n_near, form_n."""
    if ratio <= 1:
        raise ValueError(f"ratio must be over 1, so that forms lead upwards: {ratio}")
    words = vocabulary(docs, min_length=min_length, min_count=min_count, one_in=one_in)
    near = near_words(words, min_length=min_length, group_words=group_words)
    is_form = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    formed = materialize(words.join(near, "word", "left").select(
        "word", "n", F.when(is_form, F.col("best.other")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    roots = roots_of(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
