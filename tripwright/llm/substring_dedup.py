"""Substring deduplication by prefix-partitioned suffix trees over words.

Every place where ``window`` words follow one another starts a suffix. Suffixes are split by
prefixes of variable length: by one word where that is rare enough, by two, three and so on
where it is not, until what shares a prefix fits a memory-sized group. Inside a group the
suffixes are sorted, and the tree over them is cut at the depth of the window: a node at
that depth is a run of suffixes with equal words, and its leaves are the window's
occurrences. A node with leaves in several documents is a repeat; where windows that follow
one another repeat, their spans join to maximal repeats. Of each repeat the smallest doc_id
keeps its words, the others lose theirs.

A batch of documents settles windows that repeat inside it and sends on only those of each
window's smallest document there, so that a passage found everywhere counts once per batch,
not once per document. Suffixes travel as 64-bit codes of their words, sorted and packed
per group; the group's prefix adds its own bits, so that more groups also mean longer codes.
Results return to their batch as window numbers. Prefix lengths and the number of groups
come from a bounded sample of suffixes and only decide how evenly groups are filled.

The documents must read the same twice (a table, not a random sample), as a lost batch is
packed again from its input.

Nulls and edges: a null or empty text has no words; texts with fewer words than the window
lose none; a null doc_id counts as the largest; rows that share a doc_id do not take words
from each other, nor do windows that only repeat inside one document; an empty table gives
no rows; other columns are ignored; texts are read whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tripwright.llm.common import multipliers, pick, text_mark, text_or_empty, utf8_slices, word_codes

WINDOW = 13
BATCH_BYTES = 4 << 20
GROUP_SUFFIXES = 1_500_000
SAMPLE_DOCUMENTS, SAMPLE_SUFFIXES = 4000, 48
LAST_ID = 2 ** 63 - 1

SUFFIXES, BATCH = 0, 1  # what a packed row holds
PACKED = "kind int, part long, batch long, n long, codes binary, places binary, ids binary, offsets binary, marks binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def packed(values: np.ndarray, kind: type) -> bytes:
    """The numbers byte by byte: first all lowest bytes, last all highest, which are mostly 0."""
    raw = np.ascontiguousarray(values.astype(kind))
    return raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


class Prefixes:
    """Which prefixes are too frequent for one group, by length, and the number of groups."""

    def __init__(self, frequent: list[np.ndarray], groups: int, window: int):
        self.frequent, self.groups = frequent, groups
        self.factors = multipliers(window, 2)

    def parts(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The group of each suffix: its shortest prefix that is not too frequent."""
        prefix = mixed(codes[starts] * self.factors[0])
        final, open_ = prefix.copy(), np.arange(len(starts))
        for length, frequent in enumerate(self.frequent, 1):
            if not len(frequent) or not len(open_):
                break
            at = np.searchsorted(frequent, prefix)
            longer = (at < len(frequent)) & (frequent[np.minimum(at, len(frequent) - 1)] == prefix)
            open_, prefix = open_[longer], prefix[longer]
            prefix = mixed(prefix + codes[starts[open_] + length] * self.factors[length])
            final[open_] = prefix
        return (final % np.uint64(self.groups)).astype(np.int64)

    @staticmethod
    def fit(sample: np.ndarray, suffixes: float, window: int, group_suffixes: int) -> "Prefixes":
        """``sample``: (n, window) word codes of suffixes; ``suffixes``: how many there are in all."""
        groups = max(1, int(np.ceil(suffixes / group_suffixes)))
        factors, frequent, rows = multipliers(window, 2), [], sample
        prefix = mixed(rows[:, 0] * factors[0]) if len(rows) else np.zeros(0, np.uint64)
        most = max(2.0, len(sample) * group_suffixes / max(suffixes, 1) / 4)
        for length in range(1, window):
            values, where, count = np.unique(prefix, return_inverse=True, return_counts=True)
            frequent.append(values[count > most])
            longer = (count > most)[where]
            rows = rows[longer]
            if not len(rows):
                break
            prefix = mixed(prefix[longer] + rows[:, length] * factors[length])
        return Prefixes(frequent, groups, window)


def batches_of(source: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[bytes]]]]:
    """(ids, marks, words) of documents in batches of about ``limit`` bytes, by growing id."""
    for batch in source:
        texts = batch.column(2)
        for a, b in utf8_slices(pc.binary_length(texts).to_pylist(), limit):
            ids, marks = batch.column(0).slice(a, b - a).to_numpy(), batch.column(1).slice(a, b - a).to_numpy()
            words = [t.as_buffer().to_pybytes().split() for t in texts.slice(a, b - a)]
            order = np.lexsort((marks, ids))
            yield ids[order], marks[order], [words[i] for i in order]


def suffix_starts(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers where a suffix starts, and each document's first suffix number."""
    counts = np.maximum(lengths - window + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    first_word = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.arange(offsets[-1]) + np.repeat(first_word - offsets[:-1], counts), offsets


def least_by_code(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by code, and in that order the smallest id among equal codes."""
    order = np.argsort(codes)
    heads = np.flatnonzero(np.concatenate(([True], codes[order][1:] != codes[order][:-1])))
    least = np.minimum.reduceat(ids[order], heads)
    return order, np.repeat(least, np.diff(np.append(heads, len(codes))))


def pack_suffixes(rows: DataFrame, prefixes: Prefixes, window: int, batch_bytes: int) -> DataFrame:
    """Packed suffixes per batch and group, and one row per batch that says whose they are."""
    names = [f.split()[0] for f in PACKED.split(", ")]
    factors = multipliers(window, 1)

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (ids, marks, words) in enumerate(batches_of(source, batch_bytes)):
            lengths = np.array([len(w) for w in words])
            starts, offsets = suffix_starts(lengths, window)
            if not len(starts):
                continue
            batch = task << 32 | number
            codes = word_codes([w for doc in words for w in doc])
            whole = sum((codes[starts + j] * factors[j] for j in range(window)), np.zeros(len(starts), np.uint64))
            owner = np.repeat(ids, np.diff(offsets))
            order, least = least_by_code(whole, owner)
            late = owner[order] > least  # a smaller document of this batch has the same window
            out = [(BATCH, batch % prefixes.groups, batch, len(ids), b"", packed(np.sort(order[late]), np.uint32),
                    ids.tobytes(), offsets.tobytes(), marks.tobytes())]
            order = order[~late]
            part = prefixes.parts(codes, starts[order])
            order, part = order[by := np.argsort(part, kind="stable")], part[by]
            for some in np.split(np.arange(len(order)), np.flatnonzero(np.diff(part)) + 1):
                if not len(some):
                    continue
                places = order[some]  # still sorted by code
                docs = np.unique(np.searchsorted(offsets, places, "right") - 1)
                out.append((SUFFIXES, int(part[some[0]]), batch, len(places), packed(steps(whole[places]), np.uint64),
                            packed(places, np.uint32), packed(steps(ids[docs]), np.int64), packed(steps(offsets[docs]), np.uint32), b""))
            for row in out:
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row)}, schema=SCHEMA)

    return rows.mapInArrow(pack, PACKED)


SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("batch", pa.int64()), ("n", pa.int64()),
                    *[(n, pa.binary()) for n in ("codes", "places", "ids", "offsets", "marks")]])


def search_tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The repeats of one group: places to remove, per batch. Rows about batches pass through."""
    passed, own = rows[rows["kind"] == BATCH], rows[rows["kind"] == SUFFIXES]
    if len(own):
        codes = [np.cumsum(unpacked(c, np.uint64), dtype=np.uint64) for c in own["codes"]]
        places = [unpacked(p, np.uint32) for p in own["places"]]
        ids = []
        for p, i, o in zip(places, own["ids"], own["offsets"]):
            docs = np.cumsum(unpacked(i, np.int64))
            ids.append(docs[np.searchsorted(np.cumsum(unpacked(o, np.uint32), dtype=np.int64), p, "right") - 1])
        batch, everywhere = np.repeat(np.arange(len(own)), [len(p) for p in places]), np.concatenate(ids)
        order, least = least_by_code(np.concatenate(codes), everywhere)
        late = np.sort(order[everywhere[order] > least])
        places, batch = np.concatenate(places)[late], batch[late]
        cuts = np.searchsorted(batch, np.arange(len(own) + 1))
        found = [packed(np.sort(places[a:b]), np.uint32) for a, b in zip(cuts, cuts[1:])]
        own = own.assign(n=0, codes=b"", places=found, ids=b"", offsets=b"", marks=b"")[np.diff(cuts) > 0]
    return pd.concat([passed, own])[rows.columns]


def join_spans(window: int):
    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Per document of one batch: the word spans to remove, as starts and stops."""
        about = rows[rows["kind"] == BATCH].iloc[0]
        ids, marks = np.frombuffer(about["ids"], np.int64), np.frombuffer(about["marks"], np.int64)
        offsets = np.frombuffer(about["offsets"], np.int64)
        places = np.sort(np.concatenate([unpacked(p, np.uint32) for p in rows["places"]]).astype(np.int64))
        owner = np.searchsorted(offsets, places, "right") - 1
        at = places - offsets[owner]
        fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + window)))[: len(at)]
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(at)) - 1
        doc = owner[heads]
        cuts = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)
        out = [(ids[doc[a]], marks[doc[a]], at[heads[a:b]], at[tails[a:b]] + window) for a, b in zip(cuts, [*cuts[1:], len(doc)])]
        return pd.DataFrame(out, columns=["id", "mark", "starts", "stops"])

    return joined


def numbered(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_mark().alias("mark"), text_or_empty().alias("text"))


def compressed(rows: DataFrame) -> DataFrame:
    """(id, mark, body): texts as they travel to meet their spans."""

    def press(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in source:
            bodies = [len(b := t.as_buffer()).to_bytes(8, "little") + codec.compress(b, asbytes=True) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], ["id", "mark", "body"])

    return rows.mapInArrow(press, "id long, mark long, body binary")


def expanded(body: bytes) -> bytes:
    return pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)


def fit_prefixes(rows: DataFrame, window: int, group_suffixes: int) -> Prefixes:
    """Cut lengths from ``SAMPLE_SUFFIXES`` suffixes of about ``SAMPLE_DOCUMENTS`` documents."""
    documents = rows.count()

    def sample(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for text in batch.column(0):
                codes = word_codes(text.as_buffer().to_pybytes().split())
                n = max(0, len(codes) - window + 1)
                starts = np.unique(np.linspace(0, n - 1, SAMPLE_SUFFIXES).astype(np.int64)) if n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"n": [n], "codes": [codes[starts[:, None] + np.arange(window)].tobytes()]},
                    schema=pa.schema([("n", pa.int64()), ("codes", pa.binary())]))

    share = min(1.0, SAMPLE_DOCUMENTS / max(documents, 1))
    picked = rows.select("text").sample(share, 5).mapInArrow(sample, "n long, codes binary").collect()
    codes = np.frombuffer(b"".join(bytes(r.codes) for r in picked), np.uint64).reshape(-1, window)
    total = sum(r.n for r in picked) * documents / max(len(picked), 1)
    return Prefixes.fit(codes, total, window, group_suffixes)


def repeated_spans(docs: DataFrame, window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES,
                   batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, mark, starts, stops): the maximal word spans that smaller documents also hold."""
    rows = numbered(docs)
    prefixes = fit_prefixes(rows, window, group_suffixes)
    suffixes = pack_suffixes(rows, prefixes, window, batch_bytes)
    found = suffixes.groupBy("part").applyInPandas(search_tree, PACKED)
    return found.groupBy("batch").applyInPandas(join_spans(window), "id long, mark long, starts array<int>, stops array<int>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES,
                   batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the kept words joined by spaces."""
    spans = repeated_spans(docs, window, group_suffixes, batch_bytes)
    # rows that agree in id and text have the same spans
    spans = spans.dropDuplicates(["id", "mark"])

    def keep(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n_words, n_removed, kept = [], [], []
            for body, starts, stops in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = expanded(body.as_py()).split()
                total = len(words)
                for a, b in zip(reversed(starts.as_py() or []), reversed(stops.as_py() or [])):
                    del words[a:b]
                n_words.append(total)
                n_removed.append(total - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept"])

    joined = compressed(numbered(docs)).join(spans, ["id", "mark"], "left").select("id", "body", "starts", "stops")
    done = joined.mapInArrow(keep, "id long, n_words long, n_removed long, kept string")
    return done.select(F.nullif("id", F.lit(LAST_ID)).alias("doc_id"), "n_words", "n_removed", "kept")
