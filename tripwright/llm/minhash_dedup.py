"""MinHash near-deduplication by an inverted join over signature coordinates.

A document's set is its distinct word shingles. Documents with equal sets form one class;
classes get a MinHash signature of ``COORDINATES`` values. Two sets as similar as asked agree
in at least T coordinates (T from the binomial distribution: one such pair in a million is
missed), so a class is posted only under its rarest coordinate-value pairs: values no other
class has cost nothing, and of the others all but T - 1 suffice (prefix). Inside a posting list
collisions are counted coordinate by coordinate, and pairs that can no longer reach T are
skipped. A list yields a spanning forest of its matches, not all pairs; long lists are cut
into blocks and meet block by block.

The components of these matches are families: every link lies inside one. Families are
confirmed on the full sets, again by blocks, and yield spanning forests of the true links,
whose components are the result. No link between different sets is lost but for the stated
miss of the signature; links between copies follow from their class.

Nulls and edges: A-Z count as a-z; a null or empty text, or one without words, has the empty
set and is linked with nothing; fewer words than a shingle are one shingle; a null doc_id
never names a component that has a number; a document is kept if its doc_id is its
component's; rows with equal doc_id and text count as copies; an empty table gives no rows;
other columns are ignored; texts are read whole.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tripwright.llm.common import apply_copies, by_shuffle, multipliers, pick, text_mark, text_or_empty, utf8_slices, word_codes
from tripwright.llm.components import components
from tripwright.storage import materialize

COORDINATES, MISS = 48, 1e-6
LIST_BLOCK, FAMILY_BLOCK = 1024, 512
GROUP_ROWS, GROUP_SHINGLES = 4_000, 500_000
BATCH_BYTES = 4 << 20
STRIPE = 4096
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WIDE = np.uint64(32)


def least_matches(coordinates: int, percent: int, miss: float = MISS) -> int:
    """Coordinates that a pair of ``percent`` similarity shares with probability 1 - miss."""
    j, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * j ** t * (1 - j) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def codes_of_texts(texts: list[bytes]) -> list[np.ndarray]:
    """Codes of each text's lower-cased words."""
    words = [t.translate(LOWER).split() for t in texts]
    codes = word_codes([w for doc in words for w in doc])
    return np.split(codes, np.cumsum([len(w) for w in words])[:-1])


def shingle_set(codes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle codes; fewer words than ``size`` are one shingle."""
    if not len(codes):
        return codes
    width = min(size, len(codes))
    factors = multipliers(size, 11)
    total = np.full(len(codes) - width + 1, width, np.uint64)
    for j in range(width):
        total += codes[j:len(codes) - width + 1 + j] * factors[j]
    total ^= total >> np.uint64(31)
    return np.unique(total * np.uint64(0xD6E8FEB86659FD93))


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    factors, shifts = multipliers(coordinates, 12), multipliers(coordinates, 13)
    best = np.full(coordinates, 2 ** 32 - 1, np.uint64)
    for a in range(0, len(shingles), STRIPE):
        best = np.minimum(best, ((shingles[a:a + STRIPE, None] * factors + shifts) >> WIDE).min(axis=0))
    return best.astype(np.uint32).view(np.int32)


def texts_in_batches(source: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in source:
        for a, b in utf8_slices(pc.binary_length(batch.column(column)).to_pylist(), BATCH_BYTES):
            part = batch.slice(a, b - a)
            yield part, [t.as_buffer().to_pybytes() for t in part.column(column)]


def sketches(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """(doc_id, mark, n, print, signature) of every document, written once."""

    def sketch(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in_batches(source, 2):
            sets = [shingle_set(c, size) for c in codes_of_texts(texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([signature(s, coordinates) for s in sets], pa.list_(pa.int32()))],
                ["doc_id", "mark", "n", "print", "signature"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), text_or_empty().alias("text"))
    return materialize(rows.mapInArrow(sketch, "doc_id long, mark long, n long, print binary, signature array<int>"), "sketches")


def classes_of(sketched: DataFrame) -> DataFrame:
    """One numbered row per distinct set: (node, print, n, signature, doc_id, mark)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))
    grouped = sketched.filter("n > 0").groupBy("print").agg(
        F.any_value("n").alias("n"), F.any_value("signature").alias("signature"), first.alias("first"))
    return materialize(grouped.select(F.monotonically_increasing_id().alias("node"), "print", "n", "signature", "first.doc_id", "first.mark"), "classes")


def postings(classes: DataFrame, least: int) -> DataFrame:
    """(key, node): every class under the rarest of its shared coordinate values, prefix only."""
    posted = classes.select("node", F.posexplode("signature").alias("at", "value")).select(
        "node", F.xxhash64("at", "value").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    lists = posted.join(by_shuffle(shared), "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("keys"))
    prefix = F.slice("keys", 1, F.size("keys") - (least - 1))
    return lists.filter(F.size("keys") >= least).select("node", F.explode(prefix).alias("k")).select("node", F.col("k.key").alias("key"))


def blocks(rows: DataFrame, key: str, block: int, per_group: int, weight: Column, tie: Column) -> DataFrame:
    """Deal keys with their rows to groups of bounded size: adds part, left, right and deal.

    A key of up to ``block`` rows shares a group with others; a longer one is cut into parts,
    and each pair of parts (left, right) is a group of its own.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.sum(weight).alias("_weight"))
    sizes = materialize(sizes.filter("_rows > 1"), "block-sizes")
    total = sizes.agg(F.coalesce(F.sum("_weight"), F.lit(0))).first()[0]
    groups = max(1, int(total // per_group))
    parts = F.ceil(F.col("_rows") / block).cast("int")
    dealt = rows.join(by_shuffle(sizes.select(key, parts.alias("_parts"))), key)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(tie), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.withColumn("left", F.least("part", "_other")).withColumn("right", F.greatest("part", "_other"))
    alone = F.xxhash64(key, "left", "right")
    return dealt.withColumn("deal", F.when(F.col("_parts") == 1, F.pmod(F.xxhash64(key), F.lit(groups))).otherwise(alone)).drop("_parts", "_other")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    out, fresh = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not fresh[root]:
            continue
        fresh[root], open_ = False, [root]
        while open_:
            at = open_.pop()
            new = np.flatnonzero(linked[at] & fresh)
            fresh[new] = False
            out += [(at, int(i)) for i in new]
            open_ += new.tolist()
    return out


def size_allows(n: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])


def matching(signatures: np.ndarray, allowed: np.ndarray, least: int) -> np.ndarray:
    """Pairs with ``least`` equal coordinates; a pair that can't reach them is skipped early."""
    out = np.zeros(allowed.shape, bool)
    i, j = np.nonzero(np.triu(allowed, 1))
    count = np.zeros(len(i), np.int64)
    coordinates = signatures.shape[1]
    for a in range(0, coordinates, 8):
        count += (signatures[i, a:a + 8] == signatures[j, a:a + 8]).sum(axis=1)
        going = count + max(0, coordinates - a - 8) >= least
        i, j, count = i[going], j[going], count[going]
    out[i, j] = out[j, i] = True
    return out


def lists_of(frame: pd.DataFrame, key: str) -> Iterator[pd.DataFrame]:
    """The rows of each (key, left, right), in node order."""
    frame = frame.sort_values([key, "left", "right", "node"], kind="stable")
    marks = frame[[key, "left", "right"]].to_numpy()
    cuts = np.flatnonzero(np.any(marks[1:] != marks[:-1], axis=1)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(frame)]):
        if b - a > 1:
            yield frame.iloc[a:b]


def edges_frame(edges: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def across(rows: pd.DataFrame) -> np.ndarray:
    """Which pairs a block pair decides: all of one part, or those between two."""
    part = rows["part"].to_numpy()
    if rows["left"].iloc[0] == rows["right"].iloc[0]:
        return np.ones((len(part), len(part)), bool)
    return part[:, None] != part[None, :]


def matches(classes: DataFrame, percent: int, least: int) -> DataFrame:
    """(a, b): spanning forests of the signature matches in every posting list."""
    posted = postings(classes, least).join(by_shuffle(classes.select("node", "n", "signature")), "node")
    dealt = blocks(posted, "key", LIST_BLOCK, GROUP_ROWS, F.lit(1), F.col("node"))

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for rows in lists_of(frame, "key"):
            nodes = rows["node"].to_numpy()
            allowed = size_allows(rows["n"].to_numpy(), percent) & across(rows)
            linked = matching(np.vstack(rows["signature"].to_numpy()), allowed, least)
            found += [(int(nodes[i]), int(nodes[j])) for i, j in forest(linked)]
        return edges_frame(found)

    return dealt.groupBy("deal").applyInPandas(count, "a long, b long")


def linked_sets(sets: list[np.ndarray], percent: int, allowed: np.ndarray) -> np.ndarray:
    """Which sets are as similar as asked, by their full intersections."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    common = (times > 1)[where]
    column, owner = number[where[common]], owner[common]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    both = np.zeros((len(sets), len(sets)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, STRIPE):
        lo, hi = np.searchsorted(column, (a, a + STRIPE))
        held = np.zeros((len(sets), STRIPE), np.float32)
        held[owner[lo:hi], column[lo:hi] - a] = 1
        both += held @ held.T
    union = n[:, None] + n[None, :] - both
    linked = (100 * both >= percent * union) & allowed
    np.fill_diagonal(linked, False)
    return linked


def confirmed(docs: DataFrame, classes: DataFrame, families: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): spanning forests of the true links inside every family."""
    members = families.withColumnRenamed("root", "family").join(by_shuffle(classes.select("node", "doc_id", "mark")), "node").select(
        "family", "node", F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_n"), "mark")
    texts = pick(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_n"),
        text_mark().alias("mark"), text_or_empty().alias("text"))
    found = texts.join(by_shuffle(members), ["_k", "_n", "mark"]).select("family", "node", "text")

    def shingled(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in texts_in_batches(source, 2):
            sets = [shingle_set(c, size) for c in codes_of_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["family", "node", "n", "shingles"])

    # repeated rows of one text are one member
    sets = found.mapInArrow(shingled, "family long, node long, n long, shingles binary").dropDuplicates(["node"])
    sets = materialize(sets, "family-sets")
    dealt = blocks(sets, "family", FAMILY_BLOCK, GROUP_SHINGLES, F.col("n"), F.col("node"))

    def confirm(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for rows in lists_of(frame, "family"):
            nodes = rows["node"].to_numpy()
            held = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
            found += [(int(nodes[i]), int(nodes[j])) for i, j in forest(linked_sets(held, percent, across(rows)))]
        return edges_frame(found)

    return dealt.groupBy("deal").applyInPandas(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, and the text's mark.

    Links join sets with 100 * intersection >= percent * union of shingles of ``size`` words.
    """
    sketched = sketches(docs, size, coordinates)
    classes = classes_of(sketched)
    families = components(matches(classes, percent, least_matches(coordinates, percent)))
    linked = components(confirmed(docs, classes, families, size, percent))
    rooted = classes.join(by_shuffle(linked), "node", "left").select("print", "doc_id", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = rooted.join(by_shuffle(named), "root").select("print", "component_id")
    joined = sketched.select("doc_id", "mark", "n", "print").join(by_shuffle(of_class), "print", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"), "mark")


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with the columns of ``docs``."""
    kept = near_duplicates(docs, size, percent).filter("kept")
    return apply_copies(docs, kept.select("doc_id", "mark", F.lit(1).alias("copies")))
