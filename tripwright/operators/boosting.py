"""Gradient boosting of many models at once over binned rows.

Rows are coded once: a byte per feature, 0 for missing, numbers by quantile edges, category
codes by frequency. Each boosting step sums gradients by (model, node, feature, bin) and
chooses splits from these sums only. A split is a 64-bit set of bins, so numbers (missing to
either side) and categories (bins ordered by gradient) are routed alike. Gradients are
whole numbers (24 binary places), so sums don't depend on the order or place of rows.

Three ways give the same trees. Models whose training rows are at most ``local_rows`` (checked
by count) are boosted side by side, one group each. Beyond that the rows of all models are dealt
to one barrier task per core, which keeps them in memory for the whole fit; at each level tasks
exchange the sums of the smaller siblings and choose the same splits. If a task would hold more
than ``held_rows``, or the session can't say how many tasks run at once, every level is one
Spark aggregate over all rows of all models: tasks send partial histograms, salted sums
meet on the driver as (models x nodes x features x 64) numbers, and margins are written
every ``snapshot`` trees, so that a lost executor costs a few trees only.

A row takes part in tree t of a bagged fit by a hash of its id and t, so the first k trees
of a long fit are the k-tree fit, bagged or not.
"""
from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.operators.skew import values_at_shares
from tripwright.storage import materialize

BINS, EDGES, CATEGORIES = 64, 62, 62
UNIT = 2.0 ** 24
LEAST_HESSIAN, CATEGORY_SMOOTH = 1e-3, 10.0
LOCAL_ROWS, SNAPSHOT, MOST_TASKS, SCORED_ROWS, SCORED_BATCH = 2_500_000, 20, 2_000, 100_000, 60_000
FEW_TASKS, MOST_SCORES = 96, 1_500_000
# Rows that a barrier task may hold, at about 130 bytes each.
HELD_ROWS = 8_000_000
# Cells of a joint code, rows of a chunk, rows that are counted feature by feature, depth of trees that are read densely.
JOINT, CHUNK, FEW_ROWS, DENSE_DEPTH = 8_192, 32_768, 4_096, 4
MODEL = "slot int, config int, prior double, depth int, trees int, feature binary, mask binary, value binary, gain binary, losses array<double>"


# ---- codes --------------------------------------------------------------------

@dataclass(frozen=True)
class Coding:
    """How features become bins: edges for all slots, or one list of edges per slot; category codes."""

    features: tuple[str, ...]
    categorical: tuple[bool, ...]
    shared: dict[str, list]
    of_slot: dict[str, dict[int, list]]

    def codes(self, frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(frame), len(self.features)), np.uint8)
        for j, (name, category) in enumerate(zip(self.features, self.categorical)):
            x = frame[name].to_numpy(np.float64, na_value=np.nan)
            known = ~np.isnan(x)
            if category:
                values = np.array(sorted(self.shared[name]), np.float64)
                at = np.searchsorted(values, x[known])
                hit = values[np.minimum(at, len(values) - 1)] == x[known] if len(values) else np.zeros(known.sum(), bool)
                out[known, j] = np.where(hit, 1 + at, BINS - 1)
            elif name in self.of_slot:
                slots = frame["slot"].to_numpy()
                for slot in np.unique(slots):
                    own = known & (slots == slot)
                    out[own, j] = 1 + np.searchsorted(self.of_slot[name].get(slot, []), x[own])
            else:
                out[known, j] = 1 + np.searchsorted(self.shared[name], x[known])
        return out


def value_counts(rows: DataFrame, features: Sequence[str], n: Column | int = 1) -> DataFrame:
    """(feature, value, n): how often each known number or code occurs, a row counted ``n`` times."""
    entries = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
    weighted = rows.withColumn("_n", F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")).filter("_n > 0").select("_n", entries)
    return weighted.filter("value IS NOT NULL AND NOT isnan(value)").groupBy("feature", "value").agg(F.sum("_n").alias("n"))


def coding_of(counts: DataFrame, features: Sequence[str], categorical: Sequence[str], per_slot: Sequence[str]) -> Coding:
    """Quantile edges and frequent category codes: at most 62 numbers per feature (and slot).

    ``counts`` has (feature, slot, value, n), the slot null but for ``per_slot`` features. Edges are the
    exact values of ranks 1/63 to 62/63.
    """
    counts = materialize(counts, "value-counts")
    shares = [(i + 1) / (EDGES + 1) for i in range(EDGES)]
    shared: dict[str, list] = {c: [] for c in features if c not in per_slot}
    of_slot: dict[str, dict[int, list]] = {c: {} for c in per_slot}
    numbers = counts.filter(~F.col("feature").isin(*categorical))
    for row in values_at_shares(numbers, ["feature", "slot"], "value", "n", shares).collect():  # 62 values per feature and slot
        own = shared[row["feature"]] if row["slot"] is None else of_slot[row["feature"]].setdefault(row["slot"], [])
        own.append(row["value"])
    if categorical:
        most = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
        lists = counts.filter(F.col("feature").isin(*categorical)).withColumn("_place", F.row_number().over(most)).filter(F.col("_place") <= CATEGORIES)
        for row in lists.collect():  # 62 codes per feature
            shared[row["feature"]].append(row["value"])
    shared = {c: own if c in categorical else sorted(own) for c, own in shared.items()}
    of_slot = {c: {slot: sorted(own) for slot, own in slots.items()} for c, slots in of_slot.items()}
    return Coding(tuple(features), tuple(c in categorical for c in features), shared, of_slot)


def fit_coding(train: DataFrame, features: Sequence[str], categorical: Sequence[str], per_slot: Sequence[str]) -> Coding:
    """The coding of training rows that have all features (and their slot)."""
    common = [c for c in features if c not in per_slot]
    none = F.lit(None).cast("int")
    parts = [value_counts(train, common).withColumn("slot", none)] if common else []
    for c in per_slot:
        known = F.col(c).cast("double").alias("value")
        parts.append(train.select("slot", known).filter("value IS NOT NULL AND NOT isnan(value)").groupBy("slot", "value")
                     .agg(F.count(F.lit(1)).alias("n")).withColumn("feature", F.lit(c)))
    return coding_of(reduce(lambda a, b: a.unionByName(b), [p.select("feature", "slot", "value", "n") for p in parts]), features, categorical, per_slot)


def coded_rows(rows: DataFrame, coding: Coding, keep: Sequence[str]) -> DataFrame:
    """``keep`` (slot included) and ``codes``: a byte per feature."""
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in keep)

    def code(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            packed = coding.codes(frame)
            yield frame[[c for c in frame.columns if c in keep]].assign(codes=[r.tobytes() for r in packed])

    numbers = [F.col(c).cast("double").alias(c) for c in coding.features if c not in keep]
    return rows.select(*[c for c in rows.columns if c in keep], *numbers).mapInPandas(code, f"{schema}, codes binary")


def shared_codes(coding: Coding) -> Column:
    """A byte for each feature whose bins are the same in all slots, in the coding's order."""
    names = [c for c in coding.features if c not in coding.of_slot]
    if not names:
        return F.lit(bytearray())
    kinds = tuple(k for c, k in zip(coding.features, coding.categorical) if c not in coding.of_slot)
    own = Coding(tuple(names), kinds, coding.shared, {})

    def code(*numbers: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in own.codes(pd.DataFrame(dict(zip(names, numbers))))])

    return F.pandas_udf(code, "binary")(*[F.col(c).cast("double") for c in names])


def view_codes(values: np.ndarray, edges: dict[int, list], views: int) -> np.ndarray:
    """The bins of (key, slot and view): each slot's values by its own edges, 0 where there is none."""
    out = np.zeros(values.shape, np.uint8)
    for slot in range(values.shape[1] // views):
        at = slice(slot * views, (slot + 1) * views)
        bins = 1 + np.searchsorted(edges.get(slot, []), values[:, at])
        out[:, at] = np.where(np.isnan(values[:, at]), 0, bins)
    return out


def key_codes(keyed: DataFrame, coding: Coding, views: int, prefix: str) -> DataFrame:
    """(column, key, codes) of (column, key, values): a byte for each slot and view."""
    of_slot = coding.of_slot

    def code(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            for column, own in frame.groupby("column"):
                bins = view_codes(np.stack(own["values"].tolist()).astype(np.float64), of_slot[f"{prefix}{column}"], views)
                yield pd.DataFrame({"column": column, "key": own["key"], "codes": [r.tobytes() for r in bins]})

    return keyed.select("column", "key", "values").mapInPandas(code, "column string, key string, codes binary")


def unpacked(codes: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), width)


# ---- one tree -----------------------------------------------------------------

def mixed_hash(ids: np.ndarray, tree: int) -> np.ndarray:
    """A mixed 64-bit hash of id and tree."""
    x = ids.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sampled(ids: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether each row is in the sample of a tree."""
    return mixed_hash(ids, tree).astype(np.float64) < share * 2.0 ** 64


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g, h = np.empty(len(margin)), np.empty(len(margin))
    for start in range(0, len(margin), CHUNK):  # a chunk's numbers stay in the processor's cache
        at = slice(start, start + CHUNK)
        p = 1 / (1 + np.exp(-margin[at]))
        np.rint((p - y[at]) * UNIT, out=g[at])
        np.rint(p * (1 - p) * UNIT, out=h[at])
    return g, h


def histograms(codes: np.ndarray, g: np.ndarray, h: np.ndarray, place: np.ndarray, nodes: int) -> np.ndarray:
    """Sums of gradient, Hessian and rows by (node, feature, bin); ``place`` is -1 for rows that don't count."""
    cells = Cells(columns_of(codes))
    return np.stack([cells.sums(g, h, np.flatnonzero(place == n)) for n in range(nodes)], axis=1)


def columns_of(codes: np.ndarray) -> np.ndarray:
    """(feature, row): each feature's codes side by side."""
    return np.ascontiguousarray(codes.T)


class Cells:
    """Sums by (feature, bin) over any rows of one table.

    Features are packed into joint codes of at most ``JOINT`` cells that hold rows, so that one count
    serves several features, the more the more they say of each other; a feature's sums are those of the
    joint code, added over the cells of each bin. Few rows are counted by each feature's bins instead.
    Sums are whole numbers: both are exact.
    """

    def __init__(self, columns: np.ndarray):
        self.columns, self.offsets = columns, np.arange(len(columns))[:, None] * BINS
        self.groups: list[tuple[np.ndarray, list[tuple[int, np.ndarray]]]] | None = None

    def _pack(self) -> list[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
        """(joint code of each row, (feature, bin of each cell) of its members): a feature joins the code whose
        cells it multiplies least, as the first rows show; all rows then say whether it fits."""
        filled = [np.count_nonzero(np.bincount(c, minlength=BINS)) for c in self.columns]
        groups: list[tuple[np.ndarray, list[tuple[int, np.ndarray]], int]] = []
        for j in sorted(range(len(filled)), key=lambda j: -filled[j]):
            column = self.columns[j]
            fits = []
            for k, (joint, _, cells) in enumerate(groups):
                seen = np.count_nonzero(np.bincount(joint[:CHUNK] * np.int64(BINS) + column[:CHUNK]))
                if seen <= JOINT:
                    fits.append((seen / cells, k))
            for _, k in sorted(fits):
                joint, members, cells = groups[k]
                both = joint * np.int32(BINS) + column
                held = np.flatnonzero(np.bincount(both, minlength=cells * BINS))
                if len(held) <= JOINT:
                    place = np.zeros(cells * BINS, np.uint16)
                    place[held] = np.arange(len(held))
                    groups[k] = place[both], [*((i, bins[held // BINS]) for i, bins in members), (j, held % BINS)], len(held)
                    break
            else:
                groups.append((column.astype(np.uint16), [(j, np.arange(BINS))], BINS))
        return [(joint, members) for joint, members, _ in groups]

    def sums(self, g: np.ndarray, h: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """(3, feature, bin): gradients, Hessians and numbers of the rows ``own``, or of all rows."""
        width = len(self.columns)
        if own is not None and len(own) < FEW_ROWS:
            at = (self.columns[:, own] + self.offsets).ravel()
            size = width * BINS
            found = [np.bincount(at, np.broadcast_to(v[own], (width, len(own))).ravel(), size) for v in (g, h)]
            return np.stack([*found, np.bincount(at, minlength=size)]).reshape(3, width, BINS)
        if self.groups is None:
            self.groups = self._pack()
        sizes = [len(members[0][1]) for _, members in self.groups]
        totals = [np.zeros((3, size)) for size in sizes]
        n = self.columns.shape[1] if own is None else len(own)
        for start in range(0, n, CHUNK):  # a chunk's rows stay in the processor's cache
            rows = slice(start, start + CHUNK) if own is None else own[start:start + CHUNK]
            own_g, own_h = (g[rows], h[rows]) if own is None else (g.take(rows), h.take(rows))
            for (joint, _), total, size in zip(self.groups, totals, sizes):
                at = (joint[rows] if own is None else joint.take(rows)).astype(np.intp)
                total[0] += np.bincount(at, own_g, size)
                total[1] += np.bincount(at, own_h, size)
                total[2] += np.bincount(at, minlength=size)
        out = np.zeros((3, width, BINS))
        for (_, members), total in zip(self.groups, totals):
            for j, bins in members:
                out[:, j] = [np.bincount(bins, t, BINS) for t in total]
        return out

    def level(self, g: np.ndarray, h: np.ndarray, rows: dict[int, np.ndarray], taken: np.ndarray | None, active: np.ndarray,
              parents: dict[int, np.ndarray]) -> np.ndarray:
        """(3, node, feature, bin) of the active nodes: of two siblings only the smaller is summed, the
        other is what it leaves of their parent."""
        found: dict[int, np.ndarray] = {}
        for n in active.tolist():
            least = n if n == 1 or len(rows[n]) <= len(rows[n ^ 1]) else n ^ 1
            if least not in found:
                own = rows[least] if taken is None else rows[least].compress(taken.take(rows[least]))
                found[least] = self.sums(g, h, None if len(own) == self.columns.shape[1] else own)
            if n != least:
                found[n] = parents[n // 2] - found[least]
        return np.stack([found[n] for n in active.tolist()], axis=1)


@lru_cache(maxsize=1 << 16)
def bins_of(mask: int) -> tuple[np.uint8, np.uint8, bytes | None]:
    """A split's set as its first bin and the number of others, if it is a run as for a number; else as a table."""
    low = (mask & -mask).bit_length() - 1
    run = mask >> low
    if run & (run + 1) == 0:
        return np.uint8(low), np.uint8(run.bit_length() - 1), None
    held = np.unpackbits(np.array([mask], "<u8").view(np.uint8), bitorder="little")
    return np.uint8(0), np.uint8(0), held.tobytes() + bytes(256 - BINS)


def goes_left(mask: int, codes: np.ndarray) -> np.ndarray:
    """Which codes are in a split's set; a run of bins is compared at once."""
    low, others, table = bins_of(mask)
    return codes - low <= others if table is None else np.frombuffer(codes.tobytes().translate(table), bool)


def halves(feature: np.ndarray, mask: np.ndarray, columns: np.ndarray, node: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``own`` of a node that go to its left and right child."""
    left = goes_left(int(mask[node]), columns[feature[node]].take(own))
    return own.compress(left), own.compress(~left)


def dense_leaves(feature: np.ndarray, mask: np.ndarray, columns: np.ndarray, node: int) -> np.ndarray | np.uint8:
    """The leaf below a node that each row would reach from there, as bits that both sides choose between."""
    if feature[node] < 0:
        return np.uint8(node)
    left = np.negative(goes_left(int(mask[node]), columns[feature[node]]).view(np.uint8))  # all bits, or none
    here, there = (dense_leaves(feature, mask, columns, child) for child in (2 * node, 2 * node + 1))
    return there ^ (here ^ there) & left


def leaf_values(feature: np.ndarray, mask: np.ndarray, value: np.ndarray, columns: np.ndarray, depth: int) -> np.ndarray:
    """The value of each row's leaf. Shallow trees choose between the leaves of both children, a byte each, for
    all rows at once, in deep ones the rows step down together."""
    out = np.empty(columns.shape[1])
    if depth <= DENSE_DEPTH:
        for start in range(0, len(out), CHUNK):
            out[start:start + CHUNK] = value.take(dense_leaves(feature, mask, columns[:, start:start + CHUNK], 1))
        return out
    inner, nodes = feature >= 0, np.arange(len(value))
    own, bits = np.where(inner, feature, 0).astype(np.intp), np.where(inner, mask, np.uint64(0))
    onward = np.where(inner, 2 * nodes + 1, nodes)  # the right child; a leaf leads to itself
    for start in range(0, len(out), CHUNK):
        block = np.ascontiguousarray(columns[:, start:start + CHUNK])
        rows, flat, first = np.arange(block.shape[1]), block.reshape(-1), own * block.shape[1]
        node = np.ones(len(rows), np.intp)
        for _ in range(depth):
            code = flat.take(first.take(node) + rows).astype(np.uint64)
            node = onward.take(node) - (bits.take(node) >> code & np.uint64(1)).astype(np.intp)
        out[start:start + CHUNK] = value.take(node)
    return out


def best_splits(hist: np.ndarray, categorical: np.ndarray, min_leaf: int) -> list[tuple | None]:
    """Per node (feature, mask, gain, left sums, all sums) of the largest gain, or None; the first of equals.

    ``categorical`` says of features, or of each node's features, whether their bins have no order.
    A cut after an empty bin repeats the cut before it, and without missing rows both sides
    for them are one, so neither is looked at.
    """
    categorical = np.broadcast_to(categorical, hist.shape[1:3])
    total = hist[:, :, 0].sum(axis=-1)
    order = np.broadcast_to(np.arange(BINS), hist.shape[1:]).copy()
    if categorical.any():
        some = hist[:, categorical]
        score = np.where(some[2] > 0, some[0] / (some[1] + CATEGORY_SMOOTH * UNIT), np.inf)
        order[categorical] = by_score = np.argsort(score, axis=-1, kind="stable")
        hist = hist.copy()
        hist[:, categorical] = np.take_along_axis(some, by_score[None], axis=-1)
    nodes, width = hist.shape[1:3]
    cells = width * BINS
    sums, missing = np.cumsum(hist, axis=-1).reshape(3, -1), hist[..., 0].reshape(3, -1)
    filled = hist[2] > 0
    filled[..., -1] = False
    sides = []
    for variant in (0, 1):  # 1: missing to the right; of numbers only
        at = np.flatnonzero(filled & (filled[..., :1] & ~categorical[..., None]) if variant else filled)
        n, all_n = sums[2].take(at), total[2].take(at // cells)
        if variant:
            n -= missing[2].take(at // BINS)
        large = (n >= min_leaf) & (all_n - n >= min_leaf)
        at = at[large]
        node = at // cells
        g, h, all_g, all_h = sums[0].take(at), sums[1].take(at), total[0].take(node), total[1].take(node)
        if variant:
            g, h = g - missing[0].take(at // BINS), h - missing[1].take(at // BINS)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g * g / h + (all_g - g) ** 2 / (all_h - h) - all_g ** 2 / all_h
        gain = np.where((h >= LEAST_HESSIAN * UNIT) & (all_h - h >= LEAST_HESSIAN * UNIT), gain, -np.inf)
        sides.append((np.searchsorted(at, np.arange(nodes + 1) * cells), gain, at, np.stack([g, h, n[large]])))
    out: list[tuple | None] = []
    for node in range(nodes):
        best = None
        for variant, (bounds, gain, at, left) in enumerate(sides):
            a, b = bounds[node:node + 2]
            if a == b:
                continue
            i = a + int(gain[a:b].argmax())
            if gain[i] > (1e-9 * UNIT if best is None else best[0]):
                best = (gain[i], variant, int(at[i]) % cells, left[:, i])
        if best is None:
            out.append(None)
            continue
        gained, variant, cell, own = best
        feature, cut = divmod(cell, BINS)
        bins = order[node, feature, :cut + 1].tolist()
        mask = sum(1 << i for i in bins[variant:])
        out.append((feature, mask, float(gained / UNIT), own, total[:, node]))
    return out


class Tree:
    """A tree under way, nodes numbered as in a heap: the children of k are 2k and 2k + 1."""

    def __init__(self, depth: int, rate: float, min_leaf: int):
        self.depth, self.rate, self.min_leaf = depth, rate, min_leaf
        nodes = 2 ** (depth + 1)
        self.feature, self.mask = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint64)
        self.value, self.gain, self.count = np.zeros(nodes), np.zeros(nodes), np.zeros(nodes)
        self.active = np.array([1])

    def place(self, node: np.ndarray) -> np.ndarray:
        """Position of each row's node among the active ones, or -1."""
        lookup = np.full(len(self.value), -1)
        lookup[self.active] = np.arange(len(self.active))
        return lookup[node]

    def split(self, hist: np.ndarray, categorical: np.ndarray) -> None:
        """Split the active nodes; children that are large enough are the next active ones."""
        onward = []
        for node, best in zip(self.active.tolist(), best_splits(hist, categorical, self.min_leaf)):
            if node == 1:
                self._leaf(1, hist[:, 0, 0].sum(axis=-1))
            if best is None:
                continue
            self.feature[node], self.mask[node], self.gain[node] = best[0], best[1], best[2]
            for child, sums in ((2 * node, best[3]), (2 * node + 1, best[4] - best[3])):
                self._leaf(child, sums)
                if sums[2] >= 2 * self.min_leaf and child < 2 ** self.depth:
                    onward.append(child)
        self.active = np.array(onward, int)

    def _leaf(self, node: int, sums: np.ndarray) -> None:
        self.count[node] = sums[2]
        self.value[node] = -self.rate * sums[0] / sums[1] if sums[1] else 0.0


def step_down(feature: np.ndarray, mask: np.ndarray, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The nodes of rows one level further; rows in leaves stay."""
    f = feature[node]
    inner = f >= 0
    code = codes[np.arange(len(codes)), np.where(inner, f, 0)].astype(np.uint64)
    left = (mask[node] >> code) & np.uint64(1)
    return np.where(inner, 2 * node + (1 - left.astype(int)), node)


def leaves(feature: np.ndarray, mask: np.ndarray, codes: np.ndarray, depth: int) -> np.ndarray:
    node = np.ones(len(codes), int)
    for _ in range(depth):
        node = step_down(feature, mask, codes, node)
    return node


def mean_loss(margin: np.ndarray, y: np.ndarray) -> float:
    """Log loss of scores that stay 1e-15 from 0 and 1."""
    p = np.clip(1 / (1 + np.exp(-margin)), 1e-15, 1 - 1e-15)
    return float(-np.mean(np.where(y == 1, np.log(p), np.log1p(-p)))) if len(y) else float("nan")


def prior_margin(positives: float, rows: float) -> float:
    share = min(max(positives / rows, 1e-6), 1 - 1e-6) if rows else 0.5
    return float(np.log(share / (1 - share)))


def stopped(losses: list[float], rounds: int | None) -> bool:
    return rounds is not None and len(losses) - 1 - int(np.argmin(losses)) >= rounds


def packed_model(slot: int, config: int, prior: float, depth: int, trees: list[Tree], losses: list[float], stop: bool) -> dict:
    kept = trees[:int(np.argmin(losses)) + 1] if stop else trees
    arrays = {name: np.concatenate([getattr(t, name) for t in kept]).tobytes() for name in ("feature", "mask", "value", "gain")}
    return {"slot": slot, "config": config, "prior": prior, "depth": depth, "trees": len(kept), **arrays, "losses": losses}


# ---- whole fits ---------------------------------------------------------------

def boost(codes: np.ndarray, y: np.ndarray, ids: np.ndarray, held_codes: np.ndarray, held_y: np.ndarray, params: dict,
          categorical: np.ndarray) -> tuple[float, list[Tree], list[float]]:
    """One model over rows in memory: prior margin, trees, and the holdout loss after each."""
    prior = prior_margin(y.sum(), len(y))
    margin, held, share = np.full(len(y), prior), np.full(len(held_y), prior), params.get("row_share", 1.0)
    columns, held_columns = columns_of(codes), columns_of(held_codes)
    trees, losses, cells = [], [], Cells(columns)
    for t in range(params["trees"]):
        g, h = gradients(margin, y)
        taken = sampled(ids, t, share) if share < 1 else None
        tree, rows = Tree(params["depth"], params["learning_rate"], params["min_leaf"]), {1: np.arange(len(y))}
        parents: dict[int, np.ndarray] = {}
        while len(tree.active):
            active = tree.active.tolist()
            hist = cells.level(g, h, rows, taken, tree.active, parents)
            parents = {n: hist[:, i] for i, n in enumerate(active)}
            tree.split(hist, categorical)
            for n in active:
                if tree.feature[n] >= 0:
                    rows[2 * n], rows[2 * n + 1] = halves(tree.feature, tree.mask, columns, n, rows.pop(n))
        for n, own in rows.items():
            margin[own] += tree.value[n]
        held = held + leaf_values(tree.feature, tree.mask, tree.value, held_columns, tree.depth)
        trees.append(tree)
        losses.append(mean_loss(held, held_y))
        if stopped(losses, params.get("stopping_rounds")):
            break
    return prior, trees, losses


def _boost_groups(tables: Sequence[tuple[DataFrame, Coding]], configs: Sequence[dict], slots: int) -> DataFrame:
    """All models of all tables side by side, a task each; slots are numbered below ``slots``."""
    codings = [(np.array(coding.categorical), len(coding.features)) for _, coding in tables]

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        of, place = divmod(int(key[0]), slots * len(configs))
        slot, config = divmod(place, len(configs))
        categorical, width = codings[of]
        order = np.argsort(frame.flight_id.to_numpy(), kind="stable")
        held = order[frame.is_held.to_numpy()[order]]
        train = order[~frame.is_held.to_numpy()[order]]
        codes, y, ids = unpacked(frame.codes, width), frame.y.to_numpy(float), frame.flight_id.to_numpy()
        del frame  # a model's rows stay in memory as these arrays only
        prior, trees, losses = boost(codes[train], y[train], ids[train], codes[held], y[held], configs[config], categorical)
        stop = configs[config].get("stopping_rounds") is not None
        return pd.DataFrame([packed_model(slot, config, prior, configs[config]["depth"], trees, losses, stop)]).assign(of=of)

    each = F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1))).alias("_config")
    rows = reduce(lambda a, b: a.unionByName(b), [
        coded.filter("part <> 'valid'").select(F.lit(i).alias("_of"), "slot", (F.col("part") == "holdout").alias("is_held"), "flight_id", "y", "codes", each)
        for i, (coded, _) in enumerate(tables)])
    model = ((F.col("_of") * slots + F.col("slot")) * len(configs) + F.col("_config")).alias("model")
    rows = rows.select(model, "is_held", "flight_id", "y", "codes")
    # dealt by hash, some tasks would get several models and others none
    dealt = rows.repartitionById(min(len(tables) * slots * len(configs), MOST_TASKS), "model")
    return dealt.groupBy("model").applyInPandas(fit, f"{MODEL}, of int")


class HeldModel:
    """One task's share of a slot's rows, and the model that all tasks grow alike."""

    def __init__(self, train: tuple[np.ndarray, ...], held: tuple[np.ndarray, ...]):
        self.columns, self.y, self.ids = train
        self.held_columns, self.held_y, _ = held
        self.cells = Cells(self.columns)

    def start(self, prior: float, params: dict) -> None:
        self.params, self.margin, self.held = params, np.full(len(self.y), prior), np.full(len(self.held_y), prior)
        self.trees: list[Tree] = []
        self.losses: list[float] = []

    def loss(self) -> np.ndarray:
        n = len(self.held_y)
        return np.array([mean_loss(self.held, self.held_y) * n if n else 0.0, n])

    def plant(self) -> None:
        p, share = self.params, self.params.get("row_share", 1.0)
        self.g, self.h = gradients(self.margin, self.y)
        self.taken = sampled(self.ids, len(self.trees), share) if share < 1 else None
        self.tree, self.rows, self.parents = Tree(p["depth"], p["learning_rate"], p["min_leaf"]), {1: np.arange(len(self.y))}, {}

    def least(self) -> list[int]:
        """The active nodes or, where smaller in all tasks together, their siblings."""
        count = self.tree.count
        return list(dict.fromkeys(n if n == 1 or count[n] <= count[n ^ 1] else n ^ 1 for n in self.tree.active.tolist()))

    def sums(self) -> np.ndarray:
        """(node, 3, feature, bin) of ``least``."""
        found = []
        for n in self.least():
            own = self.rows[n] if self.taken is None else self.rows[n].compress(self.taken.take(self.rows[n]))
            found.append(self.cells.sums(self.g, self.h, None if 0 < len(own) == len(self.y) else own))
        return np.stack(found)

    def grow(self, sums: np.ndarray, categorical: np.ndarray) -> None:
        """Split the active nodes by the ``sums`` of all tasks."""
        known, active = dict(zip(self.least(), sums)), self.tree.active.tolist()
        hist = {n: known[n] if n in known else self.parents[n // 2] - known[n ^ 1] for n in active}
        self.parents = hist
        self.tree.split(np.stack([hist[n] for n in active], axis=1), categorical)
        for n in active:
            if self.tree.feature[n] >= 0:
                self.rows[2 * n], self.rows[2 * n + 1] = halves(self.tree.feature, self.tree.mask, self.columns, n, self.rows.pop(n))

    def finish(self) -> None:
        tree = self.tree
        for n, own in self.rows.items():
            self.margin[own] += tree.value[n]
        self.held = self.held + leaf_values(tree.feature, tree.mask, tree.value, self.held_columns, tree.depth)
        self.trees.append(tree)


def boost_held(models: dict[int, HeldModel], priors: dict[int, float], params: dict, categorical: np.ndarray, filled: np.ndarray,
               added: Callable[[np.ndarray], np.ndarray]) -> None:
    """Boost the models of one parameter set in step with the other tasks; ``added`` sums an array over all tasks.

    The loss of a tree travels with the root of the next one.
    """
    for slot, model in models.items():
        model.start(priors[slot], params)
    running = dict(models)
    while running:
        planted = [m for m in running.values() if len(m.trees) < params["trees"]]
        for model in planted:
            model.plant()
        growing, sent = planted, [m.loss() for m in running.values() if m.trees]
        while growing or sent:
            packed = [m.sums()[..., filled] for m in growing]
            total = added(np.concatenate([*sent, *[p.ravel() for p in packed], np.zeros(0)]))
            at = 2 * len(sent)
            if sent:
                for model, (loss, n) in zip(running.values(), total[:at].reshape(-1, 2)):
                    model.losses.append(float(loss / n) if n else float("nan"))
                sent, running = [], {s: m for s, m in running.items() if len(m.trees) < params["trees"] and not stopped(m.losses, params.get("stopping_rounds"))}
            for model, part in zip(growing, packed):
                sums = np.zeros((len(part), 3, *filled.shape))
                sums[..., filled] = total[at:at + part.size].reshape(part.shape)
                at += part.size
                if model in running.values():
                    model.grow(sums, categorical)
            growing = [m for m in growing if m in running.values() and len(m.tree.active)]
        for model in running.values():
            model.finish()


def _boost_tasks(coded: DataFrame, coding: Coding, configs: Sequence[dict], tasks: int) -> DataFrame:
    """All models in step, their rows dealt to barrier tasks that run at the same time."""
    categorical, width = np.array(coding.categorical), len(coding.features)

    def fit(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()

        def shared(values: np.ndarray) -> list[np.ndarray]:
            return [np.frombuffer(base64.b64decode(m)) for m in context.allGather(base64.b64encode(values.astype(np.float64).tobytes()).decode())]

        def added(values: np.ndarray) -> np.ndarray:
            return np.sum(shared(values), axis=0)

        held: dict[tuple[int, bool], list] = {}
        for frame in source:
            for key, own in frame.groupby(["slot", "is_held"]):
                held.setdefault((int(key[0]), bool(key[1])), []).append((columns_of(unpacked(own.codes, width)), own.y.to_numpy(float), own.flight_id.to_numpy()))

        def rows(slot: int, is_held: bool) -> tuple[np.ndarray, ...]:
            parts = held.pop((slot, is_held), [(np.zeros((width, 0), np.uint8), np.zeros(0), np.zeros(0, np.int64))])
            return np.concatenate([p[0] for p in parts], axis=1), *(np.concatenate([p[i] for p in parts]) for i in (1, 2))

        slots = sorted(set(np.concatenate(shared(np.array([s for s, _ in held], float))).astype(int).tolist()))
        models = {s: HeldModel(rows(s, False), rows(s, True)) for s in slots}
        filled = np.zeros((width, BINS))
        for model in models.values():
            for j, column in enumerate(model.columns):
                filled[j] += np.bincount(column, minlength=BINS)
        filled = added(filled.ravel()).reshape(width, BINS) > 0
        known = added(np.array([(m.y.sum(), len(m.y)) for m in models.values()]).ravel()).reshape(-1, 2)
        priors = {s: prior_margin(*sums) for s, sums in zip(slots, known)}
        for config, params in enumerate(configs):
            boost_held(models, priors, params, categorical, filled, added)
            if context.partitionId() == 0:
                stop = params.get("stopping_rounds") is not None
                yield pd.DataFrame([packed_model(s, config, priors[s], params["depth"], m.trees, m.losses, stop) for s, m in models.items()])

    rows = coded.filter("part <> 'valid'").select("slot", (F.col("part") == "holdout").alias("is_held"), "flight_id", "y", "codes")
    return rows.repartition(tasks, "flight_id").mapInPandas(fit, MODEL, barrier=True)


def tasks_at_once(coded: DataFrame) -> int:
    """How many tasks the session runs at the same time; 0 if it doesn't say or may change it."""
    context = coded.sparkSession.sparkContext
    conf = context.getConf()
    if conf.contains("spark.default.parallelism") or conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    return context.defaultParallelism // int(conf.get("spark.task.cpus", "1"))


def add_partials(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packed arrays of doubles added by key, first within salts, so that no task adds all partials."""
    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b, np.float64) for b in frame["sums"]], axis=0)
        return pd.DataFrame([{**dict(zip(keys, key)), "sums": total.tobytes()}])

    schema = ", ".join(f"{k} int" for k in keys) + ", sums binary"
    salted = partials.groupBy(*keys, "salt").applyInPandas(
        lambda key, frame: add(key[:-1], frame).assign(salt=key[-1]), f"{schema}, salt int")
    return salted.groupBy(*keys).applyInPandas(add, schema)


def _boost_levels(coded: DataFrame, coding: Coding, configs: Sequence[dict], snapshot: int) -> DataFrame:
    """All models of one parameter set at a time, level by level."""
    categorical, width = np.array(coding.categorical), len(coding.features)
    spark, models = coded.sparkSession, []
    seen = coded.groupBy("slot").agg(F.sum(F.when(F.col("part") == "train", F.col("y"))).alias("s"),
                                     F.count_if(F.col("part") == "train").alias("n")).collect()  # a row for each slot
    priors = {r["slot"]: prior_margin(r["s"] or 0, r["n"]) for r in seen}
    for config, params in enumerate(configs):
        share, prior_of = params.get("row_share", 1.0), F.create_map(*[F.lit(x) for kv in priors.items() for x in kv])
        state = materialize(coded.filter("part <> 'valid'").withColumn("margin", prior_of[F.col("slot")]), "margins")
        trees: dict[int, list[Tree]] = {s: [] for s in priors}
        losses: dict[int, list[float]] = {s: [] for s in priors}
        since = 0  # trees that the written margins include

        def margins(frame: pd.DataFrame, slot: int, done: dict) -> np.ndarray:
            columns, margin = columns_of(unpacked(frame.codes, width)), frame.margin.to_numpy()
            for tree in done[slot]:
                margin = margin + leaf_values(tree.feature, tree.mask, tree.value, columns, tree.depth)
            return margin

        def partial(kind: str, done: dict, growing: dict, t: int):
            def sums(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                held: dict[int, np.ndarray] = {}
                for frame in source:
                    for slot, own in frame.groupby("slot"):
                        if slot not in growing:
                            continue
                        y, margin = own.y.to_numpy(float), margins(own, slot, done)
                        if kind == "losses":
                            found = np.array([mean_loss(margin, y) * len(y), len(y)])
                        else:
                            codes, tree = unpacked(own.codes, width), growing[slot]
                            place = tree.place(leaves(tree.feature, tree.mask, codes, tree.depth))
                            if share < 1:
                                place = np.where(sampled(own.flight_id.to_numpy(), t, share), place, -1)
                            found = histograms(codes, *gradients(margin, y), place, len(tree.active)).ravel()
                        held[slot] = held[slot] + found if slot in held else found
                if held:
                    yield pd.DataFrame({"slot": list(held), "salt": np.random.randint(0, 32, len(held)), "sums": [v.tobytes() for v in held.values()]})
            return sums

        def recent() -> dict[int, list[Tree]]:
            return {s: list(grown[since:]) for s, grown in trees.items()}

        running = set(priors)
        for t in range(params["trees"]):
            growing = {s: Tree(params["depth"], params["learning_rate"], params["min_leaf"]) for s in running}
            whole, train, held = dict(growing), state.filter("part = 'train'"), state.filter("part = 'holdout'")
            while growing:
                sent = train.mapInPandas(partial("histograms", recent(), growing, t), "slot int, salt int, sums binary")
                for row in add_partials(sent, ["slot"]).collect():  # histograms of the active nodes, bounded by the declared sizes
                    tree = growing[row["slot"]]
                    tree.split(np.frombuffer(row["sums"], np.float64).reshape(3, len(tree.active), width, BINS), categorical)
                growing = {s: tree for s, tree in growing.items() if len(tree.active)}
            for s, tree in whole.items():
                trees[s].append(tree)
            sent = held.mapInPandas(partial("losses", recent(), whole, t), "slot int, salt int, sums binary")
            found = {r["slot"]: np.frombuffer(r["sums"], np.float64) for r in add_partials(sent, ["slot"]).collect()}
            for s in whole:
                losses[s].append(float(found[s][0] / found[s][1]) if s in found else float("nan"))
            running -= {s for s in running if stopped(losses[s], params.get("stopping_rounds"))}
            if not running:
                break
            if len(trees[next(iter(running))]) - since >= snapshot:
                def forward(source: Iterator[pd.DataFrame], done=recent()) -> Iterator[pd.DataFrame]:
                    for frame in source:
                        for slot, own in frame.groupby("slot"):
                            yield own.assign(margin=margins(own, slot, done))
                state = materialize(state.filter(F.col("slot").isin(*running)).mapInPandas(forward, state.schema), "margins")
                since = len(trees[next(iter(running))])
        stop = params.get("stopping_rounds") is not None
        models += [packed_model(s, config, priors[s], params["depth"], trees[s], losses[s], stop) for s in priors]
    return spark.createDataFrame(pd.DataFrame(models), MODEL)


def fit_models(coded: DataFrame, coding: Coding, configs: Sequence[dict], *, local_rows: int = LOCAL_ROWS,
               held_rows: int = HELD_ROWS, snapshot: int = SNAPSHOT) -> DataFrame:
    """A row per slot and parameter set: packed trees and holdout losses after each tree, written once.

    ``coded`` has slot, part (train, holdout, valid), flight_id, y and codes.
    """
    return fit_each([(coded, coding)], configs, local_rows=local_rows, held_rows=held_rows, snapshot=snapshot)[0]


def fit_each(tables: Sequence[tuple[DataFrame, Coding]], configs: Sequence[dict], *, local_rows: int = LOCAL_ROWS,
             held_rows: int = HELD_ROWS, snapshot: int = SNAPSHOT) -> list[DataFrame]:
    """``fit_models`` of several tables; those whose models are fitted in groups share one round of tasks."""
    for params in configs:
        if not 0 < params.get("row_share", 1.0) <= 1 or params["trees"] < 1 or not 1 <= params["depth"] <= 12:
            raise ValueError(f"trees, depth or row share out of range: {params}")
    grouped, slots, out = [], 0, {}
    for i, (coded, coding) in enumerate(tables):
        counts = coded.filter("part <> 'valid'").groupBy("slot").count()
        largest, every, last = counts.agg(F.max("count"), F.sum("count"), F.max("slot")).first()
        tasks = tasks_at_once(coded)
        if (largest or 0) <= local_rows:
            grouped.append(i)
            slots = max(slots, (last or 0) + 1)
        elif every <= held_rows * tasks:
            out[i] = materialize(_boost_tasks(coded, coding, configs, tasks), "boosted")
        else:
            out[i] = materialize(_boost_levels(coded, coding, configs, snapshot), "boosted")
    if grouped:
        fitted = materialize(_boost_groups([tables[i] for i in grouped], configs, slots), "boosted")
        out |= {i: fitted.filter(F.col("of") == at).drop("of") for at, i in enumerate(grouped)}
    return [out[i] for i in range(len(tables))]


# ---- scores -------------------------------------------------------------------

def spread_rows(rows: DataFrame, models: int) -> DataFrame:
    """Rows dealt to tasks: scoring by hundreds of trees takes long, and a small table has few files. ``FEW_TASKS``
    hold at most ``SCORED_ROWS`` scores if they can, more tasks ``MOST_SCORES``, as a tree costs the same time for few rows
    as for some thousands. Of rows that have a slot, a task gets those of few slots, many of each."""
    of_slot = "slot" in rows.columns
    scores = rows.count() * (1 if of_slot else models)
    tasks = max(min(-(-scores // SCORED_ROWS), max(FEW_TASKS, scores // MOST_SCORES)), 1)
    if not of_slot:
        return rows.repartition(tasks, "flight_id")
    return rows.repartition(tasks, "slot", F.pmod(F.xxhash64("flight_id"), F.lit(max(4 * tasks // max(models, 1), 1))))


class Scorer:
    """The trees of a model, ready to score rows by the first so many of them."""

    def __init__(self, model, counts: Sequence[int]):
        nodes = 2 ** (model["depth"] + 1)
        self.prior, self.depth, self.counts = model["prior"], model["depth"], sorted({min(c, model["trees"]) for c in counts})
        self.arrays = [np.frombuffer(model[k], kind).reshape(-1, nodes) for k, kind in (("feature", np.int16), ("mask", np.uint64), ("value", np.float64))]

    def scores(self, columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(trees, score of each row) for every wanted number of trees."""
        margin = np.full(columns.shape[1], self.prior)
        for t in range(max(self.counts)):
            margin = margin + leaf_values(*[a[t] for a in self.arrays], columns, self.depth)
            if t + 1 in self.counts:
                yield t + 1, 1 / (1 + np.exp(-margin))


def gathered(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of a task, put together to at least ``SCORED_BATCH`` rows each."""
    held: list[pd.DataFrame] = []
    for frame in source:
        held.append(frame)
        if sum(map(len, held)) >= SCORED_BATCH:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def prefix_scores(coded: DataFrame, models: DataFrame, counts: Sequence[int] | dict[int, int], width: int,
                  keep: Sequence[str]) -> DataFrame:
    """``keep`` and one (n_trees, p) per requested tree count; a dict gives the one count of each slot.

    ``models`` holds one model per slot; their trees (declared numbers and depths) go to every task.
    """
    packed = {r["slot"]: r for r in models.collect()}
    keep = [c for c in coded.columns if c in keep]
    schema = ", ".join(f"{c} {t}" for c, t in coded.dtypes if c in keep)

    def score(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in gathered(source):
            for slot, own in frame.groupby("slot"):
                scorer = Scorer(packed[slot], [counts[slot]] if isinstance(counts, dict) else counts)
                for n, p in scorer.scores(columns_of(unpacked(own.codes, width))):
                    yield own[keep].assign(n_trees=np.int32(n), p=p)

    return spread_rows(coded, len(packed)).mapInPandas(score, f"{schema}, n_trees int, p double")


def every_score(rows: DataFrame, coding: Coding, models: DataFrame) -> DataFrame:
    """(flight_id, slot, p): every row scored by every model, each of which has a slot and all of its trees.

    A row is coded and sent to Python once for all models, and its scores come back as one array.
    """
    packed = sorted(models.collect(), key=lambda r: r["slot"])

    def score(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(model, [model["trees"]]) for model in packed]
        for frame in source:
            columns = columns_of(coding.codes(frame))
            found = [p for scorer in scorers for _, p in scorer.scores(columns)]
            yield pd.DataFrame({"flight_id": frame.flight_id, "scores": list(np.stack(found, axis=1))})

    numbers = [F.col(c).cast("double").alias(c) for c in coding.features]
    dealt = spread_rows(rows.select("flight_id", *numbers), len(packed))
    scored = dealt.mapInPandas(score, "flight_id long, scores array<double>")
    of_slot = F.array(*[F.lit(r["slot"]) for r in packed])
    return scored.select("flight_id", F.posexplode("scores").alias("_at", "p")).select("flight_id", F.get(of_slot, "_at").alias("slot"), "p")


def feature_gains(models: DataFrame, features: Sequence[str]) -> DataFrame:
    """(slot, feature, importance): each feature's share of a model's gains; 0 for one that never splits."""
    def gains(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            for row in frame.itertuples():
                f, gain = np.frombuffer(row.feature, np.int16), np.frombuffer(row.gain, np.float64)
                sums = np.bincount(f[f >= 0], gain[f >= 0], len(features))
                yield pd.DataFrame({"slot": row.slot, "feature": list(features), "importance": sums / (sums.sum() or 1.0)})

    return models.select("slot", "feature", "gain").mapInPandas(gains, "slot int, feature string, importance double")
