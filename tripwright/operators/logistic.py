"""Logistic models of all slots and penalties at once by Newton's method.

The design of a slot comes from its training rows only: medians fill missing numbers, a flag
says where, both are scaled, declared columns become levels with rare ones grouped, raw
high-cardinality codes go. A design row holds its numbers and, for each group of levels, the
column that is 1. Each step is one pass over all rows: tasks send the gradient of every
(slot, C) they met, salted sums meet on the driver, where matrices of the design's width are
solved. A Hessian is summed at the start and wherever steps don't shrink fast; until then the
last one serves. ``C`` is the inverse strength of an L2 penalty on all weights but the
intercept; a step that would raise the penalised loss is halved.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tripwright.operators.boosting import add_partials
from tripwright.storage import materialize

STEPS, TOLERANCE, HALVINGS = 50, 1e-10, 20
# A Hessian is summed anew if a step is more than this share of the one before; a step that can't lower the loss by this share is the last.
SHRINKS, LEAST_GAIN = 0.05, 1e-18


@dataclass(frozen=True)
class Design:
    """What a slot's columns become: (name, fill, flagged, mean, deviation, flag mean, flag deviation) and levels."""
    numbers: tuple[tuple, ...]
    levels: dict[str, tuple[str, ...]]

    @property
    def width(self) -> int:
        return 1 + len(self.numbers) + sum(n[2] for n in self.numbers) + sum(len(v) + 1 for v in self.levels.values())

    def matrix(self, frame: pd.DataFrame) -> np.ndarray:
        """The number of dense columns (in the place of the intercept), their other values, and the column of each level."""
        parts = [np.zeros(len(frame))]
        for name, fill, flagged, mean, deviation, flag_mean, flag_deviation in self.numbers:
            x = frame[name].to_numpy(np.float64, na_value=np.nan)
            missing = np.isnan(x)
            parts.append((np.where(missing, fill, x) - mean) / deviation)
            if flagged:
                parts.append((missing - flag_mean) / flag_deviation)
        parts[0] += len(parts)
        start = len(parts)
        for name, values in self.levels.items():
            at = pd.Index(values).get_indexer(frame[f"level_{name}"])
            parts.append(start + np.where(at < 0, len(values), at))  # a level that is rare or missing (-1) has the last column
            start += len(values) + 1
        return np.stack(parts, axis=1)


def fit_designs(train: DataFrame, numeric: Sequence[str], levels: Sequence[str], min_frequency: int) -> dict[int, Design]:
    """One aggregate for all numbers and one for all levels; a few values per slot and column come back."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for c in numeric:
        x = F.col(c).cast("double")
        aggregates += [F.count(x).alias(f"{c}.n"), F.sum(x).alias(f"{c}.s"), F.sum(x * x).alias(f"{c}.q"),
                       F.percentile_approx(x, 0.5, 20_000).alias(f"{c}.m")]
    values = {}
    if levels:
        entries = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in levels]))
        counted = train.select("slot", entries).filter("value IS NOT NULL").groupBy("slot", "column", "value").agg(F.count(F.lit(1)).alias("n"))
        frequent = counted.filter(F.col("n") >= min_frequency).groupBy("slot", "column").agg(F.sort_array(F.collect_list("value")).alias("values"))
        values = {(r["slot"], r["column"]): tuple(r["values"]) for r in frequent.collect()}  # airlines, months and hours
    designs = {}
    for r in train.groupBy("slot").agg(*aggregates).collect():  # a row for each slot
        n, numbers = r["n"], []
        for c in numeric:
            known = r[f"{c}.n"]
            if not known:  # no value, no median
                continue
            fill, missing = r[f"{c}.m"], n - known
            mean = (r[f"{c}.s"] + missing * fill) / n
            spread = max(r[f"{c}.q"] + missing * fill * fill - n * mean * mean, 0.0)
            share = missing / n
            deviation, flag_deviation = (np.sqrt(v / max(n - 1, 1)) for v in (spread, n * share * (1 - share)))
            numbers.append((c, fill, missing > 0, mean, deviation if deviation > 1e-12 else 1.0, share, flag_deviation or 1.0))
        designs[r["slot"]] = Design(tuple(numbers), {c: values.get((r["slot"], c), ()) for c in levels})
    return designs


def design_rows(rows: DataFrame, designs: dict[int, Design], keep: Sequence[str], numeric: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """``keep`` (slot included) and ``x``: the design row of the slot as packed doubles."""
    keep = [c for c in rows.columns if c in keep]
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in keep)

    def build(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            for slot, own in frame.groupby("slot"):
                matrix = designs[slot].matrix(own)
                yield own[keep].assign(x=[r.tobytes() for r in matrix])

    columns = [*[F.col(c).cast("double").alias(c) for c in numeric if c not in keep],
               *[F.col(c).cast("string").alias(f"level_{c}") for c in levels]]
    return rows.select(*keep, *columns).mapInPandas(build, f"{schema}, x binary")


class Rows:
    """Design rows of one slot: dense columns, and for each group of levels the column that is 1."""

    def __init__(self, packed: pd.Series):
        x = np.frombuffer(b"".join(packed)).reshape(len(packed), -1).copy()
        wide = int(x[0, 0])
        x[:, 0] = 1.0
        self.dense, self.levels = x[:, :wide], [np.ascontiguousarray(c) for c in x[:, wide:].T.astype(np.intp)]

    def probability(self, w: np.ndarray) -> np.ndarray:
        margin = self.dense @ w[:self.dense.shape[1]]
        for level in self.levels:
            margin += w[level]
        return 1 / (1 + np.exp(-margin))

    def gradient(self, v: np.ndarray, width: int) -> np.ndarray:
        """Column sums of the design times ``v``."""
        out = np.append(v @ self.dense, np.zeros(width - self.dense.shape[1]))
        for level in self.levels:
            out += np.bincount(level, v, width)
        return out

    def hessian(self, r: np.ndarray, width: int) -> np.ndarray:
        """The design's products weighted by ``r``: products of numbers, and sums by level and pair of levels."""
        out, wide = np.zeros((width, width)), self.dense.shape[1]
        weighted = np.ascontiguousarray((self.dense * r[:, None]).T)
        out[:wide, :wide] = weighted @ self.dense
        for i, level in enumerate(self.levels):
            low, count = int(level.min()), int(level.max() - level.min()) + 1
            own = level - low
            sums = np.stack([np.bincount(own, column, count) for column in weighted])
            out[:wide, low:low + count] = sums
            out[low:low + count, :wide] = sums.T
            columns = np.arange(low, low + count)
            out[columns, columns] += np.bincount(own, r, count)
            for other in self.levels[:i]:
                base, number = int(other.min()), int(other.max() - other.min()) + 1
                pair = np.bincount(own * number + (other - base), r, count * number).reshape(count, number)
                out[low:low + count, base:base + number] = pair
                out[base:base + number, low:low + count] = pair.T
        return out


def _log_loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return float(-np.sum(np.where(y == 1, np.log(p), np.log1p(-p))))


def _by_slot(rows: DataFrame, measure) -> dict[int, np.ndarray]:
    """Sums over all rows of ``measure(slot, x, y)``, an array per slot."""
    def partial(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in source:
            for slot, own in frame.groupby("slot"):
                found = measure(slot, Rows(own.x), own.y.to_numpy(float))
                held[slot] = held[slot] + found if slot in held else found
        if held:
            yield pd.DataFrame({"slot": list(held), "salt": np.random.randint(0, 32, len(held)), "sums": [v.tobytes() for v in held.values()]})

    sent = rows.select("slot", "x", "y").mapInPandas(partial, "slot int, salt int, sums binary")
    return {r["slot"]: np.frombuffer(r["sums"]) for r in add_partials(sent, ["slot"]).collect()}  # bounded by the designs' widths


class Newton:
    """One model's search: ``at`` is where the next sums are taken, ``wants`` says whether with a Hessian."""

    def __init__(self, width: int, strength: float):
        self.ridge = np.append(0.0, np.full(width - 1, 1 / strength))
        self.at, self.base, self.step = np.zeros(width), np.zeros(width), np.zeros(width)
        self.loss, self.halved, self.done = np.inf, 0, False
        self.curve, self.wants, self.length = None, True, np.inf

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray | None) -> None:
        """Go on from the sums at ``at``; without a Hessian the last one serves."""
        loss += float(self.ridge @ self.at ** 2) / 2
        if loss > self.loss + 1e-9 * abs(self.loss) and self.halved < HALVINGS:
            self.halved += 1
            self.step = self.step / 2
            self.length, self.wants = np.inf, True  # the next step starts with a Hessian of its own
        else:
            self.base, self.loss, self.halved = self.at, loss, 0
            slope = gradient + self.ridge * self.at
            if hessian is not None:
                self.curve = hessian + np.diag(self.ridge)
            self.step = -np.linalg.lstsq(self.curve, slope, rcond=None)[0]
            length, gain = float(np.max(np.abs(self.step))), -float(slope @ self.step)
            self.done = length < TOLERANCE or gain < LEAST_GAIN * abs(loss)
            self.wants, self.length = length > SHRINKS * self.length or not np.isfinite(self.length), length
        self.at = self.base + self.step
        if self.done:
            self.base = self.at


def fit_weights(rows: DataFrame, widths: dict[int, int], strengths: Sequence[float]) -> dict[int, list[np.ndarray]]:
    """Weights of every slot for every C, in the order of ``strengths``."""
    searches = {s: [Newton(w, c) for c in strengths] for s, w in widths.items()}
    for _ in range(STEPS):
        at = {s: [(i, n.at, n.wants) for i, n in enumerate(each) if not n.done] for s, each in searches.items()}
        at = {s: open_ones for s, open_ones in at.items() if open_ones}
        if not at:
            break

        def measure(slot: int, x: Rows, y: np.ndarray, at=at) -> np.ndarray:
            out, width, seen = [], widths[slot], {}
            for _, w, wants in at[slot]:
                key = w.tobytes()
                if key not in seen:  # all penalties start from the same weights
                    p = x.probability(w)
                    hessian = [x.hessian(p * (1 - p), width).ravel()] if wants else []
                    seen[key] = [[_log_loss(y, p)], x.gradient(p - y, width), *hessian]
                out += seen[key]
            return np.concatenate(out)

        for slot, sums in _by_slot(rows.filter(F.col("slot").isin(*at)), measure).items():
            width, start = widths[slot], 0
            for i, _, wants in at[slot]:
                end = start + 1 + width
                hessian = sums[end:end + width * width].reshape(width, width) if wants else None
                searches[slot][i].take(sums[start], sums[start + 1:end], hessian)
                start = end + width * width * wants
    return {s: [n.base for n in each] for s, each in searches.items()}


def mean_losses(rows: DataFrame, weights: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
    """Mean log loss of every slot's rows under each of its weights."""
    def measure(slot: int, x: Rows, y: np.ndarray) -> np.ndarray:
        return np.array([float(len(y)), *[_log_loss(y, x.probability(w)) for w in weights[slot]]])

    return {s: v[1:] / v[0] for s, v in _by_slot(rows, measure).items()}


def scored(rows: DataFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` without their design and with p, by one weight vector per slot."""
    keep = [c for c in rows.columns if c != "x"]
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in keep)

    def score(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            for slot, own in frame.groupby("slot"):
                yield own[keep].assign(p=Rows(own.x).probability(weights[slot]))

    return rows.mapInPandas(score, f"{schema}, p double")


def prepared(encoded: DataFrame, numeric: Sequence[str], levels: Sequence[str], min_frequency: int, keep: Sequence[str]) -> tuple[DataFrame, dict[int, int]]:
    """Design rows of all slots, written once, and each slot's width."""
    designs = fit_designs(encoded.filter("part = 'train'"), numeric, levels, min_frequency)
    rows = materialize(design_rows(encoded, designs, keep, numeric, levels), "design")
    return rows, {s: d.width for s, d in designs.items()}
