"""Approximate nearest neighbours by stable projections and kd-trees.

A Gaussian projection to ``DIMS`` dimensions keeps distances in this sense: the squared
projected distance over the squared true distance is chi-squared with ``DIMS`` degrees of
freedom. Vectors are laid into the cells of a kd-tree over their projections (cut on a
bounded sample), cells into chunks of bounded size, and every chunk builds its own kd-tree.
A query visits leaves by growing projected distance r and verifies the vectors in them
exactly, until the chi-squared distribution says that a vector beyond r is nearer than its
present k-th neighbour with probability at most ``1 - CONFIDENCE``: r^2 / d_k^2 is above
that quantile. It first searches its own cell; the d_k found there tells which other cells
it must visit at all.

Largest inner product becomes nearest point by one more coordinate, sqrt(M^2 - |x|^2) with
M the largest norm, and queries scaled to norm M. Scores are plain inner products of the
original vectors in double precision, summed in the order of the components.

Queries travel in blocks of near cells, index chunks are repeated per block of queries, and
a pair of blocks is one bounded group; no group grows with the data.

Nulls and edges: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without a vec_id, nor vectors of another length than the most frequent one
(the longer at a tie). Of rows that repeat a query's vec_id, the one with the smallest
vector asks, and none answers it. Equal scores go to the smaller vec_id. Fewer candidates than
``k`` are all returned. Empty tables give no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tripwright.llm.common import pick
from tripwright.storage import materialize

DIMS, CONFIDENCE, SEED = 8, 0.97, 17
SAMPLE_ROWS, CELL_ROWS, CHUNK_ROWS, QUERY_ROWS, LEAF_ROWS = 16384, 4096, 8192, 4096, 256
CHI_SQUARED_STEPS = 20000


def chi_squared_quantile(p: float, degrees: int) -> float:
    """By integrating the density of the root, which has no pole, at the middle of each step."""
    step = (degrees ** 0.5 + 12) / CHI_SQUARED_STEPS
    root = (np.arange(CHI_SQUARED_STEPS) + 0.5) * step
    log_density = (degrees - 1) * np.log(root) - root * root / 2 - (degrees / 2 - 1) * log(2) - lgamma(degrees / 2)
    mass = np.cumsum(np.exp(log_density)) * step
    return float(root[min(np.searchsorted(mass, p), len(root) - 1)] ** 2)


@dataclass(frozen=True)
class Index:
    """What every task needs: the projection, the cuts of the cell tree and the largest norm."""

    projection: np.ndarray
    cuts: list[tuple[int, float]]  # a complete tree in breadth-first order: (dimension, value)
    low: np.ndarray  # bounding box of each cell, as wide as the cuts leave it
    high: np.ndarray
    largest: float
    stop: float

    def project(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        norms = np.linalg.norm(vectors, axis=1)
        if queries:
            lifted = np.hstack([vectors * (self.largest / norms)[:, None], np.zeros((len(vectors), 1))])
        else:
            lifted = np.hstack([vectors, np.sqrt(np.maximum(self.largest ** 2 - norms ** 2, 0))[:, None]])
        return lifted @ self.projection

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(int(np.log2(len(self.low)))):
            dim = np.array([c[0] for c in self.cuts])[node]
            value = np.array([c[1] for c in self.cuts])[node]
            node = 2 * node + 1 + (points[np.arange(len(points)), dim] > value)
        return node - len(self.cuts)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0)
        out += gap * gap
    return out


def widest_cut(points: np.ndarray) -> tuple[int, float]:
    if not len(points):
        return 0, 0.0
    dim = int(np.argmax(np.ptp(points, axis=0)))
    return dim, float(np.median(points[:, dim]))


def cell_tree(points: np.ndarray, depth: int) -> tuple[list[tuple[int, float]], np.ndarray, np.ndarray]:
    dims = points.shape[1]
    level = [(points, np.full(dims, -np.inf), np.full(dims, np.inf))]
    cuts: list[tuple[int, float]] = []
    for _ in range(depth):
        below = []
        for part, low, high in level:
            dim, value = widest_cut(part)
            cuts.append((dim, value))
            right = part[:, dim] > value
            upper, lower = high.copy(), low.copy()
            upper[dim], lower[dim] = value, value
            below += [(part[~right], low, upper), (part[right], lower, high)]
        level = below
    return cuts, np.array([b[1] for b in level]), np.array([b[2] for b in level])


def leaves(points: np.ndarray, size: int = LEAF_ROWS) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree."""
    out, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        dim = int(np.argmax(np.ptp(points[rows], axis=0)))
        middle = len(rows) // 2
        order = rows[np.argpartition(points[rows, dim], middle)]
        open_ += [order[:middle], order[middle:]]
    return out


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in component order whatever the batch."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * vectors[:, d]
    return total


def search(index: Index, query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, ids: np.ndarray,
           vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (score, id) of one chunk per query, by incremental projected search.

    ``known`` is the k-th score each query already has elsewhere (-inf: none). Empty places
    have score -inf.
    """
    best = np.full((len(queries), k), -np.inf)
    named = np.full((len(queries), k), np.iinfo(np.int64).max)
    points, asked = index.project(vectors, False), index.project(queries, True)
    groups = leaves(points)
    low = np.array([points[g].min(axis=0) for g in groups])
    high = np.array([points[g].max(axis=0) for g in groups])
    distance = box_distance(asked, low, high)
    order = np.argsort(distance, axis=1, kind="stable")
    norms = np.linalg.norm(queries, axis=1)
    slack = 1e-9 * norms * index.largest
    active = np.arange(len(queries))
    for turn in range(len(groups)):
        leaf = order[active, turn]
        floor = np.maximum(best[active, -1], known[active])
        squared = np.maximum(2 * index.largest ** 2 - 2 * index.largest * floor / norms[active], 0)
        going = ~(distance[active, leaf] > index.stop * squared)
        active, leaf = active[going], leaf[going]
        if not len(active):
            break
        for at in np.unique(leaf):
            mine, rows = active[leaf == at], groups[at]
            rough = queries[mine] @ vectors[rows].T
            floor = np.maximum(best[mine, -1], known[mine]) - slack[mine]
            q, r = np.nonzero((rough >= floor[:, None]) & (ids[rows][None, :] != query_ids[mine][:, None]))
            if not len(q):
                continue
            exact = exact_scores(queries[mine[q]], vectors[rows[r]])
            for i in np.unique(q):
                own = q == i
                scores = np.concatenate((best[mine[i]], exact[own]))
                names = np.concatenate((named[mine[i]], ids[rows[r[own]]]))
                top = np.lexsort((names, -scores))[:k]
                best[mine[i]], named[mine[i]] = scores[top], names[top]
    return best, named


def stacked(column) -> np.ndarray:
    return np.vstack([np.asarray(v, np.float64) for v in column])


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles of one length."""
    rows = pick(table, "vec_id", "embedding").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0].n if lengths else 0))


def fit(rows: DataFrame, dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = SEED) -> tuple[Index, int]:
    """The index's tree, cut on at most ``SAMPLE_ROWS`` vectors, and the number of rows."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    size, largest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not size:
        return Index(np.zeros((0, dims)), [], np.zeros((1, dims)), np.zeros((1, dims)), 0.0, 0.0), 0
    sample = rows.orderBy(F.xxhash64("vec_id"), "v").limit(SAMPLE_ROWS).select("v").collect()
    vectors = stacked(r.v for r in sample)
    projection = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, dims))
    # the length of a vector in Spark and here may differ in the last bit
    index = Index(projection, [], np.zeros((1, dims)), np.zeros((1, dims)), largest * (1 + 1e-12), chi_squared_quantile(confidence, dims))
    depth = max(0, int(np.ceil(np.log2(max(1, size / CELL_ROWS)))))
    depth = min(depth, int(np.log2(max(1, len(vectors) / 16))))
    cuts, low, high = cell_tree(index.project(vectors, False), depth)
    return Index(projection, cuts, low, high, index.largest, index.stop), size


def spread(rows: DataFrame, key: str, part: str, least: int) -> DataFrame:
    """Number the parts of each key so that none holds much more than ``least`` rows."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / least).alias("_parts"))
    mark = (F.monotonically_increasing_id() % F.col("_parts")).cast("int")
    return rows.join(sizes, key).withColumn(part, mark).drop("_parts")


def search_pairs(index: Index, data: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """Search each (cell, chunk, block): (query_id, scores, ids), best first.

    ``asking``: vec_id, v, known, block and the cells to visit; ``data``: vec_id, v, cell, chunk.
    """
    chunks = data.select("cell", "chunk").distinct()
    visits = asking.select("vec_id", "v", "known", "block", F.explode("cells").alias("cell")).join(chunks, "cell")
    wanted = visits.select("cell", "chunk", "block").distinct()
    laid = data.join(wanted, ["cell", "chunk"])

    def one(key, index_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(index_rows) or not len(query_rows):
            return pd.DataFrame({"query_id": [], "scores": [], "ids": []})
        ids, asked = index_rows["vec_id"].to_numpy(), query_rows["vec_id"].to_numpy()
        best, named = search(index, asked, stacked(query_rows["v"]), query_rows["known"].to_numpy(), ids, stacked(index_rows["v"]), k)
        full = (best > -np.inf).sum(axis=1)
        return pd.DataFrame({"query_id": asked, "scores": [b[:n] for b, n in zip(best, full)],
                             "ids": [i[:n] for i, n in zip(named, full)]})[full > 0]

    left = laid.select("vec_id", "v", F.col("cell").alias("_cell"), F.col("chunk").alias("_chunk"), F.col("block").alias("_block"))
    right = visits.select("vec_id", "v", "known", F.col("cell").alias("_at"), F.col("chunk").alias("_of"), F.col("block").alias("_by"))
    return left.groupBy("_cell", "_chunk", "_block").cogroup(right.groupBy("_at", "_of", "_by")).applyInPandas(
        one, "query_id long, scores array<double>, ids array<long>")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """Merge the partial lists of each query: (query_id, best), scores negated for sorting."""
    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("score"), F.col("ids").alias("vec_id"))
    merged = F.flatten(F.collect_list(pairs))
    return found.groupBy("query_id").agg(F.slice(F.array_sort(merged), 1, k).alias("best"))


def map_vectors(rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], list[pa.Array]], schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, *add(vectors, batch)], [*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 20, dims: int = DIMS,
                       confidence: float = CONFIDENCE) -> DataFrame:
    """The ``k`` nearest found of each query row: query_id, rank, vec_id, score."""
    rows = usable(table)
    index, size = fit(rows, dims, confidence)
    placed = map_vectors(rows, lambda v, _: [pa.array(index.cell(index.project(v, False)), pa.int32())],
                         "vec_id long, v array<double>, cell int", ["cell"])
    data = materialize(spread(placed, "cell", "chunk", CHUNK_ROWS), "vectors")

    asking = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = map_vectors(asking, lambda v, _: [pa.array(index.cell(index.project(v, True)), pa.int32())],
                         "vec_id long, v array<double>, home int", ["home"])
    asking = materialize(asking, "asking")
    # blocks of queries from neighbouring cells
    areas = -(-asking.count() // QUERY_ROWS)
    asking = asking.withColumn("area", F.floor(F.col("home") * areas / len(index.low)).cast("int"))
    asking = spread(asking, "area", "part", QUERY_ROWS).withColumn("block", F.struct("area", "part"))
    asking = materialize(asking.select("vec_id", "v", "home", "block"), "queries")

    first = search_pairs(index, data, asking.select(
        "vec_id", "v", F.lit(float("-inf")).alias("known"), "block", F.array("home").alias("cells")), k)
    first = materialize(best_of(first, k), "first-neighbours")

    def others(vectors: np.ndarray, batch: pa.RecordBatch) -> list[pa.Array]:
        known = batch.column(3).to_numpy()
        norms = np.linalg.norm(vectors, axis=1)
        squared = np.maximum(2 * index.largest ** 2 - 2 * index.largest * known / norms, 0)
        near = box_distance(index.project(vectors, True), index.low, index.high) <= index.stop * squared[:, None]
        near[np.arange(len(near)), batch.column(2).to_numpy()] = False
        return [pa.array([np.flatnonzero(n) for n in near], pa.list_(pa.int32()))]

    kth = F.coalesce(-F.get("best", F.lit(k - 1))["score"], F.lit(float("-inf")))
    onward = asking.join(first.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select(
        "vec_id", "v", "home", kth.alias("known"), "block")
    onward = map_vectors(onward, others, "vec_id long, v array<double>, home int, known double, "
                         "block struct<area:int,part:int>, cells array<int>", ["cells"])
    second = search_pairs(index, data, onward, k)
    lists = second.unionByName(first.select(
        "query_id", F.transform("best", lambda b: -b["score"]).alias("scores"), F.transform("best", lambda b: b["vec_id"]).alias("ids")))
    ranked = best_of(lists, k).select("query_id", F.posexplode("best").alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                         (0.0 - F.col("hit.score")).alias("score"))
