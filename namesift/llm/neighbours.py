"""Nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into partitions of
equal size with few edges between them, and a small network learns in which
partitions the neighbours of a vector lie. Every row is put into the partition
that the network holds most probable; a query is compared with all rows of its
most probable partitions, in double precision. How many partitions that takes is
measured on sample vectors that the network was not fitted to. A query whose
partitions hold too few rows is compared with all.

Partitions follow the number of rows. Where ``PARTITIONS`` would be crowded, each
is cut again, by a graph and a network of its own that a task fits to a bounded
sample of the partition; a query then goes to the inner partitions whose
probabilities, the product of both networks', are largest over all of them.

Rows of a partition and the queries that come to it are cut into blocks, and two
blocks at a time meet in a task, so that neither a crowded partition nor very
many equal vectors make a large group.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stored import stored
from .streams import runs

#: Rows that the partitions and the network are fitted to.
SAMPLE = 6_000
PARTITIONS, NEIGHBOURS = 16, 10
#: Share of the neighbours that the probed partitions must hold, on vectors set aside.
RECALL = 0.95
#: Rows that a partition holds about, and inner partitions of one at most.
PART_ROWS, INNER = 4096, 64
#: Rows and queries of a block.
BLOCK, QUERY_BLOCK = 4096, 1024
HIDDEN, EPOCHS, RATE = 128, 60, 0.003


def nearest(of: np.ndarray, among: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Numbers of the ``k`` nearest rows; ``same`` leaves out a row's own number."""
    k = min(k, len(among) - same)
    out = np.empty((len(of), k), np.int64)
    squares = (among**2).sum(axis=1)
    for start in range(0, len(of), 512):
        part = squares - 2 * of[start : start + 512] @ among.T
        if same:
            part[np.arange(len(part)), np.arange(start, start + len(part))] = np.inf
        out[start : start + 512] = np.argpartition(part, k - 1, axis=1)[:, :k] if k else 0
    return out


def cut_graph(links: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """Part numbers of equal frequency, by halving: along the slowest mode of the graph, at the median."""
    part = np.zeros(len(links), np.int64)
    rng = np.random.default_rng(seed)

    def halve(nodes: np.ndarray, first: int, count: int) -> None:
        part[nodes] = first
        if count < 2 or len(nodes) < 2:
            return
        inside = np.full(len(links), -1)
        inside[nodes] = np.arange(len(nodes))
        to = inside[links[nodes]]
        at, column = np.nonzero(to >= 0)
        to = to[at, column]
        degree = np.bincount(at, minlength=len(nodes)) + np.bincount(to, minlength=len(nodes)) + 1.0
        mode = rng.standard_normal(len(nodes))
        for _ in range(80):
            mode -= (mode * degree).sum() / degree.sum()
            spread = mode + np.bincount(at, mode[to], len(nodes)) + np.bincount(to, mode[at], len(nodes))
            mode = 0.5 * mode + 0.5 * spread / degree
            mode /= np.linalg.norm(mode) + 1e-300
        side = np.zeros(len(nodes), bool)
        side[np.argsort(mode, kind="stable")[len(nodes) // 2 :]] = True
        # Exchange pairs that both gain by it; the halves stay equal.
        for _ in range(10):
            pull = np.bincount(at, np.where(side[to], 1.0, -1.0), len(nodes)) + np.bincount(to, np.where(side[at], 1.0, -1.0), len(nodes))
            gain = np.where(side, -pull, pull)
            a, b = np.flatnonzero(side & (gain > 0)), np.flatnonzero(~side & (gain > 0))
            n = min(len(a), len(b)) // 2
            if not n:
                break
            side[a[np.argsort(-gain[a], kind="stable")[:n]]] = False
            side[b[np.argsort(-gain[b], kind="stable")[:n]]] = True
        halve(nodes[~side], first, count // 2)
        halve(nodes[side], first + count // 2, count - count // 2)

    halve(np.arange(len(links)), 0, parts)
    return part


class Router:
    """A network of one hidden layer that gives each partition's logit."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.scale = 1 / (np.sqrt((x**2).mean()) + 1e-300)
        d, p = x.shape[1], target.shape[1]
        self.weights = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, p)) / np.sqrt(HIDDEN), np.zeros(p)]
        mean, square = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        x, step = x * self.scale, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for start in range(0, len(x), 128):
                rows = order[start : start + 128]
                w1, b1, w2, b2 = self.weights
                hidden = np.maximum(x[rows] @ w1 + b1, 0)
                logits = hidden @ w2 + b2
                e = np.exp(logits - logits.max(axis=1, keepdims=True))
                miss = (e / e.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                back = (miss @ w2.T) * (hidden > 0)
                step += 1
                for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), hidden.T @ miss, miss.sum(axis=0))):
                    g = g + 1e-4 * self.weights[i] * (self.weights[i].ndim > 1)
                    mean[i] += 0.1 * (g - mean[i])
                    square[i] += 0.001 * (g * g - square[i])
                    self.weights[i] = self.weights[i] - RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)

    @classmethod
    def of(cls, scale: float, weights: list[np.ndarray]) -> Router:
        """A router that was fitted before."""
        router = cls.__new__(cls)
        router.scale, router.weights = scale, weights
        return router

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x * self.scale @ w1 + b1, 0) @ w2 + b2

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partition numbers of each row, the most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")

    def placed(self, x: np.ndarray) -> np.ndarray:
        """The partition that each row is put into."""
        return self.ranked(x)[:, 0]


def _logs(router: Router, x: np.ndarray) -> np.ndarray:
    logits = router.logits(x)
    logits = logits - logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


class Nested:
    """Routers of partitions that are cut again, behind the router of the partitions.

    Inner partitions are numbered one partition after another.
    """

    def __init__(self, outer: Router, inner: dict[int, Router]):
        self.outer, self.inner = outer, inner
        sizes = [inner[p].weights[3].size if p in inner else 1 for p in range(PARTITIONS)]
        self.first = np.concatenate(([0], np.cumsum(sizes)))

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Inner partition numbers of each row, the most probable first."""
        outer = _logs(self.outer, x)
        columns = [outer[:, [p]] + _logs(self.inner[p], x) if p in self.inner else outer[:, [p]] for p in range(PARTITIONS)]
        return np.argsort(-np.concatenate(columns, axis=1), axis=1, kind="stable")

    def placed(self, x: np.ndarray) -> np.ndarray:
        """The most probable inner partition of the most probable partition."""
        outer = self.outer.placed(x)
        found = self.first[outer].copy()
        for p, router in self.inner.items():
            rows = np.flatnonzero(outer == p)
            if rows.size:
                found[rows] += router.placed(x[rows])
        return found


def _distinct(sample: np.ndarray) -> np.ndarray:
    rows = np.unique(sample, axis=0)
    return rows[np.random.default_rng(3).permutation(len(rows))]


def learn(known: np.ndarray, parts: int) -> Router:
    """A router to ``parts`` partitions of the graph of the nearest neighbours of different rows."""
    links = nearest(known, known, NEIGHBOURS, True)
    part = cut_graph(links, parts)
    near = np.concatenate((links, np.arange(len(known))[:, None]), axis=1)
    target = np.zeros((len(known), parts))
    np.add.at(target, (np.repeat(np.arange(len(known)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    return Router(known, target)


def probes_for(router: Router | Nested, tests: np.ndarray, known: np.ndarray) -> int:
    """How many partitions to probe, so that they hold ``RECALL`` of the neighbours of ``tests`` among ``known``."""
    placed = router.placed(known)
    truth = nearest(tests, known, NEIGHBOURS, False)
    place_of = np.argsort(router.ranked(tests), axis=1)
    depth = np.sort(np.take_along_axis(place_of, placed[truth], axis=1).ravel())
    return 1 + int(depth[min(len(depth) - 1, int(np.ceil(RECALL * len(depth))) - 1)])


def fit(sample: np.ndarray) -> tuple[Router, int]:
    """The router and the number of partitions to probe."""
    rows = _distinct(sample)
    aside = len(rows) // 6
    router = learn(rows[aside:], PARTITIONS)
    return router, probes_for(router, rows[:aside], rows[aside:]) if aside else PARTITIONS


def fit_inside(index: DataFrame, outer: Router, size: int) -> Nested:
    """Routers for the partitions with more than ``PART_ROWS`` rows, each fitted by a task to about ``SAMPLE`` of them."""
    counts = index.groupBy("part").agg(F.count("*").alias("rows")).filter(F.col("rows") > PART_ROWS)
    share = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 30)) < F.col("rows").cast("double") ** -1 * (SAMPLE * float(1 << 30))
    sample = index.join(F.broadcast(counts), "part").filter(share).select("part", "rows", "vector")

    def learned(frame: pd.DataFrame) -> pd.DataFrame:
        known = _distinct(np.array(frame["vector"].tolist(), float).reshape(-1, size)[: 2 * SAMPLE])
        wanted = 1 << int(np.ceil(np.log2(frame["rows"].iloc[0] / PART_ROWS)))
        parts = min(INNER, wanted, 1 << int(np.log2(max(1, len(known) / 32))))
        router = learn(known, parts) if parts > 1 else None
        state = pickle.dumps((router.scale, router.weights)) if router else None
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "router": [state]})

    found = sample.groupBy("part").applyInPandas(learned, "part int, router binary").filter("router is not null").collect()
    return Nested(outer, {r.part: Router.of(*pickle.loads(r.router)) for r in found})


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _route(router: Router | Nested, size: int, probes: int) -> Callable:
    """Rows with their most probable partitions as a list; for one, the partition they are put into."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"), size)
                ranked = (router.placed(x)[:, None] if probes == 1 else router.ranked(x)[:, :probes]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ranked) + 1, dtype=np.int32) * probes), pa.array(ranked.ravel()))
                yield pa.record_batch([batch.column("vec_id"), batch.column("vector"), lists], ["vec_id", "vector", "parts"])

    return run


def _rerank(size: int, k: int) -> Callable:
    """The nearest ``k`` rows of a block for each query of a block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["part", "block", "query_block"]):
            vec_id, is_query = (group.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "is_query"))
            vectors = _matrix(group.column("vector"), size)
            queries, rows = np.flatnonzero(is_query), np.flatnonzero(~is_query)
            for q in queries:
                score = np.sqrt(((vectors[rows] - vectors[q]) ** 2).sum(axis=1))
                other = vec_id[rows] != vec_id[q]
                ids, score = vec_id[rows][other], score[other]
                best = np.lexsort((ids, score))[:k]
                yield pa.record_batch([pa.array(np.full(len(best), vec_id[q])), pa.array(ids[best]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    return run


class Search:
    """The index of a table, the queries with the partitions they are sent to, and what is needed to compare them."""

    def __init__(self, vectors: DataFrame, every: int, id_column: str, vector_column: str):
        vector = vectors[vector_column].cast("array<double>")
        rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vector.alias("vector"))
        finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        usable = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
        sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).select("vector").collect()
        sizes = [len(r[0]) for r in sample]
        self.size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
        fitting = np.array([r[0] for r in sample if len(r[0]) == self.size], float).reshape(-1, max(self.size, 1))
        # Too few different vectors tell no partitions apart: one for all then.
        self.route, self.probes, self.partitions = None, 1, 1
        if len(np.unique(fitting, axis=0)) >= 2 * PARTITIONS:
            self.route, self.probes = fit(fitting)
            self.partitions = PARTITIONS
        usable = usable.filter(F.size("vector") == self.size)
        self.index = stored(self._parts(usable, 1).select("vec_id", "vector", F.col("parts")[0].alias("part")))
        if self.route is not None and self.index.count() > PARTITIONS * PART_ROWS:
            nested = fit_inside(self.index, self.route, self.size)
            if nested.inner:
                known = _distinct(fitting)
                aside = len(known) // 6
                self.route, self.partitions = nested, int(nested.first[-1])
                self.probes = probes_for(nested, known[:aside], known[aside:])
                self.index = stored(self._parts(self.index.select("vec_id", "vector"), 1).select("vec_id", "vector", F.col("parts")[0].alias("part")))
        queries = usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        self.asked = stored(self._parts(queries, self.probes).select("vec_id", "vector", F.explode("parts").alias("part")))

    def _parts(self, table: DataFrame, count: int) -> DataFrame:
        if self.route is None:
            return table.withColumn("parts", F.array(F.lit(0)))
        return table.mapInArrow(_route(self.route, self.size, count), "vec_id long, vector array<double>, parts array<int>")

    def scanned(self) -> float:
        """The share of the rows that a query is compared with, on average."""
        sizes = self.index.groupBy("part").agg(F.count("*").alias("rows"))
        pairs = self.asked.join(sizes, "part").agg(F.sum("rows")).first()[0] or 0
        return pairs / max(1, self.index.count() * self.asked.select("vec_id").distinct().count())


def nearest_vectors(vectors: DataFrame, every: int = 100, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows with another id. The score is the Euclidean distance of the original
    vectors; ties go to the smaller id. Rows without id, and vectors that are
    null, empty or zero, hold null, NaN or infinity, or have another length than
    most of the sample take no part. Rows that repeat are repeated among the
    candidates; a repeated query counts once, as its first vector. Without two
    usable rows nothing is found.
    """
    search = Search(vectors, every, id_column, vector_column)
    index, asked, size = search.index, search.asked, search.size
    found = "query_id long, vec_id long, score double"

    def blocks(table: DataFrame, rows_each: int, name: str) -> DataFrame:
        """For each partition, the number of blocks; there are ``PARTITIONS`` times ``INNER`` partitions at most."""
        return F.broadcast(table.groupBy("part").agg(F.ceil(F.count("*") / rows_each).cast("int").alias(name)))

    def ranked(asked: DataFrame) -> DataFrame:
        """The nearest ``k`` rows of each block for the queries that come to it."""
        grid = blocks(index, BLOCK, "_blocks").join(blocks(asked, QUERY_BLOCK, "_queries"), "part")
        every_block = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block")
        every_query = F.explode(F.sequence(F.lit(0), F.col("_queries") - 1)).alias("query_block")
        own = lambda count: F.pmod(F.xxhash64("vec_id"), F.col(count)).cast("int")
        left = index.join(F.broadcast(grid), "part").select("part", own("_blocks").alias("block"), every_query, F.lit(False).alias("is_query"), "vec_id", "vector")
        right = asked.join(F.broadcast(grid), "part").select("part", every_block, own("_queries").alias("query_block"), F.lit(True).alias("is_query"), "vec_id", "vector")
        keys = ["part", "block", "query_block"]
        met = left.union(right.select(left.columns)).repartition(*keys).sortWithinPartitions(*keys)
        return met.mapInArrow(_rerank(size, k), found)

    near = ranked(asked)
    if search.route is not None and search.probes < search.partitions:
        # Where the probed partitions hold fewer than k candidates, all are asked.
        near = stored(near)
        full = near.groupBy("query_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= k).select("query_id")
        short = asked.join(full, F.col("vec_id") == F.col("query_id"), "left_anti").select("vec_id", "vector").distinct()
        again = stored(short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(search.partitions - 1)))))
        near = near.join(full, "query_id", "left_semi").select("query_id", "vec_id", "score").union(ranked(again))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
