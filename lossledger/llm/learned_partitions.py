"""Nearest neighbours through learned partitions.

The neighbour graph of a bounded sample is cut into parts of equal size that break few edges
(spectral bisection, then swaps across the cut). A small classifier (one hidden layer) learns
from a vector which parts its neighbours lie in. Every row of the table is filed under its most
probable part; a query visits its `visits` most probable parts and is compared exactly, in
double precision, with all rows filed there. `visits` is the least number that reaches
`TARGET` recall on the rows of the sample that the router did not learn from, as queries and as
candidates, measured against brute force. A query that finds fewer than `k` rows there visits
the other parts too.

Parts are read in blocks: a cell is a block of rows and a block of queries of one part, so a part
that holds a third of all rows (a very common vector) is spread over tasks, and no task depends
on the size of the table. A query's most probable part is searched first; from the cells of the
others only rows that reach its k-th best score leave, `k` at most.

Defined results: rows without an id, and vectors that are null, zero, of another length than
most, or hold a null or a non-finite number, take no part; rows that share an id count as one,
with the least of their vectors; ties go to the smaller id; fewer candidates give fewer rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossledger.llm.common import Scratch

#: Vectors of the sample at most, neighbours in the graph, and units of the hidden layer.
SAMPLE, GRAPH, HIDDEN = 8192, 12, 96
#: Rows for each part (a power of two of parts), and the parts at most.
PART_ROWS, MAX_PARTS = 1024, 256
#: Recall wanted on the held-out part of the sample, the queries that measure it, and one row held out of so many.
TARGET, MEASURED, HELD_OUT = 0.95, 1024, 4
#: Rows and queries of a cell, at most (about).
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096


def neighbours(queries: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
    """Numbers of the k rows of largest inner product with each query, without its own row."""
    out = np.empty((len(queries), k), dtype=np.int64)
    for first in range(0, len(queries), 512):
        s = queries[first : first + 512] @ rows.T
        s[np.arange(len(s)), own[first : first + 512]] = -np.inf
        out[first : first + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halves(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, seed: int) -> np.ndarray:
    """True for the half of `nodes` on one side of a balanced cut; edges are numbers into `nodes`."""
    n = len(nodes)
    x = np.random.default_rng(seed).standard_normal(n)
    degree = np.bincount(src, minlength=n) + 1e-9
    root = np.sqrt(degree)
    for _ in range(60):  # second vector of the normalised adjacency
        x -= root * (x @ root) / (root @ root)
        x = x + np.bincount(src, weights=(x / root)[dst], minlength=n) / root
        x /= np.linalg.norm(x) + 1e-12
    right = np.zeros(n, dtype=bool)
    right[np.argsort(x / root, kind="stable")[n // 2 :]] = True
    for _ in range(8):  # swap the nodes that gain most by changing sides
        other = np.bincount(src, weights=right[src] != right[dst], minlength=n)
        gain = 2 * other - np.bincount(src, minlength=n)
        a = np.flatnonzero(right & (gain > 0))
        b = np.flatnonzero(~right & (gain > 0))
        count = min(len(a), len(b)) // 2
        if not count:
            break
        right[a[np.argsort(-gain[a], kind="stable")[:count]]] = False
        right[b[np.argsort(-gain[b], kind="stable")[:count]]] = True
    return right


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node of a neighbour graph; parts differ by at most one node for each bisection."""
    n = len(graph)
    src = np.repeat(np.arange(n), graph.shape[1])
    dst = graph.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    part = np.zeros(n, dtype=np.int64)
    level = 1
    while level < parts:
        fresh = np.zeros(n, dtype=np.int64)
        for p in range(level):
            nodes = np.flatnonzero(part == p)
            number = np.full(n, -1)
            number[nodes] = np.arange(len(nodes))
            inside = (number[src] >= 0) & (number[dst] >= 0)
            right = _halves(nodes, number[src[inside]], number[dst[inside]], level + p)
            fresh[nodes] = 2 * p + right
        part, level = fresh, 2 * level
    return part


@dataclass(frozen=True)
class Router:
    """Classifier from vectors to parts, and how many parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def _train(x: np.ndarray, target: np.ndarray, epochs: int = 30) -> list[np.ndarray]:
    """Cross entropy to soft targets, by Adam over mini-batches."""
    rng = np.random.default_rng(7)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    d, m = x.shape[1], target.shape[1]
    values = [rng.standard_normal((d, HIDDEN)), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, m)) * 0.1, np.zeros(m)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            some = order[lo : lo + 256]
            w1, b1, w2, b2 = values
            hidden = np.maximum(x[some] @ w1 + b1, 0)
            z = hidden @ w2 + b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - target[some]) / len(some)
            back = (error @ w2.T) * (hidden > 0)
            slopes = [x[some].T @ back, back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                values[i] = values[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return values


def fit(sample: np.ndarray, rows: int, k: int = 20) -> Router:
    """A router for a table of `rows` vectors, from a sample of them in an order by chance."""
    d = sample.shape[1] if len(sample) else 1
    unseen, sample = sample[: len(sample) // HELD_OUT], sample[len(sample) // HELD_OUT :]
    n = len(sample)
    parts = 1
    while parts < MAX_PARTS and parts * PART_ROWS < rows and parts * 32 <= n:
        parts *= 2
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    degree = min(GRAPH, n - 1)
    graph = neighbours(sample, sample, degree, np.arange(n))
    part = balanced_parts(graph, parts)
    target = np.zeros((n, parts))
    for j in range(degree):
        np.add.at(target, (np.arange(n), part[graph[:, j]]), 1 / (degree + 1))
    target[np.arange(n), part] += 1 / (degree + 1)
    router = Router(*_train(sample, target), visits=parts)
    order = router.order(unseen)
    filed = order[:, 0]
    asked = np.arange(0, len(unseen), max(1, len(unseen) // MEASURED))
    truth = neighbours(unseen[asked], unseen, min(k, len(unseen) - 1), asked)
    place = np.argsort(order[asked], axis=1)  # when a query visits each part
    when = np.take_along_axis(place, filed[truth], axis=1)
    visits = next(v for v in range(1, parts + 1) if (when < v).mean() >= TARGET)
    return Router(router.w1, router.b1, router.w2, router.b2, visits)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(vec_id, v) with one finite, non-zero vector of the usual length for each id."""
    v = F.col("embedding").cast("array<double>")
    body = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    body = body.where("vec_id is not null and v is not null").where(sound)
    stored = scratch.store(body.withColumn("d", F.size("v")), "vectors")
    usual = stored.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return stored.drop("d")
    right = stored.where(F.col("d") == usual["d"]).drop("d")
    if right.groupBy("vec_id").count().where("count > 1").limit(1).count():
        right = scratch.store(right.groupBy("vec_id").agg(F.min("v").alias("v")), "single")
    return right


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "learned-partitions")
    rows = usable(vectors, scratch)
    total = rows.count()
    # Bounded: SAMPLE vectors.
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    router = fit(np.array([r.v for r in taken], dtype=np.float64).reshape(len(taken), -1 if taken else 1), total, k)
    sent = spark.sparkContext.broadcast(router)  # fixed size: HIDDEN * (dimensions + parts)

    def file_rows(batches):
        for batch in batches:
            if batch.num_rows:
                order = sent.value.order(_matrix(batch.column("v")))[:, : sent.value.visits]
                parts = pa.ListArray.from_arrays(
                    np.arange(0, order.size + 1, order.shape[1], dtype=np.int32), pa.array(order.astype(np.int32).ravel())
                )
                yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "parts"])

    filed = scratch.store(rows.mapInArrow(file_rows, "vec_id long, v array<double>, parts array<int>"), "filed")
    asked = filed.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "parts")
    sizes = filed.groupBy(F.col("parts")[0].alias("part")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks"))
    routed = asked.select("query_id", "q", F.posexplode("parts").alias("visit", "part"))

    own_block = lambda i, blocks: F.pmod(F.xxhash64(i), F.col(blocks)).cast("int")
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    def blocks(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Blocks of each part for these queries, and the rows in them."""
        loads = routed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
        grid = F.broadcast(scratch.store(sizes.join(loads, "part"), "grid"))  # at most MAX_PARTS rows
        held = filed.select("vec_id", "v", F.col("parts")[0].alias("part")).join(grid, "part")
        return grid, held.select(
            "part", own_block("vec_id", "row_blocks").alias("rb"), every_block("query_blocks").alias("qb"), "vec_id", "v"
        )

    def cell(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(candidates) and len(queries):
            ids = candidates["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, c = ids[order], np.stack(candidates["v"].to_numpy())[order]
            names, q = queries["query_id"].to_numpy(), np.stack(queries["q"].to_numpy())
            bounds = queries["bound"].to_numpy()
            for lo in range(0, len(q), 256):
                scores = q[lo : lo + 256] @ c.T
                for name, bound, s in zip(names[lo : lo + 256], bounds[lo : lo + 256], scores, strict=True):
                    s[ids == name] = -np.inf
                    near = np.flatnonzero((s >= bound) & (s > -np.inf))
                    if len(near) > k:
                        near = near[s[near] >= np.partition(s[near], len(near) - k)[len(near) - k]]
                    near = near[np.argsort(-s[near], kind="stable")[:k]]  # ids ascend, so ties do
                    found.append((np.full(len(near), name), ids[near], s[near]))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pd.DataFrame({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]})

    key = ["part", "rb", "qb"]

    def compare(asked: DataFrame, grid: DataFrame, held: DataFrame) -> DataFrame:
        cells = asked.join(grid, "part").select(
            "part", every_block("row_blocks").alias("rb"), own_block("query_id", "query_blocks").alias("qb"), "query_id", "q", "bound"
        )
        return held.groupBy(*key).cogroup(cells.groupBy(*key)).applyInPandas(cell, "query_id long, vec_id long, score double")

    def nearest(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # The most probable part first: its k-th best is a bound for what the other parts may add.
    below = F.lit(float("-inf"))
    usual = blocks(routed)
    near = scratch.store(nearest(compare(routed.where("visit = 0").withColumn("bound", below), *usual)).drop("rank"), "near")
    bounds = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    bounds = bounds.withColumnRenamed("query_id", "known")
    others = routed.where("visit > 0").join(bounds, F.col("query_id") == F.col("known"), "left")
    more = compare(others.withColumn("bound", F.coalesce("bound", below)), *usual)
    if router.visits == router.parts:
        ranked = nearest(near.unionByName(more))
    else:
        ranked = scratch.store(nearest(near.unionByName(more)), "ranked")
        full = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("full"))
        short = asked.join(full, F.col("query_id") == F.col("full"), "left_anti")
        unvisited = F.array_except(F.sequence(F.lit(0), F.lit(router.parts - 1)), "parts")
        rest = scratch.store(short.select("query_id", "q", F.explode(unvisited).alias("part"), below.alias("bound")), "rest")
        if rest.take(1):
            ranked = nearest(ranked.drop("rank").unionByName(compare(rest, *blocks(rest))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
