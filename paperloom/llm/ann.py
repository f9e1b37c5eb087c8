"""Nearest neighbours by an inverted multi-index (operator 2).

Vectors are cut into two halves; each half is quantised to its own centroids. A
cell is a pair of centroids. A query walks the cells in order of the summed
distance of its halves, by a heap, until the cells hold enough vectors; these are
ranked again by the exact inner product. Queries go to the index in blocks of
bounded size; the index is never exchanged for them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.skew import top_n
from paperloom.session import cut, spread

CENTROIDS = 64  # of each half
SAMPLE = 20_000  # vectors that the centroids are fitted on: those of the least hashes
ROUNDS = 12
SHARE = 0.55  # of the distinct vectors, which the cells on a query's walk must hold
LEAST = 64  # distinct vectors that a walk holds at least, if there are as many: enough for an answer
QUERY_BLOCK = 8_192  # queries sent to the index at once
MOST_HELD = 1_000_000  # candidates that a task holds before it drops all but k of each query
LANES = 256  # queries compared with a batch at once


@dataclass
class Quantizer:
    """Centroids of both halves, over vectors extended so that distance follows the inner product."""

    halves: list[np.ndarray]
    bound: float  # largest squared norm of a vector


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles. Null ids and vectors, zero vectors,
    and vectors with null or non-finite components do not."""
    v = F.col(vector).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    ok = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return out.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok & F.exists("v", lambda x: x != 0))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds; an empty centroid moves to the point that is worst served."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy() if k else x[:0]
    for _ in range(rounds if k else 0):
        d = ((x**2).sum(1)[:, None] - 2 * x @ c.T) + (c**2).sum(1)
        near = d.argmin(1)
        for j in range(k):
            own = near == j
            c[j] = x[own].mean(0) if own.any() else x[d.min(1).argmax()]
    return c


def extended(v: np.ndarray, bound: float, query: bool = False) -> np.ndarray:
    """One more component, so that all vectors have one norm; 0 for a query."""
    last = np.zeros(len(v)) if query else np.sqrt(np.maximum(bound - (v**2).sum(1), 0))
    return np.concatenate([v, last[:, None]], axis=1)


def split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = v.shape[1] // 2
    return v[:, :half], v[:, half:]


def fit(classes: DataFrame, centroids: int, sample: int = SAMPLE) -> Quantizer:
    """Centroids from at most ``sample`` distinct vectors, those whose hashes are least."""
    bound = classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    keyed = classes.select("v", F.xxhash64("v").alias("h"), "vec_id")
    # The bound is found on hashes and ids alone; only the vectors below it are collected.
    last = keyed.select("h", "vec_id").orderBy("h", "vec_id").limit(sample).agg(F.max(F.struct("h", "vec_id")).alias("m")).first()["m"]
    if last is None:
        return Quantizer([np.zeros((0, 0)), np.zeros((0, 0))], 0.0)
    below = (F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("vec_id") <= last["vec_id"]))
    rows = sorted(keyed.filter(below).collect(), key=lambda r: (r["h"], r["vec_id"]))
    x = extended(np.array([r["v"] for r in rows]), bound)
    return Quantizer([kmeans(part, centroids) for part in split(x)], bound)


def distances(part: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (part**2).sum(1)[:, None] - 2 * part @ c.T + (c**2).sum(1)


def cells_of(v: np.ndarray, q: Quantizer, query: bool = False) -> list[np.ndarray]:
    return [distances(p, c) for p, c in zip(split(extended(v, q.bound, query)), q.halves, strict=True)]


def walk(a: np.ndarray, b: np.ndarray, size: np.ndarray, reach: int) -> float:
    """How far the multi-sequence heap gets: the sum a[i] + b[j] of the cell that fills ``reach``.

    Cells are popped in order of their sum until those popped hold ``reach``
    vectors; the cells on the walk are those with a sum up to the result.
    """
    ia, ib = a.argsort(kind="stable"), b.argsort(kind="stable")
    da, db, grid = a[ia].tolist(), b[ib].tolist(), size[np.ix_(ia, ib)].tolist()
    # A row's next cell enters when the row above has got as far, or further.
    heap, held, far = [(da[0] + db[0], 0, 0)], 0, -np.inf
    while heap and held < reach:
        far, i, j = heapq.heappop(heap)
        held += grid[i][j]
        if j + 1 < len(db):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return far


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def best_of(score: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) pairs of the k largest scores of each row, ties to the smaller first id; -inf takes no part."""
    if score.shape[1] > k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    else:
        edge = np.full(len(score), -np.inf)
    q, e = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
    order = np.lexsort((first[e], -score[q, e], q))
    q, e = q[order], e[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], e[rank < k]


def kept(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best ids of each query."""
    q, near, score = (np.concatenate([h[i] for h in held]) for i in range(3))
    order = np.lexsort((near, -score, q))
    q, near, score = q[order], near[order], score[order]
    ok = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[ok], near[ok], score[ok]


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, query_step: int = 20,
    centroids: int = CENTROIDS, sample: int = SAMPLE, share: float = SHARE,
    least: int = LEAST, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``query_step`` the k nearest found.

    Score is the inner product in doubles; ties go to the smaller id. Equal vectors
    are one entry of the index with their least k + 1 ids, as no more can appear
    in an answer; so copies, however many, fill no cell. A row is never its own
    neighbour; of rows that repeat an id the least vector counts. Vectors must have
    one length: those of another than the commonest (then longest) take no part.
    Every usable row is indexed; the centroids are fitted on a sample. ``share``
    trades work for recall: vectors without clusters need a large one.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = usable(vectors, id_col, vector)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == sizes["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = cut(rows, "vectors")
    # A copy group of any size leaves each salted part as k + 1 ids.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    part = top_n(salted, ["v", "salt"], ["vec_id"], k + 1).groupBy("v", "salt").agg(F.collect_list("vec_id").alias("ids"))
    ids = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1)
    classes = cut(part.groupBy("v").agg(ids.alias("ids")).withColumn("vec_id", F.element_at("ids", 1)), "vector-classes")
    quantizer = fit(classes, centroids, sample)
    shared = spark.sparkContext.broadcast(quantizer)
    shape = tuple(len(h) for h in quantizer.halves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j = (d.argmin(1) for d in cells_of(matrix(b.column("v")), shared.value))
            cell = pa.array(i * shape[1] + j, pa.int64())
            yield pa.RecordBatch.from_arrays([cell, b.column("v"), b.column("ids")], names=["cell", "v", "ids"])

    placed = classes.select("v", "ids").mapInArrow(place, "cell long, v array<double>, ids array<long>")
    # Cells lie together, so most batches are off the walk of most queries.
    index = cut(placed.repartitionByRange("cell", F.xxhash64("v")).sortWithinPartitions("cell"), "vector-cells")
    size = np.zeros(shape[0] * shape[1], np.int64)
    for r in index.groupBy("cell").count().collect():  # one row per cell; their number is fixed
        size[r["cell"]] = r["count"]
    reach = max(int(np.ceil(share * size.sum())), least, k + 1)
    plan = spark.sparkContext.broadcast(size.reshape(shape))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            da, db = cells_of(matrix(b.column("v")), shared.value, query=True)
            far = [walk(da[r], db[r], plan.value, reach) for r in range(len(da))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far, pa.float64())], names=["vec_id", "v", "far"])

    queries = rows.filter(F.col("vec_id") % query_step == 0).select("vec_id", "v")
    queries = cut(spread(queries).mapInArrow(start, "vec_id long, v array<double>, far double"), "vector-queries")
    blocks = -(-queries.count() // query_block)
    found = None
    for n in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).orderBy("vec_id").collect()
        block = (np.array([r["vec_id"] for r in own]), np.array([r["v"] for r in own]), np.array([r["far"] for r in own]))
        asked = spark.sparkContext.broadcast(block)

        def rank(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            who, x, far = asked.value
            da, db = cells_of(x, shared.value, query=True)
            held, n = [], 0  # (query, id, score) arrays; a task keeps k of each query
            for b in batches:
                cell, y = b.column("cell").to_numpy(), matrix(b.column("v"))
                lists = b.column("ids").to_pylist()
                first = np.array([i[0] for i in lists], np.int64)
                for lo in range(0, len(who), LANES):
                    on = slice(lo, lo + LANES)
                    visited = da[on][:, cell // shape[1]] + db[on][:, cell % shape[1]] <= far[on][:, None]
                    if not visited.any():
                        continue
                    score = np.where(visited, x[on] @ y.T, -np.inf)
                    q, e = best_of(score, first, k + 1)  # one of them may be the query itself
                    q += lo
                    exact = np.einsum("ij,ij->i", x[q], y[e])
                    size = np.array([len(lists[c]) for c in e.tolist()], np.int64)
                    near = np.array([i for c in e.tolist() for i in lists[c]], np.int64)
                    q, exact = np.repeat(q, size), np.repeat(exact, size)
                    other = near != who[q]
                    held.append((q[other], near[other], exact[other]))
                    n += int(other.sum())
                    if n > MOST_HELD:
                        held = [kept(held, k)]
                        n = len(held[0][0])
            if held:
                q, near, exact = kept(held, k)
                yield pa.RecordBatch.from_arrays([pa.array(who[q]), pa.array(near), pa.array(exact)], names=["query_id", "vec_id", "score"])

        part = index.mapInArrow(rank, schema)
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], schema) if found is None else found
    best = top_n(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k, "rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
