"""Exact top-k search by inner product: ball trees and branch and bound.

Vectors are dealt over shards by a hash of their id; a worker builds one ball
tree per shard. A node's ball bounds every inner product below it: with query
q, centre c and radius r it is at most q.c + |q| r. Nodes are visited in the
order of that bound until it falls below the query's k-th best score.

The k-th score is shared: a query is first searched in one shard, and starts
in all others with the k-th score found there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.llm.shared import saved

# Vectors of a shard on average, of a leaf, and queries searched together at most.
SHARD_ROWS = 16_384
LEAF_ROWS = 64
BLOCK = 2_048

HIT = "query_id long, vec_id long, score long"


def quantized(vector: str) -> Column:
    """floor(256 x) of every component; null where one is null or not finite."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.when(fine, F.transform(x, lambda c: F.floor(c.cast("double") * 256)))


class BallTree:
    """A tree over the rows of an integer matrix, as flat arrays."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        points = rows.astype(np.float64)
        self.order = np.arange(len(ids))
        self.low, self.high, self.left, centres, radii = [], [], [], [], []
        waiting = [(0, len(ids))]
        # Nodes are numbered in the order of this queue; children stand side by side.
        for low, high in waiting:
            own = points[self.order[low:high]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            self.low.append(low)
            self.high.append(high)
            centres.append(centre)
            radii.append(away.max())
            if high - low <= LEAF_ROWS or radii[-1] == 0:
                self.left.append(-1)
                continue
            # Along the line between two far points, halved at the median.
            a = own[away.argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            half = (high - low) // 2
            self.order[low:high] = self.order[low:high][np.argpartition(own @ (b - a), half)]
            self.left.append(len(waiting))
            waiting += [(low, low + half), (low + half, high)]
        self.ids, self.rows, self.points = ids[self.order], rows[self.order], points[self.order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.largest = float(np.abs(points).sum(axis=1).max())

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query's place, id, score) of the k best that reach the query's floor."""
        q = queries.astype(np.float64)
        bounds = q @ self.centres.T + np.linalg.norm(q, axis=1)[:, None] * self.radii
        # What rounding may take away from a bound.
        bounds += 1e-9 * (1 + np.abs(bounds)) + 1e-6
        exact = self.largest * float(np.abs(q).max(initial=0)) < 2**53
        for i in range(len(q)):
            best: list[tuple[int, int]] = []  # (score, -id), the worst on top
            floor, heap = floors[i], [(-bounds[i, 0], 0)]
            while heap and -heap[0][0] >= floor:
                node = heapq.heappop(heap)[1]
                left = self.left[node]
                if left >= 0:
                    for child in (left, left + 1):
                        if bounds[i, child] >= floor:
                            heapq.heappush(heap, (-bounds[i, child], child))
                    continue
                part = slice(self.low[node], self.high[node])
                if exact:
                    scores = (self.points[part] @ q[i]).astype(np.int64)
                else:
                    whole = self.rows[part].astype(object) @ queries[i].astype(object)
                    scores = np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)
                for j in np.flatnonzero(scores >= floor):
                    vec, score = int(self.ids[part][j]), int(scores[j])
                    if vec == own[i]:
                        continue
                    item = (score, -vec)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            for score, negative in best:
                yield i, -negative, score


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, tree = None, [], [], None
        waiting: list[tuple] = []

        def answers():
            nonlocal tree
            if ids and waiting:
                tree = tree or BallTree(np.array(ids), np.array(rows, np.int64))
                own = np.array([w[0] for w in waiting])
                floors = np.array([-np.inf if w[2] is None else w[2] for w in waiting])
                found = list(tree.search(np.array([w[1] for w in waiting], np.int64), own, floors, k))
                if found:
                    at, vec, score = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[list(at)]), pa.array(vec, pa.int64()), pa.array(score, pa.int64())],
                        names=["query_id", "vec_id", "score"],
                    )
            waiting.clear()

        # Sorted by shard; a shard's vectors come before its queries.
        for batch in batches:
            for s, is_query, vec, q, floor in zip(*(batch.column(c).to_pylist() for c in ("shard", "is_query", "vec_id", "q", "floor"))):
                if s != shard:
                    yield from answers()
                    shard, ids, rows, tree = s, [], [], None
                if is_query:
                    waiting.append((vec, q, floor))
                    if len(waiting) >= BLOCK:
                        yield from answers()
                else:
                    ids.append(vec)
                    rows.append(q)
        yield from answers()

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Rows (`query_id`, `rank`, `vec_id`, `score`): each query's `k` best other rows, all if fewer.

    Components become floor(256 x); a score is the integer inner product,
    held within a long. Equal scores go by the smaller id. Vectors that are
    null, empty or hold null or non-finite components, and rows without id,
    take no part. Vectors of different length do not meet. Repeated ids are
    candidates of their own; a query skips every row of its own id, and a
    query id that repeats must carry one vector (equal rows ask once).
    An empty table gives no rows.
    """
    rows = saved(
        vectors.select(
            F.col(id_column).cast("long").alias("vec_id"), quantized(vector_column).alias("q"), is_query.alias("asks")
        ).where(F.col("vec_id").isNotNull() & (F.size("q") > 0))
    )
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("dims", F.size("q"))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    stored = dealt.select(
        F.struct("dims", home.alias("no")).alias("shard"), F.lit(False).alias("is_query"), "vec_id", "q",
        F.lit(None).cast("long").alias("floor"),
    )
    asked = dealt.where("asks").select("dims", home.alias("home"), "vec_id", "q").distinct()

    def search(queries: DataFrame) -> DataFrame:
        both = stored.unionByName(queries.select("shard", F.lit(True).alias("is_query"), "vec_id", "q", "floor"))
        laid = both.repartition("shard").sortWithinPartitions("shard", "is_query")
        flat = laid.withColumn("shard", F.concat_ws(":", "shard.dims", "shard.no"))
        return flat.mapInArrow(_search(k), HIT)

    at_home = asked.select(F.struct("dims", F.col("home").alias("no")).alias("shard"), "vec_id", "q", F.lit(None).cast("long").alias("floor"))
    first = saved(search(at_home))
    floors = first.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")
    )
    others = (
        asked.join(floors, F.col("vec_id") == F.col("query_id"), "left")
        .withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .where("no <> home")
        .select(F.struct("dims", "no").alias("shard"), "vec_id", "q", "floor")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = first.unionByName(search(others))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
