"""Exact top-k by inner product with KD-trees.

Vectors are dealt into shards; each shard is a KD-tree of median splits whose nodes keep tight bounding boxes. A box bounds
the score of every vector in it: sum of max(q * low, q * high) over the components. A query visits boxes best first and
stops when the best bound left is below its k-th score; equal scores are visited, as ties go to the smaller id.

The k-th score is propagated: the first shard is searched, then the next ones in rounds of eight times as many, each query
starting with the k-th score of all shards before. A task gets a shard's vectors, builds its tree once, and answers the
queries batch by batch as they stream in after them, so it holds one shard and one batch.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, table

K, SHARD, LEAF, SCALE = 10, 8192, 64, 1024
FOUND = "query_id long, vec_id long, score long"


class Tree:
    """Median splits on the widest component, boxes of all nodes in arrays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        self.low, self.high, self.kids, self.span = [], [], [], []
        self.order = np.arange(len(ids))
        self._x = x
        if len(ids):
            self._build(0, len(ids), leaf)
        self.ids, self.x = ids[self.order], x[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        del self._x

    def _build(self, a: int, b: int, leaf: int) -> int:
        own = self._x[self.order[a:b]]
        low, high, k = own.min(0), own.max(0), len(self.kids)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.span.append((a, b))
        axis = int((high - low).argmax())
        if b - a > leaf and high[axis] > low[axis]:
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], half)]
            self.kids[k] = (self._build(a, a + half, leaf), self._build(a + half, b, leaf))
        return k

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest score that each box can hold: q is split by sign."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, q: np.ndarray, bound: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """Up to k (score, id) with scores of at least ``floor``, best first; ``own`` is left out."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        queue = [(-bound[0], 0)] if len(self.ids) else []
        while queue:
            most, node = heapq.heappop(queue)
            if -most < max(floor, best[0][0] if len(best) == k else -math.inf):
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(queue, (-bound[kid], kid))
                continue
            a, b = self.span[node]
            scores = self.x[a:b] @ q
            least = max(floor, best[0][0] if len(best) == k else -math.inf)
            for at in np.flatnonzero(scores >= least).tolist():
                one = (int(scores[at]), -int(self.ids[a + at]))
                if -one[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, matrix of longs) of the vectors of each size."""
    column = batch.column("vector")
    sizes, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.r_[0, sizes])[:-1]
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, flat[starts[rows][:, None] + np.arange(size)].astype(np.int64)


class Shard:
    """Vectors of one shard, and the trees of each size, built when a query first asks."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.trees: dict[tuple[int, type], Tree] = {}
        self.top: dict[int, float] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        ids = batch.column("id").to_numpy()
        for size, rows, x in _by_size(batch):
            self.parts.setdefault(size, []).append((ids[rows], x))

    def tree(self, size: int, top_q: float) -> Tree:
        """In doubles where every sum of products is exact in them, else in Python's integers."""
        x = np.concatenate([x for _, x in self.parts[size]])
        if size not in self.top:
            self.top[size] = float(np.abs(x.astype(np.float64)).max(initial=0.0))
        kind = np.float64 if self.top[size] * top_q * max(1, size) < 2.0**53 else object
        if (size, kind) not in self.trees:
            self.trees[size, kind] = Tree(np.concatenate([i for i, _ in self.parts[size]]), x.astype(kind))
        return self.trees[size, kind]

    def answer(self, batch: pa.RecordBatch, k: int) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        own, floors = batch.column("id").to_numpy(), batch.column("floor").to_pylist()
        for size, rows, y in _by_size(batch):
            if size in self.parts:
                tree = self.tree(size, float(np.abs(y.astype(np.float64)).max(initial=0.0)))
                y = y.astype(tree.x.dtype)
                bounds = tree.bounds(y)
                for n, at in enumerate(rows.tolist()):
                    floor = floors[at] if floors[at] is not None else -math.inf
                    out += [(int(own[at]), i, s) for s, i in tree.search(y[n], bounds[n], int(own[at]), k, floor)]
        return out


def _search(k: int):
    """Rows sorted by shard, vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, Shard()
        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            at = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])]) if len(shards) else []
            for i, j in zip(at, [*at[1:], len(shards)] if len(shards) else []):
                part = batch.slice(i, j - i)
                if shards[i] != number:
                    number, shard = shards[i], Shard()
                if kinds[i] == 0:
                    shard.add(part)
                    continue
                out = shard.answer(part, k)
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows of other ids, ties to the smaller id.

    Vectors are arrays of longs. Null vectors, and null components, take no part; a query is compared with vectors of its
    own length. Every row of ``vectors`` is a candidate, also those that repeat an id; an id asks once, of several vectors
    with the least. Other columns are not read. An empty side gives an empty result."""
    whole = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(True))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(whole("vector") & F.col("id").isNotNull())
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(whole("vector") & F.col("id").isNotNull())
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    shards = max(1, math.ceil(rows.count() / SHARD))
    data = rows.select(F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "vector", F.lit(None).cast("long").alias("floor"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # the partial limit of a ranking runs before its shuffle, so a query's rows come as k a task at most
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def searched(first: int, last: int, floors: DataFrame | None) -> DataFrame:
        own = asked.join(floors, "id", "left") if floors is not None else asked.withColumn("floor", F.lit(None).cast("long"))
        own = own.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shard"), F.lit(1).alias("kind"), "id", "vector", "floor")
        both = data.where(F.col("shard").between(first, last)).unionByName(own)
        return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_search(k), FOUND)

    found, done = searched(0, 0, None), 1
    while done < shards:
        found = materialize(best(found).drop("rank"), "best-so-far")
        floors = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
        last = min(8 * done, shards)
        found = found.union(searched(done, last - 1, floors))
        done = last
    return best(found).select("query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vector of floor(scale * x); without vectors that are null or hold null or non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias(id_col), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias(vector_col))


def op4_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {"op4_kd_tree_top_k": op4_kd_tree_top_k}
ORACLE_SQL = {
    "op4_kd_tree_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""
}
