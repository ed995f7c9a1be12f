"""Near-duplicate vectors by a pivot-permutation index.

Pivots are vectors of the table, chosen by a hash of their ids: one for ``PER_PIVOT`` distinct vectors, from 32 to
``PIVOTS`` (a bounded sample; every vector is indexed), and thinned so that no two have a cosine of ``_apart`` or more: a
dense group would else have more pivots than a prefix holds, all about as near, and its members would keep different ones.
Fewer pivots only make longer lists. A
vector is described by the ``prefix`` pivots nearest to it, in order. Inverted lists: for each pivot, the vectors that have
it in their prefix. Two vectors that share at least ``shared`` pivots or the nearest one are candidates; their cosine is
verified in double precision, so no link below the threshold is made. A pair is compared only in the list of the first
pivot that both have.

Equal vectors are one entry with a count. Long lists are cut into blocks that are compared with each other, so a task holds
two blocks; a block sends one row for each vector with a link (the number of links) and a spanning forest, not its pairs.
Comparisons in a list grow with the square of a dense group, as its links do.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, as do vectors of different
lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import components, materialize, table
from graphloom.llm.sampling import by_hash

PIVOTS, PER_PIVOT, PREFIX, SHARED, BLOCK = 2048, 400, 10, 4, 4096
#: Cosines to pivots of a group with cosine c correlate by (cosine - c) / (1 - c) for two of its members: 5/6 at the
#: threshold where pivots lie SPREAD times as far apart as linked vectors.
SPREAD = 6


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(threshold: float) -> float:
    """Pivots have a smaller cosine than this with each other."""
    return max(0.5, 1 - SPREAD * (1 - threshold))


def thinned(points: np.ndarray, apart: float) -> np.ndarray:
    """Those unit vectors whose cosine with every earlier one that stays is below ``apart``; the first always stays."""
    kept, n = np.empty_like(points), 0
    for x in points:
        if not n or (kept[:n] @ x).max() < apart:
            kept[n], n = x, n + 1
    return kept[:n]


def _hits(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``pairs`` (len(x) by len(y)) have a cosine of at least ``threshold``; dense by one product, whose doubtful
    last digits are computed pair by pair."""
    hit, count = np.zeros(pairs.shape, dtype=bool), np.count_nonzero(pairs)
    if count * 16 > pairs.size:
        cosine = x @ y.T
        hit = pairs & (cosine >= threshold)
        a, b = np.nonzero(pairs & (np.abs(cosine - threshold) < 1e-9))
    else:
        a, b = np.nonzero(pairs)
    for s in range(0, len(a), 1 << 18):
        i, j = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
        hit[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return hit


def _merge(label: np.ndarray, x: int, to: np.ndarray) -> None:
    """Give the sets of ``x`` and of all of ``to`` one label."""
    if (label[to] != label[x]).any():
        parts = np.unique(np.append(label[to], label[x]))
        label[np.isin(label, parts)] = parts[0]


def _indexed(pivots: dict[int, np.ndarray], prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            masks = [b""] * len(vectors)
            for size in {len(v) for v in vectors}:
                rows = [k for k, v in enumerate(vectors) if len(v) == size]
                u, p = unit(np.array([vectors[k] for k in rows], dtype=np.float64)), pivots.get(size)
                near = np.argsort(-(u @ p.T), axis=1, kind="stable")[:, :prefix] if p is not None else np.zeros((len(rows), 1), dtype=np.int64)
                for k, order in zip(rows, near.astype("<i4")):
                    masks[k] = order.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("count"), batch.column("vector"), pa.array([np.frombuffer(m, dtype="<i4").tolist() for m in masks], pa.list_(pa.int32()))], names=["id", "count", "vector", "order"])

    return run


def _compare(threshold: float, shared: int):
    """Two blocks of a pivot's list (or one with itself): links by vector and a spanning forest."""

    def run(t: pa.Table) -> pa.Table:
        at, i, j = t.column("at")[0].as_py(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        ids, counts, block = (t.column(k).to_numpy() for k in ("id", "count", "block"))
        orders, vectors = t.column("order").to_pylist(), t.column("vector").to_pylist()
        out = []
        for size in sorted({len(v) for v in vectors}):
            rows = np.array([k for k, v in enumerate(vectors) if len(v) == size])
            u = unit(np.array([vectors[k] for k in rows], dtype=np.float64))
            width = 1 + max(max(orders[k]) for k in rows)
            has, nearest = np.zeros((len(rows), width), dtype=np.float32), np.array([orders[k][0] for k in rows])
            for n, k in enumerate(rows):
                has[n, orders[k]] = 1
            least = min(shared, int(has.sum(1).min()))
            weight, links, label = counts[rows].astype(np.float64), np.zeros(len(rows)), np.arange(len(rows))
            right = np.flatnonzero(block[rows] == j)
            for start in range(0, len(rows), 512):
                left = np.arange(start, min(start + 512, len(rows)))
                left = left[block[rows[left]] == i]
                if not len(left):
                    continue
                pairs = (has[left] @ has[right].T >= least) | (nearest[left][:, None] == nearest[right][None, :])
                if at:  # an earlier pivot in common: the pair belongs to that pivot's list
                    pairs &= has[left][:, :at] @ has[right][:, :at].T == 0
                if i == j:
                    pairs &= left[:, None] < right[None, :]
                hit = _hits(u[left], u[right], pairs, threshold)
                links[left] += hit @ weight[right]
                links[right] += weight[left] @ hit
                for n in np.flatnonzero(hit.any(axis=1)):
                    _merge(label, left[n], right[hit[n]])
            linked = np.flatnonzero(links)
            root = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(root, label, ids[rows])
            out.append((ids[rows[linked]], links[linked].astype(np.int64), root[label[linked]]))
        return pa.table({name: pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k, name in enumerate(("id", "n", "root"))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """Per row: id, n_links (other rows whose vectors have a cosine of at least ``threshold`` and were found), component_id
    (least id reachable by links), kept (it is its component's id). Other columns are not read.

    Rows with equal vectors link with each other. Rows that share an id and a vector count each."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.where(usable(F.col("vector")) & F.col("id").isNotNull())
    # -0.0 equals 0.0
    good = good.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    distinct = materialize(good.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("count")), "distinct-vectors")
    n = distinct.count()
    pivots = pivots or min(PIVOTS, max(32, n // PER_PIVOT))
    chosen: dict[int, list] = {}
    for r in sorted(by_hash(distinct, n, pivots, "id").select("id", "vector").collect()):
        chosen.setdefault(len(r["vector"]), []).append(r["vector"])
    points = {n: thinned(unit(np.array(v, dtype=np.float64)), _apart(threshold)) for n, v in chosen.items()}
    indexed = materialize(distinct.mapInArrow(_indexed(points, prefix), "id long, count long, vector array<double>, order array<int>"), "permutations")
    lists = indexed.withColumn("at", F.explode("order"))
    blocks = {r["at"]: math.ceil(r["count"] / BLOCK) for r in lists.groupBy("at").count().collect()}  # one row for each pivot
    number = F.create_map(*[F.lit(x) for pair in (blocks or {0: 1}).items() for x in pair])
    lists = lists.withColumn("blocks", F.element_at(number, F.col("at"))).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = lists.select("at", "i", "j", "block", "id", "count", "vector", "order").groupBy("at", "i", "j").applyInArrow(_compare(threshold, shared), "id long, n long, root long")
    found = materialize(found, "vector-links")
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-components")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    of = distinct.join(linked, "id", "left").join(comps, "id", "left").select("vector", (F.coalesce("n", F.lit(0)) + F.col("count") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    done = good.join(of, "vector").select("id", "n_links", "component_id")
    rest = rows.where(~(usable(F.col("vector")) & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def brute_links(ids: np.ndarray, x: np.ndarray, threshold: float) -> set[tuple[int, int]]:
    """All linked pairs, for measuring recall on small tables."""
    u = unit(x.astype(np.float64))
    a, b = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    return {(int(ids[i]), int(ids[j])) for i, j in zip(a, b)}


QUERIES = {"op2_pivot_near_dedup": op2_pivot_near_dedup}
