"""Exact top-k inner products from an impact-ordered index, read score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from omicspark.session import cut_lineage

#: Vectors of one part of the index, and queries that read it together.
SHARD_ROWS, QUERY_ROWS = 8192, 1024
#: Quantisation steps between zero and the largest impact of a shard.
IMPACT_STEPS = 32
#: Beyond this a scaled component is cut off, so that products of long vectors still fit a long.
LARGEST = 1 << 24


class ImpactIndex:
    """The postings of a shard in segments of descending quantised impact.

    A component v has the impact h = round(v / step). Segment s holds the postings with |h| between two powers
    of two, largest first; postings with h = 0 have no impact and stand in no segment. ``rest[s]`` is, per
    vector, the length of what the segments from s on and the rounding have not yet added.
    """

    def __init__(self, vectors: np.ndarray, steps: int = IMPACT_STEPS):
        self.vectors = vectors
        step = max(1.0, float(np.abs(vectors).max(initial=0)) / steps)
        impact = np.rint(vectors / step)
        size = np.abs(impact)
        limits = [float("inf")] + [float(2**k) for k in range(int(steps).bit_length() - 1, -1, -1)]
        left = vectors.astype(np.float64)
        self.segments, self.rest = [], [np.linalg.norm(left, axis=1)]
        for high, low in zip(limits, limits[1:]):
            segment = np.where((size >= low) & (size < high), impact * step, 0.0)
            if segment.any():
                left = left - segment
                self.segments.append(segment)
                self.rest.append(np.linalg.norm(left, axis=1))


def search_shard(index: ImpactIndex, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) that hold the k best of each query, ties at the k-th included.

    ``own[q, v]`` is true where v is no candidate of q. A vector's score lies within |q| * rest of its sum so
    far. A query stops when few enough vectors can still reach the k-th largest lower bound, which proves that
    the others are no members; those that can are scored exactly.
    """
    vectors = index.vectors
    norms = np.linalg.norm(queries.astype(np.float64), axis=1)
    sums = np.zeros((len(queries), len(vectors)))
    active = np.arange(len(queries))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    enough = max(8 * k, len(vectors) // 64)
    for s in range(len(index.segments) + 1):
        if s:
            sums[active] += queries[active].astype(np.float64) @ index.segments[s - 1].T
        if not len(active):
            break
        last = s == len(index.segments)
        slack = norms[active, None] * index.rest[s][None, :] + 1e-9 * norms[active, None] * index.rest[0][None, :] + 1e-6
        low = np.where(own[active], -np.inf, sums[active] - slack)
        if low.shape[1] > k:
            limit = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        else:
            limit = np.full(len(active), -np.inf)
        possible = (sums[active] + slack >= limit[:, None]) & ~own[active]
        done = last | (possible.sum(axis=1) <= enough)
        q, v = np.nonzero(possible & done[:, None])
        score = np.empty(len(q), dtype=np.int64)
        for at in range(0, len(q), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] = np.einsum("ij,ij->i", queries[active[q[part]]], vectors[v[part]])
        found.append((active[q], v, score))
        active = active[~done]
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, dims: int) -> np.ndarray:
    taken = column.combine_chunks().take(pa.array(rows))
    return np.asarray(taken.flatten()).astype(np.int64).reshape(len(rows), dims)


def _search(k: int):
    names = ("query_id", "vec_id", "score")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, ...]] = []
        query_dims, vector_dims = np.asarray(left["dims"]), np.asarray(right["dims"])
        for d in np.intersect1d(query_dims, vector_dims):
            q_rows, v_rows = np.flatnonzero(query_dims == d), np.flatnonzero(vector_dims == d)
            query_ids, ids = np.asarray(left["id"])[q_rows], np.asarray(right["id"])[v_rows]
            index = ImpactIndex(_matrix(right["scaled"], v_rows, d))
            queries = _matrix(left["scaled"], q_rows, d)
            q, v, score = search_shard(index, queries, query_ids[:, None] == ids[None, :], k)
            order = np.lexsort((ids[v], -score, q))
            q, v, score = q[order], v[order], score[order]
            starts = np.searchsorted(q, q)
            top = np.arange(len(q)) - starts < k
            parts.append((query_ids[q[top]], ids[v[top]], score[top]))
        whole = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, whole)})

    return run


def top_k(
    vectors: DataFrame,
    k: int = 10,
    query_every: int = 100,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to the smaller id.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``query_every``;
    candidates are all rows with another id, of the same length. The index is built per shard of ``shard_rows``
    vectors and read by blocks of ``query_rows`` queries; each returns at most k rows a query.

    Rows with a null id or vector, an empty vector, or a null or non-finite component take no part. Rows that
    repeat an id are candidates of their own; all vectors of a repeated query id are searched, equal ones once, and
    give one list. Scaled
    components beyond 2^24 count as 2^24. A query without candidates has no rows. Other columns are not read.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    edge = float(LARGEST)
    scaled = F.transform(
        "vector", lambda x: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), x.cast("double") * scale))).cast("int")
    )
    rows = cut_lineage(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        .where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("vector") > 0))
        .select("id", F.size("vector").alias("dims"), scaled.alias("scaled"))
    )
    queries = rows.where(F.col("id") % query_every == 0).distinct()
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    left = queries.select(
        "*",
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    right = rows.select(
        "*",
        F.pmod(F.xxhash64("id", "scaled"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )
    found = (
        left.groupBy("block", "shard")
        .cogroup(right.groupBy("block", "shard"))
        .applyInArrow(_search(k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
