"""Operator 8, exact top-k by inner product with a pivot table.

For whole-number vectors q and x, 2 q.x = |q|^2 + |x|^2 - |q - x|^2, so a lower bound of
the distance is an upper bound of the score.  A block's vectors carry their distances to
``PIVOTS`` pivots (vectors of the block that lie far apart); by the triangle inequality the
largest difference |d(q, p) - d(x, p)| over all pivots bounds the distance from below, and
|q| |x| bounds the score as well (the pivot at the origin).  Candidates are evaluated in the
order of their bounds, in batches; a query is done when its k-th best score is above the
bound of the next candidate, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revwise.llm.blocks import finite_vectors, search_blocks, top

PIVOTS = 16
#: Candidates of a query's first batch; each further one is twice as large.
BATCH = 256
#: Bounds are widened by this share, far more than the rounding of their arithmetic.
SLACK = 1e-5
#: Whole numbers up to here are exact in 64-bit floating point.
EXACT = float(1 << 53)


def pivots(vectors: np.ndarray) -> np.ndarray:
    """The origin, then each time the vector farthest from all chosen so far."""
    chosen = [np.zeros(vectors.shape[1])]
    far = np.full(len(vectors), np.inf)
    while len(chosen) < PIVOTS + 1:
        far = np.minimum(far, ((vectors - chosen[-1]) ** 2).sum(axis=1))
        if not far.max() > 0:
            break
        chosen.append(vectors[int(far.argmax())])
    return np.asarray(chosen)


def distances(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((vectors - p) ** 2).sum(axis=1) for p in to], axis=1))


def search_block(ids: np.ndarray, queries: np.ndarray, vec_ids: np.ndarray, vectors: np.ndarray,
                 k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    table_pivots = pivots(vectors)
    of_vectors, of_queries = distances(vectors, table_pivots), distances(queries, table_pivots)
    squares, query_squares = (vectors * vectors).sum(axis=1), (queries * queries).sum(axis=1)
    small = np.abs(vectors).max() * np.abs(queries).max() * vectors.shape[1] < EXACT
    exact = (lambda m: m) if small else np.frompyfunc(int, 1, 1)
    whole = exact(vectors)
    by_pivot = np.ascontiguousarray(of_vectors.T)
    for i, query_id in enumerate(ids):
        apart = np.zeros(len(vec_ids))
        for p, d in zip(by_pivot, of_queries[i], strict=True):
            np.maximum(apart, np.abs(p - d), out=apart)
        bound = (query_squares[i] + squares - apart * apart * (1 - SLACK)) / 2
        bound += SLACK * (query_squares[i] + squares)
        bound[vec_ids == query_id] = -np.inf
        order = np.argsort(-bound)
        order = order[:len(order) - int((vec_ids == query_id).sum())]
        q = exact(queries[i])
        best, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at, size = 0, BATCH
        while at < len(order):
            if len(best) == k and scores[-1] > bound[order[at]]:
                break
            part = order[at:at + size]
            new = whole[part] @ q
            if not small:
                new = np.asarray([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in new], dtype=np.int64)
            best, scores = top(np.append(best, vec_ids[part]), np.append(scores, new.astype(np.int64)), k)
            at, size = at + size, 2 * size
        yield best, scores


def whole_components(x: Column) -> Column:
    return F.floor(x * 64).cast("double")


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the exact ``k`` highest inner products of each query.

    Each component x counts as floor(64 x).  Null and empty vectors and vectors with null or
    non-finite components take no part, neither do rows without an id; a query meets only
    vectors of its own dimension.  All candidates are returned where there are fewer than
    ``k``.  Ties go to the smaller vec_id.  Of rows that repeat a vec_id the one with the
    smallest vector counts.  Scores beyond the range of a long are cut to it.  An empty
    table gives an empty result.
    """
    def search(ids, queries, vec_ids, block):
        return search_block(ids, queries, vec_ids, block, k)
    return search_blocks(finite_vectors(vectors, whole_components), is_query, k, search, "long")
