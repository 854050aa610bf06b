"""Queries against all vectors, in blocks: each task gets one block of queries and one of vectors.

Shared by the vector searches.  Vectors and queries are dealt to blocks by a hash of their
id, so blocks are even whatever the vectors are; vectors of different dimensions never
meet.  A task holds one block pair, whatever the input; the best rows of all blocks are
merged per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Vectors and queries of one block, on average.
VECTOR_BLOCK = 8192
QUERY_BLOCK = 512

#: (query ids, queries, vector ids, vectors) -> for each query its best vector ids and scores.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def finite_vectors(vectors: DataFrame, component: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(vec_id, dim, v): the rows with an id and a vector whose components are all finite.

    Null ids, null and empty vectors, and vectors with a null or non-finite component take
    no part.  Only vec_id and embedding are read, so other columns may have any name.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).select("vec_id", F.size("v").alias("dim"), F.transform("v", component).alias("v"))


def _matrix(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    v = rows.column("v").combine_chunks()
    return rows.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def search_blocks(rows: DataFrame, is_query: Column, k: int, search: Search, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` best candidates of all blocks.

    ``rows`` is (vec_id, dim, v).  Candidates are all rows whose vec_id is not the query's
    own.  Higher scores first, ties to the smaller vec_id.  Of rows that repeat a vec_id the
    one with the smallest vector counts, as a query and as a candidate.
    """
    rows = rows.groupBy("vec_id", "dim").agg(F.min("v").alias("v")) if _repeats(rows) else rows
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks = max(1, -(-n // VECTOR_BLOCK))
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int, salt: int) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        return (df.withColumn(own, F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(parts)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))))
    vectors = dealt(rows, "block", blocks, "query_block", query_blocks, 1)
    queries = dealt(rows.where(is_query), "query_block", query_blocks, "block", blocks, 2)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if len(left) and len(right):
            dim = key[0].as_py()
            ids, q = _matrix(left, dim)
            vec_ids, v = _matrix(right, dim)
            for query_id, (found, scores) in zip(ids, search(ids, q, vec_ids, v), strict=True):
                out_q.append(np.full(len(found), query_id))
                out_v.append(found)
                out_s.append(scores)
        join = (lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, dtype=t))
        return pa.table({"query_id": join(out_q, np.int64), "vec_id": join(out_v, np.int64),
                         "score": join(out_s, np.int64 if score == "long" else np.float64)})
    keys = ["dim", "query_block", "block"]
    found = queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(
        run, f"query_id long, vec_id long, score {score}")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _repeats(rows: DataFrame) -> bool:
    """Whether any vec_id occurs twice."""
    return not rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]
