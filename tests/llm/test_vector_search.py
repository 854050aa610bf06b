"""Operators 2 and 8 against brute force."""

import numpy as np
from pyspark.sql import functions as F

from revwise.llm import blocks, collision_ann, pivot_topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def brute(vectors, queries, k, measure):
    """{query: [(vec_id, score)]} of the highest scores, ties to the smaller id."""
    out = {}
    for q in queries:
        pairs = [(-measure(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        out[q] = [(i, -s) for s, i in sorted(pairs)[:k]]
    return out


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "r")
                                  for i, v in vectors], SCHEMA)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def cosine(a, b):
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def stored(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r["vec_id"]: np.asarray(r["embedding"], dtype=np.float64) for r in rows}


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


def test_collision_search_recall(spark):
    from revwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    vectors = stored(spark, sf)
    got = found(QUERIES["op2_collision_search"](spark, sf))
    want = brute(vectors, [i for i in vectors if i % 50 == 0], 5, cosine)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, rows in got.items():
        assert all(abs(s - cosine(vectors[q], vectors[i])) < 1e-12 for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_collision_search_over_several_blocks_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(blocks, "VECTOR_BLOCK", 200)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    vectors = {i: (centres[i % 20] + 0.3 * rng.standard_normal(16)).astype(np.float32).astype(float) for i in range(900)}
    for i in range(0, 900, 3):
        vectors[i] = vectors[0]  # a third of all vectors are one
    got = found(collision_ann.nearest(table(spark, vectors.items()), F.col("vec_id") % 50 == 0, 5))
    want = brute(vectors, [i for i in vectors if i % 50 == 0], 5, cosine)
    assert recall(got, want) >= 0.9
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15]  # ties to the smaller id


BAD = [(1, None), (2, []), (3, [None, 1]), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (None, [1, 1])]


def test_edges_of_both(spark):
    good = [(0, [1, 0]), (50, [1, 0]), (100, [0, 2]), (7, [3, 4]), (7, [3, 4]), (8, [-1, 0]), (200, [1, 2, 3]), (20, [0, 0])]
    df = table(spark, good + BAD)
    near = found(collision_ann.nearest(df, F.col("vec_id") % 50 == 0, 5))
    vectors = {i: np.asarray(v, dtype=float) for i, v in good}
    want = brute({i: v for i, v in vectors.items() if v.any()}, [0, 50, 100, 200], 5, cosine)
    assert near == {q: v for q, v in want.items() if v}  # alone in its dimension: no row
    top = found(pivot_topk.top_k(df, F.col("vec_id") % 20 == 0, 20))
    whole = {i: np.floor(64 * v) for i, v in vectors.items()}
    want = brute(whole, [0, 20, 100, 200], 20, lambda a, b: int(a @ b))
    assert top == {q: v for q, v in want.items() if v}
    for f in (collision_ann.nearest, pivot_topk.top_k):
        assert f(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_pivot_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(blocks, "VECTOR_BLOCK", 300)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 12)) * 3
    vectors = {i: (centres[i % 8] * rng.choice([0.1, 1, 5]) + rng.standard_normal(12)).astype(np.float32).astype(float)
               for i in range(1000)}
    for i in range(0, 1000, 3):
        vectors[i] = vectors[0]
    got = found(pivot_topk.top_k(table(spark, vectors.items()), F.col("vec_id") % 20 == 0, 20))
    whole = {i: np.floor(64 * v) for i, v in vectors.items()}
    assert got == brute(whole, [i for i in vectors if i % 20 == 0], 20, lambda a, b: int(a @ b))


def test_pivot_search_stops_early_and_handles_huge_numbers(spark):
    rng = np.random.default_rng(5)
    vectors = np.floor(rng.standard_normal((4000, 6)) * 40 * rng.exponential(size=(4000, 1)))
    ids, seen = np.arange(4000), []
    top = pivot_topk.top

    def counted(i, s, k):
        seen.append(len(i))
        return top(i, s, k)
    pivot_topk.top = counted
    try:
        list(pivot_topk.search_block(ids[:20], vectors[:20], ids, vectors, 20))
    finally:
        pivot_topk.top = top
    assert sum(seen) < 20 * 4000 / 2
    huge = {0: [1e30, 1.0], 20: [1e15, 3.0], 40: [-1e30, 2.0], 3: [1e10, 1e10]}
    got = found(pivot_topk.top_k(spark.createDataFrame([(i, v) for i, v in huge.items()], "vec_id long, embedding array<double>"),
                                 F.col("vec_id") % 20 == 0, 20))
    cut = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    whole = {i: [float(cut(int(64 * x))) for x in v] for i, v in huge.items()}
    exact = {i: [int(x) for x in v] for i, v in whole.items()}
    for q in (0, 20, 40):
        want = sorted((-cut(sum(a * b for a, b in zip(exact[q], exact[i], strict=True))), i) for i in huge if i != q)
        assert got[q] == [(i, -s) for s, i in want]
