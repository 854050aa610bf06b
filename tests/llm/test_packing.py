"""Operator 7: ids equal the tokenizer's, bins are valid, reduction keeps an optimal packing."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from revwise.llm import packing as K

PATH = P.path("word_bpe_49k.json")


def fewest_bins(items: list[int], capacity: int) -> int:
    """Optimal number of bins by search (small instances)."""
    items = sorted(items, reverse=True)
    for bins in itertools.count(-(-sum(items) // capacity)):
        def fits(k: int, room: tuple[int, ...]) -> bool:
            if k == len(items):
                return True
            tried = set()
            for i, r in enumerate(room):
                if r >= items[k] and r not in tried:
                    tried.add(r)
                    if fits(k + 1, (*room[:i], r - items[k], *room[i + 1:])):
                        return True
            return False
        if fits(0, (capacity,) * bins):
            return bins
    return 0


def expand(plan):
    return [[n for n, each in content for _ in range(each)] for content, bins in plan for _ in range(bins)]


def test_dominance_keeps_an_optimum_and_bins_are_valid():
    rng = random.Random(5)
    reduced = 0
    for _ in range(250):
        capacity = rng.choice([20, 33, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        counts = np.bincount(items, minlength=capacity + 1)
        rest = counts.copy()
        fixed = K.reduce_by_dominance(rest, capacity)
        left = [n for n in range(capacity + 1) for _ in range(rest[n])]
        assert sorted(left + [n for b in expand(fixed) for n in b]) == sorted(items)
        assert len(expand(fixed)) + (fewest_bins(left, capacity) if left else 0) == fewest_bins(items, capacity)
        reduced += bool(fixed)
        bins = expand(K.packing_plan(counts, capacity))
        assert sorted(n for b in bins for n in b) == sorted(items)
        assert all(0 < sum(b) <= capacity for b in bins)
        assert len(bins) <= fewest_bins(items, capacity) + 1
    assert reduced > 100


def check(rows, docs, capacity=K.CAPACITY):
    """Every piece once, ids as the tokenizer gives them, sequences without gaps."""
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            expected.append((d, k, at, len(part), zlib.crc32(np.asarray(part, dtype="<u4").tobytes())))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(expected, key=key)
    bins = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values(), default=0) <= capacity
    return bins


def test_query_packs_all_documents(spark):
    from revwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bins = check(QUERIES["op7_best_fit_packing"](spark, sf).collect(), docs)
    assert len(bins) <= -(-sum(bins.values()) // K.CAPACITY) + 1


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "long words " * 9000), (5, "a\x1cb c <|endoftext|> É é"),
            (6, "z" * 30_000), (7, "'ll don't 42nd"), *[(100 + k, "same text") for k in range(50)]]
    rows = spark.createDataFrame([(d, t, k, 0) for k, (d, t) in enumerate(docs)], "doc_id long, text string, length int, sequence_id int")
    check(K.pack(rows, PATH).collect(), docs)
    assert K.pack(rows.limit(0), PATH).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(k, "one two three " * k) for k in range(40)], "doc_id long, text string")
    packed = K.pack(docs, PATH, capacity=64)
    rows = packed.collect()
    pieces = {(r["doc_id"], r["piece"]): bytes(r["ids"]) for r in K.tokenized_pieces(docs, PATH, 64).collect()}
    for s in K.sequences(docs, packed, PATH, 64).collect():
        mine = sorted((r for r in rows if r["sequence_id"] == s["sequence_id"]), key=lambda r: r["offset"])
        assert bytes(s["ids"]) == b"".join(pieces[r["doc_id"], r["piece"]] for r in mine)
        assert s["tokens"] <= 64
