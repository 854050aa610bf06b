"""Operator 3 against brute force on whole sets."""

import random
from collections import Counter

import numpy as np
import pytest

from revwise.llm import minmax_dedup as M


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ")
    words = [w for w in words.replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(docs):
    """{doc_id: (set size, component, kept)} over all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d
    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    pairs = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1:]}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def run(spark, docs, extra=""):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, bands string")
    out = M.near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return [tuple(r) for r in out.collect()]


def check(spark, docs):
    got = run(spark, docs)
    assert len(got) == len(docs)
    assert {r[0]: r[1:] for r in got} == brute(docs)


def text(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))


def edited(rng, base, edits):
    words = base.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = text(rng, 1)
    return " ".join(words)


def groups(rng):
    docs = [text(rng, 80) for _ in range(120)]
    base = text(rng, 150)
    docs += [edited(rng, base, rng.randrange(0, 12)) for _ in range(150)]  # around the threshold, many unlinked
    chain = text(rng, 60)
    for _ in range(25):
        chain = edited(rng, chain, 1)
        docs.append(chain)
    docs += [docs[5]] * 90 + [docs[6].upper()] * 3 + [docs[7].replace(" ", "\n\t")]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_groups_of_copies_chains_and_unlinked_neighbours(spark):
    check(spark, groups(random.Random(1)))


@pytest.mark.parametrize("chunk", [1 << 9, 1 << 17])
def test_undecided_buckets_are_searched_whole(spark, monkeypatch, chunk):
    """Without the stars of larger buckets all their links are left to the chunks."""
    monkeypatch.setattr(M, "STAR_ROUNDS", 1)
    monkeypatch.setattr(M, "CHUNK", chunk)
    found = []
    old, pairs = M._chunk_links, M._pairs
    monkeypatch.setattr(M, "_pairs", lambda left, first, percent: pairs(left.where("n <= 2"), first, percent))

    def counted(*args):
        out = old(*args)
        found.append(out.count())
        return out
    monkeypatch.setattr(M, "_chunk_links", counted)
    rng = random.Random(2)
    loose = text(rng, 70)
    docs = groups(rng) + [(1000 + k, edited(rng, loose, 4)) for k in range(60)]
    check(spark, docs)
    assert found[0] > 0


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a b c d e"), (8, "a b c d"),
            (9, "éa É"), (10, "éa é"), (11, text(random.Random(3), 30_000)), (12, "a" * 100_000)]
    check(spark, docs)
    got = run(spark, [*docs, (None, "a b c d e"), (6, "a b c d e"), (None, None)])
    assert Counter(got)[6, 1, 6, True] == 2
    assert Counter(got)[None, 1, None, True] == 1 and Counter(got)[None, 0, None, True] == 1
    assert run(spark, []) == []


def test_signature_is_unbiased():
    """Minimum and maximum both agree with a probability of the similarity."""
    rng = np.random.default_rng(4)
    low, high = [], []
    for _ in range(60):
        u = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = M.signature(np.sort(u[:300])), M.signature(np.sort(u[100:]))  # similarity 200 / 400
        low.append((a[0] == b[0]).mean())
        high.append((a[1] == b[1]).mean())
    assert abs(np.mean(low) - 0.5) < 0.03 and abs(np.mean(high) - 0.5) < 0.03
    assert np.var([(x + y) / 2 for x, y in zip(low, high, strict=True)]) < np.var(low)


def test_query_against_brute_force(spark):
    from revwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op3_near_duplicates"](spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(docs)


def test_no_link_of_small_sets_escapes(spark):
    """Pairs of 7 and 8 words share 3 of 4 shingles; the bands alone miss about one in 600."""
    words = [[f"w{i}x{k}" for k in range(8)] for i in range(6000)]
    docs = [(2 * i + d, " ".join(w[:8 - d])) for i, w in enumerate(words) for d in (0, 1)]
    rows = M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == 12000 and all(r["component_id"] == r["doc_id"] // 2 * 2 for r in rows)


def test_small_keys_hold_every_intersection_of_linked_sets():
    rng = random.Random(5)
    linked = 0
    for _ in range(20000):
        pool = np.array(rng.sample(range(1, 1 << 60), rng.randint(1, 14)), dtype=np.uint64)
        a, b = (np.unique(pool[[rng.random() < 0.9 for _ in pool]]) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        if 0 < max(len(a), len(b)) <= M.SMALL and 100 * shared >= 75 * (len(a) + len(b) - shared):
            linked += 1
            assert len(np.intersect1d(M.small_keys(a), M.small_keys(b)))
    assert linked > 1000 and len(M.small_keys(np.arange(12, dtype=np.uint64))) == 0


def test_texts_under_one_id_are_linked_on_their_own(spark):
    rng = random.Random(31)
    a, b = text(rng, 40), text(rng, 40)
    docs = [(9, a), (9, b), (4, edited(rng, a, 1)), (6, edited(rng, b, 1)), (9, a)]
    got = Counter((r[0], r[2], r[3]) for r in run(spark, docs))
    assert got == Counter({(4, 4, True): 1, (6, 6, True): 1, (9, 4, False): 2, (9, 6, False): 1})
