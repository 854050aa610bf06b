"""Operator 4: targets, apportionment and spans against plain computations."""

from collections import defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from revwise.llm import mixing as M


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    out = M.targets(sizes)
    assert sum(out) == Fraction(3, 2) * sum(sizes)
    assert all(0 <= t <= 2 * n for t, n in zip(out, sizes, strict=True))
    # Sources below their bound are dealt by weight.
    level = {t / (3, 1, 2)[i % 3] for i, (t, n) in enumerate(zip(out, sizes, strict=True)) if t < 2 * n}
    assert len(level) <= 1
    for i, (t, n) in enumerate(zip(out, sizes, strict=True)):
        assert t < 2 * n or not level or t / (3, 1, 2)[i % 3] <= min(level)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(0, 60))
def test_apportionment_takes_the_highest_quotients(wanted, seats):
    got = list(M.apportion([Fraction(w) for w in wanted], [1000] * len(wanted), seats))
    quotients = sorted(((-w / (2 * k + 1), i) for i, w in enumerate(wanted) if w for k in range(seats)))
    assert sorted(got) == sorted(i for _, i in quotients[:seats])


def check(rows, words, shards=M.SHARDS):
    """Whole result against the plan: targets, one cover of each taken block, quotas of each shard."""
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == words(r["text"])
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    block, plans = M.plan([sizes[s] for s in order], shards=shards)
    taken, covered, of_shard = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in rows:
        plan = plans[order.index(r["source"])]
        assert (r["source_size"], r["target"]) == (plan.size, float(plan.target))
        assert sum(s["end"] - s["start"] for s in r["spans"]) <= 2 * r["size"]
        for s in r["spans"]:
            assert 0 <= s["start"] < s["end"] <= r["size"]
            taken[r["source"]] += s["end"] - s["start"]
            covered[r["source"], s["block"], s["epoch"]] += s["end"] - s["start"]
            of_shard[r["source"], s["shard"]].add((s["block"], s["epoch"]))
    for i, source in enumerate(order):
        plan = plans[i]
        mine = {k: n for k, n in covered.items() if k[0] == source}
        assert len(mine) == sum(plan.quotas)
        assert all(n == min(block, plan.size - k[1] * block) for k, n in mine.items())
        assert [len(of_shard[source, j]) for j in range(shards)] == plan.quotas
        assert abs(taken[source] - plan.target) <= 3 * block
    quotas = [sum(p.quotas[j] for p in plans) for j in range(shards)]
    assert not quotas or max(quotas) - min(quotas) <= 1


def count(text):
    return len(M._WORDS.findall(text or ""))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows, count)
    assert sorted(map(str, rows)) == sorted(map(str, M.mix(docs.repartition(5)).collect()))


EDGES = [(1, None, "a", 9), (2, "", "a", 9), (3, " \t\n", None, 9), (4, "one two", None, 9), (None, "x " * 900, "b", 9),
         (5, "y " * 40, "b", 9), (5, "y " * 40, "b", 9), *[(10 + k, "same words here " * 30, "hot", 9) for k in range(200)]]


def test_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, source string, size int")
    rows = M.mix(docs, shards=3).collect()
    assert len(rows) == len(EDGES)
    check(rows, count, 3)
    assert M.mix(docs.limit(0)).count() == 0 and M.mix(docs.limit(0)).columns == M.mix(docs).columns
    nothing = M.mix(docs.where("size = 9 and (text is null or text = '')")).collect()
    assert [(r["size"], r["target"], r["spans"]) for r in nothing] == [(0, 0.0, [])] * 2


def test_mixed_documents_hold_the_words(spark):
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s, _ in EDGES], "doc_id long, text string, source string, n_chars long")
    out = M.mixed_documents(docs, shards=3)
    assert out.columns == docs.columns
    rows = out.collect()
    spans = M.mix(docs, shards=3).collect()
    assert sum(count(r["text"]) for r in rows) == sum(s["end"] - s["start"] for r in spans for s in r["spans"])
    assert all(len(r["text"]) == r["n_chars"] for r in rows)


def test_cut_words():
    assert M.cut_words("a  b\tc d\ne", [(0, 2), (3, 5)]) == "a  b\nd\ne"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=8), st.integers(0, 30_000_000_000))
def test_every_source_is_near_its_target(small, large):
    """Whatever the size of the whole mix, a source misses by at most 1/128 of its own target, or half a word."""
    _, plans = M.plan([*small, large, large // 2, large // 3], shards=4)
    for p in plans:
        # The seats of one epoch take the blocks in the seeded order; only the last block may be short.
        epochs, rest = divmod(sum(p.quotas), max(1, p.blocks))
        last = (p.step * (p.blocks - 1) + p.shift) % max(1, p.blocks)
        short = p.blocks * p.block - p.size if last < rest else 0
        taken = epochs * p.size + rest * p.block - short
        assert abs(taken - p.target) <= max(Fraction(1, 2), p.target / 128)


def test_small_sources_of_a_large_mix_are_taken(spark, monkeypatch):
    """The largest block (here the mix over 64) is far above the small sources."""
    monkeypatch.setattr(M, "BLOCKS", 64)
    rows = [(k, "w " * 1000, "a", 0) for k in range(300)] + [(1000 + k, "v " * 100, "b", 0) for k in range(3)]
    rows += [(2000, "u " * 33, "c", 0), (2001, "t", "d", 0), *[(3000 + k, "s " * 1000, "e", 0) for k in range(300)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got, target = defaultdict(int), {}
    for r in M.mix(docs).collect():
        target[r["source"]] = r["target"]
        got[r["source"]] += sum(s["end"] - s["start"] for s in r["spans"])
    assert [got[s] for s in "bcd"] == [target[s] for s in "bcd"] == [600, 66, 2]
    assert all(abs(got[s] - target[s]) <= max(0.5, target[s] / 128) for s in target)
