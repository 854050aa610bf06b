"""Operator 12: every row equals a plain count of all phrases, whatever the first threshold."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from revwise.llm import collocations as K


def brute(docs, top=2000, least=30, covered=80):
    words = defaultdict(Counter)
    for lang, text in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    words["und" if lang is None else lang][tuple(w[i:i + size])] += 1
    out = []
    for lang, f in words.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cands = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        dropped = set()
        for q, c in cands.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    if 100 * c >= covered * cands[q[i:i + size]]:
                        dropped.add(q[i:i + size])
        rows = []
        for p, a in cands.items():
            if p in dropped:
                continue
            score, k = min((K.SCALE * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n, s) for i, (s, a, p, x, y) in enumerate(rows[:top])]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in K.collocations(df, **options).collect())


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "new", "york", "city", "hall", "a", "b", "é", "日本", "x-y", "O'Neil", "\x1c", "\x00"]
    chunks = ["new york city hall", "New York", "a b a b a b", "the of", "日本 é"]
    docs = []
    for _ in range(n):
        parts = [rng.choice(chunks) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for p in parts)
        docs.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return docs


@pytest.mark.parametrize(("seed", "options"), [
    (1, {"top": 5, "first_rank": 1}), (2, {"top": 3, "first_rank": 2}), (3, {"top": 12, "first_rank": 4}),
    (4, {"top": 2000}), (5, {"top": 1, "first_rank": 1})])
def test_any_threshold_gives_the_same_rows(spark, seed, options):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    want = brute(docs, options["top"], 10)
    assert want
    assert mined(df, least=10, **options) == want


def test_small_bit_tables_lose_nothing(spark, monkeypatch):
    docs = corpus(9)
    df = spark.createDataFrame(docs, "lang string, text string")
    real = K.bit_table
    monkeypatch.setattr(K, "bit_table", lambda members: real(members, 64))
    assert mined(df, top=6, least=8, first_rank=3) == brute(docs, 6, 8)


def test_edges(spark):
    schema = "doc_id long, lang string, text string, n string, score int, phrase double, total int"
    docs = [(None, None), ("", "a b " * 40), (None, ""), ("en", None), ("en", "x " * 100 + ". " + "y z, " * 35), ("en", "A B. " * 30),
            ("en", "a b. " * 30), ("und", "p q " * 50), (None, "p q;" * 10), ("long", "one two three four five. " * 5000)]
    df = spark.createDataFrame([(k, lang, t, "x", 1, 0.5, 2) for k, (lang, t) in enumerate(docs)], schema)
    want = brute(docs)
    assert {r[0] for r in want} == {"", "en", "und", "long"}
    assert mined(df) == want
    assert mined(df.limit(0)) == []
    assert mined(df.where("text is null")) == []


def test_scores_are_exact_beyond_64_bits(spark):
    n = 9_000_000_000_000_001
    row = spark.sql(f"select {n}L as n, {n}L as l, {n + 2}L as r").selectExpr(K._per_sum("n", "l", "r") + " as score").first()
    assert row["score"] == K.SCALE * n // (2 * n + 2)


def test_words_keep_their_order_and_pieces():
    import pyarrow as pa
    part = pa.RecordBatch.from_arrays([pa.array(["x", None, "x"]), pa.array(["Ab c,d", "  ", "\te  F.\n"])], ["lang", "text"])
    found = {w.lang: w for w in K.words(part)}
    names = found["x"].names.to_pylist()
    assert [names[k] if k >= 0 else None for k in found["x"].numbers] == [
        "ab", "c", None, "d", None, "e", "f", None, None]
    assert set(found) == {"x"}
    bits = np.zeros(2, dtype=np.uint64)
    assert not K.has(bits, found["x"].hashes()).any()


def test_query_equals_brute_force(spark):
    from revwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    out = QUERIES["op12_collocations"](spark, sf)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert dict(out.dtypes) == {c: "string" if c in ("lang", "phrase") else "bigint" for c in out.columns}
    assert sorted(map(tuple, out.collect())) == brute(docs)
