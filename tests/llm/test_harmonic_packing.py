"""Operator 13: ids equal the tokenizer's, each id in one piece, sequences without gaps, little padding."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from revwise.llm import harmonic_packing as K
from revwise.llm.segments import cut

PATH = P.path("byte_bpe_50k.json")


def power(n: int) -> bool:
    return n & (n - 1) == 0


def check(rows, docs, capacity=K.CAPACITY) -> tuple[int, int]:
    """Pieces put together give the documents' ids; (tokens, padding) of the sequences."""
    tokenizer = Tokenizer.from_file(PATH)
    expected = sorted(((d is None, d or 0), np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
                      for d, t in docs)
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) > 0
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    tokens = padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        tokens += at
        padding += 0 if power(at) else capacity - at
    # Documents: with equal ids and lengths several rows share a key, so starts are taken in turn.
    found = []
    for (d, n), parts in by_doc.items():
        starts = {}
        for r in parts:
            starts.setdefault(r["start"], []).append(r)
        for _ in range(len(starts[0])):
            at, whole = 0, b""
            while at < n:
                r = starts[at].pop()
                whole += bytes(r["ids"])
                at += r["length"]
            assert at == n
            found.append(((d is None, d or 0), whole))
        assert not any(starts.values())
    assert sorted(found) == expected
    return tokens, padding


def test_class_cuts_are_short_and_fill_their_bins():
    for capacity in (2048, 64, 2, 1):
        table, count = K.class_cuts(capacity)
        assert count.max() <= 6
        for rest in range(capacity):
            sizes = table[rest, :count[rest]]
            assert sizes.sum() == rest and (sizes > 0).all()
            for s in sizes.tolist():
                each = capacity // s
                assert capacity // each == s and capacity - each * s < each


def test_fill_places_whole_bins_only():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([8, 64, 2048])
        sizes = np.asarray([capacity // rng.randint(1, capacity) for _ in range(rng.randint(0, 300))], dtype=np.int64)
        sequence, offset, placed, used = K.fill(sizes, capacity)
        assert set(sequence[placed].tolist()) == set(range(used))
        for s in range(used):
            rows = np.flatnonzero(placed & (sequence == s))
            assert len(set(sizes[rows].tolist())) == 1 and len(rows) == capacity // sizes[rows[0]]
            assert (offset[rows] == np.arange(len(rows)) * sizes[rows[0]]).all()
        for s in set(sizes[~placed].tolist()):
            assert (~placed & (sizes == s)).sum() < capacity // s


def test_rest_has_no_padding():
    rng = random.Random(4)
    for _ in range(100):
        sizes = np.asarray([1 << rng.randint(0, 6) for _ in range(rng.randint(0, 200))], dtype=np.int64)
        sequence, offset, used = K.fill_rest(sizes, 64)
        for s in range(used):
            rows = np.flatnonzero(sequence == s)
            order = rows[np.argsort(offset[rows])]
            assert offset[order].tolist() == (np.cumsum(sizes[order]) - sizes[order]).tolist()
            assert power(int(sizes[rows].sum())) and sizes[rows].sum() <= 64


def test_segments_give_the_whole_text():
    import pyarrow as pa
    rng = random.Random(8)
    alphabet = ["a", "Bc", " ", "  ", "\n", "\t", " ", "▁", "　", "'s", "12", "é", "日", "😀", ".", "\x1c", "​", "<|endoftext|>"]
    texts = [None, "", " ", "   ", "a", " a", "a ", *["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(500)]]
    tokenizer = Tokenizer.from_file(PATH)
    for blank in (False, True):
        found = cut(pa.array(texts), blank)
        for i, t in enumerate(texts):
            parts = [found.names[k] for k in found.numbers[found.starts[i]:found.starts[i + 1]]]
            whole = " " * blank + (t or "")
            assert "".join(parts) == whole
            ids = [k for p in parts for k in tokenizer.encode(p, add_special_tokens=False).ids]
            assert ids == tokenizer.encode(whole, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer():
    import pyarrow as pa
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    names = cut(texts).names
    rng = random.Random(2)
    marks = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA0, 0x180))] + ["\n", "'s", "'ll", " the", "ing", "tion", "\x85"]
    names += ["".join(rng.choices(marks, k=rng.randint(1, 9))) for _ in range(20_000)]
    encoder = K.SegmentIds(PATH, cached=10**7)
    assert encoder.merge
    encoder._learn(names)
    assert sum(K._PLAIN.fullmatch(s) is not None for s in names) > len(names) // 2
    for s, e in zip(names, encoder.tokenizer.encode_batch(names, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.known[s], dtype="<u4").tolist() == e.ids, s
    ids, ends = encoder.encode(pa.array(["a b", None, "<|endoftext|> x"]), 1)
    assert ids[:3].tolist() == [64, 275, 1] and ends.tolist() == [3, 4, len(ids)]


def test_query_packs_all_documents(spark):
    from revwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in K.pack(docs, PATH).collect()]
    tokens, padding = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert padding < tokens / 200
    out = QUERIES["op13_harmonic_packing"](spark, sf)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    key = lambda r: (r["doc_id"], r["start"])
    for got, row in zip(sorted(out.collect(), key=key), sorted(rows, key=key), strict=True):
        assert got["ids_crc32"] == zlib.crc32(row["ids"])
        assert all(got[c] == row[c] for c in ("length", "doc_tokens", "sequence_id", "offset"))


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (3, "other text"), (None, "x"), (None, None), (4, "long words " * 9000),
            (5, "a\x1cb  c <|endoftext|> É é ▁ 😀\n\n x "), (6, "z" * 30_000), (7, " " * 5000), (8, "日本語" * 3000),
            *[(100 + k, "same text") for k in range(50)]]
    rows = spark.createDataFrame([(d, t, k, 0, "x") for k, (d, t) in enumerate(docs)],
                                 "doc_id long, text string, length int, sequence_id int, ids string")
    for parts in (1, 3):
        assert check([r.asDict() for r in K.pack(rows.coalesce(1).repartition(parts), PATH).collect()], docs)[1] < 3000
    assert check([r.asDict() for r in K.pack(rows, PATH, capacity=64, cached=1).collect()], docs, 64)[0] > 0
    assert K.pack(rows.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        K.pack(rows, PATH, capacity=100)


def test_sequences_hold_the_ids(spark, tmp_path):
    docs = spark.createDataFrame([(k, "one two three " * k) for k in range(60)], "doc_id long, text string")
    path = str(tmp_path / "packed")
    K.pack(docs, PATH, capacity=64).write.parquet(path)
    packed = spark.read.parquet(path)
    parts = packed.collect()
    total = 0
    for s in K.sequences(packed, 64).collect():
        mine = sorted((r for r in parts if r["sequence_id"] == s["sequence_id"]), key=lambda r: r["offset"])
        assert bytes(s["ids"]) == b"".join(bytes(r["ids"]) for r in mine)
        assert s["tokens"] * 4 == len(s["ids"]) and s["padded"] == (s["tokens"] if power(s["tokens"]) else 64)
        total += s["tokens"]
    assert total == sum(r["length"] for r in parts)
