"""Operator 11: groups, links and counts equal those of whole texts encoded at once."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from revwise.llm import token_alignment as K

FIRST, SECOND = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """The byte-level alphabet, by its published rule."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in kept}
    for k, b in enumerate(b for b in range(256) if b not in kept):
        out[chr(256 + k)] = b
    return out


def brute(texts):
    """(n_a, n_b, groups as lists) of each text, tokens from one call for the whole text."""
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    names = {i: t for t, i in first.get_vocab().items()}
    second = SentencePieceProcessor(model_file=SECOND)
    code = byte_level()
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        data = (" " + t).encode()
        a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
        bytes_a = [bytes(code[c] for c in names[i]) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
                   else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            out.append(None)
            continue

        def ends(parts):
            at, found = 0, []
            for p in parts:
                at += len(p)
                found.append(at)
            return found
        end_a, end_b = ends(bytes_a), ends(bytes_b)
        both = sorted(set(end_a) & set(end_b))
        found, i, k = [], 0, 0
        for e in both:
            j, m = bisect_right(end_a, e), bisect_right(end_b, e)
            found.append((a[i:j], b[k:m]))
            i, k = j, m
        out.append((len(a), len(b), found))
    return out


def expected(docs):
    rows = brute([t for _, t in docs])
    counts = Counter()
    links = []
    for r in rows:
        mine = Counter((x, y) for xs, ys in r[2] for x in xs for y in ys) if r else Counter()
        links.append(mine)
        counts.update(mine.keys())
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (d, _), r, mine in zip(docs, rows, links):
        if r is None:
            out.append((d, 0, 0, 0, 0, "", 0, 0))
            continue
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in r[2])
        out.append((d, r[0], r[1], len(r[2]), sum(mine.values()), hashlib.sha256(text.encode()).hexdigest(),
                    sum(n for p, n in mine.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in mine.items())))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, v) for v in r))


PARTS = ["word", "Tokenizer", "alignment ", " ", "  ", "\n", "\t", "▁", "日本語", "é", "😀", "👨‍👩‍👧", "ȼ", "ﬁ", "12345", "<s>", "</s>",
         "<unk>", "<0x0A>", "<|endoftext|>", "'s", "...", "====", "aaaaaaaaaaaaaaa", "\x00", "\x1c", " ", "　", "ع", "שלום", "¼", " the"]


def test_random_texts(spark):
    rng = random.Random(11)
    docs = [(k, "".join(rng.choices(PARTS, k=rng.randint(1, 25)))) for k in range(400)]
    docs += [(k, " ".join(rng.choices(["the", "of", "nation", "zyx", "naïve", "Ünï"], k=12))) for k in range(400, 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = order(expected(docs))
    assert sum(r[1] == 0 for r in want) > 20 and sum(r[1] > 0 for r in want) > 200
    assert order(K.align(df, FIRST, SECOND).collect()) == want
    assert order(K.align(df, FIRST, SECOND, cached=1, pairs_in_memory=0).collect()) == want


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (3, "c"), (None, "x y"), (None, None), (4, " "), (5, "= " * 3000),
            (6, "z" * 20_000), (7, "=-" * 2000 + "é" * 500), (8, "日" * 1500), (9, "▁"), (10, "long word list " * 4000)]
    rows = spark.createDataFrame([(d, t, k, "n", 0.5) for k, (d, t) in enumerate(docs)],
                                 "doc_id long, text string, pairs int, groups_sha256 string, n_a double")
    assert order(K.align(rows, FIRST, SECOND).collect()) == order(expected(docs))
    assert K.align(rows.limit(0), FIRST, SECOND).count() == 0
    assert K.align(rows.where("text is null"), FIRST, SECOND, pairs_in_memory=-1).count() == 2


def test_large_groups_are_counted_not_listed(monkeypatch):
    import pyarrow as pa
    texts = pa.array(["=-" * 40 + "ꙮ" * 30, "aaaaaaa" * 9, "one two"])
    found = []
    for listed in (K.LISTED, 0):
        monkeypatch.setattr(K, "LISTED", listed)
        aligner = K.Aligner(FIRST, SECOND)
        cut, rows = aligner.segments(texts)
        known = aligner.known.take(rows)
        of = np.repeat(np.arange(len(rows)), known.n_pairs)
        links = Counter()
        for k, p, n in zip(of.tolist(), known.pair.tolist(), known.weight.tolist()):
            links[cut.names[k], p] += n
        found.append((links, known.counts.tolist(), known.groups.to_pylist()))
    assert found[0] == found[1]


def test_whole_texts_where_segments_are_not_allowed():
    import pyarrow as pa
    texts = ["one two  three", None, "", "one two  three", "naïve ▁ x", "日本 語"]
    aligner = K.Aligner(FIRST, SECOND)
    assert aligner.cuttable
    totals = []
    for cuttable in (True, False):
        aligner.cuttable = cuttable
        found, rows = aligner.segments(pa.array(texts))
        counts = aligner.known.counts[rows]
        totals.append([[counts[n].tolist() for n in found.numbers[i:j]] for i, j in zip(found.starts[:-1], found.starts[1:])])
    for parts, (whole,) in zip(*totals):
        assert all(p[0] for p in parts) == whole[0]
        if whole[0]:
            assert [sum(x) for x in list(zip(*parts))[1:]] == list(whole[1:])


def test_groups_are_the_aligned_spans(spark):
    texts = ["naïve 日本 tokens 😀!", "plain words here", "▁"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(K.groups(df, FIRST, SECOND).collect(), key=lambda r: (r["doc_id"], r["group"]))
    for d, r in enumerate(brute(texts)):
        mine = [x for x in rows if x["doc_id"] == d]
        assert [(x["a"], x["b"]) for x in mine] == ([] if r is None else r[2])
        if r:
            assert mine[0]["start"] == 0 and mine[-1]["end"] == len((" " + texts[d]).encode())
            assert all(x["end"] == y["start"] for x, y in zip(mine, mine[1:]))


def test_query_equals_brute_force(spark):
    from revwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op11_token_alignment"](spark, sf)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.columns == names
    want = [(d, na, nb, g, n, b, c, s) for d, na, nb, g, n, s, b, c in expected(docs)]
    assert order(out.collect()) == order(want)


@pytest.mark.parametrize("text", ["ȼx", "日 本", "x\x00y", "👨‍👩‍👧"])
def test_refined_ends_are_bytes(text):
    aligner = K.Aligner(FIRST, SECOND)
    ids_a, _, end_a, ids_b, _, end_b, last, good = aligner.ends([" " + text])
    assert good.all()
    for ids, ends, size in ((ids_a, end_a, aligner.first_length), (ids_b, end_b, aligner.second_length)):
        assert (size[ids].cumsum() == ends).all() and ends[-1] == last[-1]


def test_segments_are_encoded_many_at_once(monkeypatch):
    import pyarrow as pa
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(300)]
    texts += [" ".join(f"w{k}é" for k in range(i, i + 40)) for i in range(0, 1000, 40)] + ["", " ", "  ", "end ", " ﷽ ▁", "a​ b"]
    found = []
    for joined in (1, 7, K.JOINED):
        monkeypatch.setattr(K, "JOINED", joined)
        aligner = K.Aligner(FIRST, SECOND)
        names = aligner.cut(pa.array(texts)).names
        found.append([x.tolist() for x in aligner.ends(names)])
    assert found[0] == found[1] == found[2]

    class Counted:
        def __init__(self, inner):
            self.inner, self.texts = inner, 0

        def encode_batch(self, batch, **more):
            self.texts += len(batch)
            return self.inner.encode_batch(batch, **more)
    aligner.first = Counted(aligner.first)
    cut, _ = aligner.segments(pa.array(texts[300:325]))
    assert len(cut.names) == 1000 and aligner.first.texts <= 10
