"""Operator 10: counts after edits equal a full encoding; only a stretch is encoded again."""

import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from revwise.llm import edit_counts as E

RANKS, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
COUNTS = E.PieceCounts(RANKS, PATTERN)


def full(text: str) -> int:
    return len(COUNTS.bpe.encode_ordinary(text))


def apply(text: str, at: int, removed: int, inserted: str) -> str:
    at = min(max(at, 0), len(text))
    return text[:at] + inserted + text[at + max(removed, 0):]


PART = st.text(alphabet="ab 'lrevst\n\t.9é　", max_size=60)


@settings(max_examples=300, deadline=None)
@given(PART, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 30), st.text(alphabet="a 'lre\n9", max_size=9)), max_size=4))
def test_any_edits_equal_a_full_encoding(text, edits):
    tree = E.SegmentTree(text * 9, COUNTS)
    now = text * 9
    for at, removed, inserted in edits:
        tree.replace(at, removed, inserted)
        now = apply(now, at, removed, inserted)
        assert tree.text == now and tree.total() == full(now) and tree.chars[1] == len(now)


def test_long_text_encodes_only_a_stretch():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefg'", k=rng.randint(1, 9))) for _ in range(30_000))
    tree = E.SegmentTree(text, COUNTS)
    first = tree.encoded
    for _ in range(20):
        at = rng.randrange(len(text))
        tree.replace(at, 5, "new 's")
        text = apply(text, at, 5, "new 's")
    assert tree.total() == full(text)
    assert tree.encoded - first < first / 20


def test_operator_edges(spark):
    rows = [(1, "It is late", [(2, 0, "'s")], 5), (2, None, [(0, 0, "x")], None), (3, "", None, 1),
            (4, "abc", [(99, 5, "!"), None, (None, None, None)], 2), (4, "abc", [(99, 5, "!"), None, (None, None, None)], 2),
            (None, "a" * 200_000, [(100_000, 1, " ")], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:long,removed:long,inserted:string>>, n_edits int")
    out = {(r["doc_id"], r["text"][:12]): r for r in E.count_edited(docs, RANKS, PATTERN).collect()}
    assert len(out) == 5  # the repeated row has an equal answer
    assert out[1, "It's is late"]["tokens_after"] == full("It's is late")
    assert out[2, "x"]["tokens_before"] == 0 and out[3, ""]["n_edits"] == 0
    assert out[4, "abc!"]["n_edits"] == 2
    long = out[None, "a" * 12]
    assert long["tokens_after"] == full("a" * 100_000 + " " + "a" * 99_999)
    assert E.count_edited(docs.limit(0), RANKS, PATTERN).count() == 0


def test_query_against_full_encoding(spark):
    from revwise.llm.queries import EDITS, QUERIES
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op10_edit_counts"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", f"{EDITS} AS e").collect()
    plain = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=COUNTS.bpe._mergeable_ranks, special_tokens={})
    assert len(got) == len(rows)
    for r in rows:
        text = r["text"]
        assert got[r["doc_id"]]["tokens_before"] == len(plain.encode_ordinary(text))
        for e in r["e"]:
            text = apply(text, e["at"], e["removed"], e["inserted"])
        assert got[r["doc_id"]]["tokens_after"] == len(plain.encode_ordinary(text))
        assert got[r["doc_id"]]["chars_after"] == len(text)
