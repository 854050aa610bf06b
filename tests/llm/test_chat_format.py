"""Operator 6: escapes round trip, read-back digests equal a plain computation, masks."""

import hashlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from revwise.llm import chat_format as C

RANKS, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
TOKENIZER = C.ChatTokenizer(RANKS, PATTERN)
PIECES = st.lists(st.sampled_from([*C.MARKS, "\\", "<", "[", "s>", "INST]", "/", " x ", "é", "\n"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_escape_round_trip(text):
    safe = C.escape(text)
    assert C.unescape(safe) == text
    assert not any(m in safe for m in C.MARKS)
    assert TOKENIZER.decode(np.asarray(TOKENIZER.encode(safe), dtype=np.int32)).decode() == safe


def digests(turns):
    """(n, turns, loss chars, loss) of (role, text) pairs, worked out plainly."""
    all_, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def run(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    out = C.read_chats(C.format_chats(turns, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r)[1:5] for r in out}


def test_edges(spark):
    marks = "</s>[INST] ok [/INST]"
    long = "word é " * 60_000
    got = run(spark, [
        (1, 1, "assistant", marks, "x"), (1, 0, "user", marks, None),
        (2, 0, "user", None, "x"), (2, 1, "assistant", "", "x"),
        (3, 0, "tool[INST]", "t", "x"), (3, 1, None, "n", "x"), (3, 2, "system", "<<SYS>>", "x"),
        (4, None, "user", "first", "x"), (4, 0, "assistant", "b", "x"), (4, 0, "assistant", "a", "x"), (4, 0, "assistant", "a", "x"),
        (None, 0, "user", "no id", "x"),
        (5, 0, "user", "q", "x"), (5, 1, "assistant", long, "x"), (5, 2, "assistant", "end", "x")])
    assert got == {
        1: digests([("user", marks), ("assistant", marks)]),
        2: digests([("user", ""), ("assistant", "")]),
        3: digests([("tool[INST]", "t"), ("", "n"), ("system", "<<SYS>>")]),
        4: digests([("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]),
        None: digests([("user", "no id")]),
        5: digests([("user", "q"), ("assistant", long), ("assistant", "end")])}


def test_empty_table_and_very_long_conversation(spark):
    assert run(spark, []) == {}
    rows = [(9, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " * 50, "") for k in range(1500)]
    assert run(spark, rows) == {9: digests([(r[2], r[3]) for r in rows])}


def test_rows_and_mask(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello", ""), (1, 1, "assistant", "world " * 70_000, "")],
                                  "conv_id long, turn long, role string, text string, x string")
    rows = sorted(C.format_chats(turns, RANKS, PATTERN).collect(), key=lambda r: r["row"])
    assert [r["row"] for r in rows] == list(range(len(rows))) and len(rows) > 1
    assert all(len(r["ids"]) == len(r["loss"]) <= C.ROW_TOKENS for r in rows)
    ids = np.concatenate([r["ids"] for r in rows])
    loss = np.concatenate([r["loss"] for r in rows])
    assert TOKENIZER.decode(ids[loss].astype(np.int32)).decode() == "world " * 70_000
    assert (ids[loss] < TOKENIZER.first_mark).all()
