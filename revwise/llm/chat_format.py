"""Operator 6, chat formatting by token-level assembly.

Every text is encoded on its own by a byte-level tokenizer, and the template's marks are
reserved ids (behind the vocabulary) that are spliced between the encoded texts; no text
can produce one.  Strings of the marks that occur in a text are escaped first, so the
printed form is unambiguous too.  Token offsets and the loss mask come from prefix sums
over the lengths of the spliced pieces: the mask covers the texts of the assistant alone.

A conversation is written as rows of at most ``ROW_TOKENS`` tokens.  Turns are sorted on
their way into the task and stream through it, so a very long conversation is never held.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwise.llm.common import list_array

#: The marks, in the order of their reserved ids.
MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[OUT]"]
#: Marks before and after a text, by role; other roles name themselves between [ROLE] and [/ROLE].
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
TRAINED = "assistant"
ROW_TOKENS = 65_536
#: Texts are encoded in pieces of at most so many characters, which bounds a task's memory.
PIECE_CHARS = 100_000

#: A mark's first character, then backslashes that an escape has put or found there, then its rest.
_RESTS = "|".join(re.escape(m[1:]) for m in sorted(MARKS, key=len, reverse=True) if m[0] == "<")
_SQUARE = "|".join(re.escape(m[1:]) for m in sorted(MARKS, key=len, reverse=True) if m[0] == "[")
_LIKE = re.compile(rf"<(\\*)(?={_RESTS})|\[(\\*)(?={_SQUARE})")


def escape(text: str) -> str:
    """One more backslash behind the first character of everything that looks like a mark."""
    return _LIKE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _LIKE.sub(lambda m: m[0][:-1] if len(m[0]) > 1 else m[0], text)


class ChatTokenizer:
    """Byte-level BPE from a rank file; the marks' ids follow the vocabulary."""

    def __init__(self, ranks: str, pattern: str) -> None:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.first_mark = max(table.values()) + 1
        self.ids = {m: self.first_mark + k for k, m in enumerate(MARKS)}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), PIECE_CHARS):
            out += self.bpe.encode_ordinary(text[at:at + PIECE_CHARS])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bpe.decode_bytes(ids.tolist())


def pieces(tokenizer: ChatTokenizer, role: str, text: str) -> Iterator[tuple[list[int], bool]]:
    """A turn as (ids, under the loss mask) pieces: marks and encoded texts."""
    ids = tokenizer.ids
    if role in TEMPLATE:
        before, after = TEMPLATE[role]
        yield [ids[before]], False
    else:
        yield [ids["[ROLE]"]], False
        yield tokenizer.encode(escape(role)), False
        before, after = "[/ROLE]", "</s>"
        yield [ids[before]], False
    yield tokenizer.encode(escape(text)), role == TRAINED
    yield [ids[after]], False


def _formatted(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ChatTokenizer(ranks, pattern)
        rows: list[tuple[int | None, int, np.ndarray, np.ndarray]] = []
        held: list[tuple[list[int], bool]] = []
        current, row, count, started = None, 0, 0, False

        def flush(end: bool) -> None:
            nonlocal held, row, count
            if end:
                held.append(([tokenizer.ids["</s>"]], False))
            # Offsets of the pieces by prefix sums; the mask is +1 at a trained piece's start, -1 at its end.
            starts = np.concatenate([[0], np.cumsum([len(p) for p, _ in held])])
            ids = np.fromiter((x for p, _ in held for x in p), dtype=np.int32, count=int(starts[-1]))
            edges = np.zeros(len(ids) + 1, dtype=np.int64)
            trained = np.asarray([t for _, t in held], dtype=bool)
            np.add.at(edges, starts[:-1][trained], 1)
            np.add.at(edges, starts[1:][trained], -1)
            mask = np.cumsum(edges)[:-1] > 0
            for at in range(0, len(ids), ROW_TOKENS):
                rows.append((current, row, ids[at:at + ROW_TOKENS], mask[at:at + ROW_TOKENS]))
                row += 1
            held, count = [], 0

        def batch() -> pa.RecordBatch:
            sizes = [len(r[2]) for r in rows]
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 list_array(np.concatenate([r[2] for r in rows]), sizes),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                          pa.array(np.concatenate([r[3] for r in rows])))],
                ["conv_id", "row", "ids", "loss"])
            rows.clear()
            return out
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not started or conv != current:
                    if started:
                        flush(True)
                    current, row, started = conv, 0, True
                    held.append(([tokenizer.ids["<s>"]], False))
                for piece in pieces(tokenizer, role, text):
                    held.append(piece)
                    count += len(piece[0])
                if count >= ROW_TOKENS:
                    flush(False)
                if sum(len(r[2]) for r in rows) >= ROW_TOKENS:
                    yield batch()
        if started:
            flush(True)
        if rows:
            yield batch()
    return run


def format_chats(turns: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(conv_id, row, ids, loss): the token ids of each conversation and its loss mask, in rows.

    ``turns`` holds conv_id, turn, role and text.  Turns go by ``turn`` (nulls first), equal
    ones by role and text; a null text or role is an empty one.  Rows without a conv_id are
    a conversation of their own.  Other columns are not read; an empty table gives an empty
    result.  Rows of a conversation are in one partition, in order.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_formatted(ranks, pattern), "conv_id long, row long, ids array<int>, loss array<boolean>"))


class _Reader:
    """Reads one formatted conversation back, row by row, and digests it."""

    def __init__(self, tokenizer: ChatTokenizer) -> None:
        self.tokenizer = tokenizer
        self.name = {i: m for m, i in tokenizer.ids.items()}
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.role: str | None = None  # of the open turn
        self.naming = False
        self.text: list[np.ndarray] = []
        self.masked: list[np.ndarray] = []

    def add(self, ids: np.ndarray, loss: np.ndarray) -> None:
        at = 0
        for k in [*np.flatnonzero(ids >= self.tokenizer.first_mark), len(ids)]:
            self.text.append(ids[at:k])
            self.masked.append(loss[at:k])
            if k < len(ids):
                self._mark(self.name[int(ids[k])])
            at = k + 1

    def _mark(self, mark: str) -> None:
        ids, loss = np.concatenate(self.text), np.concatenate(self.masked)
        self.text, self.masked = [], []
        printed = self.tokenizer.decode(ids).decode("utf-8")
        self.chars += len(printed) + len(mark)
        opening = {before: role for role, (before, _) in TEMPLATE.items()}
        if self.naming and mark == "[/ROLE]":
            self.role, self.naming = unescape(printed), False
        elif self.role is not None:
            text = unescape(printed)
            self.turns.update(f"{self.role}\n{text}\n".encode())
            self.n_turns += 1
            learnt = unescape(self.tokenizer.decode(ids[loss]).decode("utf-8"))
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)
            self.role = None
        elif mark in opening:
            self.role = opening[mark]
        elif mark == "[ROLE]":
            self.naming = True


def _read(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ChatTokenizer(ranks, pattern)
        done: list[tuple] = []
        reader, current = None, None

        def close() -> None:
            done.append((current, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars,
                         reader.loss.hexdigest(), reader.chars))
        for b in batches:
            ids, loss = b.column("ids"), b.column("loss")
            for i, (conv, row) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("row").to_pylist(), strict=True)):
                if reader is None or conv != current or row == 0:
                    if reader is not None:
                        close()
                    reader, current = _Reader(tokenizer), conv
                reader.add(ids[i].values.to_numpy(), np.asarray(loss[i].values.to_numpy(zero_copy_only=False), dtype=bool))
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(_COLUMNS, zip(*done, strict=True), strict=True)))
                done.clear()
        if reader is not None:
            close()
            yield pa.RecordBatch.from_pydict(dict(zip(_COLUMNS, zip(*done, strict=True), strict=True)))
    return run


_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_chats(formatted: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Digests of each conversation, read back from the rows of ``format_chats`` (in their order)."""
    return formatted.mapInArrow(_read(ranks, pattern), (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
