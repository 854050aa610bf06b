"""Operator 13, harmonic packing: bins of k pieces of a k-th of the capacity, filled by each worker alone.

Lengths fall into reciprocal classes: class k takes pieces of ``capacity // k`` tokens,
``k`` of which fill a sequence.  A document that fits no class exactly is cut: first whole
sequences, then of what is left always the largest class it reaches; the rest shrinks
about quadratically (at most 6 pieces at a capacity of 2048, 3 or 4 as a rule), and a full
sequence of class k lacks less than k tokens.  Every class has a fixed count for its
sequences, so a piece's place follows from its number within its class alone: a worker
needs no length of any other worker, and nothing is shuffled.

What does not fill a sequence at the end of a worker's rows (less than a sequence for each
class, about 90 classes) is cut once more, into powers of two.  These are the classes whose
sequences have no room left, and a sequence that stays short there is split by the binary
digits of its count into sequences of 1, 2, 4, ... tokens, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwise.llm.common import slices
from revwise.llm.segments import byte_level_bytes, cut, spread

CAPACITY = 2048
END_ID = 1
#: Segments whose ids a task remembers (about 250 bytes each).
CACHED = 300_000
#: Text taken at a time.
SLICE = 4 << 20

_COLUMNS = ["doc_id", "start", "length", "doc_tokens", "ids"]


#: Segments of these characters alone are cut into words alike by both libraries (see ``SegmentIds``).
_PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
#: The pattern by which byte-level tokenizers of this kind cut texts into words.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of the tokens of a byte-level tokenizer, if its ids are the ranks of its merges."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model, cut_by = rules["model"], rules["pre_tokenizer"] or {}
    added = {t["content"] for t in rules["added_tokens"]}
    plain = (rules["normalizer"] is None and cut_by.get("type") == "ByteLevel" and cut_by.get("use_regex")
             and not cut_by.get("add_prefix_space") and not model.get("ignore_merges") and not model.get("dropout"))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if not plain or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    code = byte_level_bytes()
    return {bytes([code[c] for c in token]): i for token, i in model["vocab"].items() if token not in added}


class SegmentIds:
    """Ids of texts under a byte-level tokenizer, from the ids of their segments.

    New segments take the longest, so those of printable ASCII and Latin letters are merged
    by tiktoken from the same file's merges (a third of the time; the ids are the same, see
    the tests), where the file's ids are the merges' ranks.  All others, and segments that
    hold an added token, are encoded by tokenizers.
    """

    def __init__(self, path: str, cached: int = CACHED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(" " in t.content or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("an added token reaches over blanks, so texts have no segments of their own")
        self.added = [t.content for t in added]
        ranks = _ranks(path)
        self.merge = ranks and tiktoken.Encoding("segments", pat_str=_WORDS, mergeable_ranks=ranks,
                                                 special_tokens={}).encode_ordinary
        self.cached = cached
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        plain = [s for s in new if self.merge and _PLAIN.fullmatch(s) and not any(a in s for a in self.added)]
        others = list(set(new).difference(plain))
        for at in range(0, len(new), 1 << 14):  # few at a time: an encoding holds far more than its ids
            part = others[at:at + (1 << 14)]
            encoded = [e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
            self.known.update(zip(part, (np.asarray(e, dtype="<u4").tobytes() for e in encoded), strict=True))
        encoded = [self.merge(s) for s in plain]
        flat = np.asarray([i for e in encoded for i in e], dtype="<u4").tobytes()
        at = 0
        for s, e in zip(plain, encoded, strict=True):
            self.known[s] = flat[at:at + 4 * len(e)]
            at += 4 * len(e)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids behind each other, ``end_id`` after each text, and where each text ends."""
        found = cut(texts)
        if len(self.known) > self.cached:  # frequent segments are among those used now
            self.known = {s: self.known[s] for s in found.names if s in self.known}
        self._learn([s for s in found.names if s not in self.known])
        encoded = [self.known[s] for s in found.names]
        encoded.append(np.asarray([end_id], dtype="<u4").tobytes())
        length = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), dtype="<u4")
        numbers = np.insert(found.numbers, found.starts[1:], len(encoded) - 1)
        count = length[numbers]
        ids = flat[spread((np.cumsum(length) - length)[numbers], count)]
        return ids, np.cumsum(count)[found.starts[1:] + np.arange(len(texts))]


def class_cuts(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each rest below ``capacity``, in rows filled up with zeros, and how many there are."""
    cuts: list[list[int]] = [[]]
    for rest in range(1, capacity):
        size = capacity // (capacity // (rest + 1) + 1)  # largest capacity // k that is not above the rest
        cuts.append([size, *cuts[rest - size]])
    count = np.asarray([len(c) for c in cuts], dtype=np.int64)
    table = np.zeros((capacity, max(1, int(count.max()))), dtype=np.int64)
    for rest, sizes in enumerate(cuts):
        table[rest, :len(sizes)] = sizes
    return table, count


def cut_lengths(lengths: np.ndarray, capacity: int, table: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece sizes of all lengths behind each other, and how many pieces each length has."""
    whole, rest = lengths // capacity, lengths % capacity
    pieces = whole + count[rest]
    sizes = np.full(int(pieces.sum()), capacity, dtype=np.int64)
    nth = spread(np.zeros(len(lengths), dtype=np.int64), pieces) - np.repeat(whole, pieces)
    small = nth >= 0
    sizes[small] = table[np.repeat(rest, pieces)[small], nth[small]]
    return sizes, pieces


def fill(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sequence, offset, placed, sequences) of pieces in order: whole bins of ``capacity // size`` pieces.

    Pieces that don't fill a bin of their class aren't placed.
    """
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    count = np.diff(np.append(first, len(ordered)))
    each = capacity // ordered[first]
    bins = count // each
    nth = np.arange(len(ordered)) - np.repeat(first, count)
    each_row = np.repeat(each, count)
    sequence, offset, placed = np.empty_like(sizes), np.empty_like(sizes), np.empty(len(sizes), dtype=bool)
    sequence[order] = np.repeat(np.cumsum(bins) - bins, count) + nth // each_row
    offset[order] = nth % each_row * ordered
    placed[order] = nth // each_row < np.repeat(bins, count)
    return sequence, offset, placed, int(bins.sum())


def fill_rest(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset, sequences) of pieces that are powers of two up to ``capacity`` (itself one).

    A bin that stays short becomes sequences by the binary digits of its count, largest first.
    """
    sequence, offset, placed, used = fill(sizes, capacity)
    for size in np.unique(sizes[~placed]).tolist():
        rows = np.flatnonzero(~placed & (sizes == size))
        at = 0
        for bit in reversed(range(len(rows).bit_length())):
            if len(rows) >> bit & 1:
                part = rows[at:at + (1 << bit)]
                sequence[part], offset[part] = used, np.arange(len(part)) * size
                used += 1
                at += 1 << bit
    return sequence, offset, used


def _binary_digits(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of two that make up each length, largest first, and how many each has."""
    digits = [[1 << b for b in reversed(range(n.bit_length())) if n >> b & 1] for n in lengths.tolist()]
    return (np.asarray([d for ds in digits for d in ds], dtype=np.int64),
            np.asarray([len(d) for d in digits], dtype=np.int64))


def _binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """``flat`` (32-bit ids) cut behind each other into binary values of ``sizes`` ids."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(4 * sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         cached: int = CACHED) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset) for every piece of ``docs``.

    A document's ids are those of its text (null: empty) and ``end_id``; ``ids`` (binary,
    32-bit little-endian) are the ``length`` ids of a piece, which begins at the document's
    id number ``start`` and at place ``offset`` of its sequence.  Sequences hold at most
    ``capacity`` ids (a power of two) without gaps; ``sequences`` puts them together.

    Every row is packed on its own, so repeated rows and equal doc_ids all appear; a null
    doc_id stays null; a null or empty text is the end id alone.  Only doc_id and text are
    read, so other columns may have any name; an empty table gives an empty result.
    Sequence ids begin with the number of the worker's partition: read a written result,
    or evaluate it once, where they must stay the same.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SegmentIds(tokenizer, cached)
        table, count = class_cuts(capacity)
        base = TaskContext.get().partitionId() << 32
        used, held = 0, None
        for part in slices(batches, "text", 1 << 14, SLICE):
            ids, ends = encoder.encode(part.column("text"), end_id)
            lengths = np.diff(ends, prepend=0)
            sizes, pieces = cut_lengths(lengths, capacity, table, count)
            of = np.repeat(np.arange(len(lengths)), pieces)
            start = np.cumsum(sizes) - sizes - (ends - lengths)[of]
            rows = pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(of)), pa.array(start), pa.array(sizes), pa.array(lengths[of]),
                 _binaries(ids, sizes)], _COLUMNS)
            if held is not None:
                rows = pa.concat_batches([held, rows])
            sequence, offset, placed, more = fill(rows.column("length").to_numpy(), capacity)
            held = rows.filter(pa.array(~placed))
            out = rows.filter(pa.array(placed))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(base + used + sequence[placed]), pa.array(offset[placed])],
                [*_COLUMNS, "sequence_id", "offset"])
            used += more
        if held is not None and held.num_rows:
            sizes, pieces = _binary_digits(held.column("length").to_numpy())
            of = np.repeat(np.arange(held.num_rows), pieces)
            within = np.cumsum(sizes) - sizes
            start = within - within[np.cumsum(pieces) - pieces][of] + held.column("start").to_numpy()[of]
            flat = np.frombuffer(b"".join(held.column("ids").to_pylist()), dtype="<u4")
            sequence, offset, _ = fill_rest(sizes, capacity)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [held.column("doc_id").take(at), pa.array(start), pa.array(sizes), held.column("doc_tokens").take(at),
                 _binaries(flat, sizes), pa.array(base + used + sequence), pa.array(offset)],
                [*_COLUMNS, "sequence_id", "offset"])
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, "
                             "sequence_id long, offset long"))


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, tokens, padded, ids): the sequences of a written result of ``pack``.

    ``padded`` is the length with padding: the number of tokens where it is a power of two,
    ``capacity`` elsewhere.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    tokens = F.sum("length").alias("tokens")
    power = F.bit_count("tokens") == 1
    return (packed.groupBy("sequence_id").agg(tokens, F.unhex(F.array_join(ordered, "")).alias("ids"))
            .select("sequence_id", "tokens", F.when(power, F.col("tokens")).otherwise(F.lit(capacity).cast("long"))
                    .alias("padded"), "ids"))
