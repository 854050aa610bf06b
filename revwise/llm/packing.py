"""Operator 7, packing documents into sequences: Martello-Toth dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the instance is a histogram: how many
pieces there are of each length.  It has at most ``CAPACITY`` rows whatever the input, and
only it comes to the driver.  Dominance reduction fixes bins that no alternative beats and
takes them out; what is left is packed best fit, longest first.  The result is a list of
patterns (lengths of a bin, number of such bins), which gives every n-th piece of a length
its sequence and offset.  Pieces are numbered within their length in two levels (counts of
hash cells, then rows of a cell), so a frequent length is never in one task.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from revwise.llm.common import slices, stage_table

CAPACITY = 4096
END_ID = 1
CELLS = 512
#: Words, and pieces of words, whose ids a task remembers (about 250 bytes each).
CACHED_WORDS = 250_000
#: Blanks beyond ASCII: the tokenizer cuts at them, so a word that holds one goes its whole way.
_ODD = re.compile(r"\s")
#: Normalized words of ASCII letters, and marks behind them (no apostrophe, which may begin a
#: piece with letters): the pre-tokenizer makes one piece of the letters and one of the marks.
_SIMPLE = re.compile(r"([a-z]+)([!-&(-/:-@\[-`{-~]*)")

Pattern = tuple[list[tuple[int, int]], int]  # [(length, how often in the bin)], number of bins


class WordIds:
    """Ids of texts under a tokenizer that drops blanks, so that a text's ids are those of its words.

    Words are encoded once and remembered; a text then is a join of its words' ids.  New
    words go through the tokenizer's own steps (normalizer, pre-tokenizer, model), the
    first two for all new words at once; the model sees each pre-token once.  Words that
    hold an added token take the tokenizer's whole way.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = range(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.packed = [i.to_bytes(4, "little") for i in ids]
        self.cached = cached
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(piece)])
        return found

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        if len(self.pieces) > self.cached:
            self.pieces.clear()
        normal = self.tokenizer.normalizer.normalize_str(" ".join(words)).split(" ")
        if len(normal) != len(words):  # never seen: a normalizer that makes blanks
            self.known.update((w, self._whole(w)) for w in words)
            return
        known, piece, simple = self.known, self._piece, _SIMPLE.fullmatch
        others, forms = [], []
        for word, form in zip(words, normal, strict=True):
            if m := simple(form):
                letters, marks = m.groups()
                known[word] = piece(letters) + piece(marks) if marks else piece(letters)
            else:
                others.append(word)
                forms.append(form)
        joined = " ".join(forms)
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(joined)
        lengths = np.fromiter(map(len, forms), dtype=np.int64, count=len(forms))
        starts = np.fromiter([x[1][0] for x in cut], dtype=np.int64, count=len(cut))
        ends = np.searchsorted(starts, np.cumsum(lengths + 1) - 1)
        encoded = [piece(x[0]) for x in cut]
        at = 0
        for word, end in zip(others, ends.tolist(), strict=True):
            known[word] = encoded[at] if end == at + 1 else b"".join(encoded[at:end])
            at = end

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null text is an empty one.

        Arrow cuts the texts at ASCII blanks and numbers the different words; Python sees each
        of these once, and the texts' ids are put together by their numbers.
        """
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = words.values.dictionary_encode()
        number = numbered.indices.to_numpy()
        used = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.cached:  # frequent words are among those used now
            self.known = {w: self.known[w] for w in used if w in self.known}
        if missing := [w for w in used if w not in self.known]:
            text = "".join(missing)
            odd = [a for a in {*self.added, *_ODD.findall(text)} if a in text]
            whole = [w for w in missing if not w or (odd and any(a in w for a in odd))]
            self.known.update((w, self._whole(w)) for w in whole)
            self._learn([w for w in missing if w not in self.known])
        encoded = [self.known[w] for w in used]
        length = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) // 4
        first = np.cumsum(length) - length
        ids = np.frombuffer(b"".join(encoded), dtype="<u4")
        # Each word's range of ids, one behind the other.
        n = length[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(first[number] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = 4 * ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [out[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     cached_words: int = CACHED_WORDS) -> DataFrame:
    """(doc_id, text_key, piece, start, ids): each document's ids and ``end_id``, cut only if longer than ``capacity``.

    ``text_key`` is xxhash64 of the text; ``ids`` is binary, 32-bit little-endian.  A null or
    empty text is the end id alone.
    ``cached_words`` bounds what a task remembers, and the text it takes at a time.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer, cached_words)
        for part in slices(batches, "text", 1024, 32 * cached_words):
            doc, piece, start, ids = [], [], [], []
            for d, encoded in enumerate(encoder.encode(part.column("text"))):
                encoded += end
                for k, at in enumerate(range(0, len(encoded), 4 * capacity)):
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    ids.append(encoded[at:at + 4 * capacity])
            yield pa.RecordBatch.from_arrays(
                [*part.select(["doc_id", "text_key"]).take(pa.array(doc, pa.int64())).columns, pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "text_key", "piece", "start", "ids"])
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
            .withColumn("text_key", F.xxhash64("text"))
            .mapInArrow(run, "doc_id long, text_key long, piece int, start long, ids binary"))


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Martello-Toth: fix bins that dominate every alternative; ``counts`` keeps the rest.

    For a piece j with ``left = capacity - j``: alone, if nothing else fits; with the piece
    that fills the bin exactly; with the largest piece that fits, if no two others fit.
    Any other content of j's bin then fits, piece by piece, where the chosen one was, so
    some optimal packing holds the fixed bin.  Repeated until nothing more is fixed.
    """
    fixed: list[Pattern] = []
    while True:
        lengths = [int(n) for n in np.flatnonzero(counts)]
        before = len(fixed)
        for j in reversed(lengths):
            while counts[j]:
                left = capacity - j
                if left > 0 and left != j and counts[left]:
                    n = int(min(counts[j], counts[left]))
                    fixed.append(([(j, 1), (left, 1)], n))
                    counts[j] -= n
                    counts[left] -= n
                    continue
                if left == j and counts[j] >= 2:
                    n = int(counts[j] // 2)
                    fixed.append(([(j, 2)], n))
                    counts[j] -= 2 * n
                    continue
                rest = np.flatnonzero(counts[:left + 1])
                if j <= left and counts[j] == 1:
                    rest = rest[rest != j]
                if not len(rest):
                    fixed.append(([(j, 1)], int(counts[j])))  # one, if two of them would fit
                    counts[j] = 0
                    continue
                smallest, largest = int(rest[0]), int(rest[-1])
                spare = counts[smallest] - (smallest == j)
                second = smallest if spare >= 2 else int(rest[1]) if len(rest) > 1 else capacity + 1
                if smallest + second <= left:
                    break
                if largest == j:
                    n = int(counts[j] // 2)
                    fixed.append(([(j, 2)], n))
                    counts[j] -= 2 * n
                else:
                    n = int(min(counts[j], counts[largest]))
                    fixed.append(([(j, 1), (largest, 1)], n))
                    counts[j] -= n
                    counts[largest] -= n
        if len(fixed) == before:
            return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first, over a histogram: bins of equal content are one pattern."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(pattern)

    def take(room: int) -> Pattern:
        pattern = open_[room].pop()
        if not open_[room]:
            del open_[room]
            del rooms[bisect_left(rooms, room)]
        return pattern

    for length in map(int, np.flatnonzero(counts)[::-1]):
        left = int(counts[length])
        while left:
            k = bisect_left(rooms, length)
            room, (content, bins) = (rooms[k], take(rooms[k])) if k < len(rooms) else (capacity, ([], left))
            each = min(room // length, left)
            filled = min(bins, left // each)
            if bins > filled and content:
                put(room, (content, bins - filled))
            put(room - each * length, ([*content, (length, each)], filled))
            left -= each * filled
    return [p for patterns in open_.values() for p in patterns]


def packing_plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that together hold every piece of the histogram (``counts[length]``)."""
    rest = counts.astype(np.int64).copy()
    return reduce_by_dominance(rest, capacity) + best_fit(rest, capacity)


def _places(plan: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, as ranges of their numbers, sorted by (length, first number)."""
    rows, given, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for content, bins in plan:
        offset = 0
        for length, each in content:
            rows.append((length, given[length], sequence, each, offset))
            given[length] += each * bins
            offset += length * each
        sequence += bins
    rows.sort()
    cols = np.asarray(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "each", "offset"), cols, strict=True))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...; lengths 1 to ``capacity``) with sequence_id and offset.

    Every row gets a place, repeated rows a place each; sequences have no gaps and are as few
    as the method finds.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    rows = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(CELLS)).cast("int"))
    cells = rows.groupBy("length", "cell").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(_places(packing_plan(counts, capacity), capacity))
    before = cells.select("length", "cell", (F.sum("n").over(W.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    inside = W.partitionBy("length", "cell").orderBy("doc_id", "piece")
    numbered = (rows.join(before, ["length", "cell"])
                .withColumn("number", F.col("before") + F.row_number().over(inside) - 1).drop("before", "cell"))
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = p["length"] << np.int64(44) | p["first"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            k = np.searchsorted(keys, length << np.int64(44) | number, "right") - 1
            nth = number - p["first"][k]
            each = p["each"][k]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, pa.array(p["sequence"][k] + nth // each),
                 pa.array(p["offset"][k] + nth % each * length)], [*names, "sequence_id", "offset"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.select(*names, "number").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         cached_words: int = CACHED_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, text_key, sequence_id, offset) for every piece of ``docs``.

    Rows that repeat a doc_id with another text differ in ``text_key`` (xxhash64 of the
    text); rows that repeat both are interchangeable.  Only doc_id and text are read, so other columns may have any name.  A null doc_id is
    kept as null; a null or empty text is one piece of the end id alone; longer texts than
    ``capacity`` are cut.  ``sequences`` turns the result into token rows.
    """
    pieces = tokenized_pieces(docs, tokenizer, capacity, end_id, cached_words).select(
        "doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "text_key")
    return place(stage_table(pieces, "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = CAPACITY,
              end_id: int = END_ID) -> DataFrame:
    """(sequence_id, tokens, ids): the packed sequences themselves, at most ``capacity`` ids each.

    A piece's ids are those of its text, whichever row of ``docs`` holds it, so doc_ids may
    repeat or be null.
    """
    ids = (tokenized_pieces(docs.select("doc_id", "text").dropDuplicates(["text"]), tokenizer, capacity, end_id)
           .select("text_key", "piece", "ids"))
    parts = packed.select("text_key", "piece", "sequence_id", "offset").join(ids, ["text_key", "piece"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return parts.groupBy("sequence_id").agg(F.unhex(F.array_join(ordered, "")).alias("ids")).select(
        "sequence_id", (F.octet_length("ids") / 4).cast("long").alias("tokens"), "ids")
