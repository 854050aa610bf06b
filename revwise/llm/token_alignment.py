"""Operator 11, cross-tokenizer alignment: byte-level BPE tokens against sentencepiece tokens of the same text.

Both tokenizers see the text with one blank in front (the second adds it itself).  Their
spans are the coarse cuts: character offsets of the first, the spans that sentencepiece
gives with its pieces of the second (installed versions have dropped the immutable proto's
name and give the same spans as ``offset_mapping``).  Character places become byte places,
and where several tokens share a character (parts of a multibyte character) or a token is
a byte of the fallback, the ends come from the tokens' decoded bytes instead.  Byte places
where both have an end cut the tokens into groups; all pairs of one group are links.

Neither tokenizer joins a character with a blank behind it, so a text's tokens, ends and
groups are those of its segments (``segments.cut``).  A task aligns each segment once and
remembers it; should a model hold such a piece, whole texts take the segments' place.
New segments are encoded many behind each other: as one text they give the same tokens.

Corpus counts: each document's different id pairs are exploded and counted by Spark.
Counts of two and more come back as sorted arrays, broadcast below ``PAIRS_IN_MEMORY``
pairs; beyond it documents' pairs are joined with the counts by a shuffle.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwise.llm.common import list_array, slices, stage_table
from revwise.llm.segments import Cut, byte_level_bytes, cut, open_ended, spread

#: Segments whose alignment a task remembers (about 300 bytes each).
CACHED = 200_000
#: Text taken at a time.
SLICE = 4 << 20
#: Id pairs (of a count above one) up to this number are broadcast, 16 bytes each.
PAIRS_IN_MEMORY = 2_000_000
#: Segments that both tokenizers encode at a time.
LEARNED = 1 << 13
#: Segments that are encoded as one text.
JOINED = 128
#: Pairs of one group that are listed; larger groups are counted by their different ids.
LISTED = 4096


def list_array_of(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


@dataclass
class Aligned:
    """Alignments of segments, a row each.

    ``counts``: whether both sides give the segment back, tokens of both, groups, links;
    ``groups``: the groups as text; ``n_pairs``: how many of ``pair`` (id pairs, in the
    segments' order; they may repeat) are the row's, each with ``weight`` links.
    """

    counts: np.ndarray
    groups: pa.Array
    n_pairs: np.ndarray
    pair: np.ndarray
    weight: np.ndarray

    def take(self, rows: np.ndarray) -> Aligned:
        at = spread((np.cumsum(self.n_pairs) - self.n_pairs)[rows], self.n_pairs[rows])
        return Aligned(self.counts[rows], self.groups.take(pa.array(rows)), self.n_pairs[rows], self.pair[at], self.weight[at])

    @staticmethod
    def join(parts: list[Aligned]) -> Aligned:
        if len(parts) == 1:
            return parts[0]
        return Aligned(np.concatenate([p.counts for p in parts]), pa.concat_arrays([p.groups for p in parts]),
                       *(np.concatenate([getattr(p, c) for p in parts]) for c in ("n_pairs", "pair", "weight")))


class Aligner:
    """Alignments of segments under two tokenizers, remembered up to ``cached`` of them."""

    def __init__(self, byte_level: str, pieces: str, cached: int = CACHED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_file=pieces)
        code = byte_level_bytes()
        vocabulary = self.first.get_vocab(with_added_tokens=True)
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in code for c in token):
                self.first_bytes[i] = bytes([code[c] for c in token])
        n = self.second.get_piece_size()
        names = [self.second.id_to_piece(i) for i in range(n)]
        self.fallback = np.asarray([self.second.is_byte(i) for i in range(n)], dtype=bool)
        self.second_bytes = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode()
                             for p, b in zip(names, self.fallback.tolist(), strict=True)]
        self.first_length = np.asarray([len(b) for b in self.first_bytes], dtype=np.int64)
        self.second_length = np.asarray([len(b) for b in self.second_bytes], dtype=np.int64)
        model = ModelProto.FromString(self.second.serialized_model_proto())
        rules = model.normalizer_spec
        self.cuttable = (rules.name == "identity" and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
                         and not any("▁" in p.lstrip("▁") for p in names))
        self.cached = cached
        self.row: dict[str, int] = {}
        self.known = Aligned(np.zeros((0, 5), np.int64), pa.array([], pa.string()), *np.zeros((3, 0), np.int64))

    def cut(self, texts: pa.Array) -> Cut:
        if self.cuttable:
            return cut(texts, blank_first=True)
        whole = [" " + (t or "") for t in texts.to_pylist()]
        names = list(dict.fromkeys(whole))
        number = {t: k for k, t in enumerate(names)}
        return Cut(names, np.asarray([number[t] for t in whole], dtype=np.int64), np.arange(len(whole) + 1))

    def runs(self, names: list[str]) -> np.ndarray:
        """Where each run of names begins that are encoded as one text, and the number of names.

        Names that may be a text's last (white space at their end) and whole texts stand alone.
        """
        alone = np.ones(len(names), dtype=bool)
        if self.cuttable:
            alone = np.fromiter((open_ended(s) for s in names), dtype=bool, count=len(names))
        begins = alone.copy()
        begins[1:] |= alone[:-1]
        begins[::JOINED] = True
        return np.append(np.flatnonzero(begins), len(names))

    def ends(self, names: list[str]) -> tuple:
        """Ids, tokens of each name, and byte ends (from the first name's start) under both; names' byte
        ends; whether the decoded tokens of both give the name."""
        data = "".join(names).encode()
        begins = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80)
        byte_at = np.append(begins, len(data))  # byte place of each character
        chars = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
        char_first = np.cumsum(chars) - chars
        first_byte, last_byte = byte_at[char_first], byte_at[char_first + chars]
        good = np.ones(len(names), dtype=bool)
        out = []
        runs = self.runs(names)
        texts = ["".join(names[i:j]) for i, j in zip(runs[:-1], runs[1:], strict=True)]
        run_first = char_first[runs[:-1]]
        a = self.first.encode_batch(texts, add_special_tokens=False)
        b = self.second.encode([s[1:] for s in texts], return_type="offset_mapping", num_threads=1)
        for ids_of, spans_of, blank, size, decoded in (
                ([e.ids for e in a], [e.offsets for e in a], 0, self.first_length, self.first_bytes),
                ([e["ids"] for e in b], [e["offsets"] for e in b], 1, self.second_length, self.second_bytes)):
            in_run = np.fromiter(map(len, ids_of), dtype=np.int64, count=len(texts))
            ids = np.fromiter(chain.from_iterable(ids_of), dtype=np.int64, count=in_run.sum())
            spans = np.fromiter(chain.from_iterable(chain.from_iterable(spans_of)), dtype=np.int64,
                                count=2 * in_run.sum()).reshape(-1, 2)
            spans += np.repeat(run_first + blank, in_run)[:, None]
            # A name's first token takes its blank, so that all its tokens end behind its start.
            of = np.searchsorted(char_first + chars, spans[:, 1])
            count = np.bincount(of, minlength=len(names))
            coarse = byte_at[spans[:, 1]]
            lengths = size[ids]
            total = np.bincount(of, lengths, len(names)).astype(np.int64)
            ended = np.cumsum(lengths)
            fine = ended - (np.cumsum(total) - total)[of] + first_byte[of]
            shared = np.zeros(len(ids), dtype=bool)
            shared[:-1] = (spans[1:, 0] < spans[:-1, 1]) & (of[1:] == of[:-1])
            shared[1:] |= shared[:-1]
            if blank:
                shared |= self.fallback[ids]
            joined = b"".join([decoded[i] for i in ids.tolist()])
            if joined != data:
                at, to = np.cumsum(total) - total, np.cumsum(total)
                good &= np.fromiter((joined[i:j] == data[k:m] for i, j, k, m in zip(
                    at.tolist(), to.tolist(), first_byte.tolist(), last_byte.tolist(), strict=True)), bool, len(names))
            out += [ids, count, np.where(shared, fine, coarse)]
        return (*out, last_byte, good)

    def learn(self, names: list[str]) -> Aligned:
        """Alignments of ``names``, each on its own."""
        ids_a, count_a, end_a, ids_b, count_b, end_b, last, good = self.ends(names)
        if not good.all():
            keep_a, keep_b = np.repeat(good, count_a), np.repeat(good, count_b)
            ids_a, end_a, ids_b, end_b = ids_a[keep_a], end_a[keep_a], ids_b[keep_b], end_b[keep_b]
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        owner = np.searchsorted(last, common)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        links = in_a * in_b
        # Links of a group: each of its first ids with all its second ids.
        few = links <= LISTED
        rows = np.flatnonzero(few[group_a])
        times = in_b[group_a[rows]]
        left = np.repeat(rows, times)
        right = spread(first_b[group_a[rows]], times)
        of, pair, weight = owner[group_a[left]], self.pair(ids_a[left], ids_b[right]), np.ones(len(left), np.int64)
        if not few.all():
            listed = [np.stack([of, pair, weight])]
            for g in np.flatnonzero(~few).tolist():
                x, nx = np.unique(ids_a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
                y, ny = np.unique(ids_b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
                listed.append(np.stack([np.full(len(x) * len(y), owner[g]),
                                        self.pair(np.repeat(x, len(y)), np.tile(y, len(x))), np.outer(nx, ny).ravel()]))
            of, pair, weight = np.concatenate(listed, axis=1)
            order = np.argsort(of, kind="stable")
            of, pair, weight = of[order], pair[order], weight[order]
        side_a, side_b = (pc.binary_join(list_array_of(pa.array(ids).cast(pa.string()), count), ",")
                          for ids, count in ((ids_a, in_a), (ids_b, in_b)))
        n_groups = np.bincount(owner, minlength=len(names))
        written = pc.binary_join(list_array_of(pc.binary_join_element_wise(side_a, side_b, "|"), n_groups), ";")
        counts = np.stack([good, count_a, count_b, n_groups,
                           np.bincount(owner, links, len(names)).astype(np.int64)], axis=1)
        return Aligned(counts, written, np.bincount(of, minlength=len(names)), pair, weight)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * len(self.second_bytes) + b

    def segments(self, texts: pa.Array) -> tuple[Cut, np.ndarray]:
        """The texts' segments, and the row of ``known`` of each different one."""
        found = self.cut(texts)
        if len(self.row) > self.cached:  # frequent segments are among those used now
            kept = [s for s in found.names if s in self.row]
            self.known = self.known.take(np.asarray([self.row[s] for s in kept], dtype=np.int64))
            self.row = {s: k for k, s in enumerate(kept)}
        new = [s for s in found.names if s not in self.row]
        parts = [self.known]
        for at in range(0, len(new), LEARNED):  # few at a time: an encoding holds far more than its ids
            part = new[at:at + LEARNED]
            parts.append(self.learn(part))
            self.row.update(zip(part, range(len(self.row), len(self.row) + len(part)), strict=True))
        self.known = Aligned.join(parts)
        return found, np.fromiter((self.row[s] for s in found.names), dtype=np.int64, count=len(found.names))


def sum_by(of: np.ndarray, key: np.ndarray, n_keys: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (of, key) in order, with the sums of their weights; keys are below ``n_keys``."""
    both = of * np.int64(n_keys) + key
    order = np.argsort(both, kind="stable")
    both = both[order]
    begins = np.flatnonzero(np.diff(both, prepend=-1))
    if not len(begins):
        return of[:0], key[:0], weight[:0]
    both = both[begins]
    return both // n_keys, both % n_keys, np.add.reduceat(weight[order], begins)


_ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs array<long>, weights array<long>")


def aligned(docs: DataFrame, byte_level: str, pieces: str, cached: int = CACHED) -> DataFrame:
    """One row per row of ``docs``: counts, digest of the groups, and the different id pairs (first id *
    size of the second vocabulary + second id) with the number of links of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level, pieces, cached)
        for part in slices(batches, "text", 1 << 14, SLICE):
            texts = part.column("text")
            found, rows = aligner.segments(texts)
            known = aligner.known.take(rows)
            numbers, starts = found.numbers, found.starts
            filled = pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False)
            filled &= np.minimum.reduceat(known.counts[numbers, 0], starts[:-1]) == 1
            sums = [np.where(filled, np.add.reduceat(known.counts[numbers, c], starts[:-1]), 0) for c in range(1, 5)]
            written = pc.binary_join(list_array_of(known.groups.take(pa.array(numbers)), np.diff(starts)), ";")
            digests = [hashlib.sha256(w).hexdigest() if ok else ""
                       for ok, w in zip(filled.tolist(), written.cast(pa.binary()).to_pylist(), strict=True)]
            pairs, place = np.unique(known.pair, return_inverse=True)
            first = np.cumsum(known.n_pairs) - known.n_pairs
            doc = np.repeat(np.arange(len(filled)), np.diff(starts))
            use = filled[doc]
            numbers, doc = numbers[use], doc[use]
            at = spread(first[numbers], known.n_pairs[numbers])
            of, pair, weight = sum_by(np.repeat(doc, known.n_pairs[numbers]), place[at], max(1, len(pairs)), known.weight[at])
            pair = pairs[pair]
            each = np.bincount(of, minlength=len(filled))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, sums), pa.array(digests, pa.string()),
                 list_array(pair, each), list_array(weight, each)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "weights"])
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, _ALIGNED))


def groups(docs: DataFrame, byte_level: str, pieces: str, cached: int = CACHED) -> DataFrame:
    """(doc_id, group, start, end, a, b): the groups themselves, one row each.

    ``start`` and ``end`` are bytes of the blank and the text behind it; ``a`` and ``b`` the ids.
    Rows of ``docs`` without tokens have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level, pieces, cached)
        for part in slices(batches, "text", 1 << 10, SLICE // 8):
            found, rows = aligner.segments(part.column("text"))
            known = aligner.known.take(rows)
            good, texts = known.counts[:, 0].tolist(), known.groups.to_pylist()
            docs_, group, start, end, a, b = [], [], [], [], [], []
            for row, (d, t) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)):
                mine = found.numbers[found.starts[row]:found.starts[row + 1]].tolist()
                if not t or not all(good[k] for k in mine):
                    continue
                at = 0
                for k, text in enumerate(x for m in mine for x in texts[m].split(";")):
                    left, right = ([int(i) for i in side.split(",")] for side in text.split("|"))
                    docs_.append(d)
                    group.append(k)
                    start.append(at)
                    at += int(aligner.first_length[left].sum())
                    end.append(at)
                    a.append(left)
                    b.append(right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_, pa.int64()), *(pa.array(x, pa.int64()) for x in (group, start, end)),
                 *(pa.array(x, pa.list_(pa.int64())) for x in (a, b))], ["doc_id", "group", "start", "end", "a", "b"])
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, group long, start long, end long, a array<long>, b array<long>"))


def _with_counts(rows: DataFrame, many: DataFrame, best: DataFrame, vocabulary: int) -> DataFrame:
    """n_best and count_sum from counts held in sorted arrays (pairs without a count occur once)."""
    table = many.select("pair", "docs").toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    top = best.toArrow()
    a = top.column("a").to_numpy()
    highest = np.ones(int(a.max()) + 1 if len(a) else 1, dtype=np.int64)
    highest[a] = top.column("best").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(
        (table.column("pair").to_numpy()[order], table.column("docs").to_numpy()[order], highest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, high = shared.value
        for batch in batches:
            pairs, weights = batch.column("pairs"), batch.column("weights").flatten().to_numpy()
            pair, place = np.unique(pairs.flatten().to_numpy(), return_inverse=True)
            count = np.ones(len(pair), dtype=np.int64)
            at = np.searchsorted(keys, pair)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == pair[hit]
            count[hit] = docs[at[hit]]
            is_best = (count == high[pair // vocabulary])[place]
            ends = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            sums = [np.append(0, np.cumsum(x))[ends] for x in (weights * is_best, weights * count[place])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], *(pa.array(np.diff(x)) for x in sums)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])
    return rows.drop("row").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                            "groups_sha256 string, n_best long, count_sum long")


def _with_joined_counts(rows: DataFrame, counts: DataFrame, best: DataFrame, vocabulary: int) -> DataFrame:
    """The same by joins: for vocabularies whose pairs have no place in memory."""
    known = (counts.withColumn("a", F.expr(f"pair div {vocabulary}")).join(best, "a")
             .select("pair", "docs", (F.col("docs") == F.col("best")).alias("top")))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "weights")).alias("l")).select(
        "row", F.col("l.pairs").alias("pair"), F.col("l.weights").alias("weight"))
    sums = links.join(known, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("top"), F.col("weight")).otherwise(F.lit(0))).alias("n_best"),
        F.sum(F.col("weight") * F.col("docs")).alias("count_sum"))
    return (rows.drop("pairs", "weights").join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                    *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum"))))


def align(docs: DataFrame, byte_level: str, pieces: str, cached: int = CACHED,
          pairs_in_memory: int = PAIRS_IN_MEMORY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for every row of ``docs``.

    ``byte_level`` is a tokenizer file of the first kind, ``pieces`` a sentencepiece model.
    The count of an id pair is the number of rows of ``docs`` that hold it linked; n_best
    counts the links whose count is the highest of their first id, count_sum adds up the
    counts over all links.  A text that is null or empty, or which decoded tokens of either
    side don't give back, has no tokens: zeros and an empty digest.

    Every row is a document of its own, also where doc_ids or texts repeat; a null doc_id
    stays null.  Only doc_id and text are read, so other columns may have any name; an
    empty table gives an empty result.
    """
    from sentencepiece import SentencePieceProcessor

    vocabulary = SentencePieceProcessor(model_file=pieces).get_piece_size()
    rows = stage_table(aligned(docs, byte_level, pieces, cached).withColumn("row", F.monotonically_increasing_id()),
                       "aligned")
    counts = stage_table(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")),
                         "pair-counts")
    best = (counts.groupBy(F.expr(f"pair div {vocabulary}").alias("a")).agg(F.max("docs").alias("best")))
    many = counts.where("docs > 1")
    if many.count() <= pairs_in_memory:
        return _with_counts(rows, many, best, vocabulary)
    return _with_joined_counts(rows, counts, best, vocabulary)
