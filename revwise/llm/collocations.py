"""Operator 12, collocations: phrases of two to four words by best-first branch and bound.

Phrases grow word by word.  A phrase's score is at most ``SCALE * f(p) / (f(first word) +
f(p))`` for every prefix p of two words or more, because its own count is at most f(p) and
so is at least counted in what follows its first word; in the same way a suffix s bounds
it by ``SCALE * f(s) / (f(last word) + f(s))``.  Words and pairs of words are counted in full.
The frontier then holds the pairs, ordered by bound.  A round takes each language's pairs
down to a threshold, counts all longer phrases that can reach it, everything their scores
are made of, and the extensions that can displace a phrase that reaches it.  A language
is settled when ``top`` phrases that survive reach the threshold: everything that is not
yet counted scores below it, ties included.  The others go on with a threshold eight times
as far down, until it is zero.

Every round is one pass over the texts.  Tasks cut a slice of text into numbered words and
count phrases there before anything is shuffled.  Which pairs matter comes to the tasks as
bit tables of at most ``BITS`` bits, whatever the input: a false hit there counts a phrase too
many, whole, and never loses one.  Counts are grouped by (language, phrase), so that no
language, word or phrase meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from revwise.llm.common import slices, stage_table

TOP = 2000
LEAST = 30
#: A phrase goes if a longer one around it has this share (in percent) of its count.
COVERED = 80
SCALE = 2_000_000
#: Size limit of a bit table (16 MB).
BITS = 1 << 27
#: Text taken at a time.
SLICE = 8 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\x0d" + b"\x09",
                         b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Stands between pieces: no word holds an upper-case letter.
_BREAK = b" A "
_K = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of one language in a slice: different words, and their numbers in order (-1 between pieces)."""

    lang: str
    names: pa.Array
    numbers: np.ndarray

    def hashes(self) -> np.ndarray:
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        return np.asarray([xxhash.xxh3_64_intdigest(w, seed) for w in self.names.cast(pa.large_binary()).to_pylist()],
                          dtype=np.uint64)


def words(part: pa.RecordBatch) -> Iterator[Words]:
    """Words of each language (null: ``und``) of a slice of (lang, text)."""
    langs = pc.fill_null(part.column("lang"), "und").dictionary_encode()
    texts = pc.fill_null(part.column("text"), "").cast(pa.binary())
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        mine = texts.filter(pc.equal(langs.indices, k)).to_pylist()
        data = b"\n".join(mine).translate(_LOWER).replace(b"\n", _BREAK).strip()
        if not data:
            continue
        whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.asarray([0, len(data)], dtype=np.int64)), pa.py_buffer(data))
        coded = pc.ascii_split_whitespace(whole).flatten().dictionary_encode()
        numbers = coded.indices.to_numpy().astype(np.int64)
        at = pc.index(coded.dictionary, pa.scalar("A", coded.dictionary.type)).as_py()
        if at >= 0:  # the break is no word
            numbers = np.where(numbers == at, -1, numbers - (numbers > at))
            names = pa.concat_arrays([coded.dictionary[:at], coded.dictionary[at + 1:]])
        else:
            names = coded.dictionary
        yield Words(lang, names, numbers)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first * _K ^ second) * _K
    return (h ^ (h >> np.uint64(29))) * _K


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is marked in a bit table (perhaps falsely)."""
    at = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _rows(found: Words, size: int, parts: list[np.ndarray], count: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    texts = [found.names.take(pa.array(p)) for p in parts]
    phrase = texts[0] if size == 1 else pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string()))
    n = len(count)
    return pa.RecordBatch.from_arrays(
        [pa.array([found.lang], pa.string()).take(pa.array(np.zeros(n, np.int64))), phrase.cast(pa.string()),
         pa.array(np.full(n, size, np.int32)), pa.array(code.view(np.int64)), pa.array(count.astype(np.int64))],
        ["lang", "phrase", "size", "code", "n"])


def count_words(found: Words) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of all words together as the phrase of no word."""
    count = np.bincount(found.numbers[found.numbers >= 0], minlength=len(found.names))
    yield _rows(found, 1, [np.arange(len(count))], count, found.hashes())
    yield pa.RecordBatch.from_arrays(
        [pa.array([found.lang], pa.string()), pa.array([""], pa.string()), pa.array([0], pa.int32()), pa.array([0], pa.int64()),
         pa.array([int(count.sum())], pa.int64())], ["lang", "phrase", "size", "code", "n"])


def count_pairs(found: Words, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of neighbours that are both marked."""
    h = found.hashes()
    marked = np.append(has(frequent, h), False)  # the last one answers for -1
    c = np.where(marked[found.numbers], found.numbers, -1)
    left, right = c[:-1], c[1:]
    use = (left >= 0) & (right >= 0)
    d = max(1, len(found.names))
    key, count = np.unique(left[use] * d + right[use], return_counts=True)
    a, b = key // d, key % d
    yield _rows(found, 2, [a, b], count, pair_hash(h[a], h[b]))


def count_longer(found: Words, frequent: np.ndarray, prefixes: np.ndarray, suffixes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of three and four words that a threshold needs.

    ``prefixes`` and ``suffixes`` mark the pairs whose bound reaches it.  A phrase that
    reaches the threshold begins with one of the first and ends with one of the second; its
    parts begin or end so, and its extensions hold both in a row.
    """
    h = np.append(found.hashes(), np.uint64(0))
    c = found.numbers
    if len(c) < 3:
        return
    both = (c[:-1] >= 0) & (c[1:] >= 0)
    codes = pair_hash(h[c[:-1]], h[c[1:]])
    at = np.flatnonzero(both)
    often = np.zeros(len(codes), dtype=bool)
    often[at] = has(frequent, codes[at])
    at = np.flatnonzero(often)
    begin, end = np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=bool)
    begin[at], end[at] = has(prefixes, codes[at]), has(suffixes, codes[at])
    three = often[:-1] & often[1:] & (begin[:-1] | end[1:])
    four = often[:-2] & often[1:-1] & often[2:] & (begin[:-2] & (end[1:-1] | end[2:]) | begin[1:-1] & end[2:])
    three, four = np.flatnonzero(three), np.flatnonzero(four)
    # Pairs of words are numbered, so that longer phrases are pairs of numbers.
    d = max(1, len(found.names))
    place = np.unique(np.concatenate([three, four, four + 2]))
    pair, number = np.unique(c[place] * d + c[place + 1], return_inverse=True)
    first = number[np.searchsorted(place, three)]
    key, count = np.unique(first * d + c[three + 2], return_counts=True)
    p = pair[key // d]
    yield _rows(found, 3, [p // d, p % d, key % d], count, np.zeros(len(key), np.uint64))
    n = max(1, len(pair))
    key, count = np.unique(number[np.searchsorted(place, four)] * n + number[np.searchsorted(place, four + 2)],
                           return_counts=True)
    p, q = pair[key // n], pair[key % n]
    yield _rows(found, 4, [p // d, p % d, q // d, q % d], count, np.zeros(len(key), np.uint64))


def _counted(texts: DataFrame, count: Callable[..., Iterator[pa.RecordBatch]], tables: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, size, code, n) of all texts, counted by ``count`` in slices and added up."""
    shared = texts.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 16, SLICE):
            for found in words(part):
                yield from count(found, *shared.value)
    return (texts.mapInArrow(run, "lang string, phrase string, size int, code long, n long")
            .groupBy("lang", "phrase", "size", "code").agg(F.sum("n").alias("n")))


def bit_table(members: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bit table of the codes of ``members`` (code): 16 bits a member, up to ``bits``."""
    size = max(64, min(bits, 1 << (16 * members.count()).bit_length()))
    at = members.select((F.col("code").bitwiseAND(F.lit(size - 1).cast("long"))).alias("at"))
    marks = (at.groupBy(F.shiftright("at", 6).alias("slot"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mark")).toArrow())  # at most size / 64 rows
    table = np.zeros(size // 64, dtype=np.uint64)
    table[marks.column("slot").to_numpy()] = marks.column("mark").to_numpy().view(np.uint64)
    return table


def _per_sum(n: str, a: str, b: str) -> str:
    """floor(SCALE * n / (a + b)) beyond 64 bits."""
    return f"cast({n} as decimal(19,0)) * {SCALE} div (cast({a} as decimal(19,0)) + cast({b} as decimal(19,0)))"


def _pairs(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """Pairs with the counts of their words, score, and bounds as prefix and as suffix."""
    for side, which in (("l", 1), ("r", -1)):
        pairs = (pairs.withColumn("word", F.substring_index("phrase", " ", which))
                 .join(single.select("lang", F.col("phrase").alias("word"), F.col("n").alias(side)), ["lang", "word"])
                 .drop("word"))
    return pairs.select("lang", "phrase", "size", "code", "n", "l", "r", F.expr(_per_sum("n", "l", "r")).alias("score"),
                        F.expr(_per_sum("n", "l", "n")).alias("as_prefix"), F.expr(_per_sum("n", "r", "n")).alias("as_suffix"))


def _scored(longer: DataFrame, counts: DataFrame) -> DataFrame:
    """Longer phrases with their lowest-scoring cut; those with a part that wasn't counted are left out."""
    cuts = longer.select("lang", "phrase", "size", "n", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - size)").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side], "left")
    cuts = cuts.withColumn("score", F.expr(_per_sum("n", "l", "r")))
    return (cuts.groupBy("lang", "phrase", "size", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.count("score").alias("known"))
            .where("known = size - 1").select("lang", "phrase", "size", "n", "cut.l", "cut.r", "cut.score"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, covered: int = COVERED,
                 first_rank: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to four words.

    Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into
    words ``[^\\x20\\x09]+``; null texts are empty and a null lang is ``und``.  Candidates occur
    ``least`` times or more (``a``) within pieces.  The score is the lowest of floor(2000000 * a
    / (l + r)) over all cuts into two parts that occur l and r times (of equal ones the first
    cut's); n is the number of words of the language.  Phrases inside a longer candidate with
    ``covered`` percent of their count are left out.  Order: score, a (both falling), phrase.

    ``first_rank`` is the rank among pairs at which the first threshold lies (twice ``top``).
    Rows count each on its own, also where they repeat; only lang and text are read, so
    other columns may have any name.  Languages without candidates, and empty tables, give
    no rows.
    """
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    single = stage_table(_counted(texts, count_words, []).where(f"size = 0 or n >= {least}"), "words")
    total = single.where("size = 0").select("lang", F.col("n").alias("total"))
    single = single.where("size = 1")
    pairs = _counted(texts, count_pairs, [bit_table(single)]).where(f"n >= {least}")
    pairs = stage_table(_pairs(pairs, single), "pairs")

    by_score = W.partitionBy("lang").orderBy(F.desc("score"), "phrase")
    open_langs = stage_table(pairs.select("lang").distinct(), "open")
    rank, done = first_rank or 2 * top, None
    while not open_langs.isEmpty():
        ranked = pairs.join(open_langs, "lang").withColumn("at", F.row_number().over(by_score)).where(f"at <= {rank}")
        limit = stage_table(open_langs.join(ranked.where(f"at = {rank}").select("lang", "score"), "lang", "left")
                            .select("lang", F.coalesce("score", F.lit(0).cast("long")).alias("limit")), "limits")
        frontier = stage_table(pairs.join(limit, "lang"), "frontier")
        tables = [bit_table(frontier), bit_table(frontier.where("as_prefix >= limit")),
                  bit_table(frontier.where("as_suffix >= limit"))]
        longer = _counted(texts.withColumn("lang", F.coalesce("lang", F.lit("und"))).join(open_langs, "lang", "left_semi"),
                          count_longer, tables)
        longer = stage_table(longer.where(f"n >= {least}").select("lang", "phrase", "size", "n"), "longer")
        counts = (single.select("lang", "phrase", "n").union(frontier.select("lang", "phrase", "n"))
                  .union(longer.select("lang", "phrase", "n")))
        reached = (_scored(longer, counts).join(limit, "lang").where("score >= limit").drop("limit")
                   .union(frontier.where("score >= limit").select("lang", "phrase", "size", "n", "l", "r", "score")))
        around = (longer.select("lang", "n", F.explode(F.expr(
            "array(substring_index(phrase, ' ', size - 1), substring_index(phrase, ' ', 1 - size))")).alias("phrase"))
                  .groupBy("lang", "phrase").agg(F.max("n").alias("longer")))
        kept = (reached.join(around, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {covered} * n")
                .withColumn("rank", F.row_number().over(
                    W.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase"))).where(f"rank <= {top}"))
        kept = stage_table(kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"),
                                       "l", "r", "score"), "kept")
        settled = stage_table(limit.where("limit = 0").select("lang")
                              .union(kept.where(f"rank = {top}").select("lang")).distinct(), "settled")
        more = kept.join(settled, "lang", "left_semi")
        done = more if done is None else done.union(more)
        open_langs = stage_table(open_langs.join(settled, "lang", "left_anti"), "open")
        rank *= 8
    if done is None:
        done = docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, score long")
    return done.join(total.withColumnRenamed("total", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
