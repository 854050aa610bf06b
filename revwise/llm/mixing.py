"""Operator 4, mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents, in a seeded order, are one stream of words cut into blocks of equally
many words; its seats take the blocks in a seeded order, and start again from the first when
all are taken.  A source has the seats whose words come nearest to its target, and its block
is at most 1/64 of the target, so it misses the target by at most 1/128 of it or half a word.
Seats come one by one from the source with the highest quotient (target in blocks) / (2 seats
+ 1); their sequence is cut into shards of equally many words, which gives every shard an
integer quota of each source.

Only a total for each source comes to the driver.  Where a document starts in its source's
stream is found with two levels of sums: totals of ``CELLS`` ranges of the seeded order for
each source, then a running sum inside each range, so no source is ever in one task.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from revwise.llm.common import fresh

#: Blank characters, as the contract of sizes has them.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MAX_EPOCHS = 2
#: The largest block is the mix over this many ...
BLOCKS = 262_144
#: ... but at least so many words; a source that is taken whole has no smaller blocks either.
LEAST_BLOCK = 16
#: A source's block is at most its target over this many, so small sources have small blocks.
SOURCE_BLOCKS = 64
SHARDS = 64
CELLS_LOG2 = 12
#: More sources than this are refused: their totals and quotas are held by the driver.
MAX_SOURCES = 100_000
SEED = 7


@dataclass
class SourcePlan:
    size: int
    target: Fraction
    block: int  # words of its blocks
    blocks: int  # of its stream
    quotas: list[int]  # seats of each shard
    step: int  # block i is taken by seat (step * i + shift) % blocks, and by one more in each epoch
    shift: int


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE,
            most: int = MAX_EPOCHS) -> list[Fraction]:
    """Words wanted of each source (in their order): ``share`` of all words dealt by weight, no
    source above ``most`` times its size, the excess dealt anew among the others."""
    out = [Fraction(0)] * len(sizes)
    rest, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i % len(weights)] for i in open_)
        want = {i: rest * weights[i % len(weights)] / weight for i in open_}
        full = [i for i in open_ if want[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = Fraction(most * sizes[i]) if full else want[i]
        if not full:
            break
        rest -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def apportion(wanted: list[Fraction], limits: list[int], seats: int) -> Iterator[int]:
    """Sainte-Laguë: the source of each seat in turn, none above its limit; ties to the first source."""
    heap = [(-float(t), i, 0) for i, t in enumerate(wanted) if t > 0 and limits[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            return
        _, i, n = heapq.heappop(heap)
        yield i
        if n + 1 < limits[i]:
            heapq.heappush(heap, (-float(wanted[i]) / (2 * n + 3), i, n + 1))


def plan(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MAX_EPOCHS,
         shards: int = SHARDS, seed: int = SEED) -> tuple[int, list[SourcePlan]]:
    """Words of the largest block, and for each source its target, quotas and block order."""
    wanted = targets(sizes, weights, share, most)
    largest = max(LEAST_BLOCK, -(-int(sum(wanted)) // BLOCKS))
    plans, seats = [], []
    for i, (size, target) in enumerate(zip(sizes, wanted, strict=True)):
        least = LEAST_BLOCK if target == most * size else 1
        block = max(least, min(largest, int(target) // SOURCE_BLOCKS))
        n = -(-size // block)
        digest = hashlib.sha256(f"{seed}/{i}".encode()).digest()
        step = 1 + int.from_bytes(digest[:8], "big") % max(n, 1)
        while gcd(step, max(n, 1)) > 1:
            step += 1
        shift = int.from_bytes(digest[8:16], "big") % max(n, 1)
        plans.append(SourcePlan(size, target, block, n, [0] * shards, step, shift))
        seats.append(seats_of(plans[-1]))
    blocks = [p.target / p.block for p in plans]
    all_words = sum(n * p.block for n, p in zip(seats, plans, strict=True))
    words = 0
    for i in apportion(blocks, seats, sum(seats)):
        plans[i].quotas[words * shards // all_words] += 1
        words += plans[i].block
    return largest, plans


def seats_of(p: SourcePlan) -> int:
    """The seats of a source whose words come nearest to its target; the last block may be short."""
    if not p.size:
        return 0
    epochs, rest = divmod(p.target, p.size)
    short = p.blocks * p.block - p.size
    last = (p.step * (p.blocks - 1) + p.shift) % p.blocks  # the seat of the last block
    low = int(rest // p.block)
    near = min(range(low, min(low + 2, p.blocks) + 1),
               key=lambda n: abs(n * p.block - (short if last < n else 0) - rest))
    return int(epochs) * p.blocks + near


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MAX_EPOCHS,
        shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with what the mix takes of each row:

    ``size`` (its words), ``source_size``, ``target`` (both of its source) and ``spans``,
    an array of (block, shard, epoch, start, end): the words [start, end) of the text that
    a shard of the mix holds.  All rows are kept; a row that is not taken has no span.

    Sources are ordered by code point, a null source last and a source of its own; weights
    repeat along that order.  Null, empty and blank texts have size 0 and no span.  Rows
    that repeat a doc_id are separate rows; equal rows are interchangeable, so reruns agree
    as a table.  An empty table gives an empty result.  Columns named like the new ones
    are replaced.
    """
    spark = docs.sparkSession
    new = ["size", "source_size", "target", "spans"]
    keep = [c for c in docs.columns if c not in new]
    at, cell, no, before, start = fresh(docs.columns + new, "at", "cell", "no", "before", "start_word")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], _size(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.col("text"))).alias(at))
    rows = rows.withColumn(cell, F.shiftrightunsigned(at, 64 - CELLS_LOG2).cast("int"))
    sums = rows.groupBy("source", cell).agg(F.sum("size").alias("size"))
    found = sums.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    _, plans = plan([r["size"] for r in found], weights, share, most, shards, seed)
    by_source = pd.DataFrame({
        "source": pd.Series([r["source"] for r in found], dtype=object), no: range(len(found)),
        "source_size": [p.size for p in plans], "target": [float(p.target) for p in plans],
        "block": [p.block for p in plans], "blocks": [p.blocks for p in plans], "step": [p.step for p in plans], "shift": [p.shift for p in plans],
        "quotas": [p.quotas for p in plans]})
    plan_columns = ["block", "blocks", "step", "shift", "quotas"]
    names = dict(zip(plan_columns, fresh(docs.columns + new, *plan_columns), strict=True))
    kinds = {"source": "string", no: "int", "source_size": "long", "target": "double", "quotas": "array<long>"}
    sources = spark.createDataFrame(
        [tuple(x) for x in by_source.itertuples(index=False)],
        ", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in by_source.columns)).withColumnsRenamed(names)
    sources = F.broadcast(sources.withColumnRenamed("source", f"{no}_source"))  # at most MAX_SOURCES rows
    same = F.col("source").eqNullSafe(F.col(f"{no}_source"))
    in_source = W.partitionBy(no).orderBy(cell)
    offsets = (sums.join(sources.select(f"{no}_source", no), same)
               .select(F.col(no).alias(f"{no}_o"), F.col(cell).alias(f"{cell}_o"),
                       (F.sum("size").over(in_source) - F.col("size")).alias(before)))
    rows = rows.join(sources, same).join(offsets, (F.col(no) == F.col(f"{no}_o")) & (F.col(cell) == F.col(f"{cell}_o")))
    inside = W.partitionBy(no, cell).orderBy(at, "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(start, F.col(before) + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    block, blocks, step, shift, quotas = (F.col(names[c]) for c in plan_columns)
    first, end = F.col(start), F.col(start) + F.col("size")
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)

    def taken(b: Column, epoch: Column) -> Column:
        seat = (step * b + shift) % blocks + epoch * blocks
        # The shard of a seat: how many shards' quotas end at or before it.
        shard = F.aggregate(quotas, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")),
                            lambda a, q: F.struct((a["sum"] + q).alias("sum"),
                                                  (a["n"] + F.when(a["sum"] + q <= seat, 1).otherwise(0)).alias("n")),
                            lambda a: a["n"])
        return F.when(seat < total, F.struct(
            b.alias("block"), shard.alias("shard"), epoch.cast("int").alias("epoch"),
            (F.greatest(b * block, first) - first).alias("start"),
            (F.least((b + 1) * block, end) - first).alias("end")))
    covered = F.sequence(F.floor(first / block).cast("long"), F.floor((end - 1) / block).cast("long"))
    spans = F.flatten(F.transform(covered, lambda b: F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)), lambda e: taken(b, e))))
    spans = F.filter(spans, lambda s: s.isNotNull())
    kind = "array<struct<block:long,shard:int,epoch:int,start:long,end:long>>"
    rows = rows.withColumn("spans", F.when(F.col("size") > 0, spans).otherwise(F.array().cast(kind)).cast(kind))
    return rows.select(*[F.col(f"`{c}`") for c in keep], *new)


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The given word ranges (in order) of a text, each with its inner blanks, joined by a newline."""
    at = [m.span() for m in _WORDS.finditer(text)]
    return "\n".join(text[at[a][0]:at[b - 1][1]] for a, b in ranges)


def _joined(spans: Column) -> Column:
    """Word ranges of spans in text order, neighbours made one."""
    return F.aggregate(
        spans, F.array().cast("array<struct<a:long,b:long>>"),
        lambda done, s: F.when(
            F.try_element_at(done, F.lit(-1))["b"] == s["start"],
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1),
                     F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), s["end"].alias("b"))))
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("a"), s["end"].alias("b"))))))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each document and epoch that has words in the mix.

    A document taken whole keeps its text; of others the text holds the taken words, in
    order.  Columns are those of ``docs``; ``n_chars`` follows the text.  Documents without
    a word (null, empty or blank texts) take no share of a mix of words and are left out.
    """
    rows = mix(docs, **options)
    epoch, ranges = fresh(rows.columns, "epoch_no", "ranges")
    merged = rows.withColumn(epoch, F.explode(F.array_distinct(F.transform("spans", lambda s: s["epoch"]))))
    merged = merged.withColumn(ranges, _joined(F.filter("spans", lambda s: s["epoch"] == F.col(epoch))))
    whole = (F.size(ranges) == 1) & (F.col(ranges)[0]["a"] == 0) & (F.col(ranges)[0]["b"] == F.col("size"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else cut_words(t, [(x["a"], x["b"]) for x in p])
                          for t, p in zip(text, parts, strict=True)], dtype=object)
    part = cut(F.when(~whole, F.col("text")), F.when(~whole, F.col(ranges)))
    text = F.when(whole, F.col("text")).otherwise(part)
    out = merged.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
