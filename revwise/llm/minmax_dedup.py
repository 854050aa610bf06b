"""Operator 3, near-duplicate detection by min-max hashing.

A text's set holds its distinct 5-word shingles.  Under each of ``PERMUTATIONS`` keyed
permutations both the smallest and the largest hash of the set are kept: each agrees
between two sets with a probability of their Jaccard similarity, so one hash evaluation
gives two signature values.  ``BANDS`` bands of ``2 * PER_BAND`` values are bucket keys.
Minimum and maximum agree together with i(i-1) / (u(u-1)), where a pair shares i of u
shingles, so a pair at 0.75 shares no band with a probability of at most 0.00021 (9 of 12),
which falls to 0.00008 for large sets.  In smaller sets it would be more; sets of at most
``SMALL`` shingles have exact keys too (``small_keys``), so of those no linked pair escapes.

Bucket members become links without emitting all pairs of a bucket:

1. Texts with equal sets are one vertex (the smallest doc_id stands for them).
2. ``STAR_ROUNDS`` star rounds: in each bucket whose members are not yet one component, a
   hub (the member that shares most buckets) is compared with the members outside its
   component.  Groups of near copies become one component here, whatever their size.
3. Buckets that still hold several components and more members than were hubs are joined
   by their first hub, and cut into chunks of about ``CHUNK`` shingles.  A task gets two
   chunks and finds the links between their components from an index of the shingles,
   without a row for a pair.

Every link is confirmed on the full sets.  After step 3 each pair that shares a bucket was
either compared or lies in one component, so no caps apply to a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwise.llm.common import BROADCAST_IDS, connected_components, list_array, semi_by_ids, slices, stage_table

SHINGLE = 5
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS = 48
PER_BAND = 3
PERMUTATIONS = BANDS * PER_BAND
#: Sets of at most so many shingles have exact keys.
SMALL = 11
STAR_ROUNDS = 2
CHUNK = 1 << 17
#: Word hashes that one task remembers (about 100 bytes each).
CACHED_WORDS = 150_000

_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]
_K = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word, remembered up to ``CACHED_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text.

    ``bytes.lower`` folds A-Z alone and ``bytes.split`` cuts at exactly the blanks
    x20 and x09 to x0D.  Fewer than five words are one shingle; no word, none.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    parts = text.encode("utf-8", "replace").lower().split()
    w = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    if not len(w):
        return w
    if len(w) < SHINGLE:
        w = np.append(w, np.uint64(len(w)))  # never equal to a shingle of five words
        h = np.zeros(1, dtype=np.uint64)
        for x in w:
            h = (h ^ x) * _K
    else:
        n = len(w) - SHINGLE + 1
        h = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            h = (h + w[k:k + n]) * _K
    return np.unique(_mix(h))


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a set under each permutation."""
    u = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    high = np.zeros(PERMUTATIONS, dtype=np.uint32)
    for at in range(0, len(u), 2048):
        v = u[None, at:at + 2048] * _MULTIPLY + _ADD
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return low, high


def band_keys(found: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band: three minima, three maxima and the band's number."""
    low, high = signature(found)
    h = np.arange(BANDS, dtype=np.uint64) * _K
    for part in (low, high):
        values = part.astype(np.uint64).reshape(BANDS, PER_BAND)
        for k in range(PER_BAND):
            h = _mix((h ^ values[:, k]) * _K)
    return h.view(np.int64)


def small_keys(found: np.ndarray) -> np.ndarray:
    """Keys of the parts of a small set that can be its intersection with a linked set.

    That is at least ``PERCENT`` of the set, so a set of 8 to 11 shingles lacks at most two
    there, one of 4 to 7 at most one: 67 keys or fewer.
    """
    if not 0 < len(found) <= SMALL:
        return np.empty(0, dtype=np.int64)
    least = -(-PERCENT * len(found) // 100)
    parts = (np.array(x, dtype=np.uint64) for n in range(least, len(found) + 1) for x in combinations(found, n))
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed=BANDS) for x in parts], dtype=np.uint64).view(np.int64)


def _digest(found: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit digest as two longs."""
    digest = xxhash.xxh3_128_intdigest(found.tobytes())
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for part in slices(batches, "text"):
        sizes, digests, keys = [], [], []
        for t in part.column("text").to_pylist():
            found = shingle_set(t, words)
            sizes.append(len(found))
            digests.append(_digest(found))
            keys.append(np.concatenate([band_keys(found), small_keys(found)]) if len(found)
                        else np.empty(0, dtype=np.int64))
        high, low = zip(*digests, strict=True)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()),
             pa.array(low, pa.int64()), list_array(np.concatenate(keys), [len(k) for k in keys])],
            ["doc_id", "text_key", "n_shingles", "h1", "h2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for part in slices(batches, "text"):
        found = [shingle_set(t, words) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), list_array(np.concatenate(found).view(np.int64), [len(x) for x in found])],
            ["id", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            lv, rv = left.values.to_numpy(), right.values.to_numpy()
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = lv[lo[i]:lo[i + 1]], rv[ro[i]:ro[i + 1]]
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])
    return run


def _undecided(members: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components and a pair that no star round compares."""
    rows = (members.where(F.col("n") > 2).join(label, "id", "left")
            .withColumn("comp", F.coalesce("component", "id")).drop("component"))
    mixed = (rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where("lo < hi").select("bucket"))
    return rows.join(mixed, "bucket")


def _hubs(left: DataFrame, used: DataFrame | None) -> DataFrame:
    """(bucket, id): of each bucket the member with most bucket mates that was no hub before."""
    pool = left if used is None else left.join(used, ["bucket", "id"], "left_anti")
    most = pool.groupBy("bucket").agg(F.max("mates").alias("mates"))
    return pool.join(most, ["bucket", "mates"]).groupBy("bucket").agg(F.min("id").alias("id"))


def _pairs(left: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of a row of ``first`` and a row of ``left`` in one bucket and two
    components whose set sizes allow the similarity."""
    hub = first.select("bucket", F.col("id").alias("hub"), F.col("comp").alias("hub_comp"),
                       F.col("n_shingles").alias("hub_n"))
    return (left.join(hub, "bucket").where("comp <> hub_comp")
            .where(f"100 * least(n_shingles, hub_n) >= {percent} * greatest(n_shingles, hub_n)")
            .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())


def _whole_sets(texts: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the vertices ``ids`` (id), from the text that stands for each."""
    rows = stage_table(reps.join(ids, "id", "left_semi").select(F.col("rep").alias("doc_id"), "text_key", "id"), "ends")
    n = rows.count()
    mine = semi_by_ids(texts, "doc_id", rows.select("doc_id").distinct(), n)
    small = F.broadcast(rows) if n <= BROADCAST_IDS else rows
    return (mine.withColumn("text_key", F.xxhash64("text")).join(small, ["doc_id", "text_key"])
            .select("id", "text").mapInArrow(_sets, "id long, shingles array<long>"))


def _compare(texts: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for each pair, from the whole sets of its texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stage_table(_whole_sets(texts, reps, ends), "sets")
    return stage_table(
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
        .select("a", "b", "left", "right")
        .mapInArrow(_confirm(percent), "a long, b long, linked boolean"), "compared")


def _linked_chunks(percent: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own, first, second = (rows.column(c).to_numpy() for c in ("own", "first", "second"))
        ids, comp = rows.column("id").to_numpy(), rows.column("comp").to_numpy()
        sets = rows.column("shingles").combine_chunks()
        values, at = sets.values.to_numpy(), sets.offsets.to_numpy()
        size = np.diff(at)
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        # Index of the left chunk: its shingles in order, each with its row.
        where = np.repeat(np.arange(len(left)), size[left])
        held = np.concatenate([values[at[i]:at[i + 1]] for i in left] or [values[:0]])
        order = np.argsort(held, kind="stable")
        held, where = held[order], where[order]
        same = {int(c): int(c) for c in np.unique(comp)}  # components joined by links found here

        def root(c: int) -> int:
            while same[c] != c:
                same[c] = c = same[same[c]]
            return c
        a, b = [], []
        for j in right:
            lo, hi = (held.searchsorted(values[at[j]:at[j + 1]], side) for side in ("left", "right"))
            n = hi - lo
            hits = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            shared = np.bincount(where[hits], minlength=len(left))
            near = (100 * shared >= percent * (size[left] + size[j] - shared)) & (comp[left] != comp[j])
            for i in left[near]:
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y:
                    same[x] = y
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _chunk_links(texts: DataFrame, reps: DataFrame, left: DataFrame, first_hub: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of undecided buckets."""
    hub = first_hub.select("bucket", F.col("id").alias("hub"))
    rows = stage_table(left.where(F.col("n") > STAR_ROUNDS + 1).join(hub, "bucket")
                       .select("hub", "id", "comp", "n_shingles").distinct(), "groups")
    groups = (rows.groupBy("hub").agg(F.sum("n_shingles").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
              .where("lo < hi").select("hub", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")))
    dealt = (rows.join(groups, "hub").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("hub", "id", "comp", "own", F.least("own", "other").alias("first"),
                     F.greatest("own", "other").alias("second")))
    sets = _whole_sets(texts, reps, rows.select("id").distinct())
    return stage_table(dealt.join(sets, "id").groupBy("hub", "first", "second").applyInArrow(
        _linked_chunks(percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, text_key: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Links are pairs whose whole shingle sets reach ``percent``; component_id is the
    smallest doc_id reachable over links, itself included, and kept marks that document.
    Empty texts, null texts and texts of blanks have no shingle and are their own
    component; texts with equal sets are always linked.  Links are between texts, not
    ids: rows that repeat a doc_id are answered row by row, each by its own text (rows with
    equal texts equally).  A null doc_id takes part in no link; its component_id is null and
    it is kept.  Only doc_id and text are read, so other columns may have any name; an empty
    table gives an empty result.  ``text_key`` adds xxhash64 of the text, which tells the
    rows of one doc_id apart.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stage_table(
        texts.withColumn("text_key", F.xxhash64("text"))
        .mapInArrow(_sketch, "doc_id long, text_key long, n_shingles long, h1 long, h2 long, bands array<long>"), "sketch")
    linkable = sketch.where("doc_id is not null and n_shingles > 0")
    # A vertex for each different set, under a number of its own.  A table, so that the join of
    # all copies with it below can split a very large group of copies.
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    reps = stage_table(linkable.groupBy("h1", "h2").agg(first)
                       .select("h1", "h2", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"),
                               F.monotonically_increasing_id().alias("id")), "reps")
    vertices = (linkable.join(reps.select(F.col("rep").alias("doc_id"), "text_key", "h1", "h2", "id"),
                              ["doc_id", "text_key", "h1", "h2"])
                .select("id", "n_shingles", "bands"))
    rows = vertices.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stage_table(rows.join(crowded, "bucket").dropDuplicates(["bucket", "id"]), "members")
    # A hub is the member with most bucket mates; the id in the low bits makes the order total.
    hubs = members.groupBy("id").agg(F.sum("n").alias("mates"))
    members = stage_table(members.join(hubs, "id").select("bucket", "id", "n_shingles", "n", "mates"), "hubs")

    left = members.withColumn("comp", F.col("id"))
    first_hub = used = stage_table(_hubs(left, None), "hub")
    pairs = stage_table(_pairs(left, left.join(first_hub, ["bucket", "id"]), percent), "pairs")
    compared = _compare(texts, reps, pairs, percent)
    label = connected_components(compared.where("linked").select("a", "b"), "near")
    for _ in range(1, STAR_ROUNDS):
        left = stage_table(_undecided(members, label), "undecided")
        hub = stage_table(_hubs(left, used), "hub")
        used = used.union(hub)
        pairs = _pairs(left, left.join(hub, ["bucket", "id"]), percent)
        pairs = stage_table(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        compared = compared.union(_compare(texts, reps, pairs, percent))
        label = connected_components(compared.where("linked").select("a", "b"), "near")
    more = _chunk_links(texts, reps, _undecided(members, label), first_hub, percent)
    if not more.isEmpty():
        label = connected_components(compared.where("linked").select("a", "b").union(more), "near")

    smallest = label.join(reps.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("smallest"))
    named = (reps.join(label.join(smallest, "component").select("id", "smallest"), "id", "left")
             .select("h1", "h2", F.coalesce("smallest", "rep").alias("component")))
    answer = sketch.select("doc_id", "text_key", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    answer = answer.withColumn("component_id", F.when(F.expr("doc_id is not null and n_shingles > 0"), F.col("component"))
                               .otherwise(F.col("doc_id")))
    return answer.select("doc_id", "n_shingles", "component_id",
                         F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
                         *(["text_key"] if text_key else []))
