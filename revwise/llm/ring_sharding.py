"""Operator 1, sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2**CELLS_LOG2`` places.  Every shard owns ``VIRTUAL_NODES`` keyed places; a
row's key is hashed to a place and belongs to the next virtual node clockwise.  No shard
holds more than ``load_factor`` times the mean: a shard takes the rows of its own arcs in
ring order until it is full, and what is over goes on clockwise to the next shard that has
room.  So balance is guaranteed, and another shard moves the rows of the arcs it takes
over and what had overflowed, no others.

Only the totals of the ring's places (at most ``2**CELLS_LOG2`` rows, whatever the input)
come to the driver, which lays the ring out as segments: a range of a place's bytes and
the shard that holds it.  Rows find their segment by a running sum inside their place.
Rows with equal values are counted before the shuffle and laid out one behind the other,
so a row that is repeated very often is never a group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from revwise.llm.common import fresh, stage_table

CELLS_LOG2 = 16
CELLS = 1 << CELLS_LOG2
VIRTUAL_NODES = 512
#: A shard's bound as a multiple of the mean load.  At 1.0 all shards are equal up to the
#: rows on the borders of segments; a larger factor moves fewer rows when shards change.
LOAD_FACTOR = 1.0
SHARDS = 24


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """The ring's arcs in order: [first place, last place, shard of the node that ends it]."""
    nodes: dict[int, tuple[bytes, int]] = {}
    for shard in range(shards):
        for k in range(virtual_nodes):
            digest = hashlib.sha256(f"shard-{shard}/{k}".encode()).digest()
            place, rest = int.from_bytes(digest[:4], "big") >> (32 - CELLS_LOG2), digest[4:]
            if place not in nodes or rest < nodes[place][0]:  # two nodes on a place: the smaller hash
                nodes[place] = (rest, shard)
    places = sorted(nodes)
    runs, first = [], 0
    for place in places:
        runs.append([first, place, nodes[place][1]])
        first = place + 1
    if first < CELLS:  # behind the last node the ring begins again
        runs.append([first, CELLS - 1, nodes[places[0]][1]])
    return runs


def lay_out(cell: np.ndarray, load: np.ndarray, shards: int, load_factor: float = LOAD_FACTOR,
            virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int]]:
    """(place, from, to, shard, hops): which shard holds each range of a place's load.

    Round 0 gives every shard its own arcs in ring order up to its bound.  What is over is
    a list of ranges that go on clockwise: in each further round every range offers itself
    to the next shard after the arc it stopped at, and that shard fills up in ring order.
    The bounds add up to the whole load at least, so every range ends somewhere.
    """
    runs = ring(shards, virtual_nodes)
    total = int(load.sum())
    if not total:
        return [(int(c), 0, 0, runs[0][2], 0) for c in cell]
    room = [-(-int(total * Fraction(load_factor)) // shards)] * shards
    run_of = np.searchsorted([r[1] for r in runs], cell, "left")
    # The next arc clockwise of each arc that belongs to another shard.
    after = [0] * len(runs)
    for i in range(len(runs)):
        k = i + 1
        while shards > 1 and runs[k % len(runs)][2] == runs[i][2]:
            k += 1
        after[i] = k % len(runs)
    waiting = [(int(c), 0, int(n), int(r), 0) for c, n, r in zip(cell, load, run_of, strict=True)]
    out = []
    while waiting:
        over = []
        for c, start, end, r, hops in waiting:
            shard = runs[r][2]
            fits = min(end - start, room[shard])
            if fits or start == end:
                out.append((c, start, start + fits, shard, hops))
                room[shard] -= fits
            if start + fits < end:
                over.append((c, start + fits, end, after[r], hops + 1))
        waiting = over
    return sorted(out)


def assign_shards(rows: DataFrame, key: list[str], size: str, shards: int = SHARDS,
                  load_factor: float = LOAD_FACTOR, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` and ``hops`` (shards passed because they were full).

    ``size`` is a positive long column; ``key`` decides a row's place on the ring.  A row goes
    to the segment that holds the middle of its bytes, so a shard differs from its bound by
    half a row at most at each border of a segment.  Slots number the rows of a shard from 0
    without gaps.  A null key is a key like any other; repeated rows are all kept, each with
    a slot of its own; an empty table gives an empty result.  The columns of ``rows`` must be
    orderable; keep texts out and join them by key where they are needed.  Columns named
    like the new ones are replaced.
    """
    new = ["shard", "slot", "hops"]
    rows = rows.drop(*new)
    names = rows.columns
    at, n, cell, start, row, copy, mid, segment = fresh(
        names + new, "at", "n", "cell", "start", "row_no", "copy", "mid", "segment")
    own = [F.col(f"`{c}`") for c in names]
    bytes_ = F.col(f"`{size}`")
    spark = rows.sparkSession
    grouped = stage_table(
        rows.groupBy(*own).agg(F.count("*").alias(n))
        .withColumn(at, F.xxhash64(F.lit("ring"), *[F.col(f"`{c}`") for c in key]))
        .withColumn(cell, F.shiftrightunsigned(at, 64 - CELLS_LOG2).cast("int")), "ring")
    cells = grouped.groupBy(cell).agg(F.sum(bytes_ * F.col(n)).alias("load")).toPandas().sort_values(cell)
    segments = pd.DataFrame(
        lay_out(cells[cell].to_numpy(np.int64), cells["load"].to_numpy(np.int64), shards, load_factor, virtual_nodes),
        columns=["cell", "start", "end", "shard", "hops"], dtype=np.int64)
    # A place's rows in the order of the hash, one behind the other.
    before = W.partitionBy(cell).orderBy(at, *own).rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum(bytes_ * F.col(n)).over(before), F.lit(0))
    placed = (grouped
              .select(*own, cell, n, first.alias(start), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(row))
              .withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
              .select(*own, cell, (F.col(start) + F.col(copy) * bytes_ + F.floor(bytes_ / 2)).alias(mid),
                      (F.col(row) + F.col(copy)).alias(row)))
    # At most CELLS + shards * (number of arcs that overflow) segments, 24 bytes each.
    keys = segments["cell"].to_numpy() << 46 | segments["start"].to_numpy()
    shared = spark.sparkContext.broadcast((keys, segments["shard"].to_numpy(), segments["hops"].to_numpy()))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shard, hops = shared.value
        for b in batches:
            byte = b.column(cell).to_numpy().astype(np.int64) << 46 | b.column(mid).to_numpy()
            k = np.searchsorted(keys, byte, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.select(names).columns, pa.array(shard[k].astype(np.int32)), pa.array(hops[k].astype(np.int32)),
                 pa.array(k), b.column(row)], [*names, "shard", "hops", segment, row])
    found = stage_table(placed.mapInArrow(
        find, f"{columns}, shard int, hops int, `{segment}` long, `{row}` long"), "placed")
    # A row's slot: the rows of its shard's earlier segments and those before it in its own.
    held = found.groupBy(segment).agg(F.count("*").alias("rows"), F.min(row).alias("first")).toPandas()
    held = held.sort_values(segment).astype(np.int64)
    held["base"] = held.groupby(segments["shard"].to_numpy()[held[segment]])["rows"].cumsum() - held["rows"]
    base = np.zeros(len(segments), dtype=np.int64)
    base[held[segment]] = held["base"] - held["first"]
    slots = spark.sparkContext.broadcast(base)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = slots.value[b.column(segment).to_numpy()] + b.column(row).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*b.select([*names, "shard"]).columns, pa.array(slot), b.column("hops")], [*names, *new])
    return found.mapInArrow(number, f"{columns}, shard int, slot long, hops int")
