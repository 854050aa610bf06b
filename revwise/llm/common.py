"""Helpers shared by the operators: tables, stage tables, Arrow slices, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revwise.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage: what follows restarts from files every executor can read,
    so a lost executor never repeats the work above.  ``revwise.session.drop_stage_tables``
    removes the application's tables when their readers are done.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/stages-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores put in front until none is a column already."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in [*columns, *out]}:
            name = f"_{name}"
        out.append(name)
    return out


#: Ids up to this count may be broadcast (8 bytes each, so 16 MB at most); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def semi_by_ids(df: DataFrame, key: str, ids: DataFrame, n_ids: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in ``ids`` (one column, distinct, ``n_ids`` rows).

    The ids are broadcast only below ``BROADCAST_IDS``; a larger set takes a shuffle join.
    """
    small = ids.toDF(key)
    return df.join(F.broadcast(small) if n_ids <= BROADCAST_IDS else small, key, "left_semi")


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = 256,
           max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of at most ``rows`` rows and about ``max_bytes`` of text
    (a single longer text is a slice of its own), so that work arrays stay small."""
    for batch in batches:
        sizes = np.asarray(batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
                           .to_pandas().map(lambda x: len(x) if x is not None else 0), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(np.cumsum(sizes[at:at + rows]), max_bytes, "right"))
            n = max(1, fit)
            yield batch.slice(at, n)
            at += n


def list_array(values: np.ndarray, lengths: np.ndarray | list[int]) -> pa.ListArray:
    """Arrow list column from its flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable from each id over undirected ``edges`` (a, b).

    Alternating large-star and small-star rounds until no edge changes.  Every round is
    a grouped minimum (partial aggregation, so a hub costs one row per task) and a join
    back on the node; each round's edges become a stage table.  Null ends and self-loops
    are ignored; an id without an edge has no row.
    """
    cur = stage_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), f"{name}-edges")
    before = None
    while True:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low2.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        cur = stage_table(small, f"{name}-round")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return (cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
                    .union(cur.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())
        before = now
