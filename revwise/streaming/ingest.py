"""Incremental ingestion (X-ING): landed store batches → reviews table.

``readStream`` over the landing folder with ``Trigger.AvailableNow``; each
micro-batch is parsed (S3), filtered and masked, then upserted (S5) into the
reviews table.  Re-running over the same files is safe twice over: the
checkpoint remembers processed files, and the upsert is idempotent (stable
id, last writer wins).  ``ingest_feed_stream`` does the same for the first
store's feed pages (S1).

A batch reads and writes only the table buckets its rows fall into (see
``revwise.sources.store.upsert_table``).

``stats_stream`` keeps the weekly statistics (A1, A8) up to date without reading the table
again: Spark's state store holds the newest version of each review, and a trigger emits
only what its rows change in the sums of a product's week.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from revwise.functions.text import iso_week, round2_or_zero
from revwise.sources.feeds import feed_reviews, parse_store_lines, store_rows
from revwise.sources.store import read_latest, upsert_table  # noqa: F401

REVIEW_COLS = ["id", "product_key", "source", "external_id", "body", "rating", "title",
               "posted_at", "version", "language", "country", "ingested_at"]


def _run(src: DataFrame, parse, table: str, checkpoint: str):
    def upsert(batch: DataFrame, batch_id: int) -> None:
        upsert_table(parse(batch).select(*REVIEW_COLS), table)

    return (src.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingest_stream(spark: SparkSession, landing: str, table: str, checkpoint: str,
                  ingested_at: str, since: str | None = None):
    """Start the second store's stream (AvailableNow) and return the StreamingQuery."""
    src = parse_store_lines(spark.readStream.text(landing))
    return _run(src, lambda b: store_rows(b, since, ingested_at), table, checkpoint)


def ingest_feed_stream(spark: SparkSession, landing: str, table: str, checkpoint: str,
                       ingested_at: str, since: str | None = None):
    """The first store's feed: one JSON page per file under ``product_key=<key>`` folders."""
    src = spark.readStream.option("wholetext", True).text(landing)
    key = F.regexp_extract(F.col("_metadata.file_path"), r"product_key=([^/]+)", 1)
    pages = src.select(key.alias("product_key"), "value")
    return _run(pages, lambda b: feed_reviews(b, since, ingested_at), table, checkpoint)


CHANGES = "product_key string, iso_week string, n long, rated long, rating_sum long"


def _change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a review's rows of one trigger change: the version held so far is taken back, the newest added.

    The state is the version held: (ingested_at, product, week, rating; -1 for none).  Late
    rows, with an older ingested_at than the version held, change nothing; of equal ones the
    greatest row counts, whatever their order.
    """
    held = state.get if state.exists else None
    best = held
    for rows in batches:
        for r in rows.itertuples(index=False):
            row = (r.version, r.product_key, r.iso_week, r.rating)
            best = row if best is None or row > best else best
    if best == held:
        return
    state.update(best)
    out = [(row[1], row[2], sign, sign * int(row[3] >= 0), sign * max(0, row[3]))
           for row, sign in ((held, -1), (best, 1)) if row is not None]
    yield pd.DataFrame(out, columns=["product_key", "iso_week", "n", "rated", "rating_sum"])


def stats_stream(reviews: DataFrame, changes: str, checkpoint: str):
    """Start the statistics stream (AvailableNow) over a stream of reviews (id, product_key, posted_at,
    rating, ingested_at) and return the StreamingQuery.

    Each trigger writes its changes under ``changes/batch_id=<n>``, added up by product and
    week, by dynamic overwrite: a trigger that is repeated after a failure replaces its own
    changes and counts nothing twice.
    """
    rows = reviews.select(
        "id", F.coalesce("product_key", F.lit("")).alias("product_key"), iso_week(F.col("posted_at")).alias("iso_week"),
        F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("version"), F.coalesce("rating", F.lit(-1)).cast("long").alias("rating"))
    changed = rows.groupBy("id").applyInPandasWithState(
        _change, CHANGES, "version long, product_key string, iso_week string, rating long", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy("product_key", "iso_week").agg(*[F.sum(c).alias(c) for c in ("n", "rated", "rating_sum")])
         .withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(changes))
    return (changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def weekly_stats(changes: DataFrame) -> DataFrame:
    """(product_key, iso_week, n, avg_rating) that the changes written so far add up to (A8's input)."""
    total = changes.groupBy("product_key", "iso_week").agg(*[F.sum(c).alias(c) for c in ("n", "rated", "rating_sum")])
    mean = F.when(F.col("rated") > 0, F.col("rating_sum") / F.col("rated"))
    return total.where("n > 0").select("product_key", "iso_week", "n", mean.alias("avg_rating"))


def product_stats(changes: DataFrame) -> DataFrame:
    """A1 from the same changes: (product_key, total_reviews, avg_rating)."""
    total = changes.groupBy("product_key").agg(*[F.sum(c).alias(c) for c in ("n", "rated", "rating_sum")])
    mean = F.when(F.col("rated") > 0, F.col("rating_sum") / F.col("rated"))
    return total.where("n > 0").select("product_key", F.col("n").alias("total_reviews"), round2_or_zero(mean).alias("avg_rating"))
