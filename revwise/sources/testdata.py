"""Adapters that present the driver's test tables in the review data model.

The reference stores reviews, runs, embeddings and model calls; the test
parquet holds documents, events, embeddings and conversations.  These
functions are plain projections/joins (no filters, no sampling), so every
query over them reads the whole tables.  The same mapping is written as SQL
in ``revwise.plans.registry`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revwise.functions.text import sha1_id
from revwise.operators.aggregates import stored_reviews

# Ingest clock of the adapter batch (the reference stamps `now`).
ADAPTER_INGESTED_AT = "2024-06-01 00:00:00"
ADAPTER_EPOCH = "2024-01-01 00:00:00"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⟕ labels in the `reviews` schema (see FIXTURES.md §2)."""
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels")
    # labels is a dimension of documents; Catalyst broadcasts it only while its
    # size estimate is under spark.sql.autoBroadcastJoinThreshold, else shuffles.
    j = d.join(lab, "doc_id", "left")
    source = F.when(F.col("doc_id") % 4 == 0, F.lit("appstore")).otherwise(F.lit("playstore"))
    ext = F.col("doc_id").cast("string")
    rating = (F.when(F.col("toxic") == 1, F.lit(1))
              .when(F.col("quality") == 0, F.lit(2))
              .when(F.col("quality") == 1, (F.lit(3) + F.col("doc_id") % 3).cast("int")))
    return j.select(
        sha1_id(source, ext).alias("id"),
        F.col("source").alias("product_key"),
        source.alias("source"),
        ext.alias("external_id"),
        F.col("text").alias("body"),
        rating.cast("int").alias("rating"),
        F.lit(None).cast("string").alias("title"),
        F.expr(f"timestampadd(HOUR, CAST(doc_id AS INT), TIMESTAMP_NTZ '{ADAPTER_EPOCH}')")
        .alias("posted_at"),
        F.lit(None).cast("string").alias("version"),
        F.col("lang").alias("language"),
        F.lit("in").alias("country"),
        F.lit(ADAPTER_INGESTED_AT).cast("timestamp_ntz").alias("ingested_at"),
        F.col("doc_id"),
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews as the store keeps them: filters passed, body and title masked."""
    return stored_reviews(reviews(spark, sf_dir))


# event_type → run status (events stand in for the run status log)
EVENT_STATUS = {"signup": "pending", "view": "ingested", "click": "clustered",
                "purchase": "summarized", "error": "failed"}


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a run status log: user_id = run, event_type → status."""
    e = load(spark, sf_dir, "events")
    status = F.lit(None).cast("string")
    for k, v in reversed(list(EVENT_STATUS.items())):
        status = F.when(F.col("event_type") == k, F.lit(v)).otherwise(status)
    return e.select(F.col("user_id").cast("string").alias("run_id"), status.alias("status"),
                    F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"),
                    F.col("value"), F.col("event_type"))


def cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as one run's clustered vectors: label-1 is the cluster (-1 noise)."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.lit("run-0").alias("run_id"),
                    F.col("vec_id").cast("string").alias("review_id"),
                    F.col("vec_id"),
                    F.col("embedding"),
                    (F.col("label") - 1).alias("cluster"))


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a model call log: conv = run, turn = seq, tokens = len // 4; an
    attempt failed (``ok`` false) when its text's length divides by 5."""
    c = load(spark, sf_dir, "conversations")
    toks = F.floor(F.length("text") / 4).cast("bigint")
    is_prompt = F.col("role").isin("user", "system")
    return c.select(F.col("conv_id").cast("string").alias("run_id"),
                    F.col("turn").cast("int").alias("seq"),
                    F.col("role"), (F.length("text") % 5 != 0).alias("ok"),
                    F.when(is_prompt, toks).otherwise(F.lit(0).cast("bigint")).alias("prompt_tokens"),
                    F.when(~is_prompt, toks).otherwise(F.lit(0).cast("bigint")).alias("completion_tokens"))


def clustered_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run's clustered reviews: embeddings (label − 1 = cluster) ⋈ stored (accepted and
    masked) reviews on doc id."""
    e = load(spark, sf_dir, "embeddings")
    r = stored(spark, sf_dir)
    j = e.join(r, e.vec_id == r.doc_id)
    return j.select(F.lit("run-0").alias("run_id"), F.col("id").alias("review_id"), "doc_id",
                    "embedding", (F.col("label") - 1).alias("cluster"), "body", "rating",
                    "source", "posted_at", "product_key")
