"""Feed parsing queries over pages/batches that Spark derives from the review table.

The driver's tables hold no landed feed pages, so the pages are built from
the reviews (one page per review, as JSON text or as HTML with embedded
JSON) and parsed back; the DuckDB twin states what the parse must yield.
The real ``pages`` table (web pages without embedded reviews) goes through
the same page parser and must yield nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revwise.plans import sqlparts as S
from revwise.plans.registry import REVIEWS_CTE, query, with_ctes
from revwise.sources import feeds as FD
from revwise.sources.testdata import ADAPTER_INGESTED_AT, load, reviews

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _label(c):
    return F.struct(c.alias("label"))


def feed_pages(spark, sf):
    r = reviews(spark, sf).filter(F.col("source") == "appstore")
    app = F.to_json(F.struct(_label(F.col("product_key")).alias("id")))
    entry = F.to_json(F.struct(
        _label(F.col("external_id")).alias("id"),
        F.struct(_label(F.col("product_key")).alias("name")).alias("author"),
        _label(F.col("body")).alias("content"),
        _label(F.date_format("posted_at", ISO_Z)).alias("updated"),
        _label(F.col("rating").cast("string")).alias("im:rating")))
    return r.select("product_key", F.concat(F.lit('{"feed":{"entry":['), app, F.lit(","), entry,
                                            F.lit("]}}")).alias("value"))


@query("q_feed_reviews", with_ctes(REVIEWS_CTE) + f"""
SELECT id, product_key, external_id, {S.mask_sql('body')} AS body,
       coalesce(rating, 0) AS rating, strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at
FROM reviews
WHERE source = 'appstore' AND {S.word_count_sql('body')} >= 3 AND {S.not_emoji_only_sql('body')}""")
def q_feed_reviews(spark, sf):
    """Feed pages → reviews (no window: since = None)."""
    out = FD.feed_reviews(feed_pages(spark, sf), None, ADAPTER_INGESTED_AT)
    return out.select("id", "product_key", "external_id", "body", "rating",
                      F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))


def html_pages(spark, sf):
    r = reviews(spark, sf).filter(F.col("source") == "playstore")
    date = F.date_format("posted_at", ISO_Z)
    reply = F.struct(F.lit("Review").alias("$kind"), F.col("body").alias("contents"),
                     F.col("product_key").alias("reviewerName"), date.alias("date"),
                     F.col("rating").alias("rating"))
    node = F.to_json(F.struct(F.lit("Review").alias("$kind"), F.col("external_id").alias("id"),
                              F.col("body").alias("contents"),
                              F.col("product_key").alias("reviewerName"), date.alias("date"),
                              F.col("rating").alias("rating"), F.array(reply).alias("replies")))
    html = F.concat(F.lit('<html><head><script type="application/json">{"data":{"items":['), node,
                    F.lit("]}}</script><script>var ready = true;</script></head></html>"))
    derived = r.select("product_key", html.alias("html"))
    real = load(spark, sf, "pages").select(F.col("url").alias("product_key"), "html")
    return derived.unionByName(real)


@query("q_page_reviews", with_ctes(REVIEWS_CTE) + f"""
, nodes AS (
  SELECT product_key, external_id, body, rating, posted_at FROM reviews WHERE source = 'playstore'
  UNION ALL
  SELECT product_key,
         sha1(product_key || strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ')
              || substring(body, 1, 20)),
         body, rating, posted_at
  FROM reviews WHERE source = 'playstore')
SELECT sha1('appstore' || external_id) AS id, product_key, external_id, {S.mask_sql('body')} AS body,
       coalesce(rating, 0) AS rating,
       strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at
FROM nodes WHERE {S.word_count_sql('body')} >= 3 AND {S.not_emoji_only_sql('body')}""")
def q_page_reviews(spark, sf):
    """Reviews embedded in page JSON (nested replies included)."""
    out = FD.page_reviews(html_pages(spark, sf), None, ADAPTER_INGESTED_AT)
    return out.select("id", "product_key", "external_id", "body", "rating",
                      F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))


@query("q_store_batches", with_ctes(REVIEWS_CTE) + f"""
SELECT id, product_key, external_id, {S.mask_sql('body')} AS body,
       coalesce(rating, 0) AS rating, strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at
FROM reviews
WHERE source = 'playstore' AND {S.word_count_sql('body')} >= 3 AND {S.not_emoji_only_sql('body')}""")
def q_store_batches(spark, sf):
    """S3: second store's batch rows (zone-less dates read as UTC)."""
    r = reviews(spark, sf).filter(F.col("source") == "playstore")
    batch = r.select("product_key", F.col("external_id").alias("reviewId"),
                     F.col("body").alias("content"), F.col("rating").alias("score"),
                     F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("at"),
                     F.lit(None).cast("string").alias("reviewCreatedVersion"))
    out = FD.store_rows(batch, None, ADAPTER_INGESTED_AT)
    return out.select("id", "product_key", "external_id", "body", "rating",
                      F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))
