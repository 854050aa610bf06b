"""Queries on run status, alerts and the store's upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from revwise.operators import aggregates as A
from revwise.operators import runs as RU
from revwise.functions import text as T
from revwise.plans import sqlparts as S
from revwise.plans.registry import REVIEWS_CTE, RUN_EVENTS_CTE, query, with_ctes
from revwise.sources import store as ST
from revwise.sources.testdata import load, reviews, run_events


def ts_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def ts_text_sql(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


LATEST_CTE = """
latest AS (
  SELECT run_id, status, updated_at, n_events FROM (
    SELECT run_id, status, max(updated_at) OVER (PARTITION BY run_id) AS updated_at,
           count(*) OVER (PARTITION BY run_id) AS n_events,
           row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, seq DESC) AS rn
    FROM run_events) WHERE rn = 1
)"""


@query("q_run_latest_status", with_ctes(RUN_EVENTS_CTE, LATEST_CTE) + f"""
SELECT run_id, status, {ts_text_sql('updated_at')} AS updated_at, n_events FROM latest""")
def q_run_latest_status(spark, sf):
    lt = RU.latest_status(run_events(spark, sf))
    return lt.select("run_id", "status", ts_text(F.col("updated_at")).alias("updated_at"),
                     "n_events")


@query("q_status_counters", with_ctes(RUN_EVENTS_CTE, LATEST_CTE) + """
SELECT count(*) AS total,
       count(*) FILTER (WHERE status = 'pending') AS pending,
       count(*) FILTER (WHERE status = 'ingested') AS ingested,
       count(*) FILTER (WHERE status = 'clustered') AS clustered,
       count(*) FILTER (WHERE status = 'summarized') AS summarized,
       count(*) FILTER (WHERE status = 'rendered') AS rendered,
       count(*) FILTER (WHERE status = 'published') AS published,
       count(*) FILTER (WHERE status = 'failed') AS failed
FROM latest""")
def q_status_counters(spark, sf):
    return A.status_counters(RU.latest_status(run_events(spark, sf)))


@query("q_recent_runs", with_ctes(RUN_EVENTS_CTE, LATEST_CTE) + f"""
SELECT run_id, status, {ts_text_sql('updated_at')} AS updated_at FROM latest
ORDER BY updated_at DESC, run_id LIMIT 5""")
def q_recent_runs(spark, sf):
    r = RU.recent_runs(RU.latest_status(run_events(spark, sf)), 5)
    return r.select("run_id", "status", ts_text(F.col("updated_at")).alias("updated_at"))


@query("q_latest_successful_run", with_ctes(RUN_EVENTS_CTE, LATEST_CTE) + f"""
SELECT run_id, status, {ts_text_sql('updated_at')} AS updated_at FROM latest
WHERE status IN ('summarized', 'published') ORDER BY updated_at DESC, run_id LIMIT 1""")
def q_latest_successful_run(spark, sf):
    r = RU.recent_runs(RU.latest_status(run_events(spark, sf)), 1, successful_only=True)
    return r.select("run_id", "status", ts_text(F.col("updated_at")).alias("updated_at"))


@query("q_next_stage", with_ctes(RUN_EVENTS_CTE) + """
, ranked AS (
  SELECT run_id, status,
         row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, seq DESC) AS rn,
         row_number() OVER (PARTITION BY run_id, status = 'failed'
                            ORDER BY updated_at DESC, seq DESC) AS rn_ok
  FROM run_events),
cur AS (SELECT run_id, status FROM ranked WHERE rn = 1),
ok AS (SELECT run_id, status AS last_ok FROM ranked WHERE rn_ok = 1 AND status <> 'failed'),
stage AS (SELECT * FROM (VALUES ('pending', 'ingest'), ('ingested', 'cluster'),
          ('clustered', 'summarize'), ('summarized', 'render'), ('rendered', 'publish'),
          ('published', 'done')) t(status, next_stage))
SELECT c.run_id, c.status,
       coalesce(CASE WHEN c.status = 'failed' THEN coalesce(s2.next_stage, 'ingest') END,
                s1.next_stage, 'ingest') AS next_stage
FROM cur c LEFT JOIN ok o ON c.run_id = o.run_id
LEFT JOIN stage s1 ON s1.status = c.status
LEFT JOIN stage s2 ON s2.status = o.last_ok""")
def q_next_stage(spark, sf):
    return RU.next_stage(run_events(spark, sf))


@query("q_error_rates", with_ctes(RUN_EVENTS_CTE) + """
SELECT run_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed,
       count(*) FILTER (WHERE event_type = 'error') / count(*) AS failure_share,
       count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.02 AS response_alert,
       count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.01 AS delivery_alert
FROM run_events GROUP BY run_id""")
def q_error_rates(spark, sf):
    ev = run_events(spark, sf).withColumn("failed", F.col("event_type") == "error")
    return RU.error_rates(ev)


@query("q_wow_alerts", with_ctes(RUN_EVENTS_CTE) + f"""
, weekly AS (
  SELECT event_type AS product_key, {S.iso_week_sql('updated_at')} AS iso_week,
         CAST(date_trunc('week', updated_at + INTERVAL 330 MINUTE) AS DATE) AS week_start,
         count(*) AS n, avg(value) AS mean
  FROM run_events GROUP BY ALL),
lagged AS (
  SELECT *, lag(week_start) OVER w AS prev_start, lag(n) OVER w AS pn, lag(mean) OVER w AS pm
  FROM weekly WINDOW w AS (PARTITION BY product_key ORDER BY week_start))
SELECT product_key, iso_week, n, mean,
       CASE WHEN prev_start + 7 = week_start THEN pn END AS prior_n,
       CASE WHEN prev_start + 7 = week_start THEN pm END AS prior_mean,
       coalesce(CASE WHEN prev_start + 7 = week_start THEN pn END > 0
                AND n < CASE WHEN prev_start + 7 = week_start THEN pn END * 0.5, false)
         AS volume_alert,
       coalesce(abs(mean - CASE WHEN prev_start + 7 = week_start THEN pm END) > 1.0, false)
         AS rating_alert
FROM lagged""")
def q_wow_alerts(spark, sf):
    weekly = RU.weekly_stats(run_events(spark, sf), "event_type", "updated_at", "value")
    return RU.wow_alerts(weekly)


# --- store upserts -----------------------------------------------------------

def products_registry(spark, sf):
    """Registry as stored: one product per documents.source."""
    r = reviews(spark, sf)
    return (r.groupBy(F.col("product_key").alias("key"))
            .agg(F.min(F.when(F.col("source") == "appstore", F.col("external_id")))
                 .alias("appstore_id"))
            .select("key", F.concat(F.lit("Product "), "key").alias("display"), "appstore_id",
                    F.concat(F.lit("com.example."), "key").alias("play_package"),
                    F.concat(F.lit("doc-"), "key").alias("gdoc_id"),
                    F.lit(None).cast("string").alias("gmail_to")))


def products_update(spark, sf):
    """New registry rows: products seen in labelled reviews, plus one per language."""
    r = reviews(spark, sf).filter(F.col("rating").isNotNull())
    seen = (r.groupBy(F.col("product_key").alias("key"))
            .agg(F.max(F.when(F.col("source") == "appstore", F.col("external_id")))
                 .alias("appstore_id"))
            .select("key", F.upper("key").alias("display"), "appstore_id",
                    F.lit(None).cast("string").alias("play_package"),
                    F.concat(F.lit("new-doc-"), "key").alias("gdoc_id"),
                    F.concat("key", F.lit("@example.com")).alias("gmail_to")))
    langs = (load(spark, sf, "documents").select(F.concat(F.lit("lang-"), "lang").alias("key"))
             .distinct()
             .select("key", F.concat(F.lit("Language "), "key").alias("display"),
                     F.lit(None).cast("string").alias("appstore_id"),
                     F.lit(None).cast("string").alias("play_package"),
                     F.lit(None).cast("string").alias("gdoc_id"),
                     F.lit(None).cast("string").alias("gmail_to")))
    return seen.unionByName(langs)


PRODUCTS_SQL = """
products_old AS (
  SELECT product_key AS key, 'Product ' || product_key AS display,
         min(CASE WHEN source = 'appstore' THEN external_id END) AS appstore_id,
         'com.example.' || product_key AS play_package, 'doc-' || product_key AS gdoc_id,
         CAST(NULL AS VARCHAR) AS gmail_to
  FROM reviews GROUP BY product_key),
products_new AS (
  SELECT product_key AS key, upper(product_key) AS display,
         max(CASE WHEN source = 'appstore' THEN external_id END) AS appstore_id,
         CAST(NULL AS VARCHAR) AS play_package, 'new-doc-' || product_key AS gdoc_id,
         product_key || '@example.com' AS gmail_to
  FROM reviews WHERE rating IS NOT NULL GROUP BY product_key
  UNION ALL
  SELECT DISTINCT 'lang-' || lang, 'Language ' || 'lang-' || lang, NULL, NULL, NULL, NULL
  FROM documents)"""


@query("q_upsert_products", with_ctes(REVIEWS_CTE, PRODUCTS_SQL) + """
SELECT coalesce(n.key, o.key) AS key,
       CASE WHEN n.key IS NOT NULL THEN n.display ELSE o.display END AS display,
       CASE WHEN n.key IS NOT NULL THEN n.appstore_id ELSE o.appstore_id END AS appstore_id,
       CASE WHEN n.key IS NOT NULL THEN n.play_package ELSE o.play_package END AS play_package,
       CASE WHEN n.key IS NOT NULL THEN n.gmail_to ELSE o.gmail_to END AS gmail_to,
       o.gdoc_id
FROM products_old o FULL OUTER JOIN products_new n ON o.key = n.key""")
def q_upsert_products(spark, sf):
    return ST.upsert_products(products_registry(spark, sf), products_update(spark, sf))


@query("q_upsert_reviews", with_ctes(REVIEWS_CTE) + """
, new_batch AS (
  SELECT id, body || ' (edited)' AS body, rating, TIMESTAMP '2024-06-08 00:00:00' AS ingested_at
  FROM reviews WHERE rating IS NOT NULL)
SELECT r.id, coalesce(n.body, r.body) AS body, r.rating,
       strftime(coalesce(n.ingested_at, r.ingested_at), '%Y-%m-%d %H:%M:%S') AS ingested_at
FROM reviews r LEFT JOIN new_batch n ON r.id = n.id""")
def q_upsert_reviews(spark, sf):
    """The labelled reviews arrive again a week later with a changed body."""
    old = reviews(spark, sf)
    new = (old.filter(F.col("rating").isNotNull())
           .withColumn("body", F.concat("body", F.lit(" (edited)")))
           .withColumn("ingested_at", F.lit("2024-06-08 00:00:00").cast("timestamp_ntz")))
    up = ST.upsert_latest(old, new, "id", "ingested_at")
    return up.select("id", "body", "rating",
                     F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"))


@query("q_insert_absent", with_ctes(REVIEWS_CTE) + f"""
, existing AS (
  SELECT DISTINCT sha1(product_key || {S.iso_week_sql('posted_at')}) AS id, product_key,
         {S.iso_week_sql('posted_at')} AS iso_week, 'ingested' AS status
  FROM reviews WHERE source = 'appstore'),
candidates AS (
  SELECT DISTINCT sha1(product_key || {S.iso_week_sql('posted_at')}) AS id, product_key,
         {S.iso_week_sql('posted_at')} AS iso_week, 'pending' AS status
  FROM reviews)
SELECT * FROM existing
UNION ALL
SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.id = c.id)""")
def q_insert_absent(spark, sf):
    """Runs seen in the appstore feed exist; runs of all reviews are inserted
    only when absent."""
    r = reviews(spark, sf).select("product_key", "source",
                                  T.iso_week(F.col("posted_at")).alias("iso_week"))

    def runs_of(df, status):
        return (df.select("product_key", "iso_week").distinct()
                .select(T.sha1_id(F.col("product_key"), F.col("iso_week")).alias("id"),
                        "product_key", "iso_week", F.lit(status).alias("status")))
    existing = runs_of(r.filter(F.col("source") == "appstore"), "ingested")
    return RU.insert_absent(existing, runs_of(r, "pending"), "id")


@query("q_embed_cache_split", with_ctes(REVIEWS_CTE) + """
SELECT r.id AS review_id, CASE WHEN e.vec_id IS NULL THEN 'miss' ELSE 'hit' END AS cache
FROM reviews r LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON r.doc_id = e.vec_id""")
def q_embed_cache_split(spark, sf):
    """Reviews whose vector is cached (embeddings by doc id) vs. to embed."""
    wanted = reviews(spark, sf).select(F.col("id").alias("review_id"), F.col("doc_id"))
    cache = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    hits, misses = ST.embed_cache_split(wanted, cache, "doc_id")
    return (hits.select("review_id", F.lit("hit").alias("cache"))
            .unionByName(misses.select("review_id", F.lit("miss").alias("cache"))))


@query("q_union_sources", with_ctes(REVIEWS_CTE, PRODUCTS_SQL) + """
SELECT r.id, r.product_key, r.source FROM reviews r
WHERE (r.source = 'appstore' AND r.product_key IN (SELECT key FROM products_old
                                                     WHERE appstore_id IS NOT NULL))
   OR (r.source = 'playstore' AND r.product_key IN (SELECT key FROM products_old
                                                      WHERE play_package IS NOT NULL))""")
def q_union_sources(spark, sf):
    r = reviews(spark, sf).select("id", "product_key", "source")
    prods = products_registry(spark, sf)
    return ST.union_sources(r.filter(F.col("source") == "appstore"),
                            r.filter(F.col("source") == "playstore"), prods)
