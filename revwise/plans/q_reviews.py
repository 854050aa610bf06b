"""Queries on the review table: filters, masks, ids, dates, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from revwise.functions import text as T
from revwise.operators import aggregates as A
from revwise.operators import filters as FL
from revwise.plans.registry import REVIEWS_CTE, query, with_ctes
from revwise.plans import sqlparts as S
from revwise.sources import feeds as FD
from revwise.sources.testdata import load, reviews

WINDOW_NOW = "2024-03-01 00:00:00"
WINDOW_WEEKS = 4


def ts_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("q_product_stats", with_ctes(REVIEWS_CTE) + f"""
SELECT product_key, count(*) AS total_reviews,
       coalesce(CAST(printf('%.2f', avg(rating)) AS DOUBLE), 0.0) AS avg_rating
FROM reviews WHERE {S.valid_sql()} GROUP BY product_key""")
def q_product_stats(spark, sf):
    return A.product_stats(A.stored_reviews(reviews(spark, sf)))


@query("q_window_filter", with_ctes(REVIEWS_CTE) + f"""
SELECT id, product_key, {S.ts_text_sql('posted_at')} AS posted_at
FROM reviews WHERE posted_at >= TIMESTAMP '{WINDOW_NOW}' - INTERVAL {WINDOW_WEEKS * 7} DAY""")
def q_window_filter(spark, sf):
    r = FL.window_filter(reviews(spark, sf), WINDOW_NOW, WINDOW_WEEKS)
    return r.select("id", "product_key", ts_text(F.col("posted_at")).alias("posted_at"))


@query("q_valid_reviews", with_ctes(REVIEWS_CTE) + f"""
SELECT id, product_key, {S.word_count_sql('body')} AS word_count
FROM reviews WHERE {S.valid_sql()}""")
def q_valid_reviews(spark, sf):
    r = FL.valid_reviews(reviews(spark, sf))
    return r.select("id", "product_key", T.word_count(F.col("body")).alias("word_count"))


@query("q_min_chars", with_ctes(REVIEWS_CTE) + """
SELECT id, CAST(length(body) AS INTEGER) AS n_chars FROM reviews WHERE length(body) >= 20""")
def q_min_chars(spark, sf):
    return FL.min_chars(reviews(spark, sf)).select("id", F.length("body").alias("n_chars"))


@query("q_rejects", with_ctes(REVIEWS_CTE) + f"""
, checked AS (
  SELECT id,
         list_filter([
           CASE WHEN NOT coalesce(source IN ('appstore', 'playstore'), false) THEN 'bad_source' END,
           CASE WHEN product_key IS NULL THEN 'null_product' END,
           CASE WHEN external_id IS NULL THEN 'null_external_id' END,
           CASE WHEN body IS NULL THEN 'null_body' END,
           CASE WHEN NOT {S.language_ok_sql('language')} THEN 'language' END,
           CASE WHEN NOT coalesce({S.word_count_sql('body')} >= 3, false) THEN 'too_short' END,
           CASE WHEN NOT coalesce({S.not_emoji_only_sql('body')}, false) THEN 'emoji_only' END
         ], lambda x: x IS NOT NULL) AS reasons
  FROM reviews)
SELECT id, array_to_string(reasons, ',') AS reasons, reasons[1] AS first_reason
FROM checked WHERE len(reasons) > 0""")
def q_rejects(spark, sf):
    r = FL.rejects(reviews(spark, sf))
    return r.select("id", F.array_join("reasons", ",").alias("reasons"), "first_reason")


@query("q_filter_counts", with_ctes(REVIEWS_CTE) + f"""
SELECT CASE WHEN NOT coalesce(source IN ('appstore', 'playstore'), false) THEN 'bad_source'
            WHEN product_key IS NULL THEN 'null_product'
            WHEN external_id IS NULL THEN 'null_external_id'
            WHEN body IS NULL THEN 'null_body'
            WHEN NOT {S.language_ok_sql('language')} THEN 'language'
            WHEN NOT coalesce({S.word_count_sql('body')} >= 3, false) THEN 'too_short'
            WHEN NOT coalesce({S.not_emoji_only_sql('body')}, false) THEN 'emoji_only'
            ELSE 'accepted' END AS reason,
       count(*) AS n
FROM reviews GROUP BY 1""")
def q_filter_counts(spark, sf):
    return FL.filter_counts(reviews(spark, sf))


@query("q_mask_pii", with_ctes(REVIEWS_CTE) + f"""
SELECT id, {S.mask_sql('body')} AS body FROM reviews""")
def q_mask_pii(spark, sf):
    r = reviews(spark, sf)
    return r.select("id", T.mask_pii(F.col("body")).alias("body"))


@query("q_mask_pii_strict", with_ctes(REVIEWS_CTE) + f"""
SELECT id, {S.mask_sql('substring(body, 1, 300)', strict=True)} AS sample_300,
       {S.mask_sql('substring(body, 1, 400)', strict=True)} AS line_400,
       {S.mask_sql('body', strict=True)} AS body
FROM reviews""")
def q_mask_pii_strict(spark, sf):
    r = reviews(spark, sf)
    return r.select("id",
                    T.mask_pii_strict(F.substring("body", 1, 300)).alias("sample_300"),
                    T.mask_pii_strict(F.substring("body", 1, 400)).alias("line_400"),
                    T.mask_pii_strict(F.col("body")).alias("body"))


@query("q_stored_reviews", with_ctes(REVIEWS_CTE) + f"""
SELECT id, product_key, source, {S.mask_sql('body')} AS body, rating
FROM reviews WHERE {S.valid_sql()}""")
def q_stored_reviews(spark, sf):
    return A.stored_reviews(reviews(spark, sf)).select("id", "product_key", "source", "body",
                                                       "rating")


@query("q_stable_ids", with_ctes(REVIEWS_CTE) + f"""
SELECT DISTINCT product_key, {S.iso_week_sql('posted_at')} AS iso_week,
       sha1(product_key || {S.iso_week_sql('posted_at')}) AS run_id
FROM reviews""")
def q_stable_ids(spark, sf):
    r = reviews(spark, sf).select("product_key", T.iso_week(F.col("posted_at")).alias("iso_week"))
    return r.distinct().withColumn("run_id", T.sha1_id(F.col("product_key"), F.col("iso_week")))


@query("q_fallback_ids", with_ctes(REVIEWS_CTE) + """
SELECT id,
       coalesce(CASE WHEN source = 'playstore' THEN external_id END,
                sha1(coalesce(CASE WHEN rating IS NOT NULL THEN product_key END, 'Anonymous')
                     || coalesce(strftime(posted_at, '%Y-%m-%dT%H:%M:%S'), 'None')
                     || coalesce(substring(body, 1, 20), ''))) AS external_id
FROM reviews""")
def q_fallback_ids(spark, sf):
    """C4 on rows whose feed node had no id (here: the appstore rows); the
    author is known only for rated rows, others fall back to 'Anonymous'."""
    r = reviews(spark, sf)
    ext = F.when(F.col("source") == "playstore", F.col("external_id"))
    author = F.when(F.col("rating").isNotNull(), F.col("product_key"))
    date_text = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss")
    return r.select("id", T.fallback_external_id(ext, author, date_text, F.col("body"))
                    .alias("external_id"))


@query("q_iso_week", with_ctes(REVIEWS_CTE) + f"""
SELECT id, {S.iso_week_sql('posted_at')} AS iso_week,
       CAST(split_part({S.iso_week_sql('posted_at')}, '-W', 1) AS INTEGER) AS year,
       CAST(split_part({S.iso_week_sql('posted_at')}, '-W', 2) AS INTEGER) AS week
FROM reviews""")
def q_iso_week(spark, sf):
    r = reviews(spark, sf).select("id", T.iso_week(F.col("posted_at")).alias("iso_week"))
    y, w = T.parse_iso_week(F.col("iso_week"))
    return r.select("id", "iso_week", y.alias("year"), w.alias("week"))


@query("q_text_cache_key", with_ctes(REVIEWS_CTE) + f"""
SELECT id, sha1({S.collapse_sql('body')}) AS cache_key FROM reviews""")
def q_text_cache_key(spark, sf):
    r = reviews(spark, sf)
    return r.select("id", T.text_cache_key(F.col("body")).alias("cache_key"))


@query("q_window_weeks", with_ctes(REVIEWS_CTE) + """
SELECT product_key, CAST(min(posted_at) AS DATE)::VARCHAR AS window_start,
       CAST(max(posted_at) AS DATE)::VARCHAR AS window_end,
       CAST(floor(date_diff('day', CAST(min(posted_at) AS DATE), CAST(max(posted_at) AS DATE)) / 7)
            AS INTEGER) AS weeks
FROM reviews GROUP BY product_key""")
def q_window_weeks(spark, sf):
    r = (reviews(spark, sf).groupBy("product_key")
         .agg(F.to_date(F.min("posted_at")).alias("ws"), F.to_date(F.max("posted_at")).alias("we")))
    return r.select("product_key", F.col("ws").cast("string").alias("window_start"),
                    F.col("we").cast("string").alias("window_end"),
                    T.window_weeks(F.col("ws"), F.col("we")).alias("weeks"))


@query("q_source_counts", with_ctes(REVIEWS_CTE) + """
SELECT source, count(*) AS n FROM reviews GROUP BY source""")
def q_source_counts(spark, sf):
    return A.source_counts(reviews(spark, sf))


@query("q_source_coverage", with_ctes(REVIEWS_CTE) + """
SELECT product_key, count(DISTINCT source) AS n_sources, count(DISTINCT language) AS n_languages,
       array_to_string(list_sort(list_distinct(list(source))), ',') AS sources,
       array_to_string(list_sort(list_distinct(list(language))), ',') AS languages
FROM reviews GROUP BY product_key""")
def q_source_coverage(spark, sf):
    return A.source_coverage(reviews(spark, sf))


@query("q_table_counts", with_ctes(REVIEWS_CTE) + """
SELECT 'reviews' AS table_name, count(*) AS n FROM reviews
UNION ALL SELECT 'review_embeddings', count(*) FROM embeddings
UNION ALL SELECT 'runs', count(DISTINCT user_id) FROM events
UNION ALL SELECT 'products', count(DISTINCT source) FROM documents""")
def q_table_counts(spark, sf):
    """A2: rows of the store's tables (runs and products as the tables imply them)."""
    r = reviews(spark, sf)
    return A.table_counts({"reviews": r, "review_embeddings": load(spark, sf, "embeddings"),
                           "runs": load(spark, sf, "events").where("user_id is not null").select("user_id").distinct(),
                           "products": r.where("product_key is not null").select("product_key").distinct()})


@query("q_sample_review", with_ctes(REVIEWS_CTE) + """
SELECT id, source, rating, substring(body, 1, 200) AS body FROM reviews ORDER BY id LIMIT 1""")
def q_sample_review(spark, sf):
    """The sample review."""
    return A.sample_review(reviews(spark, sf))


BACKFILL_WEEK = "2024-W04"


@query("q_backfill_stats", with_ctes(REVIEWS_CTE) + f"""
SELECT product_key, count(*) AS total_reviews, coalesce(CAST(printf('%.2f', avg(rating)) AS DOUBLE), 0.0) AS avg_rating
FROM reviews WHERE {S.valid_sql()}
  AND posted_at >= TIMESTAMP '2024-01-28 18:30:00' - INTERVAL {WINDOW_WEEKS * 7} DAY AND posted_at < TIMESTAMP '2024-01-28 18:30:00'
GROUP BY product_key""")
def q_backfill_stats(spark, sf):
    """A1 over the window of a given week."""
    return A.product_stats(FL.backfill_window(A.stored_reviews(reviews(spark, sf)), BACKFILL_WEEK, WINDOW_WEEKS))


@query("q_parse_dates", with_ctes(REVIEWS_CTE) + f"""
SELECT id, CASE WHEN doc_id % 5 = 4 THEN {S.ts_text_sql('ingested_at')} ELSE {S.ts_text_sql('posted_at')} END AS posted_at,
       doc_id % 5 = 4 AS defaulted
FROM reviews""")
def q_parse_dates(spark, sf):
    """Dates written with Z, with an offset, without a zone, with a blank, and not at all."""
    at, n = F.col("posted_at"), F.col("doc_id") % 5
    east = F.date_format(at + F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'+05:30'")
    text = (F.when(n == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, east)
            .when(n == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(n == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.lit("last week")))
    posted, defaulted = FD.parse_date(F.col("date_text"), F.col("ingested_at"))
    rows = reviews(spark, sf).withColumn("date_text", text)
    return rows.select("id", ts_text(posted).alias("posted_at"), defaulted.alias("defaulted"))
