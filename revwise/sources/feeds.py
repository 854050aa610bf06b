"""Landed review feeds (S1, S2, S3) → the review schema.

Fetching is outside this package: pages and batches are landed as files and
read with ``spark.read``; these functions take the landed DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revwise.functions.text import fallback_external_id, mask_pii, sha1_id
from revwise.operators.filters import enough_words, not_emoji_only

# Feed page: entries hold ``.label`` leaves; the first entry (the app record)
# has no author.  ``author`` is read as raw JSON text: only its presence counts.
FEED_SCHEMA = ("feed struct<entry: array<struct<id: struct<label: string>, author: string, "
               "title: struct<label: string>, content: struct<label: string>, "
               "updated: struct<label: string>, `im:rating`: struct<label: string>, "
               "`im:version`: struct<label: string>>>>")

STORE_SCHEMA = ("product_key string, reviewId string, content string, score int, at string, "
                "reviewCreatedVersion string")

SCRIPT_RE = r"(?s)<script[^>]*>(.*?)</script>"
OBJECT_RE = r"(?s)\{.*\}"
REVIEW_KIND = "Review"


def parse_date(text: Column, fallback: Column) -> tuple[Column, Column]:
    """ISO text ('Z', offset or zone-less = UTC) → UTC timestamp; bad text
    falls back to ``fallback`` and sets a flag (X15)."""
    zoned = text.rlike(r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)$")
    local = F.try_to_timestamp(text).cast("timestamp_ntz")   # wall clock in the session zone
    utc = F.when(zoned, F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)) \
        .otherwise(text.try_cast("timestamp_ntz"))              # zone-less text is UTC already
    return F.coalesce(utc, fallback), utc.isNull()


def _finish(rows: DataFrame, source: str, since: str | None, ingested_at: str) -> DataFrame:
    """Common tail: window, ingestion filters, masking, stable ids (the feed
    carries no language, so the language rule sees 'en')."""
    fb = F.lit(ingested_at).cast("timestamp_ntz")
    posted, defaulted = parse_date(F.col("date_text"), fb)
    out = rows.select("*", posted.alias("posted_at"), defaulted.alias("posted_at_defaulted"))
    if since is not None:
        out = out.filter(F.col("posted_at") >= F.lit(since).cast("timestamp_ntz"))
    out = out.filter(enough_words(F.col("body")) & not_emoji_only(F.col("body")))
    return out.select(
        sha1_id(F.lit(source), F.col("external_id")).alias("id"),
        "product_key", F.lit(source).alias("source"), "external_id",
        mask_pii(F.col("body")).alias("body"), F.col("rating").cast("int").alias("rating"),
        mask_pii(F.col("title")).alias("title"), "posted_at", "posted_at_defaulted",
        F.col("version"), F.lit("en").alias("language"), F.lit("in").alias("country"),
        fb.alias("ingested_at"))


def feed_reviews(pages: DataFrame, since: str | None, ingested_at: str) -> DataFrame:
    """(product_key, value JSON text) pages → review rows."""
    e = (pages.select("product_key", F.explode(F.from_json("value", FEED_SCHEMA)["feed"]["entry"])
                      .alias("e"))
         .filter(F.col("e.author").isNotNull()))
    rows = e.select(
        "product_key",
        F.coalesce(F.col("e.id.label"), F.lit("")).alias("external_id"),
        F.coalesce(F.col("e.content.label"), F.lit("")).alias("body"),
        F.col("e.title.label").alias("title"),
        F.coalesce(F.col("e.updated.label"), F.lit("")).alias("date_text"),
        F.coalesce(F.col("e.`im:rating`.label").cast("int"), F.lit(0)).alias("rating"),
        F.col("e.`im:version`.label").alias("version"))
    return _finish(rows, "appstore", since, ingested_at)


#: Nesting that the walk follows; a deeper one ends with an error.
MAX_DEPTH = 10_000


def _children(node: Column) -> Column:
    """The values of an object or array VARIANT; null for any other."""
    return F.coalesce(F.map_values(F.try_variant_get(node, "$", "map<string,variant>")),
                      F.try_variant_get(node, "$", "array<variant>"))


def _review_fields(node: Column) -> Column:
    def g(path: str, typ: str = "string") -> Column:
        return F.try_variant_get(node, path, typ)
    return F.struct(*(g(f"$.{c}").alias(c) for c in ("id", "contents", "reviewerName", "date", "title")),
                    g("$.rating", "int").alias("rating"))


def _walk_reviews(roots: DataFrame) -> DataFrame:
    """Fields of all nested objects with ``$kind = 'Review'`` under each root VARIANT (product_key,
    node, levels), at any depth.

    A page is walked level by level inside its row, so nothing is shuffled and a task reads no more
    than its pages.  ``levels`` is at least the page's nesting; levels that don't exist are empty.
    """
    def is_review(node: Column) -> Column:
        return F.try_variant_get(node, '$["$kind"]', "string") == REVIEW_KIND

    def step(state: Column, _: Column) -> Column:
        level = state["level"]
        following = F.struct(
            F.flatten(F.filter(F.transform(level, _children), F.isnotnull)).alias("level"),
            F.concat(state["hits"], F.transform(F.filter(level, is_review), _review_fields)).alias("hits"))
        return F.when(F.size(level) > 0, following).otherwise(state)
    start = F.struct(F.array("node").alias("level"),
                     F.filter(F.array(_review_fields(F.col("node"))), lambda _: F.lit(False)).alias("hits"))
    walked = roots.select("product_key", F.aggregate(
        F.sequence(F.lit(1), F.least("levels", F.lit(MAX_DEPTH))), start, step).alias("w"), "levels")
    deeper = (F.col("levels") > MAX_DEPTH) & F.exists("w.level", lambda n: _children(n).isNotNull())
    hits = F.when(deeper, F.raise_error(F.lit(f"a page nests deeper than {MAX_DEPTH} levels"))).otherwise(F.col("w.hits"))
    return walked.select("product_key", F.explode(hits).alias("hit")).select("product_key", "hit.*")


def page_reviews(pages: DataFrame, since: str | None, ingested_at: str) -> DataFrame:
    """(product_key, html) → reviews found in embedded page JSON."""
    scripts = (pages.filter(F.col("html").contains("reviewerName"))
               .select("product_key", F.explode(F.regexp_extract_all("html", F.lit(SCRIPT_RE), 1))
                       .alias("script"))
               .filter(F.col("script").contains("reviewerName")))
    objects = scripts.select("product_key", F.regexp_extract("script", OBJECT_RE, 0).alias("object"))
    roots = (objects.select("product_key", F.try_parse_json("object").alias("node"),
                            # Every level opens a bracket.
                            (F.length("object") - F.length(F.translate("object", "{[", ""))).alias("levels"))
             .filter(F.col("node").isNotNull()))
    hits = _walk_reviews(roots)
    body = F.coalesce(F.col("contents"), F.lit(""))
    rows = hits.select(
        "product_key",
        fallback_external_id(F.col("id"), F.col("reviewerName"), F.col("date"), body).alias("external_id"),
        body.alias("body"), F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("date"), F.lit("")).alias("date_text"),
        F.coalesce(F.col("rating"), F.lit(0)).alias("rating"),
        F.lit(None).cast("string").alias("version"))
    return _finish(rows, "appstore", since, ingested_at)


def appstore_reviews(pages: DataFrame, html_pages: DataFrame, since: str | None,
                     ingested_at: str) -> DataFrame:
    """S1 + S2: page fallback only for products whose feed gave no entries."""
    feed = feed_reviews(pages, since, ingested_at)
    with_entries = (pages.select("product_key", F.explode(F.from_json("value", FEED_SCHEMA)["feed"]["entry"]))
                    .select("product_key").distinct())
    fallback_pages = html_pages.join(with_entries, "product_key", "left_anti")
    return feed.unionByName(page_reviews(fallback_pages, since, ingested_at))


def store_rows(batches: DataFrame, since: str | None, ingested_at: str) -> DataFrame:
    """S3: second store's rows; rows without a date are skipped, title is null.

    A row without a score counts 0, one whose score is null has no rating (C6): ``has_score``
    tells them apart where ``batches`` has it (``read_store_batches``); without it a null
    score is taken as absent.
    """
    has_score = F.col("has_score") if "has_score" in batches.columns else F.col("score").isNotNull()
    rows = batches.filter(F.col("at").isNotNull()).select(
        "product_key", F.col("reviewId").alias("external_id"),
        F.coalesce(F.col("content"), F.lit("")).alias("body"),
        F.lit(None).cast("string").alias("title"), F.col("at").alias("date_text"),
        F.when(has_score, F.col("score")).otherwise(F.lit(0)).alias("rating"),
        F.col("reviewCreatedVersion").alias("version"))
    return _finish(rows, "playstore", since, ingested_at)


def read_feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed pages: one JSON document per file, folder per product."""
    return (spark.read.option("wholetext", True).text(path)
            .withColumn("product_key", F.regexp_extract(F.col("_metadata.file_path"),
                                                     r"product_key=([^/]+)", 1)))


def parse_store_lines(lines: DataFrame) -> DataFrame:
    """Rows of landed JSON lines (value), and whether each has a score at all."""
    parsed = lines.select(F.from_json("value", STORE_SCHEMA).alias("r"),
                          F.array_contains(F.json_object_keys("value"), "score").alias("has_score"))
    return parsed.select("r.*", F.coalesce("has_score", F.lit(False)).alias("has_score"))


def read_store_batches(spark: SparkSession, path: str) -> DataFrame:
    return parse_store_lines(spark.read.text(path))
