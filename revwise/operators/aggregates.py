"""Review and run counters (A1, A2, A3, A10).

Each is a single hash aggregate with a map-side partial step, so the shuffle
carries one row per (map task, key) whatever the skew of the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwise.functions.text import mask_pii, round2_or_zero
from revwise.operators.filters import valid_reviews

RUN_STATUSES = ("pending", "ingested", "clustered", "summarized", "rendered", "published", "failed")


def stored_reviews(raw: DataFrame, mask_title: bool = True) -> DataFrame:
    """Rows as the store keeps them: filters F2–F4 passed, body (and title) masked."""
    out = valid_reviews(raw).withColumn("body", mask_pii(F.col("body")))
    if mask_title:
        out = out.withColumn("title", mask_pii(F.col("title")))
    return out


def product_stats(reviews: DataFrame) -> DataFrame:
    """A1 + C15: review count and mean rating (nulls skipped) by product."""
    return (reviews.groupBy("product_key")
            .agg(F.count(F.lit(1)).alias("total_reviews"),
                 F.avg("rating").alias("avg_rating"))
            .withColumn("avg_rating", round2_or_zero(F.col("avg_rating"))))


def source_counts(reviews: DataFrame) -> DataFrame:
    """A2: reviews by source."""
    return reviews.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def status_counters(latest: DataFrame) -> DataFrame:
    """A3: one row of counters, one column per status (plus total)."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col("status") == s).alias(s) for s in RUN_STATUSES]
    return latest.agg(*aggs)


def source_coverage(reviews: DataFrame) -> DataFrame:
    """A10: distinct sources and languages by product."""
    return (reviews.groupBy("product_key")
            .agg(F.count_distinct("source").alias("n_sources"),
                 F.count_distinct("language").alias("n_languages"),
                 F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
                 F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A2: the number of rows of each table (table_name, n)."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def sample_review(reviews: DataFrame, chars: int = 200) -> DataFrame:
    """One review (the smallest id), its body cut to ``chars`` characters."""
    return (reviews.select("id", "source", "rating", F.substring("body", 1, chars).alias("body"))
            .orderBy("id").limit(1))
