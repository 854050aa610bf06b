"""Review tables laid out so that queries read and move little.

Reviews are partitioned by product and month and bucketed by id; tables that hang on a
review (vectors, cluster members) are bucketed by its id in as many buckets.  A question
about a product or a window then reads that product's or window's partitions alone, a join
with chosen products prunes partitions at run time, and reviews, vectors and members join
bucket by bucket, without an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of reviews, vectors and members; fixed for the tables' life.
BUCKETS = 64


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def save_reviews(reviews: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Write ``reviews`` as the catalog table ``table``, with a column posted_month.

    Rows are dealt by bucket before they are written, so a bucket has one file in a partition.
    """
    (reviews.withColumn("posted_month", month(F.col("posted_at"))).repartition(buckets, "id")
     .write.mode("overwrite").format("parquet").partitionBy("product_key", "posted_month")
     .bucketBy(buckets, "id").sortBy("id").saveAsTable(table))


def save_by_review(rows: DataFrame, table: str, key: str = "review_id", buckets: int = BUCKETS) -> None:
    """Write a table that hangs on reviews, bucketed by their id."""
    (rows.repartition(buckets, key).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))


def since(reviews: DataFrame, start: str) -> DataFrame:
    """F1 over the table: reviews posted from ``start`` on; months before it aren't read."""
    at = F.lit(start).cast("timestamp_ntz")
    return reviews.where((F.col("posted_month") >= month(at)) & (F.col("posted_at") >= at))


def of_products(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews of the given products (key, ...); partitions of others are pruned when the products are known."""
    return reviews.join(products.select(F.col("key").alias("product_key")), "product_key", "left_semi")


def vectors_of(reviews: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors (review_id, embedding) with their reviews."""
    return vectors.join(reviews, vectors["review_id"] == reviews["id"])


def members_of(reviews: DataFrame, members: DataFrame) -> DataFrame:
    """Cluster members (run_id, cluster_id, review_id) with their reviews."""
    return members.join(reviews, members["review_id"] == reviews["id"])
