"""The laid-out tables: partitions that are read, joins without an exchange, equal results."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from revwise.operators.aggregates import product_stats
from revwise.sources import layout as L


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    rows = [(f"id{k:04d}", f"p{k % 5}", rng.randint(1, 5), dt.datetime(2024, 1 + k % 6, 1 + k % 27), f"body {k}") for k in range(600)]
    reviews = spark.createDataFrame(rows, "id string, product_key string, rating int, posted_at timestamp_ntz, body string")
    vectors = reviews.select(F.col("id").alias("review_id"), F.array(F.lit(0.5)).alias("embedding"))
    members = reviews.select(F.lit("r").alias("run_id"), F.concat(F.lit("c"), F.col("rating")).alias("cluster_id"),
                             F.col("id").alias("review_id"))
    L.save_reviews(reviews, "laid_reviews", 8)
    L.save_by_review(vectors, "laid_vectors", buckets=8)
    L.save_by_review(members, "laid_members", buckets=8)
    yield reviews, vectors, members
    for t in ("laid_reviews", "laid_vectors", "laid_members"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


def read_partitions(df):
    """Partitions that the plan's file scan has read."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text
    found = []

    def walk(node):
        if "FileSourceScanExec" in node.getClass().getName():
            found.append(node.metrics().apply("numPartitions").value())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
        if "AdaptiveSparkPlanExec" in node.getClass().getName():
            walk(node.executedPlan())
        if "QueryStageExec" in node.getClass().getName():
            walk(node.plan())
    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_one_product_reads_its_partitions(spark, tables):
    one = product_stats(spark.table("laid_reviews").where("product_key = 'p3'"))
    assert rows(one) == rows(product_stats(tables[0].where("product_key = 'p3'")))
    assert read_partitions(one) == [spark.table("laid_reviews").where("product_key = 'p3'").select("posted_month").distinct().count()]


def test_window_reads_its_months(spark, tables):
    late = L.since(spark.table("laid_reviews"), "2024-05-10 00:00:00")
    want = tables[0].where("posted_at >= timestamp_ntz'2024-05-10 00:00:00'")
    assert rows(late.select("id")) == rows(want.select("id"))
    assert read_partitions(late.select("id")) == [10]  # five products, two months


def test_chosen_products_prune_at_run_time(spark, tables):
    chosen = spark.createDataFrame([("p1", "One"), ("zz", "None")], "key string, display_name string").where("display_name <> 'None'")
    some = L.of_products(spark.table("laid_reviews"), F.broadcast(chosen))
    assert rows(some.select("id")) == rows(tables[0].where("product_key = 'p1'").select("id"))
    assert re.search("dynamicpruning", plan(some.select("id")))


def test_reviews_vectors_and_members_join_without_an_exchange(spark, tables):
    reviews, vectors, members = tables
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.table("laid_reviews")
        for laid, plain in ((L.vectors_of(stored, spark.table("laid_vectors")), L.vectors_of(reviews, vectors)),
                            (L.members_of(stored, spark.table("laid_members")), L.members_of(reviews, members))):
            cols = ["review_id", "body", "rating"]
            assert "Exchange" not in plan(laid.select(cols)) and "Exchange" in plan(plain.select(cols))
            assert rows(laid.select(cols)) == rows(plain.select(cols))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
