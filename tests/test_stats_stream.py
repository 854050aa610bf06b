"""Statistics kept by a stream's state against those of the whole table."""

import json
import os
import random

from pyspark.sql import functions as F

from revwise.functions.text import iso_week
from revwise.operators.aggregates import product_stats
from revwise.sources.store import newest
from revwise.streaming import ingest as IN

SCHEMA = "id string, product_key string, rating int, posted_at timestamp_ntz, ingested_at timestamp_ntz"


def land(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for r in rows:
            f.write(json.dumps(dict(zip(("id", "product_key", "rating", "posted_at", "ingested_at"), r))) + "\n")


def version(rng, k, day):
    rating = rng.choice([None, 1, 2, 3, 4, 5])
    return (f"id{k}", f"p{rng.randint(0, 2)}", rating, f"2024-0{rng.randint(1, 3)}-1{rng.randint(0, 9)} 08:00:00", f"2024-05-{day:02d} 00:00:00")


def run(spark, landing, changes, checkpoint):
    stream = spark.readStream.schema(SCHEMA).json(landing)
    q = IN.stats_stream(stream, changes, checkpoint)
    q.awaitTermination()
    return q


def check(spark, landing, changes):
    """The stream's sums equal those of the newest versions of everything that has landed."""
    held = newest(spark.read.schema(SCHEMA).json(landing).withColumn("rating", F.coalesce("rating", F.lit(-1)))
                  .withColumn("week", iso_week(F.col("posted_at"))).select("id", "ingested_at", "product_key", "week", "rating"),
                  "id", "ingested_at").withColumn("rating", F.when(F.col("rating") >= 0, F.col("rating")))
    want = {(r["product_key"], r["week"]): (r["n"], r["m"]) for r in held.groupBy("product_key", "week").agg(
        F.count("*").alias("n"), F.avg("rating").alias("m")).collect()}
    now = spark.read.parquet(changes)
    got = {(r["product_key"], r["iso_week"]): (r["n"], r["avg_rating"]) for r in IN.weekly_stats(now).collect()}
    assert got == want
    assert sorted(map(tuple, IN.product_stats(now).collect())) == sorted(map(tuple, product_stats(held).collect()))


def test_late_and_repeated_rows_over_two_triggers(spark, tmp_path):
    rng = random.Random(7)
    landing, changes, ck = (str(tmp_path / x) for x in ("in", "changes", "ck"))
    first = [version(rng, k, 10) for k in range(40)]
    land(landing, "a.json", first + first[:5])
    run(spark, landing, changes, ck)
    check(spark, landing, changes)
    second = [version(rng, k, 12) for k in range(0, 40, 3)] + [version(rng, k, 5) for k in range(1, 40, 4)]  # newer and late ones
    second += first[20:25] + [version(rng, k, 11) for k in range(40, 50)] + [version(rng, 45, 11) for _ in range(3)]
    land(landing, "b.json", second)
    run(spark, landing, changes, ck)
    check(spark, landing, changes)
    n = spark.read.parquet(changes).count()
    assert run(spark, landing, changes, ck).lastProgress is None or spark.read.parquet(changes).count() == n  # nothing new, nothing counted
    check(spark, landing, changes)


def test_a_repeated_trigger_counts_nothing_twice(spark, tmp_path):
    """The commit of the last trigger is lost, so that the restarted query runs it again."""
    rng = random.Random(8)
    landing, changes, ck = (str(tmp_path / x) for x in ("in", "changes", "ck"))
    land(landing, "a.json", [version(rng, k, 10) for k in range(20)])
    run(spark, landing, changes, ck)
    land(landing, "b.json", [version(rng, k, 11) for k in range(10, 30)])
    run(spark, landing, changes, ck)
    commits = os.path.join(ck, "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))
    run(spark, landing, changes, ck)
    check(spark, landing, changes)
