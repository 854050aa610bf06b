"""Product registry (S7): configuration rows as a small DataFrame.

The registry is configuration (one row per product), so it is the one input
built on the driver; whether it joins as a broadcast side is left to the
size threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = ("key string, display_name string, appstore_id string, play_package string, "
                   "recipients struct<to: array<string>, cc: array<string>, bcc: array<string>>")


def registry(spark: SparkSession, products: list[dict]) -> DataFrame:
    rows = []
    for p in products:
        r = p.get("recipients") or {}
        rows.append((p["key"], p.get("display_name", p["key"]), p.get("appstore_id"),
                     p.get("play_package"),
                     (r.get("to") or [], r.get("cc") or [], r.get("bcc") or [])))
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def get_product(reg: DataFrame, key: str) -> DataFrame:
    """The product's row; an unknown key is an error raised before any data job."""
    row = reg.filter(F.col("key") == key)
    if row.isEmpty():
        raise KeyError(f"unknown product {key!r}")
    return row


def with_product(runs: DataFrame, reg: DataFrame) -> DataFrame:
    """Run → product display (left join; a missing display falls back to the key)."""
    r = reg.select(F.col("key").alias("product_key"), "display_name")
    return (runs.join(r, "product_key", "left")
            .withColumn("display", F.coalesce("display_name", "product_key")).drop("display_name"))
