"""Upserts, cache split, run status and alerts on inline rows."""

import datetime as dt

from pyspark.sql import functions as F

from revwise.operators import runs as RU
from revwise.sources import store as ST


def test_upsert_last_writer_wins_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", "old", dt.datetime(2024, 1, 1)), ("b", "keep", dt.datetime(2024, 1, 1))],
                                "id string, body string, ingested_at timestamp_ntz")
    new = spark.createDataFrame([("a", "new", dt.datetime(2024, 1, 2)), ("c", "add", dt.datetime(2024, 1, 2))],
                                "id string, body string, ingested_at timestamp_ntz")
    once = ST.upsert_latest(old, new)
    twice = ST.upsert_latest(once, new)
    want = {("a", "new"), ("b", "keep"), ("c", "add")}
    assert {(r.id, r.body) for r in once.collect()} == want
    assert {(r.id, r.body) for r in twice.collect()} == want


def test_upsert_products_keeps_gdoc(spark):
    schema = "key string, display string, appstore_id string, play_package string, gdoc_id string, gmail_to string"
    old = spark.createDataFrame([("p", "Old", "1", "pk", "DOC", None)], schema)
    new = spark.createDataFrame([("p", "New", None, "pk2", "IGNORED", "x@y"), ("q", "Q", "2", None, None, None)], schema)
    got = {r.key: r for r in ST.upsert_products(old, new).collect()}
    assert got["p"].display == "New" and got["p"].appstore_id is None and got["p"].gdoc_id == "DOC"
    assert got["q"].gdoc_id is None and got["q"].display == "Q"


def test_insert_absent(spark):
    ex = spark.createDataFrame([("r1", "ingested")], "id string, status string")
    new = spark.createDataFrame([("r1", "pending"), ("r2", "pending")], "id string, status string")
    got = {(r.id, r.status) for r in RU.insert_absent(ex, new).collect()}
    assert got == {("r1", "ingested"), ("r2", "pending")}


def test_cache_split(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "review_id string")
    cache = spark.createDataFrame([("a", [0.1])], "review_id string, embedding array<float>")
    hits, misses = ST.embed_cache_split(wanted, cache)
    assert [r.review_id for r in hits.collect()] == ["a"]
    assert [r.review_id for r in misses.collect()] == ["b"]


def test_next_stage_failed_resumes(spark):
    ev = spark.createDataFrame([
        ("r1", "pending", dt.datetime(2024, 1, 1), 1), ("r1", "ingested", dt.datetime(2024, 1, 2), 2),
        ("r1", "failed", dt.datetime(2024, 1, 3), 3),
        ("r2", "failed", dt.datetime(2024, 1, 1), 1),
        ("r3", "summarized", dt.datetime(2024, 1, 1), 1)],
        "run_id string, status string, updated_at timestamp_ntz, seq int")
    got = {r.run_id: r.next_stage for r in RU.next_stage(ev).collect()}
    assert got == {"r1": "cluster", "r2": "ingest", "r3": "render"}


def test_wow_alerts(spark):
    rows = [("p", "2024-W01", dt.date(2024, 1, 1), 10, 4.2),
            ("p", "2024-W02", dt.date(2024, 1, 8), 0, None),
            ("p", "2024-W03", dt.date(2024, 1, 15), 100, 4.2),
            ("p", "2024-W04", dt.date(2024, 1, 22), 49, 3.1),
            ("p", "2024-W05", dt.date(2024, 1, 29), 100, 3.0),
            ("p", "2024-W06", dt.date(2024, 2, 5), 50, 3.0),
            ("p", "2024-W08", dt.date(2024, 2, 19), 1, 1.0)]
    weekly = spark.createDataFrame(rows, "product_key string, iso_week string, week_start date, n long, mean double")
    got = {r.iso_week: (r.volume_alert, r.rating_alert) for r in RU.wow_alerts(weekly).collect()}
    assert got["2024-W01"] == (False, False)
    assert got["2024-W03"] == (False, False)      # prior week had 0 reviews
    assert got["2024-W04"] == (True, True)        # 100 → 49, 4.2 → 3.1
    assert got["2024-W06"] == (False, False)      # 100 → 50 is not a drop over 50 %
    assert got["2024-W08"] == (False, False)      # missing week: no comparison
