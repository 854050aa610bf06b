"""Landed feeds, page fallback, store batches and the incremental stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from revwise.sources import feeds as FD
from revwise.streaming.ingest import ingest_stream, read_latest

NOW = "2024-06-01 00:00:00"
BODY = "this app works well for me"


def _page(entries):
    return json.dumps({"feed": {"entry": [{"id": {"label": "app"}}] + entries}})


def test_feed_skips_app_record_and_defaults_rating(spark):
    page = _page([{"author": {"name": {"label": "u"}}, "id": {"label": "e1"}, "content": {"label": BODY},
                   "updated": {"label": "2024-05-01T10:00:00Z"}},
                  {"author": {"x": 1}, "id": {"label": "e2"}, "content": {"label": "too short"},
                   "updated": {"label": "2024-05-01T10:00:00Z"}, "im:rating": {"label": "5"}}])
    pages = spark.createDataFrame([("p", page)], "product_key string, value string")
    got = FD.feed_reviews(pages, None, NOW).collect()
    assert [(r.external_id, r.rating) for r in got] == [("e1", 0)]


def _html(node):
    return f'<html><script>var d = {json.dumps(node)};</script><script>x()</script></html>'


def test_page_walk_nested_and_arrays(spark):
    rev = {"$kind": "Review", "id": "a", "contents": BODY, "reviewerName": "n", "date": "2024-05-01T00:00:00Z",
           "rating": 4, "reply": {"$kind": "Review", "contents": BODY + " too", "date": None}}
    pages = spark.createDataFrame([
        ("p1", _html({"data": [rev, {"$kind": "Review", "id": "b", "contents": BODY}]})),
        ("p2", "<html><script>{broken reviewerName</script></html>"),
        ("p3", "<html><script>var x = {}</script></html>")], "product_key string, html string")
    got = FD.page_reviews(pages, None, NOW).collect()
    assert len(got) == 3
    assert {r.product_key for r in got} == {"p1"}
    nested = [r for r in got if r.body.endswith("too")][0]
    assert nested.posted_at_defaulted is True and len(nested.external_id) == 40


def test_page_fallback_only_without_feed_entries(spark):
    pages = spark.createDataFrame([("p1", _page([{"author": {}, "id": {"label": "f"}, "content": {"label": BODY},
                                                  "updated": {"label": "2024-05-01T00:00:00"}}])),
                                   ("p2", json.dumps({"feed": {}}))], "product_key string, value string")
    node = {"$kind": "Review", "id": "h", "contents": BODY, "reviewerName": "n", "date": "2024-05-01"}
    html = spark.createDataFrame([("p1", _html(node)), ("p2", _html(node))], "product_key string, html string")
    got = {(r.product_key, r.external_id) for r in FD.appstore_reviews(pages, html, None, NOW).collect()}
    assert got == {("p1", "f"), ("p2", "h")}


def test_page_walk_reaches_any_depth(spark):
    node = {"$kind": "Review", "id": "deep", "contents": BODY, "reviewerName": "n", "date": "2024-05-01"}
    for _ in range(100):
        node = {"reply": [node]}
    pages = spark.createDataFrame([("p", _html(node))], "product_key string, html string")
    got = FD.page_reviews(pages, None, NOW).collect()
    assert [(r.external_id, r.rating) for r in got] == [("deep", 0)]


def test_page_walk_moves_no_rows_between_tasks(spark):
    replies = [{"$kind": "Review", "id": f"r{k}", "contents": f"{BODY} {k} {{[", "reviewerName": "n", "date": "2024-05-01",
                "replies": [{"$kind": "Review", "id": f"s{k}", "contents": BODY}, [[None, k, "x"]], {}]} for k in range(300)]
    pages = spark.createDataFrame([(f"p{i}", _html({"data": [replies]})) for i in range(4)], "product_key string, html string")
    out = FD.page_reviews(pages, None, NOW)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "UnionLoop" not in plan
    assert sorted((r.product_key, r.external_id) for r in out.collect()) == sorted(
        (f"p{i}", f"{c}{k}") for i in range(4) for c in "rs" for k in range(300))


def test_page_walk_refuses_what_it_would_not_reach(spark, monkeypatch):
    monkeypatch.setattr(FD, "MAX_DEPTH", 3)
    node = {"$kind": "Review", "id": "a", "contents": f"{BODY} {{{{{{", "reviewerName": "n", "date": "2024-05-01"}
    flat = spark.createDataFrame([("p", _html({"x": [node]}))], "product_key string, html string")
    assert [r.external_id for r in FD.page_reviews(flat, None, NOW).collect()] == ["a"]
    deeper = spark.createDataFrame([("p", _html({"x": [[node]]}))], "product_key string, html string")
    with pytest.raises(Exception, match="nests deeper than 3 levels"):
        FD.page_reviews(deeper, None, NOW).collect()


def test_feed_stream(spark, tmpdir_path):
    from revwise.streaming.ingest import ingest_feed_stream
    landing = os.path.join(tmpdir_path, "feed", "product_key=p")
    os.makedirs(landing)
    table, ck = os.path.join(tmpdir_path, "t"), os.path.join(tmpdir_path, "c")
    for k in range(2):
        entry = {"author": {}, "id": {"label": f"e{k}"}, "content": {"label": BODY}, "updated": {"label": "2024-05-01T00:00:00Z"}}
        with open(os.path.join(landing, f"{k}.json"), "w") as f:
            f.write(_page([entry]))
        ingest_feed_stream(spark, os.path.dirname(landing), table, ck, NOW).awaitTermination()
    assert {(r.product_key, r.external_id) for r in read_latest(spark, table).collect()} == {("p", "e0"), ("p", "e1")}


def test_store_rows_drop_undated(spark):
    b = spark.createDataFrame([("p", "s1", BODY, 3, "2024-05-01 10:00:00", None),
                               ("p", "s2", BODY, 4, None, None)], FD.STORE_SCHEMA)
    got = FD.store_rows(b, "2024-01-01 00:00:00", NOW).collect()
    assert [r.external_id for r in got] == ["s1"]
    assert str(got[0].posted_at) == "2024-05-01 10:00:00"


def test_stream_twice_same_table(spark, tmpdir_path):
    landing = os.path.join(tmpdir_path, "landing")
    os.makedirs(landing)
    rows = [{"product_key": "p", "reviewId": f"s{i}", "content": f"{BODY} {i}", "score": 3,
             "at": "2024-05-01 10:00:00"} for i in range(5)]
    with open(os.path.join(landing, "b1.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    table = os.path.join(tmpdir_path, "reviews")
    ck = os.path.join(tmpdir_path, "ck")
    for _ in range(2):
        q = ingest_stream(spark, landing, table, ck, NOW)
        q.awaitTermination()
    first = sorted(r.id for r in read_latest(spark, table).collect())
    ck2 = os.path.join(tmpdir_path, "ck2")          # a fresh checkpoint replays the files
    ingest_stream(spark, landing, table, ck2, NOW).awaitTermination()
    again = sorted(r.id for r in read_latest(spark, table).collect())
    assert len(first) == 5 and first == again


def test_absent_score_counts_zero_and_null_score_has_no_rating(spark, tmp_path):
    lines = [{"reviewId": "a", "score": 4}, {"reviewId": "b", "score": None}, {"reviewId": "c"}, {"reviewId": "d", "score": "x"}]
    path = tmp_path / "batch.json"
    path.write_text("\n".join(json.dumps({"product_key": "p", "content": f"{BODY} {r['reviewId']}", "at": "2024-05-01 00:00:00"} | r)
                              for r in lines) + "\nnot json\n")
    got = {r["external_id"]: r["rating"] for r in FD.store_rows(FD.read_store_batches(spark, str(path)), None, NOW).collect()}
    assert got == {"a": 4, "b": None, "c": 0, "d": None}


def test_reviews_nested_a_hundred_and_fifty_levels_deep(spark):
    node = {"$kind": "Review", "id": "deep", "contents": f"{BODY} deep", "reviewerName": "n", "date": "2024-05-01T00:00:00Z"}
    for level in range(150):
        node = {"kids": [node, level, {"$kind": "Other"}], "$kind": "Review" if level == 75 else None, "id": f"l{level}",
                "contents": f"{BODY} at {level}", "reviewerName": "n", "date": "2024-05-01T00:00:00Z"}
    html = "<script>" + json.dumps(node) + "</script>"
    pages = spark.createDataFrame([("p", html), ("q", "<script>reviewerName {}</script>"), ("r", None)], "product_key string, html string")
    out = FD.page_reviews(pages, None, NOW)
    assert {r["external_id"] for r in out.collect()} == {"deep", "l75"}
