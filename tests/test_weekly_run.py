"""The end-to-end run: every stored review takes part, the second run has only cache hits."""

from pyspark.sql import functions as F

from revwise.operators import embed as EM
from revwise.plans import q_pipeline as QP
from revwise.sources import store as ST
from tests.conftest import SF


def test_second_run_has_only_cache_hits(spark, monkeypatch):
    wanted = QP.run_reviews(spark, SF).cache()
    cache = QP.vector_cache(spark, SF)
    seen = []
    real = QP.embed_with_cache

    def spy(w, c, embed):
        out = real(w, c, embed)
        seen.append((out[0].count(), out[1].count()))
        return out
    monkeypatch.setattr(QP, "embed_with_cache", spy)
    first, made = QP.weekly_run(wanted, cache)
    again, _ = QP.weekly_run(wanted, cache.unionByName(made))
    n = wanted.count()
    hits = wanted.join(cache, "review_id", "left_semi").count()
    assert seen == [(n, n - hits), (n, 0)]
    rows = first.collect()
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(again.collect())]
    assert rows and all(r.keyphrases and r.medoid and r.samples for r in rows)


def test_clusters_of_distinct_texts_get_their_own_requests(spark):
    topics = {"pay": "payment failed twice money refund card", "log": "login screen freezes password reset code"}
    rows = [("r", f"{t}{k:02d}", f"{words} {words.split()[k % 6]} me@x.com 9876543210", 1, "playstore")
            for t, words in topics.items() for k in range(30)]
    wanted = spark.createDataFrame(rows, "run_id string, review_id string, body string, rating int, source string")
    cache = spark.createDataFrame([], "review_id string, embedding array<float>")
    out = QP.weekly_run(wanted, cache)[0].collect()
    assert len(out) == 2
    for r in out:
        assert ("payment" in r.keyphrases) != ("login" in r.keyphrases)
        assert "@x.com" not in r.medoid + r.samples and "9876543210" not in r.medoid + r.samples


def test_masked_text_reaches_the_report(spark, tmp_path):
    """A mail address and a number planted in every body are in no quote, report or served row."""
    import shutil

    from revwise.plans.catalog import QUERIES
    for name in ("labels", "embeddings", "events", "conversations"):
        shutil.copyfile(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumn("text", F.concat(F.lit("me.too@mail.com 98765432101 said "), "text")).withColumn("lang", F.lit("en"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("q_report_lines", "q_latest_report", "q_fallback_quotes", "q_quotes", "q_label_requests"):
        rows = QUERIES[name](spark, str(tmp_path)).collect()
        assert rows and not any("me.too" in str(r) or "98765432101" in str(r) for r in rows)


def test_every_branch_of_the_recorded_answers_occurs(spark):
    from revwise.plans.catalog import QUERIES
    sf = "/root/testdata/sf0.01"
    get = lambda n: QUERIES[n](spark, sf)
    parsed = get("q_parse_responses").collect()
    assert {(r.attempt, r.ok) for r in parsed} >= {(1, True), (1, False), (2, True)}
    assert {r.sentiment for r in parsed if r.ok} == {"negative", "positive", "mixed"}
    assert {r.refused for r in get("q_cost_cap").select("refused").distinct().collect()} == {True, False}
    cost = get("q_llm_cost")
    assert cost.filter("retries > 0").count() and cost.filter("retries = 0").count()
    assert get("q_extra_picks").count() > 0
    assert {r.valid for r in get("q_quote_check").collect()} == {True, False}
    assert get("q_latest_report").first().product.startswith("Product ")
    assert get("q_page_reviews").filter("rating = 0").count() > 0


def test_embedding_of_text_without_tokens_is_zero(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "!"), (3, None)], "id long, body string")
    got = {r.id: sum(abs(x) for x in r.embedding) for r in EM.hashed_tfidf(df, dim=8).collect()}
    assert got[1] > 0 and got[2] == 0 and got[3] == 0
    assert ST.BUCKETS == 64
