"""Operator 9: held-out accuracy, scores against a plain naive Bayes, edges."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revwise.llm import langid as L


def test_query_held_out_accuracy(spark):
    from revwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_language_id"](spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


TRAIN = [("the cat and the dog", "en"), ("the sun", "en"), ("le chat et le chien", "fr"), ("der Hund und die Katze", "de")]


def ngrams(text):
    t = f" {text.lower()} "
    return [int(L.ngram_rows(np.asarray([ord(c) for c in t[i:i + n]], dtype=np.uint32), n)[0])
            for n in L.ORDERS for i in range(len(t) - n + 1)]


def plain(text):
    """Best language and posterior from counts kept in dictionaries."""
    score = {}
    for lang in sorted({x for _, x in TRAIN}):
        mine = Counter(g for t, x in TRAIN if x == lang for g in ngrams(t))
        total = sum(mine.values()) + L.SMOOTHING * (1 << L.BITS)
        prior = sum(x == lang for _, x in TRAIN) / len(TRAIN)
        score[lang] = math.log(prior) + sum(math.log((mine[g] + L.SMOOTHING) / total) for g in ngrams(text))
    top = max(score.values())
    return max(sorted(score), key=score.get), 1 / sum(math.exp(s - top) for s in score.values())


def test_scores_and_edges(spark):
    train = spark.createDataFrame([*TRAIN, (None, "en"), ("unlabelled", None)], "text string, lang string")
    model = L.train(train)
    assert model.languages == ["de", "en", "fr"]
    texts = ["the dog", "le chien", "Katze und Hund", "ß", "THE", "the cat " * 50_000, None, "", " \n", "123 !?", "the dog"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    out = L.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    for r in out.collect():
        t = texts[r["doc_id"]]
        if t is None or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            lang, p = plain(t) if len(t) < 1000 else ("en", 1.0)
            assert r["lang_pred"] == lang and r["score"] == pytest.approx(p, rel=1e-3)
    assert L.predict(docs.limit(0), model).count() == 0
    nothing = L.train(train.limit(0))
    assert nothing.languages == []
    assert {(r["lang_pred"], r["score"]) for r in L.predict(docs, nothing).collect()} == {("und", 0.0)}


def test_steps_see_every_ngram_once(monkeypatch):
    points = L.code_points("abcdefghij" * 13)
    whole = sorted(int(x) for rows in L.rows_of(points) for x in rows)
    monkeypatch.setattr(L, "STEP", 7)
    assert sorted(int(x) for rows in L.rows_of(points) for x in rows) == whole


def test_labels_are_never_inputs(spark):
    docs = spark.createDataFrame([(1, "the dog", "fr"), (2, "the dog", None)], "doc_id long, text string, lang string")
    model = L.train(spark.createDataFrame(TRAIN, "text string, lang string"))
    assert len({(r["lang_pred"], r["score"]) for r in L.predict(docs, model).select(F.col("lang_pred"), "score").collect()}) == 1
