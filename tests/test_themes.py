"""Quote check, theme ranking, response parsing, cost cap, report offsets."""

from pyspark.sql import functions as F

from revwise.operators import report as RP
from revwise.operators import themes as TH


def _pool(spark):
    return spark.createDataFrame([
        ("r", "c1", "id1", "The app is fine, really fine", 4, "playstore", 1),
        ("r", "c1", "id2", "It's   GREAT when it works", 5, "appstore", 2),
        ("r", "c2", "id3", "Another cluster text here", 1, "playstore", 1)],
        "run_id string, cluster_id string, review_id string, body string, rating int, source string, member_rank int")


def test_quote_check_edge_cases(spark):
    quotes = spark.createDataFrame([
        ("r", "c1", 1, 1, ""),                              # empty fails
        ("r", "c1", 1, 2, "app is ﬁne"),                # NFKC ligature passes
        ("r", "c1", 1, 3, "It’s great"),                # curly apostrophe fails
        ("r", "c1", 1, 4, "it's great  WHEN"),               # case and blanks pass
        ("r", "c1", 1, 5, "Another cluster"),                # other cluster's text fails
    ], "run_id string, cluster_id string, attempt int, position int, text string")
    got = {r.position: r.valid for r in TH.check_quotes(quotes, _pool(spark)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_quote_check_plan_has_no_nested_loop(spark):
    quotes = spark.createDataFrame([("r", "c1", 1, 1, "fine")],
                                   "run_id string, cluster_id string, attempt int, position int, text string")
    plan = TH.check_quotes(quotes, _pool(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_select_quotes_retry_only_when_needed(spark):
    checked = spark.createDataFrame([
        ("r", "a", 1, 1, "x", True), ("r", "a", 2, 1, "y", True),      # a: first answer valid
        ("r", "b", 1, 1, "bad", False), ("r", "b", 2, 1, "good", True),  # b: retry used
        ("r", "c", 2, 1, "z", True)],                                    # c: retry without failure
        "run_id string, cluster_id string, attempt int, position int, text string, valid boolean")
    got = {r.cluster_id: r.text for r in TH.select_quotes(checked).collect()}
    assert got == {"a": "x", "b": "good"}


def test_theme_rank_ties_keep_size_order(spark):
    t = spark.createDataFrame([
        ("r", "k10", 10, "mixed"), ("r", "k6n", 6, "negative"), ("r", "k6p", 6, "positive"),
        ("r", "k5", 5, "negative")], "run_id string, cluster_id string, size int, sentiment string")
    got = [r.cluster_id for r in TH.rank_themes(t).orderBy("rank").collect()]
    assert got == ["k6n", "k6p", "k10"]


def test_parse_label_responses(spark):
    r = spark.createDataFrame([("a", 1, "{}"), ("b", 1, '{"label":"L","sentiment":"angry"}'),
                               ("c", 1, "not json")], "cluster_id string, attempt int, response string")
    got = {x.cluster_id: (x.ok, x.label, x.description, x.sentiment)
           for x in TH.parse_label_responses(r).collect()}
    assert got["a"] == (True, "Unknown", "", "mixed")
    assert got["b"] == (True, "L", "", "mixed")
    assert got["c"][0] is False


def test_cost_cap(spark):
    calls = spark.createDataFrame([("r", 1, 0.3), ("r", 2, 0.2), ("r", 3, 0.1)],
                                  "run_id string, seq int, cost double")
    got = [r.refused for r in TH.cost_cap(calls, cap=0.5).orderBy("seq").collect()]
    assert got == [False, False, True]


def test_report_offsets(spark):
    h = spark.createDataFrame([("r", "p", "P", "2024-W02")], "run_id string, product_key string, display string, iso_week string")
    th = spark.createDataFrame([("r", 1, "L", "D")], "run_id string, rank int, label string, description string")
    q = spark.createDataFrame([("r", 1, "q", "playstore", None)], "run_id string, quote_rank int, text string, source string, rating int")
    a = spark.createDataFrame([("r", 1, "T", "D")], "run_id string, item int, title string, description string")
    u = spark.createDataFrame([("r", 1, "Support", "V")], "run_id string, item int, audience string, value string")
    for start, first in ((1, 1), (100, 101)):
        lines = RP.report_lines(h, th, q, a, u, start).orderBy("section", "item").collect()
        assert lines[0].start == first
        for x, y in zip(lines, lines[1:]):
            assert y.start == x.end
        assert lines[0].text.endswith("[pulse-p-2024-W02]\n")
    reqs = RP.doc_requests(RP.report_lines(h, th, q, a, u, 100), 100)
    kinds = {r.kind: r.n for r in RP.request_kinds(reqs).collect()}
    assert kinds["insertPageBreak"] == 1 and kinds["updateTextStyle"] == 1


def test_delivery_checks(spark):
    due = spark.createDataFrame([("p", "2024-W02", "doc"), ("p", "2024-W03", "doc"), ("q", "2024-W02", "mail")],
                                "product_key string, iso_week string, channel string")
    sent = spark.createDataFrame([("q", "2024-W02", "mail")], "product_key string, iso_week string, channel string")
    assert {(r.product_key, r.iso_week) for r in RP.undelivered(due, sent).collect()} == {
        ("p", "2024-W02"), ("p", "2024-W03")}
    docs = spark.createDataFrame([("p", "old text [pulse-p-2024-W02] more"), ("q", "[pulse-p-2024-W03]")],
                                 "product_key string, doc_text string")
    got = {r.iso_week for r in RP.delivered_by_text(due.filter("channel = 'doc'"), docs).collect()}
    assert got == {"2024-W02"}          # the W03 anchor sits in another product's document
    link = spark.range(1).select(RP.deep_link(F.lit("D"), F.lit("h.1")).alias("l")).first().l
    assert link.endswith("/d/D/edit#heading=h.1")
