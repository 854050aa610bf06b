"""Report, mail and delivery queries for the clustered run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revwise.functions import text as T
from revwise.operators import report as RP
from revwise.operators import runs as RU
from revwise.operators import themes as TH
from revwise.plans import sqlparts as S
from revwise.plans.q_themes import THEME_CTES, ThemeInputs, chosen_quotes, themes_of
from revwise.plans.registry import REVIEWS_CTE, RUN_EVENTS_CTE, query, with_ctes
from revwise.session import materialize_table
from revwise.sources.registry import with_product
from revwise.sources.testdata import reviews, run_events

AUDIENCES = ("Product", "Support", "Leadership")


class Parts:
    """The report's tables, each made when first asked for; those read more than once are stage tables."""

    def __init__(self, spark, sf):
        self.spark, self.sf, self.ti = spark, sf, ThemeInputs(spark, sf)

    @cached_property
    def header(self):
        """The run's window, counts and product (the one with most of its reviews)."""
        cr = self.ti.cr
        n = cr.groupBy("run_id", "product_key").agg(F.count(F.lit(1)).alias("n"))
        product = n.groupBy("run_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "product_key")).alias("p"))
        h = cr.groupBy("run_id").agg(F.to_date(F.min("posted_at")).alias("window_start"),
                                     F.to_date(F.max("posted_at")).alias("window_end"),
                                     F.count(F.lit(1)).alias("total_reviews"),
                                     F.avg("rating").alias("avg_rating"))
        h = h.withColumn("avg_rating", T.round_half_even(F.col("avg_rating")))
        week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("window_end")).cast("string"), F.lit("-W"),
                        F.lpad(F.weekofyear("window_end").cast("string"), 2, "0"))
        return materialize_table(with_product(h.join(product.select("run_id", "p.product_key"), "run_id")
                                              .withColumn("iso_week", week), self.registry))

    @cached_property
    def registry(self):
        """Products with a rated review are configured; every second one has receivers."""
        key = F.col("product_key")
        some = F.length(key) % 2 == 0
        keys = reviews(self.spark, self.sf).filter(F.col("rating").isNotNull()).select("product_key").distinct()
        return materialize_table(keys.select(
            key.alias("key"), F.concat(F.lit("Product "), key).alias("display_name"),
            F.struct(F.when(some, F.array(F.concat(key, F.lit("@example.com")))).otherwise(
                         F.array().cast("array<string>")).alias("to"),
                     F.array(F.lit("cc@example.com"), key).alias("cc"),
                     F.array().cast("array<string>").alias("bcc")).alias("recipients")))

    @cached_property
    def ranked(self):
        return materialize_table(TH.rank_themes(themes_of(self.ti)))

    @cached_property
    def quotes(self):
        return materialize_table(TH.report_quotes(chosen_quotes(self.ti), self.ti.top))

    @cached_property
    def actions(self):
        return self.ranked.select("run_id", F.col("rank").alias("item"),
                                  F.concat(F.lit("Address "), "label").alias("title"),
                                  F.concat(F.lit("Follow up on "), F.col("size").cast("string"),
                                           F.lit(" reviews")).alias("description"))

    @cached_property
    def audiences(self):
        return self.ranked.select("run_id", F.col("rank").alias("item"),
                                  F.element_at(F.array(*[F.lit(a) for a in AUDIENCES]), F.col("rank"))
                                  .alias("audience"), F.col("description").alias("value"))

    @cached_property
    def metrics(self):
        """A7 over the run's label calls (prompt: the cluster's size, answer: its number)."""
        calls = self.ti.labels.join(
            self.ti.top.select("run_id", "cluster_id", F.col("size").alias("prompt_tokens")), ["run_id", "cluster_id"])
        return TH.llm_cost(calls.withColumn("completion_tokens", F.col("attempt").cast("long")))


HDR_SQL = """
, hdr0 AS (
  SELECT run_id, min(CAST(posted_at AS DATE)) AS window_start, max(CAST(posted_at AS DATE)) AS window_end,
         count(*) AS total_reviews, CAST(printf('%.2f', avg(rating)) AS DOUBLE) AS avg_rating,
         strftime(max(CAST(posted_at AS DATE)), '%G-W%V') AS iso_week
  FROM creviews GROUP BY run_id),
registry AS (
  SELECT DISTINCT product_key AS key, 'Product ' || product_key AS display_name FROM reviews
  WHERE rating IS NOT NULL),
hdr AS (
  SELECT h.*, p.product_key, coalesce(g.display_name, p.product_key) AS display
  FROM hdr0 h JOIN (
    SELECT run_id, product_key, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, product_key) AS rn
    FROM (SELECT run_id, product_key, count(*) AS n FROM creviews GROUP BY ALL)) p
    ON p.run_id = h.run_id AND p.rn = 1
  LEFT JOIN registry g ON g.key = p.product_key),
rq AS (
  SELECT q.*, row_number() OVER (PARTITION BY q.run_id ORDER BY t.size_rank) AS quote_rank
  FROM qchosen q JOIN ctop t USING (run_id, cluster_id) QUALIFY quote_rank <= 3),
lines AS (
  SELECT run_id, 1 AS section, 0 AS item,
         display || ' — Weekly Review Pulse  |  ' || iso_week || '  [pulse-' || product_key || '-'
           || iso_week || ']' || chr(10) AS text, 'HEADING_1' AS style, false AS italic FROM hdr
  UNION ALL SELECT run_id, 2, 0, 'Top Themes' || chr(10), 'HEADING_2', false FROM hdr
  UNION ALL SELECT run_id, 3, 0, 'Real User Quotes' || chr(10), 'HEADING_2', false FROM hdr
  UNION ALL SELECT run_id, 4, 0, 'Action Ideas' || chr(10), 'HEADING_2', false FROM hdr
  UNION ALL SELECT run_id, 5, 0, 'What This Solves' || chr(10), 'HEADING_2', false FROM hdr
  UNION ALL SELECT run_id, 2, CAST(rank AS INTEGER),
         CAST(rank AS VARCHAR) || '. ' || label || ' — ' || description || chr(10), 'NORMAL_TEXT', false
         FROM ranked
  UNION ALL SELECT run_id, 3, CAST(quote_rank AS INTEGER),
         '"' || text || '" (' || source || ', ' || coalesce(CAST(rating AS VARCHAR), 'None') || '★)'
           || chr(10), 'NORMAL_TEXT', true FROM rq
  UNION ALL SELECT run_id, 4, CAST(rank AS INTEGER),
         '• Address ' || label || ': Follow up on ' || CAST(size AS VARCHAR) || ' reviews' || chr(10),
         'NORMAL_TEXT', false FROM ranked
  UNION ALL SELECT run_id, 5, CAST(rank AS INTEGER),
         '• ' || ['Product', 'Support', 'Leadership'][rank] || ': ' || description || chr(10),
         'NORMAL_TEXT', false FROM ranked),
offs AS (
  SELECT s.start_index, l.*,
         CAST(s.first_index + coalesce(sum(length(l.text)) OVER (
           PARTITION BY s.start_index, l.run_id ORDER BY l.section, l.item
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
  FROM lines l CROSS JOIN (VALUES (1, 1), (100, 101)) s(start_index, first_index))
"""


def lines_at(parts, start):
    return RP.report_lines(parts.header, parts.ranked, parts.quotes, parts.actions, parts.audiences,
                           start_index=start)


@query("q_report_lines", THEME_CTES + HDR_SQL + """
SELECT start_index, run_id, section, item, text, style, italic, start,
       CAST(start + length(text) AS INTEGER) AS "end"
FROM offs""")
def q_report_lines(spark, sf):
    # The lines once; an offset from 100 on is one from 1 plus the same distance.
    ln = lines_at(Parts(spark, sf), 1)
    at = ln.withColumn("start_index", F.explode(F.array(F.lit(1), F.lit(100))))
    more = F.when(F.col("start_index") > 1, F.col("start_index")).otherwise(0)
    return at.select("start_index", "run_id", "section", "item", "text", "style", "italic",
                     (F.col("start") + more).cast("int").alias("start"), (F.col("end") + more).cast("int").alias("end"))


@query("q_request_kinds", THEME_CTES + HDR_SQL + """
, reqs AS (
  SELECT 'insertPageBreak' AS kind, 100 AS start, 101 AS "end" FROM hdr
  UNION ALL SELECT 'insertText', start, CAST(start + length(text) AS INTEGER) FROM offs
    WHERE start_index = 100
  UNION ALL SELECT 'updateParagraphStyle', start, CAST(start + length(text) AS INTEGER) FROM offs
    WHERE start_index = 100
  UNION ALL SELECT 'updateTextStyle', start, CAST(start + length(text) AS INTEGER) FROM offs
    WHERE start_index = 100 AND italic)
SELECT kind, count(*) AS n, min(start) AS min_start, max("end") AS max_end,
       kind IN ('insertText', 'updateParagraphStyle', 'updateTextStyle', 'insertTable',
                'insertPageBreak') AS allowed
FROM reqs GROUP BY kind""")
def q_request_kinds(spark, sf):
    reqs = RP.doc_requests(lines_at(Parts(spark, sf), 100), 100)
    return RP.request_kinds(reqs)


@query("q_summary", THEME_CTES + HDR_SQL + f"""
, met AS (
  SELECT l.run_id, sum(t.size) AS p, sum(l.attempt) AS c, count(*) AS n, count(*) FILTER (NOT l.ok) AS r
  FROM lparsed l JOIN ctop t USING (run_id, cluster_id) GROUP BY l.run_id)
SELECT h.run_id, h.product_key AS product, CAST(h.window_start AS VARCHAR) AS window_start,
       CAST(h.window_end AS VARCHAR) AS window_end,
       CAST(floor(date_diff('day', h.window_start, h.window_end) / 7) AS INTEGER) AS weeks,
       h.total_reviews, coalesce(h.avg_rating, 0.0) AS avg_rating,
       (SELECT string_agg(rank || ' ' || label || ' ' || description || ' ' || sentiment || ' ' || size, '; ' ORDER BY rank)
        FROM ranked r WHERE r.run_id = h.run_id) AS themes,
       (SELECT string_agg(text || ' ' || coalesce(CAST(rating AS VARCHAR), '-') || ' ' || source, ' | ' ORDER BY quote_rank)
        FROM rq WHERE rq.run_id = h.run_id) AS quotes,
       (SELECT string_agg('Address ' || label || ': Follow up on ' || size || ' reviews', ' | ' ORDER BY rank)
        FROM ranked r WHERE r.run_id = h.run_id) AS ideas,
       (SELECT string_agg(['Product', 'Support', 'Leadership'][rank] || ': ' || description, ' | ' ORDER BY rank)
        FROM ranked r WHERE r.run_id = h.run_id) AS audiences,
       CAST(m.p + m.c AS BIGINT) AS total_tokens,
       m.p * (0.59 / 1000000) + m.c * (0.79 / 1000000) AS llm_cost_usd, m.n AS llm_calls, m.r AS retries
FROM hdr h LEFT JOIN met m USING (run_id)""")
def q_summary(spark, sf):
    """The nested summary document, flattened for the check."""
    p = Parts(spark, sf)
    d = RP.summary_document(p.header, p.ranked, p.quotes, p.actions, p.audiences, p.metrics)

    def text(col, item, sep):
        return F.array_join(F.transform(col, item), sep)
    return d.select(
        "run_id", "product", F.col("window.start").cast("string").alias("window_start"),
        F.col("window.end").cast("string").alias("window_end"), "window.weeks", "stats.total_reviews", "stats.avg_rating",
        text("top_themes", lambda t: F.concat_ws(" ", t["rank"], t["label"], t["description"], t["sentiment"], t["size"]),
             "; ").alias("themes"),
        text("quotes", lambda q: F.concat_ws(" ", q["text"], F.coalesce(q["rating"].cast("string"), F.lit("-")), q["source"]),
             " | ").alias("quotes"),
        text("action_ideas", lambda a: F.concat_ws(": ", a["title"], a["description"]), " | ").alias("ideas"),
        text("what_this_solves", lambda a: F.concat_ws(": ", a["audience"], a["value"]), " | ").alias("audiences"),
        "metrics.*")


@query("q_mail_view", THEME_CTES + HDR_SQL + """
, tl AS (
  SELECT run_id, string_agg(chr(10) || '* ' || label || ' (' || CAST(size AS VARCHAR) || ' reviews)' || chr(10) || '  '
                            || description || chr(10), '' ORDER BY rank) AS theme_lines,
         arg_min(label, rank) AS top_theme,
         string_agg('Address ' || label || ': Follow up on ' || CAST(size AS VARCHAR) || ' reviews', ' | ' ORDER BY rank) AS ideas
  FROM ranked GROUP BY run_id),
sv AS (
  SELECT h.*, t.theme_lines, t.top_theme, t.ideas,
         '[Weekly Pulse] ' || h.display || ' — ' || h.iso_week || ' — '
           || coalesce(t.top_theme, 'Review Pulse') AS subj
  FROM hdr h LEFT JOIN tl t USING (run_id))
SELECT sv.run_id,
       CASE WHEN length(subj) > 200 THEN substring(subj, 1, 197) || '...' ELSE subj END AS subject,
       total_reviews, printf('%.1f', avg_rating) AS avg_rating_text,
       strftime(window_start, '%b %d') AS window_start_text,
       strftime(window_end, '%b %d, %Y') AS window_end_text,
       'Subject: [Weekly Pulse] ' || display || ' — ' || iso_week || ' — ' || coalesce(top_theme, 'No Themes')
         || chr(10) || chr(10) || 'Hi Team,' || chr(10) || chr(10)
         || 'Here are the top themes discovered from this week''s reviews:' || chr(10) || chr(10)
         || coalesce(theme_lines, '') || chr(10) || chr(10)
         || 'Read full report → https://docs.google.com/document/d/doc-' || product_key || '/edit#heading=h.' || sv.run_id
         || chr(10) || chr(10) || 'This is an automated report.' || chr(10) || 'Product: ' || display
         || ' | ISO Week: ' || iso_week AS text_body,
       (SELECT string_agg(text, ' | ' ORDER BY quote_rank) FROM rq WHERE rq.run_id = sv.run_id) AS quotes, ideas,
       CASE WHEN g.key IS NOT NULL AND length(product_key) % 2 = 0 THEN product_key || '@example.com'
            ELSE 'product-team@example.com' END AS "to",
       CASE WHEN g.key IS NOT NULL THEN 'cc@example.com, ' || product_key ELSE '' END AS cc, '' AS bcc
FROM sv LEFT JOIN registry g ON g.key = sv.product_key""")
def q_mail_view(spark, sf):
    p = Parts(spark, sf)
    link = RP.deep_link(F.concat(F.lit("doc-"), "product_key"), F.concat(F.lit("h."), "run_id"))
    out = RP.mail_view(p.header, p.ranked, p.quotes, p.actions, p.registry, link=link)
    return out.withColumn("quotes", F.array_join("quotes", " | ")).withColumn("ideas", F.array_join("ideas", " | "))


@query("q_latest_report", THEME_CTES + HDR_SQL + "," + RUN_EVENTS_CTE + """
, log AS (
  SELECT run_id, status, updated_at, seq FROM run_events
  UNION ALL SELECT 'run-0', 'clustered', max(updated_at) + INTERVAL 1 DAY, 0 FROM run_events
  UNION ALL SELECT 'run-0', 'summarized', max(updated_at) + INTERVAL 1 DAY, 1 FROM run_events
  UNION ALL SELECT 'run-later', 'failed', max(updated_at) + INTERVAL 2 DAY, 0 FROM run_events),
newest AS (
  SELECT run_id, status FROM (
    SELECT run_id, arg_max(status, {'u': updated_at, 's': seq}) AS status, max(updated_at) AS u FROM log GROUP BY run_id)
  WHERE status IN ('summarized', 'published') ORDER BY u DESC, run_id LIMIT 1),
fq AS (
  SELECT c.run_id, r.body AS text, r.rating, r.source,
         row_number() OVER (PARTITION BY c.run_id ORDER BY c.cluster_id) AS rn
  FROM cmed c JOIN sreviews r ON r.id = c.medoid_review_id QUALIFY rn <= 3)
SELECT h.run_id, h.display AS product, h.iso_week, n.status,
       CAST(h.window_start AS VARCHAR) AS window_start, CAST(h.window_end AS VARCHAR) AS window_end,
       x.kind, CAST(x.ord AS INTEGER) AS ord, x.text, x.description, x.sentiment, x.review_count, x.rating, x.source
FROM hdr h JOIN newest n USING (run_id)
JOIN (SELECT run_id, 'theme' AS kind, rank AS ord, label AS text, description, sentiment, size AS review_count,
             NULL AS rating, NULL AS source FROM ranked
      UNION ALL SELECT run_id, 'quote', rn, text, NULL, NULL, NULL, rating, source FROM fq) x USING (run_id)""")
def q_latest_report(spark, sf):
    """J6 (+F8, J3, T4, T5): the newest successful run with its themes and medoid quotes."""
    p = Parts(spark, sf)
    ev = run_events(spark, sf).select("run_id", "status", "updated_at", "seq")
    day = ev.agg(F.max("updated_at").alias("u"))
    more = day.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("run_id"), F.lit(s).alias("status"), (F.col("u") + F.expr(f"INTERVAL {d} DAY")).alias("updated_at"),
                 F.lit(k).cast("long").alias("seq"))
        for r, s, d, k in (("run-0", "clustered", 1, 0), ("run-0", "summarized", 1, 1), ("run-later", "failed", 2, 0))]))
        .alias("e")).select("e.*")
    latest = RU.latest_status(ev.withColumn("seq", F.col("seq").cast("long")).unionByName(more))
    fq = TH.fallback_quotes(p.ti.med.select("run_id", "cluster_id", "medoid_review_id"), p.ti.reviews)
    w = Window.partitionBy("run_id").orderBy("cluster_id")
    return RP.served_report(latest, p.header, p.ranked, fq.withColumn("ord", F.row_number().over(w)), p.registry)


@query("q_subject_line", with_ctes(REVIEWS_CTE) + f"""
SELECT product_key,
       CASE WHEN length(s) > 200 THEN substring(s, 1, 197) || '...' ELSE s END AS subject
FROM (
  SELECT product_key, '[Weekly Pulse] Product ' || product_key || ' — ' ||
         max({S.iso_week_sql('posted_at')}) || ' — ' ||
         coalesce(min(CASE WHEN rating IS NOT NULL THEN body END),
                  'Review Pulse') AS s
  FROM reviews GROUP BY product_key)""")
def q_subject_line(spark, sf):
    """Per product, the product's smallest rated body stands in for the top
    theme (so long subjects occur)."""
    r = reviews(spark, sf).groupBy("product_key").agg(
        F.max(T.iso_week(F.col("posted_at"))).alias("iso_week"),
        F.min(F.when(F.col("rating").isNotNull(), F.col("body"))).alias("top"))
    return r.select("product_key", T.subject_line(F.concat(F.lit("Product "), F.col("product_key")),
                                                  F.col("iso_week"), F.col("top")).alias("subject"))


@query("q_undelivered", with_ctes(REVIEWS_CTE) + f"""
, wk AS (SELECT product_key, {S.iso_week_sql('posted_at')} AS iso_week, rating, source FROM reviews),
due AS (SELECT DISTINCT product_key, iso_week, unnest(['doc', 'mail']) AS channel FROM wk),
deliveries AS (
  SELECT DISTINCT product_key, iso_week, 'doc' AS channel FROM wk WHERE rating IS NOT NULL
  UNION
  SELECT DISTINCT product_key, iso_week, 'mail' FROM wk WHERE source = 'appstore')
SELECT * FROM due d WHERE NOT EXISTS (
  SELECT 1 FROM deliveries x WHERE x.product_key = d.product_key AND x.iso_week = d.iso_week
    AND x.channel = d.channel)""")
def q_undelivered(spark, sf):
    """Report (product, week, channel) rows with no delivery: a document
    counts delivered for weeks with a rated review, a mail for weeks with an
    appstore review."""
    wk = reviews(spark, sf).select("product_key", T.iso_week(F.col("posted_at")).alias("iso_week"),
                                   "rating", "source")
    due = (wk.select("product_key", "iso_week").distinct()
           .withColumn("channel", F.explode(F.array(F.lit("doc"), F.lit("mail")))))
    dl = (wk.filter(F.col("rating").isNotNull()).select("product_key", "iso_week",
                                                         F.lit("doc").alias("channel"))
          .unionByName(wk.filter(F.col("source") == "appstore")
                       .select("product_key", "iso_week", F.lit("mail").alias("channel"))))
    return RP.undelivered(due, dl)


@query("q_action_requests", THEME_CTES + """
SELECT run_id, '[' || string_agg('{"label":' || to_json(label) || ',"description":' || to_json(description)
                                 || ',"review_count":' || size || '}', ',' ORDER BY rank) || ']' AS themes_json
FROM ranked GROUP BY run_id""")
def q_action_requests(spark, sf):
    """L3: themes JSON per run (compact; the reference indents it)."""
    return TH.action_requests(Parts(spark, sf).ranked)


@query("q_actions", THEME_CTES + """
SELECT run_id, 'action' AS kind, CAST(item AS INTEGER) AS item, text FROM (
  SELECT run_id, text, row_number() OVER (PARTITION BY run_id ORDER BY o) AS item FROM (
    SELECT run_id, rank AS o, 'Address ' || label AS text FROM ranked
    UNION ALL SELECT DISTINCT run_id, 99, 'Address Monitor' FROM ranked)) WHERE item <= 3
UNION ALL
SELECT run_id, 'audience', CAST(row_number() OVER (PARTITION BY run_id ORDER BY rank) AS INTEGER), label FROM ranked""")
def q_actions(spark, sf):
    """Answers list four ideas per run (one per theme plus one); at most three are kept.
    Audience rows are all kept."""
    ranked = Parts(spark, sf).ranked
    g = ranked.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("t"))
    ideas = F.transform(F.concat(F.col("t"), F.array(F.struct(F.lit(99).alias("rank"),
                                                              F.lit("Monitor").alias("label")))),
                        lambda s: F.struct(F.concat(F.lit("Address "), s["label"]).alias("title"),
                                           F.lit("next week").alias("description")))
    resp = g.select("run_id", F.to_json(F.struct(ideas.alias("action_ideas"))).alias("response"))
    aud = g.select("run_id", F.to_json(F.struct(F.transform("t", lambda s: F.struct(
        s["label"].alias("audience"), F.lit("clearer answers").alias("value"))).alias("what_this_solves")))
        .alias("response"))
    a = TH.parse_actions(resp).select("run_id", F.lit("action").alias("kind"), "item",
                                      F.col("title").alias("text"))
    b = TH.parse_audiences(aud).select("run_id", F.lit("audience").alias("kind"), "item",
                                       F.col("audience").alias("text"))
    return a.unionByName(b)
