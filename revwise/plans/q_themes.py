"""Theme, quote and cost queries over one clustered run (embeddings ⋈ reviews).

The model's answers are a recorded response log derived from the data:
attempt 1 quotes a 40-character cut of the cluster's first pool review,
upper-cased (ASCII) with doubled blanks when its doc id is even (must pass)
or reversed when odd (must fail), plus an empty quote (fails); attempt 2
quotes the second pool review.  Label answers vary by digits of the cluster
id: every fourth first answer is malformed (its retry lacks a description and
names an unknown sentiment), and sentiments take all three values and an
unknown one.  Reviews are the stored ones: accepted and masked.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from revwise.functions.stopwords import sql_list
from revwise.operators import clusters as CL
from revwise.operators import phrases as PH
from revwise.operators import themes as TH
from revwise.plans import sqlparts as S
from revwise.plans.registry import (CALL_LOG_CTE, CLUSTERED_REVIEWS_CTE, REVIEWS_CTE, query,
                                    with_ctes)
from revwise.session import materialize_table
from revwise.sources.testdata import call_log, clustered_reviews

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()


class ThemeInputs:
    """Cluster-stage outputs the theme stage reads.

    Each is made when first asked for and written once as a stage table, the way a weekly
    run leaves them, so that a later step reads rows instead of planning all steps
    before it again.
    """

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def cr(self):
        return materialize_table(clustered_reviews(self.spark, self.sf))

    @cached_property
    def mem(self):
        return CL.members(self.cr)

    @cached_property
    def top(self):
        return materialize_table(CL.top_clusters(CL.cluster_sizes(self.cr)))

    @cached_property
    def pool(self):
        return materialize_table(TH.pool(self.mem.drop("embedding"), self.top))

    @cached_property
    def reviews(self):
        """The clustered reviews as (id, body, ...): every medoid is one of them."""
        return self.cr.select(F.col("review_id").alias("id"), "body", "rating", "source")

    @cached_property
    def med(self):
        return materialize_table(CL.medoids(self.cr).join(
            self.top.select("run_id", "cluster_id", "size", "size_rank"), ["run_id", "cluster_id"]))

    @cached_property
    def checked(self):
        return materialize_table(TH.check_quotes(quote_log(self.pool), self.pool))

    @cached_property
    def labels(self):
        return materialize_table(TH.parse_label_responses(label_log(self.med)))


def quote_log(pool):
    first = pool.filter(F.col("member_rank") == 1)
    cut = F.substring("body", 5, 40)
    a1 = first.select("run_id", "cluster_id", F.lit(1).alias("attempt"), F.lit(1).alias("position"),
                      F.when(F.col("doc_id") % 2 == 0,
                             F.regexp_replace(F.translate(cut, LOWER, UPPER), " ", "  "))
                      .otherwise(F.reverse(cut)).alias("text"), "rating", "source")
    a1e = first.select("run_id", "cluster_id", F.lit(1).alias("attempt"), F.lit(2).alias("position"),
                       F.lit("").alias("text"), "rating", "source")
    odd = first.filter(F.col("doc_id") % 2 == 1).select("run_id", "cluster_id")
    a2 = (pool.filter(F.col("member_rank") == 2).join(odd, ["run_id", "cluster_id"], "left_semi")
          .select("run_id", "cluster_id", F.lit(2).alias("attempt"), F.lit(1).alias("position"),
                  F.regexp_replace(F.substring("body", 10, 30), " ", "  ").alias("text"),
                  "rating", "source"))
    return a1.unionByName(a1e).unionByName(a2)


def _digit(place):
    """0 to 3 from a hex digit of the cluster id: how the recorded answers vary."""
    return f"(locate(substring(cluster_id, {place}, 1), '0123456789abcdef') - 1) % 4"


SENTIMENTS = ("negative", "positive", "mixed", "neutral")


def label_log(med):
    sentiment = F.element_at(F.array(*map(F.lit, SENTIMENTS)), F.expr(f"{_digit(2)} + 1"))
    malformed = F.expr(f"{_digit(3)} = 0")
    label = F.concat(F.lit("Theme "), F.substring("cluster_id", 1, 6))
    good = F.to_json(F.struct(label.alias("label"),
                              F.concat(F.lit("About "), F.col("size").cast("string"),
                                       F.lit(" reviews")).alias("description"),
                              sentiment.alias("sentiment")))
    a1 = med.select("run_id", "cluster_id", F.lit(1).alias("attempt"),
                    F.when(malformed, F.lit("not json")).otherwise(good).alias("response"))
    a2 = med.filter(malformed).select(
        "run_id", "cluster_id", F.lit(2).alias("attempt"),
        F.to_json(F.struct(label.alias("label"), F.lit("neutral").alias("sentiment")))
        .alias("response"))
    return a1.unionByName(a2)


def themes_of(ti):
    parsed = TH.first_good_attempt(ti.labels, ["run_id", "cluster_id"])
    t = ti.top.join(parsed.select("run_id", "cluster_id", "label", "description", "sentiment"),
                       ["run_id", "cluster_id"], "left")
    t = t.select("run_id", "cluster_id", "size", "size_rank",
                 F.coalesce("label", F.lit("Unknown")).alias("label"),
                 F.coalesce("description", F.lit("")).alias("description"),
                 F.coalesce("sentiment", F.lit("mixed")).alias("sentiment"))
    return t


# --- SQL twins ---------------------------------------------------------------

_NORM = "lower(" + S.collapse_sql("{x}") + ")"


def norm_sql(x: str) -> str:
    return _NORM.replace("{x}", x)


THEME_CTES = with_ctes(REVIEWS_CTE, CLUSTERED_REVIEWS_CTE) + f"""
, cm AS (
  SELECT *, sha1(run_id || '-cluster-' || CAST(cluster AS VARCHAR)) AS cluster_id
  FROM creviews WHERE cluster >= 0),
csizes AS (SELECT run_id, cluster_id, count(*) AS size FROM cm GROUP BY ALL),
ctop AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY size DESC, cluster_id)
                           AS size_rank FROM csizes) WHERE size_rank <= 6),
cpool AS (
  SELECT * FROM (
    SELECT cm.*, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY review_id) AS member_rank
    FROM cm WHERE cluster_id IN (SELECT cluster_id FROM ctop)) WHERE member_rank <= 30),
ex AS (
  SELECT run_id, cluster_id, unnest(generate_series(1, len(embedding))) AS dim,
         unnest(embedding) AS x FROM cm),
cent AS (
  SELECT run_id, cluster_id, list(v ORDER BY dim) AS centroid FROM (
    SELECT run_id, cluster_id, dim, avg(CAST(x AS DOUBLE)) AS v FROM ex GROUP BY ALL) GROUP BY ALL),
sims AS (
  SELECT cm.run_id, cm.cluster_id, cm.review_id,
         list_inner_product(CAST(cm.embedding AS DOUBLE[]), c.centroid) AS sim
  FROM cm JOIN cent c USING (run_id, cluster_id)),
cmed AS (
  SELECT s.run_id, s.cluster_id, s.review_id AS medoid_review_id, t.size, t.size_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY sim DESC, review_id)
                  AS rn FROM sims) s
  JOIN ctop t USING (run_id, cluster_id) WHERE s.rn = 1),
qlog AS (
  SELECT run_id, cluster_id, 1 AS attempt, 1 AS position,
         CASE WHEN doc_id % 2 = 0
              THEN replace(translate(substring(body, 5, 40), '{LOWER}', '{UPPER}'), ' ', '  ')
              ELSE reverse(substring(body, 5, 40)) END AS text, rating, source
  FROM cpool WHERE member_rank = 1
  UNION ALL
  SELECT run_id, cluster_id, 1, 2, '', rating, source FROM cpool WHERE member_rank = 1
  UNION ALL
  SELECT p.run_id, p.cluster_id, 2, 1, replace(substring(p.body, 10, 30), ' ', '  '), p.rating,
         p.source
  FROM cpool p WHERE p.member_rank = 2 AND p.cluster_id IN (
    SELECT cluster_id FROM cpool WHERE member_rank = 1 AND doc_id % 2 = 1)),
qchk AS (
  SELECT q.*, EXISTS (
    SELECT 1 FROM cpool p WHERE p.run_id = q.run_id AND p.cluster_id = q.cluster_id
      AND length({norm_sql('q.text')}) > 0
      AND contains({norm_sql('p.body')}, {norm_sql('q.text')})) AS valid
  FROM qlog q),
a1v AS (SELECT DISTINCT run_id, cluster_id FROM qchk WHERE attempt = 1 AND valid),
a1f AS (SELECT DISTINCT run_id, cluster_id FROM qchk WHERE attempt = 1 AND NOT valid),
qcand AS (
  SELECT * FROM qchk WHERE attempt = 1 AND valid
  UNION ALL
  SELECT * FROM qchk q WHERE attempt = 2 AND valid
    AND NOT EXISTS (SELECT 1 FROM a1v v WHERE v.run_id = q.run_id AND v.cluster_id = q.cluster_id)
    AND EXISTS (SELECT 1 FROM a1f f WHERE f.run_id = q.run_id AND f.cluster_id = q.cluster_id)),
qchosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id
                                              ORDER BY attempt, position) AS rn FROM qcand)
  WHERE rn = 1),
llog AS (
  SELECT run_id, cluster_id, 1 AS attempt,
         CASE WHEN (instr('0123456789abcdef', substring(cluster_id, 3, 1)) - 1) % 4 = 0 THEN 'not json'
              ELSE json_object('label', 'Theme ' || substring(cluster_id, 1, 6),
                               'description', 'About ' || CAST(size AS VARCHAR) || ' reviews',
                               'sentiment', ['negative', 'positive', 'mixed', 'neutral'][
                                 (instr('0123456789abcdef', substring(cluster_id, 2, 1)) - 1) % 4 + 1]
                              )::VARCHAR END AS response
  FROM cmed
  UNION ALL
  SELECT run_id, cluster_id, 2,
         json_object('label', 'Theme ' || substring(cluster_id, 1, 6), 'sentiment', 'neutral')::VARCHAR
  FROM cmed WHERE (instr('0123456789abcdef', substring(cluster_id, 3, 1)) - 1) % 4 = 0),
lparsed AS (
  SELECT run_id, cluster_id, attempt, response,
         coalesce(json_valid(response) AND regexp_matches(response, '^\\s*\\{{'), false) AS ok
  FROM llog),
lgood AS (
  SELECT run_id, cluster_id, attempt, response,
         coalesce(json_extract_string(response, '$.label'), 'Unknown') AS label,
         coalesce(json_extract_string(response, '$.description'), '') AS description,
         CASE WHEN coalesce(json_extract_string(response, '$.sentiment'), 'mixed')
                   IN ('negative', 'mixed', 'positive')
              THEN coalesce(json_extract_string(response, '$.sentiment'), 'mixed')
              ELSE 'mixed' END AS sentiment
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY attempt) AS rn
        FROM lparsed WHERE ok) WHERE rn = 1),
cthemes AS (
  SELECT t.run_id, t.cluster_id, t.size, t.size_rank, coalesce(l.label, 'Unknown') AS label,
         coalesce(l.description, '') AS description, coalesce(l.sentiment, 'mixed') AS sentiment
  FROM ctop t LEFT JOIN lgood l USING (run_id, cluster_id)),
ranked AS (
  SELECT * FROM (
    SELECT *, size * CASE sentiment WHEN 'negative' THEN 1.0 WHEN 'positive' THEN 1.0 ELSE 0.5 END
                AS score,
           row_number() OVER (PARTITION BY run_id ORDER BY
             size * CASE sentiment WHEN 'negative' THEN 1.0 WHEN 'positive' THEN 1.0 ELSE 0.5 END
             DESC, size DESC, cluster_id) AS rank
    FROM cthemes) WHERE rank <= 3)
"""


@query("q_cluster_reviews", THEME_CTES + """
SELECT run_id, cluster_id, review_id, member_rank FROM cpool""")
def q_cluster_reviews(spark, sf):
    return ThemeInputs(spark, sf).pool.select("run_id", "cluster_id", "review_id", "member_rank")


@query("q_medoid_body", THEME_CTES + """
SELECT m.run_id, m.cluster_id, m.medoid_review_id, coalesce(r.body, f.body) AS medoid_body
FROM cmed m LEFT JOIN sreviews r ON r.id = m.medoid_review_id
LEFT JOIN cpool f ON f.run_id = m.run_id AND f.cluster_id = m.cluster_id AND f.member_rank = 1""")
def q_medoid_body(spark, sf):
    ti = ThemeInputs(spark, sf)
    return TH.medoid_body(ti.med.select("run_id", "cluster_id", "medoid_review_id"),
                          ti.reviews, ti.pool)


def kp_sql() -> str:
    """Phrase counts and, in eight unrolled rounds, the diversified key phrases."""
    rounds = []
    for k in range(1, PH.TOP_N + 1):
        score = "rel" if k == 1 else f"{PH.MMR_LAMBDA} * rel - {1 - PH.MMR_LAMBDA} * coalesce(maxsim, 0.0)"
        seen = "" if k == 1 else (
            f"LEFT JOIN pen{k - 1} USING (run_id, cluster_id, phrase) WHERE NOT EXISTS (SELECT 1 FROM ("
            + " UNION ALL ".join(f"SELECT * FROM pick{j}" for j in range(1, k))
            + ") z WHERE z.run_id = b.run_id AND z.cluster_id = b.cluster_id AND z.phrase = b.phrase)")
        rounds.append(f"""pick{k} AS MATERIALIZED (
  SELECT run_id, cluster_id, phrase, pn, {k} AS phrase_rank FROM (
    SELECT b.run_id, b.cluster_id, b.phrase, b.pn, row_number() OVER (
      PARTITION BY b.run_id, b.cluster_id ORDER BY {score} DESC, b.phrase) AS rn
    FROM pbase b {seen}) WHERE rn = 1)""")
        if k == PH.TOP_N:
            break
        rounds.append(f"""sim{k} AS (
  SELECT t.run_id, t.cluster_id, t.phrase, sum(t.c * p.c) / (b.pn * k.pn) AS sim
  FROM pick{k} k JOIN ptok p ON p.run_id = k.run_id AND p.cluster_id = k.cluster_id AND p.phrase = k.phrase
  JOIN ptok t ON t.run_id = p.run_id AND t.cluster_id = p.cluster_id AND t.token = p.token
  JOIN pbase b ON b.run_id = t.run_id AND b.cluster_id = t.cluster_id AND b.phrase = t.phrase
  GROUP BY t.run_id, t.cluster_id, t.phrase, b.pn, k.pn)""")
        before = f"SELECT * FROM pen{k - 1} UNION ALL " if k > 1 else ""
        rounds.append(f"""pen{k} AS MATERIALIZED (
  SELECT run_id, cluster_id, phrase, max(maxsim) AS maxsim FROM (
    {before}SELECT run_id, cluster_id, phrase, sim AS maxsim FROM sim{k}) GROUP BY ALL)""")
    picks = " UNION ALL ".join(f"SELECT * FROM pick{k}" for k in range(1, PH.TOP_N + 1))
    return f"""
, toks AS (
  SELECT run_id, cluster_id, list_filter(regexp_extract_all(lower(body), '{PH.TOKEN_PATTERN}'),
                                         lambda x: x NOT IN ({sql_list()})) AS k FROM cm),
grams AS (
  SELECT run_id, cluster_id, unnest(k
    || list_transform(range(1, greatest(len(k), 1)), lambda i: k[i] || ' ' || k[i + 1])
    || list_transform(range(1, greatest(len(k) - 1, 1)),
                      lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2])) AS phrase
  FROM toks),
pcounts AS MATERIALIZED (SELECT run_id, cluster_id, phrase, count(*) AS n FROM grams GROUP BY ALL),
ptok AS MATERIALIZED (
  SELECT run_id, cluster_id, phrase, token, count(*) AS c FROM (
    SELECT run_id, cluster_id, phrase, unnest(string_split(phrase, ' ')) AS token FROM pcounts) GROUP BY ALL),
pdoc AS (
  SELECT run_id, cluster_id, phrase AS token, n AS dc FROM pcounts WHERE NOT contains(phrase, ' ')),
pbase AS MATERIALIZED (
  SELECT p.run_id, p.cluster_id, p.phrase, sqrt(sum(p.c * p.c)) AS pn,
         coalesce(sum(p.c * d.dc), 0.0) / (sqrt(sum(p.c * p.c)) * any_value(n.dn)) AS rel
  FROM ptok p LEFT JOIN pdoc d USING (run_id, cluster_id, token)
  JOIN (SELECT run_id, cluster_id, sqrt(sum(dc * dc)) AS dn FROM pdoc GROUP BY ALL) n
    ON n.run_id = p.run_id AND n.cluster_id = p.cluster_id
  GROUP BY p.run_id, p.cluster_id, p.phrase),
{", ".join(rounds)},
keyphrases AS (SELECT run_id, cluster_id, phrase_rank, phrase FROM ({picks}))
"""


@query("q_phrase_counts", lambda: THEME_CTES + kp_sql() + """
SELECT run_id, cluster_id, phrase, n FROM pcounts""")
def q_phrase_counts(spark, sf):
    """M5 stage 1: counts of 1- to 3-grams by cluster, stop words removed."""
    mem = CL.members(clustered_reviews(spark, sf))
    c = PH.phrase_counts(mem, ["run_id", "cluster_id"], "body")
    return c.select("run_id", "cluster_id", "phrase", "n")


@query("q_keyphrases", lambda: THEME_CTES + kp_sql() + """
SELECT run_id, cluster_id, CAST(phrase_rank AS INTEGER) AS phrase_rank, phrase FROM keyphrases""")
def q_keyphrases(spark, sf):
    """M5: 8 diversified key phrases of every cluster of the run."""
    return PH.keyphrases(ThemeInputs(spark, sf).mem, ["run_id", "cluster_id"], "body")


@query("q_label_requests", lambda: THEME_CTES + kp_sql() + f"""
, kp AS (
  SELECT run_id, cluster_id, string_agg(phrase, ', ' ORDER BY phrase_rank) AS keyphrases
  FROM keyphrases GROUP BY ALL),
smp AS (
  SELECT run_id, cluster_id,
         string_agg('- ' || {S.mask_sql('substring(body, 1, 300)', strict=True)}, chr(10)
                    ORDER BY member_rank) AS samples
  FROM cpool WHERE member_rank <= 10 GROUP BY ALL)
SELECT s.run_id, s.cluster_id, coalesce(k.keyphrases, '') AS keyphrases,
       {S.mask_sql('coalesce(r.body, f.body)', strict=True)} AS medoid, s.samples
FROM smp s JOIN cmed m USING (run_id, cluster_id)
LEFT JOIN kp k USING (run_id, cluster_id)
LEFT JOIN sreviews r ON r.id = m.medoid_review_id
LEFT JOIN cpool f ON f.run_id = m.run_id AND f.cluster_id = m.cluster_id AND f.member_rank = 1""")
def q_label_requests(spark, sf):
    ti = ThemeInputs(spark, sf)
    mem = ti.mem.join(ti.top.select("run_id", "cluster_id"), ["run_id", "cluster_id"], "left_semi")
    kp = PH.keyphrases(mem, ["run_id", "cluster_id"], "body")
    mb = TH.medoid_body(ti.med.select("run_id", "cluster_id", "medoid_review_id"),
                        ti.reviews, ti.pool)
    return TH.label_requests(ti.pool, mb.select("run_id", "cluster_id", "medoid_body"), kp)


@query("q_quote_requests", THEME_CTES + f"""
SELECT run_id, cluster_id, count(*) AS n_lines,
       string_agg('[' || coalesce(source, 'playstore') || ' | ' ||
                  coalesce(CAST(rating AS VARCHAR), 'None') || '★] ' ||
                  {S.mask_sql('substring(body, 1, 400)', strict=True)}, chr(10)
                  ORDER BY member_rank) AS reviews_block
FROM cpool GROUP BY ALL""")
def q_quote_requests(spark, sf):
    return TH.quote_requests(ThemeInputs(spark, sf).pool)


@query("q_quote_check", THEME_CTES + """
SELECT run_id, cluster_id, attempt, position, text, valid FROM qchk""")
def q_quote_check(spark, sf):
    ti = ThemeInputs(spark, sf)
    return ti.checked.select("run_id", "cluster_id", "attempt", "position", "text", "valid")


def chosen_quotes(ti):
    return TH.select_quotes(ti.checked)


@query("q_quotes", THEME_CTES + """
SELECT q.run_id, q.cluster_id, q.attempt, q.text, q.rating, q.source, t.size_rank,
       row_number() OVER (PARTITION BY q.run_id ORDER BY t.size_rank) AS quote_rank
FROM qchosen q JOIN ctop t USING (run_id, cluster_id)
QUALIFY quote_rank <= 3""")
def q_quotes(spark, sf):
    ti = ThemeInputs(spark, sf)
    r = TH.report_quotes(chosen_quotes(ti), ti.top)
    return r.select("run_id", "cluster_id", "attempt", "text", "rating", "source", "size_rank",
                    "quote_rank")


@query("q_theme_quotes", THEME_CTES + """
SELECT q.run_id, q.cluster_id, q.text, t.size_rank, row_number() OVER (PARTITION BY q.run_id ORDER BY t.size_rank) AS quote_rank
FROM qchosen q JOIN ctop t USING (run_id, cluster_id) JOIN ranked r ON r.run_id = q.run_id AND r.cluster_id = q.cluster_id
QUALIFY quote_rank <= 3""")
def q_theme_quotes(spark, sf):
    """W3 with quotes of the report's themes alone."""
    ti = ThemeInputs(spark, sf)
    r = TH.report_quotes(chosen_quotes(ti), ti.top, top_themes=TH.rank_themes(themes_of(ti)))
    return r.select("run_id", "cluster_id", "text", "size_rank", "quote_rank")


@query("q_quote_attribution", THEME_CTES + f"""
SELECT q.run_id, q.cluster_id, q.text, min(p.review_id) AS src_review_id,
       arg_min(p.rating, p.review_id) AS src_rating, arg_min(p.source, p.review_id) AS src_source
FROM qchosen q JOIN cpool p ON p.run_id = q.run_id AND p.cluster_id = q.cluster_id
  AND contains({norm_sql('p.body')}, {norm_sql('q.text')})
GROUP BY ALL""")
def q_quote_attribution(spark, sf):
    ti = ThemeInputs(spark, sf)
    return TH.attribute_quotes(chosen_quotes(ti), ti.pool)


@query("q_quote_dedup", THEME_CTES + f"""
SELECT run_id, cluster_id, text FROM (
  SELECT q.*, t.size_rank, row_number() OVER (PARTITION BY q.run_id, {norm_sql('q.text')}
                                             ORDER BY t.size_rank, q.cluster_id) AS rn
  FROM qchosen q JOIN ctop t USING (run_id, cluster_id)) WHERE rn = 1""")
def q_quote_dedup(spark, sf):
    ti = ThemeInputs(spark, sf)
    q = chosen_quotes(ti).join(ti.top.select("run_id", "cluster_id", "size_rank"),
                               ["run_id", "cluster_id"])
    return TH.dedup_quotes(q).select("run_id", "cluster_id", "text")


@query("q_parse_responses", THEME_CTES + """
SELECT l.run_id, l.cluster_id, l.attempt, l.ok,
       CASE WHEN l.ok THEN coalesce(json_extract_string(l.response, '$.label'), 'Unknown') END AS label,
       CASE WHEN l.ok THEN coalesce(json_extract_string(l.response, '$.description'), '') END
         AS description,
       CASE WHEN l.ok THEN CASE WHEN coalesce(json_extract_string(l.response, '$.sentiment'), 'mixed')
                                  IN ('negative', 'mixed', 'positive')
                             THEN coalesce(json_extract_string(l.response, '$.sentiment'), 'mixed')
                             ELSE 'mixed' END END AS sentiment
FROM lparsed l""")
def q_parse_responses(spark, sf):
    return ThemeInputs(spark, sf).labels.select("run_id", "cluster_id", "attempt", "ok", "label", "description", "sentiment")


@query("q_theme_rank", THEME_CTES + """
SELECT run_id, cluster_id, 'theme-' || cluster_id AS theme_id, label, sentiment, size AS review_count,
       score, rank FROM ranked""")
def q_theme_rank(spark, sf):
    r = TH.rank_themes(themes_of(ThemeInputs(spark, sf)))
    return r.select("run_id", "cluster_id", F.concat(F.lit("theme-"), "cluster_id").alias("theme_id"),
                    "label", "sentiment", F.col("size").alias("review_count"), "score", "rank")


@query("q_fallback_quotes", THEME_CTES + """
SELECT c.run_id, c.cluster_id, c.medoid_review_id, r.body AS text, r.rating, r.source FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cluster_id) AS rn FROM cmed) c
JOIN sreviews r ON r.id = c.medoid_review_id WHERE c.rn <= 3""")
def q_fallback_quotes(spark, sf):
    ti = ThemeInputs(spark, sf)
    return TH.fallback_quotes(ti.med.select("run_id", "cluster_id", "medoid_review_id"),
                              ti.reviews)


@query("q_extra_picks", THEME_CTES + """
, rated AS (
  SELECT s.run_id, s.cluster_id, s.review_id, s.sim,
         CASE WHEN p.doc_id % 11 <> 0 THEN coalesce(p.rating, 1 + p.doc_id % 5) END AS rating
  FROM sims s JOIN cm p USING (run_id, cluster_id, review_id))
SELECT run_id, cluster_id, review_id, CAST(rating AS INTEGER) AS rating,
       CAST(medoid_rating AS INTEGER) AS medoid_rating, pick_rank FROM (
  SELECT s.run_id, s.cluster_id, s.review_id, s.rating, mr.rating AS medoid_rating,
         row_number() OVER (PARTITION BY s.run_id, s.cluster_id
                            ORDER BY abs(s.rating - mr.rating) DESC, s.sim DESC, s.review_id)
           AS pick_rank
  FROM rated s JOIN cmed m USING (run_id, cluster_id)
  JOIN rated mr ON mr.run_id = m.run_id AND mr.cluster_id = m.cluster_id AND mr.review_id = m.medoid_review_id
  WHERE s.rating IS NOT NULL AND mr.rating IS NOT NULL AND s.rating <> mr.rating)
WHERE pick_rank <= 2""")
def q_extra_picks(spark, sf):
    """W8 over ratings that unlabelled reviews get from their id (some have none)."""
    ti = ThemeInputs(spark, sf)
    cr = ti.cr.withColumn("rating", F.when(F.col("doc_id") % 11 != 0, F.coalesce(
        "rating", (1 + F.col("doc_id") % 5).cast("int"))))
    cents = CL.centroids(cr)
    mem = (CL.members(cr).join(cents.select("run_id", "cluster", "centroid"), ["run_id", "cluster"])
           .withColumn("sim", CL.dot(F.col("embedding"), F.col("centroid"))))
    med = ti.med.join(cr.select("run_id", F.col("review_id").alias("medoid_review_id"),
                                F.col("rating").alias("medoid_rating")), ["run_id", "medoid_review_id"])
    r = TH.extra_picks(mem, med)
    return r.select("run_id", "cluster_id", "review_id", "rating", "medoid_rating", "pick_rank")


# The prices of ``revwise.operators.themes``.
COST_SQL = "prompt_tokens * (0.59 / 1000000) + completion_tokens * (0.79 / 1000000)"


@query("q_llm_cost", with_ctes(CALL_LOG_CTE) + f"""
SELECT run_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(prompt_tokens) + sum(completion_tokens) AS BIGINT) AS total_tokens,
       sum(prompt_tokens) * (0.59 / 1000000) + sum(completion_tokens) * (0.79 / 1000000)
         AS llm_cost_usd,
       count(*) AS llm_calls, count(*) FILTER (NOT ok) AS retries
FROM call_log GROUP BY run_id""")
def q_llm_cost(spark, sf):
    return TH.llm_cost(call_log(spark, sf))


@query("q_cost_cap", with_ctes(CALL_LOG_CTE) + f"""
, cap AS (SELECT round(avg(c), 7) AS cap FROM (SELECT sum({COST_SQL}) AS c FROM call_log GROUP BY run_id))
SELECT run_id, seq, {COST_SQL} AS cost,
       coalesce(sum({COST_SQL}) OVER (PARTITION BY run_id ORDER BY seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent_before,
       coalesce(sum({COST_SQL}) OVER (PARTITION BY run_id ORDER BY seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) >= (SELECT cap FROM cap)
         AS refused
FROM call_log""")
def q_cost_cap(spark, sf):
    """W6 with the mean spend of a run as the cap, so that later calls of long runs are refused."""
    calls = call_log(spark, sf)
    cap = TH.llm_cost(calls).agg(F.round(F.avg("llm_cost_usd"), 7)).first()[0]
    c = TH.cost_cap(calls, cap if cap is not None else TH.DEFAULT_COST_CAP_USD)
    return c.select("run_id", "seq", "cost", "spent_before", "refused")


@query("q_quote_retry_requests", THEME_CTES + """
SELECT run_id, cluster_id, count(*) AS n_lines,
       string_agg('- "' || text || '"', chr(10) ORDER BY position) AS failed_quotes
FROM qchk q
WHERE attempt = 1 AND NOT valid
  AND NOT EXISTS (SELECT 1 FROM a1v v WHERE v.run_id = q.run_id AND v.cluster_id = q.cluster_id)
GROUP BY ALL""")
def q_quote_retry_requests(spark, sf):
    ti = ThemeInputs(spark, sf)
    return TH.retry_requests(ti.checked)
