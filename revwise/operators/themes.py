"""Model-in-the-loop steps as table operators.

The model call itself stays outside: these operators build request tables
from clusters and reviews, and turn a recorded response log back into
themes and verified quotes.  Every per-cluster list is bounded (≤ 30 pool
reviews, ≤ 10 samples, ≤ 3 quotes), so grouped arrays never grow with data.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from revwise.functions.text import mask_pii_strict, normalise, sentiment_or_mixed

POOL_SIZE = 30
SAMPLE_SIZE = 10
SAMPLE_CHARS = 300
LINE_CHARS = 400
TOP_THEMES = 3
REPORT_QUOTES = 3

# Theme weights by sentiment and model prices (USD per token).
SENTIMENT_WEIGHT = {"negative": 1.0, "mixed": 0.5, "positive": 1.0}
COST_PER_PROMPT_TOKEN = 0.59 / 1_000_000
COST_PER_COMPLETION_TOKEN = 0.79 / 1_000_000
DEFAULT_COST_CAP_USD = 0.50

LABEL_SCHEMA = "label string, description string, sentiment string"


def nfkc(c: Column) -> Column:
    """NFKC (Spark has no built-in) through an Arrow UDF, a batch at a time.  Spark
    evaluates the UDF for every row that reaches it; ASCII rows (NFKC-stable)
    keep their value.  It is applied only to quotes and the ≤ 30 pool bodies
    of a cluster, never to whole tables."""
    # Defined here so that workers get it by value, wherever the job was started.
    @arrow_udf(StringType())
    def _nfkc(s: pa.Array) -> pa.Array:
        import pyarrow.compute as pc
        return pc.utf8_normalize(s, form="NFKC")

    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)


def quote_norm(c: Column, use_nfkc: bool = True) -> Column:
    """NFKC, blank-collapse, lower."""
    return normalise(nfkc(c) if use_nfkc else c)


def pool(members: DataFrame, clusters: DataFrame, n: int = POOL_SIZE) -> DataFrame:
    """≤ n member reviews per selected cluster, by review id.

    ``members``: (run_id, cluster_id, review_id, body, rating, source, ...);
    ``clusters``: the selected (run_id, cluster_id).  Plans as a semi join and
    a WindowGroupLimit (partial top-n before the shuffle).
    """
    sel = members.join(clusters.select("run_id", "cluster_id"), ["run_id", "cluster_id"],
                       "left_semi")
    w = Window.partitionBy("run_id", "cluster_id").orderBy("review_id")
    return sel.withColumn("member_rank", F.row_number().over(w)).filter(F.col("member_rank") <= n)


def medoid_body(clusters: DataFrame, reviews: DataFrame, pool_df: DataFrame) -> DataFrame:
    """medoid's body, else the first pool member's body."""
    first = pool_df.filter(F.col("member_rank") == 1).select(
        "run_id", "cluster_id", F.col("body").alias("first_body"))
    med = reviews.select(F.col("id").alias("medoid_review_id"), F.col("body").alias("m_body"))
    return (clusters.join(med, "medoid_review_id", "left").join(first, ["run_id", "cluster_id"], "left")
            .select("run_id", "cluster_id", "medoid_review_id",
                    F.coalesce("m_body", "first_body").alias("medoid_body")))


def _ordered_join(lines: DataFrame, key_cols: list[str], order: str, text: str,
                  sep: str) -> DataFrame:
    """Join a bounded set of lines per key in ``order``."""
    g = lines.groupBy(*key_cols).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
        .alias("_l"), F.count(F.lit(1)).alias("n_lines"))
    return g.select(*key_cols, "n_lines",
                    F.array_join(F.transform("_l", lambda s: s["t"]), sep).alias(text))


def label_requests(pool_df: DataFrame, medoids: DataFrame, keyphrases: DataFrame) -> DataFrame:
    """L1: one request per cluster: key phrases, masked medoid, ≤ 10 masked samples."""
    samples = pool_df.filter(F.col("member_rank") <= SAMPLE_SIZE).select(
        "run_id", "cluster_id", "member_rank",
        F.concat(F.lit("- "), mask_pii_strict(F.substring("body", 1, SAMPLE_CHARS))).alias("samples"))
    s = _ordered_join(samples, ["run_id", "cluster_id"], "member_rank", "samples", "\n")
    kp = _ordered_join(keyphrases, ["run_id", "cluster_id"], "phrase_rank", "phrase", ", ") \
        .select("run_id", "cluster_id", F.col("phrase").alias("keyphrases"))
    return (s.join(medoids, ["run_id", "cluster_id"]).join(kp, ["run_id", "cluster_id"], "left")
            .select("run_id", "cluster_id", F.coalesce("keyphrases", F.lit("")).alias("keyphrases"),
                    mask_pii_strict(F.col("medoid_body")).alias("medoid"), "samples"))


def review_line(source: Column, rating: Column, body: Column) -> Column:
    """`[source | rating★] masked text` with the text cut to 400 characters."""
    return F.concat(F.lit("["), F.coalesce(source, F.lit("playstore")), F.lit(" | "),
                    F.coalesce(rating.cast("string"), F.lit("None")), F.lit("★] "),
                    mask_pii_strict(F.substring(body, 1, LINE_CHARS)))


def quote_requests(pool_df: DataFrame) -> DataFrame:
    """L2: the review block of the quote request, one row per cluster."""
    lines = pool_df.select("run_id", "cluster_id", "member_rank",
                           review_line(F.col("source"), F.col("rating"), F.col("body"))
                           .alias("reviews_block"))
    return _ordered_join(lines, ["run_id", "cluster_id"], "member_rank", "reviews_block", "\n")


def check_quotes(quotes: DataFrame, pool_df: DataFrame, use_nfkc: bool = True) -> DataFrame:
    """A quote is valid when its normalised text is non-empty and is a
    substring of a normalised pool body of the same cluster.

    Semi join on the cluster key with a ``contains`` residual: a hash join, no
    nested loop, and each quote meets at most 30 bodies.
    """
    q = quotes.withColumn("norm_text", quote_norm(F.col("text"), use_nfkc))
    p = pool_df.select(F.col("run_id").alias("p_run"), F.col("cluster_id").alias("p_cluster"),
                       quote_norm(F.col("body"), use_nfkc).alias("norm_body"))
    cond = [F.col("run_id") == F.col("p_run"), F.col("cluster_id") == F.col("p_cluster"),
            F.length("norm_text") > 0, F.col("norm_body").contains(F.col("norm_text"))]
    ok = q.join(p, cond, "left_semi").select("run_id", "cluster_id", "attempt", "position",
                                             F.lit(True).alias("valid"))
    return (q.join(ok, ["run_id", "cluster_id", "attempt", "position"], "left")
            .withColumn("valid", F.coalesce("valid", F.lit(False))))


def select_quotes(checked: DataFrame) -> DataFrame:
    """First valid quote per cluster.  Attempt 2 counts only for clusters
    whose first answer had a failure and no valid quote; retry texts equal to
    an already valid text are skipped."""
    keys = ["run_id", "cluster_id"]
    a1 = checked.filter(F.col("attempt") == 1)
    a1_valid = a1.filter("valid").select(*keys).distinct()
    a1_failed = a1.filter(~F.col("valid")).select(*keys).distinct()
    retry = (checked.filter(F.col("attempt") == 2)
             .join(a1_valid, keys, "left_anti").join(a1_failed, keys, "left_semi"))
    seen = a1.filter("valid").select(*keys, "text").distinct()
    retry = retry.join(seen, [*keys, "text"], "left_anti")
    cand = a1.unionByName(retry).filter("valid")
    w = Window.partitionBy(*keys).orderBy("attempt", "position")
    return cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def report_quotes(chosen: DataFrame, cluster_order: DataFrame, n: int = REPORT_QUOTES,
                  top_themes: DataFrame | None = None) -> DataFrame:
    """W3 (second half): first n quotes over clusters in size order.

    With ``top_themes`` (run_id, cluster_id) only quotes of these count (X9), so that every
    quote belongs to a theme of the report.
    """
    if top_themes is not None:
        chosen = chosen.join(top_themes.select("run_id", "cluster_id"), ["run_id", "cluster_id"], "left_semi")
    j = chosen.join(cluster_order.select("run_id", "cluster_id", "size_rank"),
                    ["run_id", "cluster_id"])
    w = Window.partitionBy("run_id").orderBy("size_rank")
    return j.withColumn("quote_rank", F.row_number().over(w)).filter(F.col("quote_rank") <= n)


def parse_label_responses(responses: DataFrame) -> DataFrame:
    """L4: parse by schema; malformed text is a failed attempt; missing keys
    take defaults ('Unknown', '', 'mixed'); bad sentiment becomes 'mixed'."""
    parsed = F.from_json(F.col("response"), LABEL_SCHEMA)
    ok = F.try_parse_json(F.col("response")).isNotNull() & \
        F.col("response").rlike(r"^\s*\{")
    r = responses.select("*", ok.alias("ok"), parsed.alias("_p"))
    return r.select(*responses.columns, "ok",
                    F.when(F.col("ok"), F.coalesce("_p.label", F.lit("Unknown"))).alias("label"),
                    F.when(F.col("ok"), F.coalesce("_p.description", F.lit(""))).alias("description"),
                    F.when(F.col("ok"), sentiment_or_mixed(F.coalesce("_p.sentiment", F.lit("mixed"))))
                    .alias("sentiment"))


def first_good_attempt(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """L4: take the first attempt that parsed."""
    w = Window.partitionBy(*keys).orderBy("attempt")
    return (parsed.filter("ok").withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def sentiment_weight(c: Column) -> Column:
    out = F.lit(SENTIMENT_WEIGHT["mixed"])
    for k, v in SENTIMENT_WEIGHT.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def rank_themes(themes: DataFrame, n: int = TOP_THEMES) -> DataFrame:
    """score = size × weight; ties keep cluster-size order, then cluster id."""
    t = themes.withColumn("score", F.col("size") * sentiment_weight(F.col("sentiment")))
    w = Window.partitionBy("run_id").orderBy(F.col("score").desc(), F.col("size").desc(),
                                             F.col("cluster_id"))
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def attribute_quotes(chosen: DataFrame, pool_df: DataFrame, use_nfkc: bool = True) -> DataFrame:
    """The first pool review (by id) that contains the quote: id, rating, source."""
    q = chosen.select("run_id", "cluster_id", "text",
                      quote_norm(F.col("text"), use_nfkc).alias("norm_text"))
    p = pool_df.select(F.col("run_id").alias("p_run"), F.col("cluster_id").alias("p_cluster"),
                       F.col("review_id").alias("src_review_id"),
                       F.col("rating").alias("src_rating"), F.col("source").alias("src_source"),
                       quote_norm(F.col("body"), use_nfkc).alias("norm_body"))
    j = q.join(p, [F.col("run_id") == F.col("p_run"), F.col("cluster_id") == F.col("p_cluster"),
                   F.col("norm_body").contains(F.col("norm_text"))])
    return (j.groupBy("run_id", "cluster_id", "text")
            .agg(F.min_by(F.struct("src_review_id", "src_rating", "src_source"),
                          F.col("src_review_id")).alias("src"))
            .select("run_id", "cluster_id", "text", "src.*"))


def dedup_quotes(quotes: DataFrame, order_col: str = "size_rank", use_nfkc: bool = True) -> DataFrame:
    """The same normalised quote under two themes stays with the first."""
    q = quotes.withColumn("_n", quote_norm(F.col("text"), use_nfkc))
    w = Window.partitionBy("run_id", "_n").orderBy(order_col, "cluster_id")
    return q.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "_n")


def llm_cost(calls: DataFrame) -> DataFrame:
    """Tokens, cost, calls and retries by run; every failed attempt (``ok`` false)
    counts as a retry, the last one too."""
    g = calls.groupBy("run_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.count(F.lit(1)).alias("llm_calls"),
        F.count_if(~F.col("ok")).alias("retries"))
    cost = (F.col("prompt_tokens") * COST_PER_PROMPT_TOKEN
            + F.col("completion_tokens") * COST_PER_COMPLETION_TOKEN)
    return g.select("run_id", "prompt_tokens", "completion_tokens",
                    (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
                    cost.alias("llm_cost_usd"), "llm_calls", "retries")


def cost_cap(calls: DataFrame, cap: float = DEFAULT_COST_CAP_USD) -> DataFrame:
    """Spend before each call (running sum over earlier calls of the run);
    a call is refused when that spend is at or above the cap.

    The window is partitioned by run; one run's calls are bounded by the
    clusters of one week (2 per cluster + 2), so the partition stays small.
    """
    cost = (F.col("prompt_tokens") * COST_PER_PROMPT_TOKEN
            + F.col("completion_tokens") * COST_PER_COMPLETION_TOKEN)
    w = (Window.partitionBy("run_id").orderBy("seq")
         .rowsBetween(Window.unboundedPreceding, -1))
    c = calls if "cost" in calls.columns else calls.withColumn("cost", cost)
    return c.withColumn("spent_before", F.coalesce(F.sum("cost").over(w), F.lit(0.0))) \
        .withColumn("refused", F.col("spent_before") >= F.lit(cap))


def fallback_quotes(clusters: DataFrame, reviews: DataFrame, n: int = 3) -> DataFrame:
    """T4: medoid reviews of the first n clusters (by cluster id)."""
    w = Window.partitionBy("run_id").orderBy("cluster_id")
    c = clusters.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    r = reviews.select(F.col("id").alias("medoid_review_id"), "body", "rating", "source")
    return c.join(r, "medoid_review_id").select("run_id", "cluster_id", "medoid_review_id",
                                                F.col("body").alias("text"), "rating", "source")


def extra_picks(members: DataFrame, medoids: DataFrame, n: int = 2) -> DataFrame:
    """Up to n members whose rating differs from the medoid's, farthest
    rating first, then most central (sim to centroid), then id."""
    m = medoids.select("run_id", "cluster_id", "medoid_review_id", "medoid_rating")
    j = members.join(m, ["run_id", "cluster_id"]).filter(
        F.col("rating").isNotNull() & F.col("medoid_rating").isNotNull()
        & (F.col("rating") != F.col("medoid_rating")))
    w = Window.partitionBy("run_id", "cluster_id").orderBy(
        F.abs(F.col("rating") - F.col("medoid_rating")).desc(), F.col("sim").desc(),
        F.col("review_id"))
    return j.withColumn("pick_rank", F.row_number().over(w)).filter(F.col("pick_rank") <= n)


ACTIONS_SCHEMA = "action_ideas array<struct<title: string, description: string>>"
AUDIENCE_SCHEMA = "what_this_solves array<struct<audience: string, value: string>>"
MAX_ACTIONS = 3


def retry_requests(checked: DataFrame) -> DataFrame:
    """L2 (retry): for clusters whose first answer had a failed quote and no
    valid one, the list of failed quotes, one `- "text"` line each."""
    keys = ["run_id", "cluster_id"]
    a1 = checked.filter(F.col("attempt") == 1)
    need = (a1.filter(~F.col("valid")).select(*keys).distinct()
            .join(a1.filter("valid").select(*keys).distinct(), keys, "left_anti"))
    lines = (a1.filter(~F.col("valid")).join(need, keys, "left_semi")
             .select(*keys, "position", F.concat(F.lit('- "'), F.col("text"), F.lit('"')).alias("failed_quotes")))
    return _ordered_join(lines, keys, "position", "failed_quotes", "\n")


def action_requests(ranked: DataFrame) -> DataFrame:
    """L3: the top themes of each run as JSON (label, description, count);
    runs without themes get no request."""
    g = ranked.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "label", "description", F.col("size").alias("review_count")))).alias("_t"))
    return g.select("run_id", F.to_json(F.transform("_t", lambda s: s.dropFields("rank")))
                    .alias("themes_json"))


def parse_actions(responses: DataFrame) -> DataFrame:
    """At most three action ideas per run, in answer order."""
    p = responses.select("run_id", F.from_json("response", ACTIONS_SCHEMA).alias("_p"))
    return p.select("run_id", F.posexplode(F.slice(F.coalesce("_p.action_ideas", F.array()), 1,
                                                   MAX_ACTIONS)).alias("pos", "a")) \
        .select("run_id", (F.col("pos") + 1).alias("item"), "a.title", "a.description")


def parse_audiences(responses: DataFrame) -> DataFrame:
    """Every audience row of the answer, in order."""
    p = responses.select("run_id", F.from_json("response", AUDIENCE_SCHEMA).alias("_p"))
    return p.select("run_id", F.posexplode(F.coalesce("_p.what_this_solves", F.array()))
                    .alias("pos", "a")) \
        .select("run_id", (F.col("pos") + 1).alias("item"), "a.audience", "a.value")
