"""Report tables.

A report is a small ordered table of lines per run.  Offsets are a running
sum over the run's lines (a window partitioned by run: a run has a few dozen
lines, never a data-sized partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revwise.functions.text import round2_or_zero, subject_line, window_weeks
from revwise.operators.runs import recent_runs
from revwise.sources.registry import with_product

# The document request kinds that delivery accepts.
ALLOWED_KINDS = ("insertText", "updateParagraphStyle", "updateTextStyle", "insertTable",
                 "insertPageBreak")

# Section headings and line layouts of the report document.
TITLE_TAIL = " — Weekly Review Pulse  |  "
HEADINGS = {"themes": "Top Themes\n", "quotes": "Real User Quotes\n",
            "actions": "Action Ideas\n", "audiences": "What This Solves\n"}
LINK_PLACEHOLDER = "{DOC_DEEP_LINK}"
FALLBACK_RECIPIENT = "product-team@example.com"

SECTION_ORDER = {"title": 1, "themes": 2, "quotes": 3, "actions": 4, "audiences": 5}


def anchor(product: Column, week: Column) -> Column:
    """Anchor text placed in the title and searched for on delivery."""
    return F.concat(F.lit("[pulse-"), product, F.lit("-"), week, F.lit("]"))


def deep_link(doc_id: Column, heading_id: Column) -> Column:
    """Document deep link to the run's heading."""
    return F.concat(F.lit("https://docs.google.com/document/d/"), doc_id, F.lit("/edit#heading="),
                    heading_id)


def _item(run: DataFrame, section: str, item: Column, text: Column, style: str,
          italic: bool = False) -> DataFrame:
    return run.select("run_id", F.lit(SECTION_ORDER[section]).alias("section"),
                      item.alias("item"), text.alias("text"), F.lit(style).alias("style"),
                      F.lit(italic).alias("italic"))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", ""))


def report_lines(header: DataFrame, themes: DataFrame, quotes: DataFrame, actions: DataFrame,
                 audiences: DataFrame, start_index: int = 1, utf16: bool = False) -> DataFrame:
    """R1 + W5: ordered lines with style and [start, end) offsets, in characters or (X14) in
    UTF-16 units.

    header: (run_id, product_key, display, iso_week); themes: (run_id, rank,
    label, description); quotes: (run_id, quote_rank, text, source, rating);
    actions: (run_id, item, title, description); audiences: (run_id, item,
    audience, value).
    """
    title = F.concat(F.col("display"), F.lit(TITLE_TAIL), F.col("iso_week"), F.lit("  "),
                     anchor(F.col("product_key"), F.col("iso_week")), F.lit("\n"))
    parts = [
        _item(header, "title", F.lit(0), title, "HEADING_1"),
        *[_item(header, s, F.lit(0), F.lit(h), "HEADING_2") for s, h in HEADINGS.items()],
        _item(themes, "themes", F.col("rank"),
              F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("label"), F.lit(" — "),
                       F.col("description"), F.lit("\n")), "NORMAL_TEXT"),
        _item(quotes, "quotes", F.col("quote_rank"),
              F.concat(F.lit('"'), F.col("text"), F.lit('" ('), F.col("source"), F.lit(", "),
                       F.coalesce(F.col("rating").cast("string"), F.lit("None")), F.lit("★)\n")),
              "NORMAL_TEXT", italic=True),
        _item(actions, "actions", F.col("item"),
              F.concat(F.lit("• "), F.col("title"), F.lit(": "), F.col("description"), F.lit("\n")),
              "NORMAL_TEXT"),
        _item(audiences, "audiences", F.col("item"),
              F.concat(F.lit("• "), F.col("audience"), F.lit(": "), F.col("value"), F.lit("\n")),
              "NORMAL_TEXT"),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    first = start_index + (1 if start_index > 1 else 0)
    w = (Window.partitionBy("run_id").orderBy("section", "item")
         .rowsBetween(Window.unboundedPreceding, -1))
    size = utf16_length(F.col("text")) if utf16 else F.length("text")
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    out = lines.withColumn("start", (F.lit(first) + before).cast("int"))
    return out.withColumn("end", F.col("start") + size)


def doc_requests(lines: DataFrame, start_index: int = 1) -> DataFrame:
    """The request rows (2 or 3 per line, plus a page break when start > 1)."""
    reqs = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("insertText").alias("kind")),
        F.struct(F.lit(1).alias("k"), F.lit("updateParagraphStyle").alias("kind")),
        F.struct(F.lit(2).alias("k"), F.when(F.col("italic"), F.lit("updateTextStyle"))
                 .alias("kind")))
    r = lines.select("run_id", "section", "item", "start", "end", "style",
                     F.explode(reqs).alias("r")).filter(F.col("r.kind").isNotNull())
    r = r.select("run_id", "section", "item", F.col("r.k").alias("k"), F.col("r.kind").alias("kind"),
                 "start", "end", "style")
    if start_index > 1:
        pb = lines.select("run_id").distinct().select(
            "run_id", F.lit(0).alias("section"), F.lit(0).alias("item"), F.lit(0).alias("k"),
            F.lit("insertPageBreak").alias("kind"), F.lit(start_index).alias("start"),
            F.lit(start_index + 1).alias("end"), F.lit(None).cast("string").alias("style"))
        r = pb.unionByName(r)
    return r


def request_kinds(requests: DataFrame) -> DataFrame:
    """Request count and offset range by kind, with a validity flag."""
    return (requests.groupBy("kind")
            .agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("min_start"),
                 F.max("end").alias("max_end"))
            .withColumn("allowed", F.col("kind").isin(*ALLOWED_KINDS)))


def _lines(items: DataFrame, order: str, text: Column, name: str) -> DataFrame:
    """(run_id, name): the run's bounded items as an array of texts in order."""
    return items.groupBy("run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"]).alias(name))


def mail_view(summary: DataFrame, themes: DataFrame, quotes: DataFrame, actions: DataFrame,
              recipients: DataFrame | None = None, override_to: str | None = None,
              link: Column | None = None, production: bool = False) -> DataFrame:
    """Mail fields by run.

    summary: (run_id, product_key, display, iso_week, window_start date, window_end
    date, total_reviews, avg_rating); themes, quotes and actions as in ``report_lines``
    (themes with size); recipients: the registry's (key, recipients).  The receiver is
    the override, else the product's list, else a fallback; in production a run without
    a receiver is an error.
    """
    theme = F.concat(F.lit("\n* "), F.col("label"), F.lit(" ("), F.col("size").cast("string"), F.lit(" reviews)\n  "),
                     F.col("description"), F.lit("\n"))
    s = (summary.join(_lines(themes, "rank", theme, "theme_lines"), "run_id", "left")
         .join(themes.filter(F.col("rank") == 1).select("run_id", F.col("label").alias("top_theme")), "run_id", "left")
         .join(_lines(quotes, "quote_rank", F.col("text"), "quotes"), "run_id", "left")
         .join(_lines(actions, "item", F.concat(F.col("title"), F.lit(": "), F.col("description")), "ideas"),
               "run_id", "left"))
    if recipients is not None:
        s = s.join(recipients.select(F.col("key").alias("product_key"), "recipients"), "product_key", "left")
    else:
        s = s.withColumn("recipients", F.lit(None).cast(
            "struct<to: array<string>, cc: array<string>, bcc: array<string>>"))
    # The layout of the mail's text part.
    body = F.concat(
        F.lit("Subject: [Weekly Pulse] "), F.col("display"), F.lit(" — "), F.col("iso_week"), F.lit(" — "),
        F.coalesce("top_theme", F.lit("No Themes")),
        F.lit("\n\nHi Team,\n\nHere are the top themes discovered from this week's reviews:\n\n"),
        F.coalesce(F.array_join("theme_lines", ""), F.lit("")),
        F.lit("\n\nRead full report → "), link if link is not None else F.lit(LINK_PLACEHOLDER),
        F.lit("\n\nThis is an automated report.\nProduct: "), F.col("display"),
        F.lit(" | ISO Week: "), F.col("iso_week"))
    listed = F.lit(override_to) if override_to else F.when(F.size("recipients.to") > 0, F.array_join("recipients.to", ", "))
    missing = F.raise_error(F.concat(F.lit("no recipient for "), F.col("product_key"))).cast("string") if production \
        else F.lit(FALLBACK_RECIPIENT)
    return s.select(
        "run_id",
        subject_line(F.col("display"), F.col("iso_week"), F.col("top_theme")).alias("subject"),
        F.col("total_reviews"),
        F.format_number(F.col("avg_rating"), 1).alias("avg_rating_text"),
        F.date_format("window_start", "MMM dd").alias("window_start_text"),
        F.date_format("window_end", "MMM dd, yyyy").alias("window_end_text"),
        body.alias("text_body"), F.coalesce("quotes", F.array()).cast("array<string>").alias("quotes"),
        F.coalesce("ideas", F.array()).cast("array<string>").alias("ideas"),
        F.when(listed.isNull(), missing).otherwise(listed).alias("to"),
        F.coalesce(F.array_join("recipients.cc", ", "), F.lit("")).alias("cc"),
        F.coalesce(F.array_join("recipients.bcc", ", "), F.lit("")).alias("bcc"))


def summary_document(header: DataFrame, themes: DataFrame, quotes: DataFrame, actions: DataFrame,
                     audiences: DataFrame, metrics: DataFrame) -> DataFrame:
    """One nested row per run: window, stats, themes, quotes, ideas, audiences, metrics."""
    out = header.select(
        "run_id", F.col("product_key").alias("product"),
        F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end"),
                 window_weeks(F.col("window_start"), F.col("window_end")).alias("weeks")).alias("window"),
        F.struct(F.col("total_reviews"), round2_or_zero(F.col("avg_rating")).alias("avg_rating")).alias("stats"))
    for items, order, cols, name in (
            (themes, "rank", ("rank", "label", "description", "sentiment", "size"), "top_themes"),
            (quotes, "quote_rank", ("text", "rating", "source"), "quotes"),
            (actions, "item", ("title", "description"), "action_ideas"),
            (audiences, "item", ("audience", "value"), "what_this_solves")):
        out = out.join(_lines(items, order, F.struct(*cols), name), "run_id", "left")
    m = metrics.select("run_id", F.struct("total_tokens", "llm_cost_usd", "llm_calls", "retries").alias("metrics"))
    return out.join(m, "run_id", "left")


def served_report(latest: DataFrame, header: DataFrame, themes: DataFrame, quotes: DataFrame,
                  registry: DataFrame) -> DataFrame:
    """J6 (F8, J3, T5): the newest successful run with its product's display name, status
    and window, and one row for each whole theme (by rank) and quote (in order).

    latest: (run_id, status, updated_at); registry: (key, display_name).
    """
    run = recent_runs(latest, 1, successful_only=True).select("run_id", "status")
    none = F.lit(None)
    items = themes.select("run_id", F.lit("theme").alias("kind"), F.col("rank").cast("int").alias("ord"),
                          F.col("label").alias("text"), "description", "sentiment",
                          F.col("size").alias("review_count"), none.cast("int").alias("rating"),
                          none.cast("string").alias("source")).unionByName(
        quotes.select("run_id", F.lit("quote").alias("kind"), F.col("ord").cast("int").alias("ord"), "text",
                      none.cast("string").alias("description"), none.cast("string").alias("sentiment"),
                      none.cast("long").alias("review_count"), "rating", "source"))
    h = with_product(header.drop("display").join(run, "run_id"), registry)
    return h.join(items, "run_id").select(
        "run_id", F.col("display").alias("product"), "iso_week", "status",
        F.col("window_start").cast("string").alias("window_start"),
        F.col("window_end").cast("string").alias("window_end"), "kind", "ord", "text", "description",
        "sentiment", "review_count", "rating", "source")


def undelivered(due: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(product, iso_week, channel) rows not yet delivered (anti join)."""
    return due.join(deliveries, ["product_key", "iso_week", "channel"], "left_anti")


def delivered_by_text(due: DataFrame, docs: DataFrame) -> DataFrame:
    """J8, document form: a report counts as delivered when its anchor occurs
    in the product's document text (equality on product, contains residual)."""
    d = docs.select(F.col("product_key").alias("d_product"), "doc_text")
    cond = [F.col("product_key") == F.col("d_product"),
            F.col("doc_text").contains(anchor(F.col("product_key"), F.col("iso_week")))]
    return due.join(d, cond, "left_semi")
