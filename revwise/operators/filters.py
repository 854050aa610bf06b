"""Ingestion filters and row checks.

All predicates are native expressions; the window predicate on ``posted_at``
reaches the parquet scan as a pushed filter when the input is a scan.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revwise.functions.text import ISO_WEEK_PATTERN, IST_OFFSET_MINUTES, at_least_words, has_non_emoji

SOURCES = ("appstore", "playstore")
MIN_WORDS = 3
MIN_CHARS = 20


def since_of(now: str | dt.datetime, weeks: int) -> dt.datetime:
    """Start of the rolling window; ``now`` is always an argument."""
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    return now - dt.timedelta(weeks=weeks)


def in_window(posted_at: Column, now: str | dt.datetime, weeks: int) -> Column:
    return posted_at >= F.lit(since_of(now, weeks)).cast("timestamp_ntz")


def window_filter(reviews: DataFrame, now: str | dt.datetime, weeks: int = 10) -> DataFrame:
    """keep rows posted at or after ``now − weeks``."""
    return reviews.filter(in_window(F.col("posted_at"), now, weeks))


def window_of_week(week: str, weeks: int = 10) -> tuple[dt.datetime, dt.datetime]:
    """The UTC window [start, end) of ``weeks`` weeks that ends with the ISO week ``YYYY-Www`` (Sunday, India time)."""
    m = re.fullmatch(ISO_WEEK_PATTERN, week)
    if not m:
        raise ValueError(f"not an ISO week: {week!r}")
    monday = dt.datetime.combine(dt.date.fromisocalendar(int(m[1]), int(m[2]), 1), dt.time())
    end = monday + dt.timedelta(weeks=1) - dt.timedelta(minutes=IST_OFFSET_MINUTES)
    return end - dt.timedelta(weeks=weeks), end


def backfill_window(reviews: DataFrame, week: str, weeks: int = 10) -> DataFrame:
    """The reviews of a week's window, for a run of that week whenever it is made."""
    start, end = (F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") for x in window_of_week(week, weeks))
    return reviews.filter((F.col("posted_at") >= start) & (F.col("posted_at") < end))


def language_ok(lang: Column) -> Column:
    """language empty/null or starting with 'en' (any case)."""
    return (F.coalesce(lang, F.lit("")) == "") | F.lower(lang).startswith("en")


def enough_words(body: Column) -> Column:
    """at least three whitespace tokens."""
    return at_least_words(body, MIN_WORDS)


def not_emoji_only(body: Column) -> Column:
    """reject text that is only emoji and blanks."""
    return has_non_emoji(body)


def is_valid_review(body: Column, lang: Column) -> Column:
    return language_ok(lang) & enough_words(body) & not_emoji_only(body)


def valid_reviews(reviews: DataFrame) -> DataFrame:
    """F2–F4 together."""
    return reviews.filter(is_valid_review(F.col("body"), F.col("language")))


def min_chars(reviews: DataFrame, n: int = MIN_CHARS) -> DataFrame:
    """F5 (documented, off by default in the batch): minimum body length."""
    return reviews.filter(F.length("body") >= n)


# Rule order for F6/F7; the first failing rule is the row's reason.
def _rules() -> list[tuple[str, Column]]:
    return [
        ("bad_source", ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))),
        ("null_product", F.col("product_key").isNull()),
        ("null_external_id", F.col("external_id").isNull()),
        ("null_body", F.col("body").isNull()),
        ("language", ~language_ok(F.col("language"))),
        ("too_short", ~F.coalesce(enough_words(F.col("body")), F.lit(False))),
        ("emoji_only", ~F.coalesce(not_emoji_only(F.col("body")), F.lit(False))),
    ]


def with_reasons(rows: DataFrame) -> DataFrame:
    """every row with its failing checks (``reasons`` empty when accepted)."""
    rules = _rules()
    arr = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    first = F.lit(None).cast("string")
    for name, c in reversed(rules):
        first = F.when(c, F.lit(name)).otherwise(first)
    return rows.withColumn("reasons", arr).withColumn("first_reason", first)


def rejects(rows: DataFrame) -> DataFrame:
    """rows failing any check, with the reasons."""
    return with_reasons(rows).filter(F.size("reasons") > 0)


def filter_counts(rows: DataFrame) -> DataFrame:
    """count of rows by first failing rule ('accepted' when none fails)."""
    r = with_reasons(rows)
    return (r.groupBy(F.coalesce("first_reason", F.lit("accepted")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))
