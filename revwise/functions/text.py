"""Column expressions for review text: masks, ids, dates, normalisation.

All of these are built-in Spark SQL functions, so they stay inside
whole-stage codegen.  Each function takes and returns a ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
#
# First masking pass (applied in this order: e-mail, phone, Aadhaar):
#   e-mail   [\w\.-]+@[\w\.-]+\.\w+
#   phone    \+?\d{10,14}
#   Aadhaar  \b\d{4}\s?\d{4}\s?\d{4}\b
# Second, stricter pass before text is shown to a model (same order):
#   e-mail   \b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b
#   phone    \b(?:\+91[\s-]?)?[6-9]\d{9}\b
#   Aadhaar  \b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b
# Replacement tokens: [EMAIL] [PHONE] [AADHAAR]
# ---------------------------------------------------------------------------
MASK_TOKENS = ("[EMAIL]", "[PHONE]", "[AADHAAR]")

# Whitespace as Python's str.split() and Unicode \s see it (White_Space plus
# the four information separators U+001C..U+001F).
WS_CLASS = (r"\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

# Python's Unicode classes spelled out so that Java and RE2 (DuckDB) read the
# patterns the same way: \w → [\p{L}\p{N}_], \d → \p{Nd}, \s → [WS_CLASS].
_W = r"[\p{L}\p{N}_]"
_D = r"\p{Nd}"
_S = f"[{WS_CLASS}]"
_S_DASH = f"[{WS_CLASS}-]"

FIRST_PASS = (
    rf"[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+\.{_W}+",
    rf"\+?{_D}{{10,14}}",
    rf"\b{_D}{{4}}{_S}?{_D}{{4}}{_S}?{_D}{{4}}\b",
)

STRICT_PASS = (
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    rf"\b(?:\+91{_S_DASH}?)?[6-9]{_D}{{9}}\b",
    rf"\b{_D}{{4}}{_S_DASH}?{_D}{{4}}{_S_DASH}?{_D}{{4}}\b",
)

# Emoji code point ranges (pictographs, symbols, dingbats, arrows block,
# variation selector 16, zero-width joiner, tag characters).
EMOJI_CLASS = (r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}"
               r"\x{FE0F}\x{200D}\x{E0020}-\x{E007F}")

IST_OFFSET_MINUTES = 330  # ISO weeks are taken in India time, UTC+05:30


def _mask(c: Column, patterns: tuple[str, str, str]) -> Column:
    """The three passes, for texts that can match at all (an '@' or a digit); each pass
    occurs once in the plan."""
    masked = c
    for pat, tok in zip(patterns, MASK_TOKENS):
        masked = F.regexp_replace(masked, pat, tok)
    return F.when(c.rlike(r"[@\p{Nd}]"), masked).otherwise(c)


def mask_pii(c: Column) -> Column:
    """First masking pass; null stays null."""
    return _mask(c, FIRST_PASS)


def mask_pii_strict(c: Column) -> Column:
    """Stricter pass used on text that goes to a model."""
    return _mask(c, STRICT_PASS)


def word_count(c: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(c, F.lit(f"[^{WS_CLASS}]+"))


def at_least_words(c: Column, n: int) -> Column:
    """True when the text has at least n whitespace-separated tokens.  The
    pattern is anchored and possessive, so it reads the text once and stops
    at the n-th token instead of counting the whole text."""
    return c.rlike(f"^[{WS_CLASS}]*+(?:[^{WS_CLASS}]++[{WS_CLASS}]++){{{n - 1}}}[^{WS_CLASS}]")


def has_non_emoji(c: Column) -> Column:
    """true when the text holds something besides emoji and blanks."""
    return c.rlike(f"[^{EMOJI_CLASS}{WS_CLASS}]")


def collapse_blanks(c: Column) -> Column:
    """Python's ``' '.join(s.split())``."""
    return F.regexp_replace(F.regexp_replace(c, f"[{WS_CLASS}]+", " "), r"^ | $", "")


def normalise(c: Column) -> Column:
    """C9 without NFKC: collapse blanks, lower-case (see ``nfkc`` for the rest)."""
    return F.lower(collapse_blanks(c))


def sha1_id(*parts: Column) -> Column:
    """sha1 hex of the concatenated parts."""
    return F.sha1(F.concat(*parts))


def fallback_external_id(ext_id: Column, author: Column, date_text: Column, body: Column) -> Column:
    """C4: given id, else sha1(author or 'Anonymous' ‖ date text or 'None' ‖ body[:20])."""
    return F.coalesce(
        ext_id,
        F.sha1(F.concat(F.coalesce(author, F.lit("Anonymous")),
                        F.coalesce(date_text, F.lit("None")),
                        F.coalesce(F.substring(body, 1, 20), F.lit("")))),
    )


def text_cache_key(c: Column) -> Column:
    """sha1 of the blank-collapsed text."""
    return F.sha1(collapse_blanks(c))


def to_ist(ts: Column) -> Column:
    return ts + F.expr(f"INTERVAL {IST_OFFSET_MINUTES} MINUTES")


def iso_week(ts: Column) -> Column:
    """C7: 'YYYY-Www' of a UTC timestamp, taken in India time."""
    local = F.to_date(to_ist(ts))
    return F.concat(F.extract(F.lit("YEAROFWEEK"), local).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(local).cast("string"), 2, "0"))


ISO_WEEK_PATTERN = r"^([0-9]+)-W([0-9]+)$"


def parse_iso_week(c: Column) -> tuple[Column, Column]:
    """C7 parse: (year, week) ints, both null when the text is malformed."""
    ok = c.rlike(ISO_WEEK_PATTERN)
    year = F.when(ok, F.regexp_extract(c, ISO_WEEK_PATTERN, 1).cast("int"))
    week = F.when(ok, F.regexp_extract(c, ISO_WEEK_PATTERN, 2).cast("int"))
    return year, week


def window_weeks(start: Column, end: Column) -> Column:
    """Whole weeks between two dates."""
    return F.floor(F.datediff(end, start) / 7).cast("int")


# Fixed values.  Mail subject: "[Weekly Pulse] <display name> — <ISO week> — <top theme label>",
# "Review Pulse" when there is no theme; over 200 characters keeps 197 plus "...".
SUBJECT_PREFIX = "[Weekly Pulse] "
SUBJECT_SEP = " — "
SUBJECT_NO_THEME = "Review Pulse"


def subject_line(display: Column, week: Column, top_theme: Column) -> Column:
    """Mail subject line."""
    s = F.concat(F.lit(SUBJECT_PREFIX), display, F.lit(SUBJECT_SEP), week, F.lit(SUBJECT_SEP),
                 F.coalesce(top_theme, F.lit(SUBJECT_NO_THEME)))
    return F.when(F.length(s) > 200, F.concat(F.substring(s, 1, 197), F.lit("..."))).otherwise(s)


def sentiment_or_mixed(c: Column) -> Column:
    """C11: sentiment outside the three words becomes 'mixed'."""
    return F.when(c.isin("negative", "mixed", "positive"), c).otherwise(F.lit("mixed"))


def round_half_even(c: Column, digits: int = 2) -> Column:
    """A double rounded as its exact binary value demands: to the nearer decimal, ties to the
    even digit.  (``round`` rounds the shortest decimal text of the double half up, so it
    differs on ties and on values such as 1.005 that lie below the tie they look like.)

    x is compared with the midpoint (2k + 1) / (2 * 10^digits) of its two candidates as
    x * 2^(digits + 1) * 5^digits against 2k + 1: powers of two are exact, and the product with
    5^digits is split into two exact parts.  From |x| * 10^digits = 2^51 on, where 2k + 1 is no
    longer exact, x is left as it is (for ratings and two digits: from 2 * 10^13 on).
    """
    if not 0 <= digits <= 6:
        raise ValueError("digits must be from 0 to 6")
    x = F.abs(c.cast("double"))
    scaled = x * F.lit(float(2 ** (digits + 1)))
    split = scaled * F.lit(float(2 ** 27 + 1))
    high = split - (split - scaled)          # the upper 26 bits; the rest has as many
    low = scaled - high
    k = F.floor(x * F.lit(float(10 ** digits))).cast("double")
    above = (high * F.lit(float(5 ** digits)) - (k * 2 + 1)) + low * F.lit(float(5 ** digits))
    up = F.when(above > 0, 1.0).when(above < 0, 0.0).otherwise(F.pmod(k, F.lit(2.0)))
    out = (k + up) / F.lit(float(10 ** digits)) * F.when(c < 0, -1.0).otherwise(1.0)
    return F.when(x < float(2 ** 51) / 10 ** digits, out).otherwise(c.cast("double"))


def round2_or_zero(c: Column) -> Column:
    """Round to 2 digits; null or zero mean gives 0.0."""
    return F.coalesce(round_half_even(c, 2), F.lit(0.0))
