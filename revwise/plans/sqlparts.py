"""SQL (DuckDB dialect) fragments shared by the oracle statements.

The regular expressions are the very strings the Spark side uses (they are
written so that Java and RE2 read them alike).
"""

from __future__ import annotations

from revwise.functions.text import EMOJI_CLASS, FIRST_PASS, STRICT_PASS, WS_CLASS, MASK_TOKENS


def mask_sql(expr: str, strict: bool = False) -> str:
    pats = STRICT_PASS if strict else FIRST_PASS
    for p, tok in zip(pats, MASK_TOKENS):
        expr = f"regexp_replace({expr}, '{p}', '{tok}', 'g')"
    return expr


def word_count_sql(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '[^{WS_CLASS}]+')) AS INTEGER)"


def not_emoji_only_sql(expr: str) -> str:
    return f"regexp_matches({expr}, '[^{EMOJI_CLASS}{WS_CLASS}]')"


def language_ok_sql(expr: str) -> str:
    return f"(coalesce({expr}, '') = '' OR lower({expr}) LIKE 'en%')"


def valid_sql(body: str = "body", lang: str = "language") -> str:
    return (f"({language_ok_sql(lang)} AND {word_count_sql(body)} >= 3 "
            f"AND {not_emoji_only_sql(body)})")


def collapse_sql(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '[{WS_CLASS}]+', ' ', 'g'), '^ | $', '', 'g')"


def iso_week_sql(ts: str) -> str:
    return f"strftime(CAST({ts} + INTERVAL 330 MINUTE AS DATE), '%G-W%V')"


def ts_text_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"
