"""Scalar functions and filters on inline edge rows (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from revwise.functions import text as T
from revwise.operators import filters as FL


def one(spark, value, fn, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_first_mask(spark):
    cases = {
        "mail john@test.com": "mail [EMAIL]",
        "call 9876543210": "call [PHONE]",
        "1234 5678 9012": "[AADHAAR]",
        "123456789012": "[PHONE]",
        "+91-9876543210": "+91-[PHONE]",
        "user+tag@sub.domain.co.in": "user+[EMAIL]",
        "great app, love it": "great app, love it",
    }
    for src, want in cases.items():
        assert one(spark, src, T.mask_pii) == want, src
    assert one(spark, None, T.mask_pii) is None


def test_strict_mask(spark):
    assert one(spark, "+91 9876543210", T.mask_pii_strict) == "+91 [PHONE]"
    assert one(spark, "5876543210", T.mask_pii_strict) == "5876543210"
    assert one(spark, "1234-5678-9012", T.mask_pii_strict) == "[AADHAAR]"
    assert one(spark, "123456789012", T.mask_pii_strict) == "[AADHAAR]"
    assert one(spark, "user+tag@sub.domain.co.in", T.mask_pii_strict) == "[EMAIL]"


def test_word_and_emoji_filters(spark):
    rows = [("one two three", True), ("one two", False), ("   ", False),
            ("😀 😀 😀", False), ("nice app 😀", True), ("™ © ®", True)]
    df = spark.createDataFrame(rows, "body string, want boolean")
    got = df.select((FL.enough_words(F.col("body")) & FL.not_emoji_only(F.col("body"))).alias("ok"),
                    "want").collect()
    assert [r.ok for r in got] == [r.want for r in got]


def test_language_rule(spark):
    df = spark.createDataFrame([("en",), ("EN-in",), ("",), (None,), ("fr",)], "lang string")
    got = [r.ok for r in df.select(FL.language_ok(F.col("lang")).alias("ok")).collect()]
    assert got == [True, True, True, True, False]


def test_iso_week_in_india_time(spark):
    df = spark.createDataFrame([("2024-12-30 00:00:00",), ("2027-01-01 00:00:00",),
                                ("2024-01-07 19:00:00",)], "t string")
    got = [r.w for r in df.select(T.iso_week(F.col("t").cast("timestamp_ntz")).alias("w")).collect()]
    assert got == ["2025-W01", "2026-W53", "2024-W02"]


def test_iso_week_parse_rejects(spark):
    df = spark.createDataFrame([("2026-W17",), ("2026-15",), ("20260417",)], "w string")
    y, w = T.parse_iso_week(F.col("w"))
    got = [(r.y, r.k) for r in df.select(y.alias("y"), w.alias("k")).collect()]
    assert got == [(2026, 17), (None, None), (None, None)]


def test_run_id(spark):
    df = spark.createDataFrame([("groww", "2026-W17"), ("groww", "2026-W18")], "p string, w string")
    ids = [r.i for r in df.select(T.sha1_id(F.col("p"), F.col("w")).alias("i")).collect()]
    assert ids[0].startswith("f6c8e2b7") and len(ids[0]) == 40 and ids[0] != ids[1]


def test_subject_cut(spark):
    df = spark.createDataFrame([("P", "2026-W01", "x" * 300), ("P", "2026-W01", None)],
                               "d string, w string, t string")
    got = [r.s for r in df.select(T.subject_line(F.col("d"), F.col("w"), F.col("t")).alias("s"))
           .collect()]
    assert len(got[0]) == 200 and got[0].endswith("...")
    assert got[1].endswith("Review Pulse")


def test_fallback_id_uses_none_for_missing_date(spark):
    df = spark.createDataFrame([(None, None, None, "hello world body text")],
                               "i string, a string, d string, b string")
    got = df.select(T.fallback_external_id(F.col("i"), F.col("a"), F.col("d"), F.col("b"))
                    .alias("x")).first().x
    import hashlib
    assert got == hashlib.sha1("AnonymousNonehello world body tex".encode()).hexdigest()


def test_parse_date_forms(spark):
    from revwise.sources.feeds import parse_date
    df = spark.createDataFrame([("2024-05-01T10:00:00Z",), ("2024-05-01T10:00:00+05:30",),
                                ("2024-05-01 10:00:00",), ("not a date",)], "t string")
    ts, flag = parse_date(F.col("t"), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    got = [(str(r.ts), r.flag) for r in df.select(ts.alias("ts"), flag.alias("flag")).collect()]
    assert got == [("2024-05-01 10:00:00", False), ("2024-05-01 04:30:00", False),
                   ("2024-05-01 10:00:00", False), ("2024-06-01 00:00:00", True)]


def test_window_filter_is_inclusive(spark):
    import datetime as dt
    rows = [(dt.datetime(2024, 2, 2),), (dt.datetime(2024, 2, 1, 23, 59),)]
    df = spark.createDataFrame(rows, "posted_at timestamp_ntz")
    got = FL.window_filter(df, "2024-03-01 00:00:00", 4).collect()
    assert [str(r.posted_at) for r in got] == ["2024-02-02 00:00:00"]


def test_parse_date_ignores_session_zone(spark):
    from revwise.sources.feeds import parse_date
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([("2024-05-01T10:00:00Z",), ("2024-05-01 10:00:00",)], "t string")
        ts, _ = parse_date(F.col("t"), F.lit(None).cast("timestamp_ntz"))
        assert [str(r.ts) for r in df.select(ts.alias("ts")).collect()] == ["2024-05-01 10:00:00"] * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_rounding_equals_python_on_ties_and_near_ties(spark):
    import random
    rng = random.Random(3)
    values = [0.0, -0.0, 2.675, 1.005, 3.125, -3.125, 0.285, 1e300, -1e17, 2.0 ** 44 + 0.125, 5e-324, 0.005, 0.015]
    values += [k / 8 for k in range(-400, 400)] + [k / 200 for k in range(-2000, 2000)] + [k / 1000 for k in range(0, 9000, 5)]
    values += [rng.uniform(-6, 6) for _ in range(200_000)] + [rng.randint(1, 500) / rng.randint(1, 200) for _ in range(100_000)]
    values += [rng.uniform(0, 2.0 ** 40) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(8)
    for digits in (0, 2, 5):
        limit = 2.0 ** 51 / 10 ** digits
        rows = df.select("x", T.round_half_even(F.col("x"), digits).alias("y")).collect()
        assert all(r["y"] == r["x"] for r in rows if abs(r["x"]) >= limit)
        rows = [r for r in rows if abs(r["x"]) < limit]
        assert len(rows) > 300_000
        assert [(r["x"], r["y"]) for r in rows if r["y"] != round(r["x"], digits)] == []
    odd = spark.sql("select * from values (cast(null as double)), (double('nan')), (double('inf')) as t(x)")
    assert [str(r["y"]) for r in odd.select(T.round_half_even(F.col("x")).alias("y")).collect()] == ["None", "nan", "inf"]
    assert odd.limit(1).select(T.round2_or_zero(F.col("x")).alias("y")).first()["y"] == 0.0


def test_window_of_a_week_ends_with_its_sunday_in_india():
    import datetime as dt

    import pytest
    assert FL.window_of_week("2024-W04", 4) == (dt.datetime(2023, 12, 31, 18, 30), dt.datetime(2024, 1, 28, 18, 30))
    assert FL.window_of_week("2026-W53", 1)[1] == dt.datetime(2027, 1, 3, 18, 30)
    for bad in ("2024-4", "W04", "2024-W04 "):
        with pytest.raises(ValueError, match="ISO week"):
            FL.window_of_week(bad)


def test_utf16_offsets(spark):
    from revwise.operators.report import utf16_length
    texts = ["", "abc", "a😀★—é", "👨‍👩‍👧", "日本"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", utf16_length(F.col("t")).alias("n")).collect()
    assert all(r["n"] == len(r["t"].encode("utf-16-le")) // 2 for r in got)
