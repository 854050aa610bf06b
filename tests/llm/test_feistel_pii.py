"""Operator 5 against a plain implementation, and its permutations over whole formats."""

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from revwise.llm import feistel_pii as P

# Java's possessive quantifiers are read alike by Python from 3.11 on.
PATTERN = re.compile(P.PATTERN.replace(r"\1", r"(?:[ -])"))


def permute(values, radices, kind, key=P.KEY):
    half = len(values) // 2
    side = [list(values[:half]), list(values[half:])]
    radix = [radices[:half], radices[half:]]
    for n in range(P.ROUNDS):
        mine, other = (0, 1) if n % 2 == 0 else (1, 0)
        seen = ",".join(map(str, side[other]))
        side[mine] = [(x + int(hashlib.sha256(f"{key}|{kind}|{n}|{seen}|{i}".encode()).hexdigest()[:12], 16)) % r
                      for i, (x, r) in enumerate(zip(side[mine], radix[mine], strict=True))]
    return side[0] + side[1]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def refill(shape, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), shape)


def digit_pseudonym(digits, kind):
    return "".join(map(str, permute([int(c) for c in digits], [10] * len(digits), kind)))


def pseudonym(m):
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        name, domain = m.split("@")
        low = [97 if "a" <= c <= "z" else 65 if "A" <= c <= "Z" else 48 if "0" <= c <= "9" else ord(c) for c in name]
        radix = [10 if x == 48 else 26 if x in (65, 97) else 1 for x in low]
        new = permute([ord(c) - x for c, x in zip(name, low, strict=True)], radix, "email")
        return "".join(chr(x + v) for x, v in zip(low, new, strict=True)) + "@" + domain
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d([./])\d\d\1\d{4}", m):
        y, mo, d = (m[:4], m[5:7], m[8:]) if m[4] == "-" else (m[6:], m[3:5], m[:2])
        first = datetime.date(1900, 1, 1)
        try:
            n = (datetime.date(int(y), int(mo), int(d)) - first).days
        except ValueError:
            return m
        a, b = permute([n // P._DAYS[1], n % P._DAYS[1]], list(P._DAYS), "date")
        new = first + datetime.timedelta(a * P._DAYS[1] + b)
        return new.isoformat() if m[4] == "-" else new.strftime(f"%d{m[2]}%m{m[2]}%Y")
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        a, g, s = permute([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn")
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        return ".".join(map(str, permute([int(x) for x in m.split(".")], [256] * 4, "ipv4")))
    if re.fullmatch(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}", m):
        if luhn(digits):
            return m
        body = digits[0] + digit_pseudonym(digits[1:-1], "card")
        return refill(m, body + str(-luhn(body + "0") % 10))
    fixed = 0 if len(digits) == 10 else 1 if len(digits) == 11 and digits[0] == "1" else 2
    return refill(m, digits[:fixed] + digit_pseudonym(digits[fixed:], "phone"))


def plain(text):
    if text is None:
        return None, 0
    found = [m[0] for m in PATTERN.finditer(text)]
    return PATTERN.sub(lambda m: pseudonym(m[0]), text), sum(pseudonym(m) != m for m in found)


CASES = [
    "card 4111111111111111, 4111-1111-1111-1111 and 4111 1111 1111 1111 are one; 4111111111111112 is none",
    "call +1 (743) 555-3824 or 743-555-3824, (743) 555-3824, 1 743 555 3824, +442071838750",
    "from 10.0.0.1 and 255.255.255.255, not 256.1.1.1 nor 1.2.3.4.5 nor v1.2",
    "born 1984-02-29, 29.02.1984 or 29/02/1984; not 1983-02-29 and not 1984-13-01",
    "ssn 123-45-6789, 001-01-0001 and 899-99-9999; not 000-12-3456, 666-12-3456, 123-00-4567",
    "Mail John.Doe+x9@mail2.example.com, (a@b.co) JOHN@EX.ORG. not a@b nor @x.com",
    "4111111111111111$$$ ###+1 (523) 555-1055%%% lly.00@mail8.example.com&&& 4111111111111111",
    "no numbers at all", "", "12345 2024 1,000 3.14", "4465758382889437 4111111111111111",
    "x" * 50_000 + " 4111111111111111 " + "9" * 50_000 + " a." * 5_000 + "b@c.de",
]


def test_cases_against_plain_implementation(spark):
    rows = [(k, t, k) for k, t in enumerate([*CASES, None, CASES[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int").withColumn("n_pseudonyms", F.lit("clash"))
    out = P.pseudonymize(df)
    assert out.columns == ["doc_id", "text", "found", "n_pseudonyms"]
    got = {r["doc_id"]: (r["text"], r["n_pseudonyms"]) for r in out.collect()}
    for k, t, _ in rows:
        assert got[k] == plain(t), t
    card = re.findall(r"(?:\d[ -]?){15}\d", got[0][0])
    assert len({re.sub("[ -]", "", c) for c in card[:3]}) == 1 and luhn(re.sub("[ -]", "", card[0])) == 0
    assert card[3] == "4111111111111112"
    phones = {re.sub("[^0-9]", "", p)[-10:] for p in re.split("call | or |, ", got[1][0])[1:5]}
    assert len(phones) == 1 and "7435553824" not in phones
    dates = re.findall(r"\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}", got[3][0])
    assert dates[0] == "-".join(reversed(dates[1].split("."))) == "-".join(reversed(dates[2].split("/")))
    assert P.pseudonymize(df.limit(0)).count() == 0


def test_permutations_reach_their_format_once(spark):
    ints = spark.range(1000).select(F.format_string("%03d", "id").alias("d"))
    out = ints.select(P._permuted_digits(F.col("d"), "t", "k").alias("d")).collect()
    assert sorted(r["d"] for r in out) == [f"{k:03d}" for k in range(1000)]
    days = spark.range(3000).select(F.expr("cast(date_add(date'1999-01-01', cast(id as int)) as string)").alias("d"))
    out = [r["d"] for r in days.select(P._date(F.col("d"), "k").alias("d")).collect()]
    assert len(set(out)) == 3000 and all("1900-01-01" <= d <= "2099-12-31" for d in out)


def test_query_against_plain_implementation(spark):
    from revwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df = QUERIES["op5_feistel_pseudonyms"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    rows = df.collect()
    assert len(rows) == len(texts) and sum(r["n_pseudonyms"] for r in rows) > 5
    assert all((r["text"], r["n_pseudonyms"]) == plain(texts[r["doc_id"]]) for r in rows)
