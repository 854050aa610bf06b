"""Operator 5, personal data: format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated numbers, dates and mailbox names are replaced by a keyed permutation within
their own format: an equal value has an equal pseudonym in every document, whatever its
punctuation, and different values never share one.

A value is a list of symbols, each with its own radix (a digit: 10, an octet: 256, ...).
The list is cut into two halves; in each of ``ROUNDS`` rounds every symbol of one half is
shifted by a SHA-256 of the key, the kind, the round, its place and the other half, modulo
its radix.  Each round can be undone, so the whole is a permutation of the format.

Kinds: payment cards (13 to 19 digits that pass the Luhn check; the first digit stays and
the check digit is renewed), IPv4 addresses, phone numbers, social security numbers in
their valid ranges, calendar dates from 1900 to 2099 (year-month-day, day.month.year,
day/month/year), and e-mail addresses (letters and digits of the mailbox name; the domain
stays).  Numbers that fail their check stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revwise.llm.common import fresh

ROUNDS = 8
KEY = "rotate-me"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
_END = "(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}"
PHONE = (rf"(?<![0-9A-Za-z+])\+?1[ .-]?\(?[0-9]{{3}}\)?[ .-]?[0-9]{{3}}[ .-][0-9]{{4}}{_END}"
         rf"|(?<![0-9A-Za-z])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_END}"
         rf"|(?<![0-9A-Za-z+])\+[1-9][0-9]{{9,14}}{_END}")
IPV4 = rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"
DATE = (rf"(?<![0-9A-Za-z-]){_YEAR}-{_MONTH}-{_DAY}(?![0-9A-Za-z-])"
        rf"|(?<![0-9A-Za-z./]){_DAY}(?:\.{_MONTH}\.|/{_MONTH}/){_YEAR}{_END}")
SSN = rf"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}(?![0-9A-Za-z-])"
CARD = (rf"(?<![0-9A-Za-z])(?:[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}"
        rf"|[0-9]{{13,19}}){_END}")
PATTERN = f"{EMAIL}|{DATE}|{SSN}|{IPV4}|{PHONE}|{CARD}"

#: Days from 1900-01-01 to 2099-12-31, written as 17 x 4297 so that two symbols number them all.
_DAYS = (17, 4297)


def _ints(values: Column) -> Column:
    return values.cast("array<int>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _chars(text: Column) -> Column:
    return _let(text, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(1))))


def permute(values: Column, radices: Column, kind: str, key: str) -> Column:
    """Keyed permutation of a symbol array; ``radices`` holds each symbol's radix."""
    def shifted(part: Column, radix: Column, other: Column, round_: Column) -> Column:
        message = F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"),
                              F.array_join(other.cast("array<string>"), ","))

        def shift(said: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                digest = F.sha2(F.concat_ws("|", said, i.cast("string")), 256)
                return ((x + F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")) % F.element_at(radix, i + 1)).cast("int")
            return F.transform(part, one)
        return _let(message, shift)

    def rounds(s: Column) -> Column:
        half = F.floor(F.size(s["v"]) / 2).cast("int")
        cut = F.struct(*[part.alias(name) for name, part in (
            ("l", F.slice(s["v"], F.lit(1), half)), ("r", F.slice(s["v"], half + 1, F.size(s["v"]))),
            ("lr", F.slice(s["x"], F.lit(1), half)), ("rr", F.slice(s["x"], half + 1, F.size(s["v"]))))])

        def turn(acc: Column, n: Column) -> Column:
            return F.when(n % 2 == 0, acc.withField("l", shifted(acc["l"], acc["lr"], acc["r"], n))
                          ).otherwise(acc.withField("r", shifted(acc["r"], acc["rr"], acc["l"], n)))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), cut, turn, lambda acc: F.concat(acc["l"], acc["r"]))
    return _let(F.struct(_ints(values).alias("v"), radices.alias("x")), rounds)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted_digits(digits: Column, kind: str, key: str) -> Column:
    def run(values: Column) -> Column:
        done = permute(values, F.transform(values, lambda _: F.lit(10)), kind, key)
        return F.array_join(done.cast("array<string>"), "")
    return _let(_ints(_chars(digits)), run)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by those of ``digits``."""
    def run(new: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            number = c.between("0", "9")
            return F.struct(F.concat(acc["s"], F.when(number, F.substring(new, acc["k"], F.lit(1))).otherwise(c)).alias("s"),
                            (acc["k"] + number.cast("int")).alias("k"))
        return F.aggregate(_chars(shape), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step, lambda acc: acc["s"])
    return _let(digits, run)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10; the last digit counts once."""
    counted = F.transform(F.reverse(_ints(_chars(digits))), lambda d, i: F.when(i % 2 == 0, d).otherwise(
        d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(counted, F.lit(0), lambda a, x: a + x) % 10


def _card(found: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 1), _permuted_digits(
            F.substring(digits, F.lit(2), F.length(digits) - 2), "card", key))
        return _let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
    return _let(_digits(found), lambda d: F.when(_luhn(d) == 0, _refill(found, new(d))).otherwise(found))


def _phone(found: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        fixed = F.when(F.length(d) == 10, 0).when((F.length(d) == 11) & d.startswith("1"), 1).otherwise(2)
        return _let(fixed, lambda n: F.concat(F.substring(d, F.lit(1), n), _permuted_digits(
            F.substring(d, n + 1, F.length(d)), "phone", key)))
    return _refill(found, _let(_digits(found), new))


def _ipv4(found: Column, key: str) -> Column:
    octets = _ints(F.split(found, r"\."))
    return F.array_join(permute(octets, F.array(*[F.lit(256)] * 4), "ipv4", key).cast("array<string>"), ".")


def _ssn(found: Column, key: str) -> Column:
    def new(n: Column) -> Column:
        place = F.array(n[0] - 1 - (n[0] > 666).cast("int"), n[1] - 1, n[2] - 1)
        return _let(permute(place, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key), lambda d: F.format_string(
            "%03d-%02d-%04d", d[0] + 1 + (d[0] >= 665).cast("int"), d[1] + 1, d[2] + 1))
    return _let(_ints(F.split(found, "-")), new)


def _date(found: Column, key: str) -> Column:
    first = F.to_date(F.lit("1900-01-01"))
    iso = found.rlike("^[0-9]{4}-")
    day = F.when(iso, F.try_to_date(found, "yyyy-MM-dd")).otherwise(
        F.try_to_date(F.translate(found, "/", "."), "dd.MM.yyyy"))

    def new(day: Column) -> Column:
        number = F.datediff(day, first)
        done = permute(F.array(F.floor(number / _DAYS[1]).cast("int"), (number % _DAYS[1]).cast("int")),
                       F.array(*map(F.lit, _DAYS)), "date", key)
        return _let(_let(done, lambda d: F.date_add(first, d[0] * _DAYS[1] + d[1])), lambda d: F.when(
            iso, F.date_format(d, "yyyy-MM-dd")).otherwise(
                F.replace(F.date_format(d, "dd.MM.yyyy"), F.lit("."), F.substring(found, 3, 1))))
    return _let(day, lambda d: F.when(d.isNull(), found).otherwise(new(d)))  # the 31st of a shorter month is no date


def _email(found: Column, key: str) -> Column:
    def parts(c: Column) -> Column:
        """First code of the character's class, and the size of the class."""
        return (F.when(c.between(97, 122), F.struct(F.lit(97).alias("low"), F.lit(26).alias("radix")))
                .when(c.between(65, 90), F.struct(F.lit(65).alias("low"), F.lit(26).alias("radix")))
                .when(c.between(48, 57), F.struct(F.lit(48).alias("low"), F.lit(10).alias("radix")))
                .otherwise(F.struct(c.alias("low"), F.lit(1).alias("radix"))))

    def new(codes: Column) -> Column:
        return _let(F.transform(codes, parts), lambda p: F.array_join(F.zip_with(
            p, permute(F.zip_with(codes, p, lambda c, q: c - q["low"]), F.transform(p, lambda q: q["radix"]), "email", key),
            lambda q, v: F.char(q["low"] + v)), ""))
    name = F.transform(_chars(F.substring_index(found, "@", 1)), lambda c: F.ascii(c))
    return F.concat(_let(name, new), F.lit("@"), F.substring_index(found, "@", -1))


def pseudonym(found: Column, key: str) -> Column:
    """Pseudonym of one string that ``PATTERN`` has matched."""
    return (F.when(F.contains(found, F.lit("@")), _email(found, key))
            .when(found.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})$"), _date(found, key))
            .when(found.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(found, key))
            .when(found.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), _ipv4(found, key))
            .when(found.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), _card(found, key))
            .otherwise(_phone(found, key)))


def pseudonymize(docs: DataFrame, text: str = "text", count: str = "n_pseudonyms", key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` rewritten and one more column, the number of values replaced.

    Whole texts of any length are searched.  A null text stays null with 0 replacements,
    an empty one stays empty; repeated rows get equal texts; an empty table gives an empty
    result.  All other columns stay; one named like ``count`` is replaced.  Equal values
    have equal pseudonyms under an equal ``key``; keep the key secret.
    """
    keep = [c for c in docs.columns if c not in (text, count)]
    t = F.col(f"`{text}`")
    was, found, new = fresh(docs.columns, "was", "found", "new")
    none = F.array().cast("array<string>")
    has = t.rlike("[0-9@]")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias(was),
                       F.when(has, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(none).alias(found))
    rows = rows.withColumn(new, F.transform(found, lambda m: pseudonym(m, key)))
    between = F.split(F.col(was), PATTERN, -1)
    joined = F.concat(between[0], F.array_join(F.zip_with(
        F.col(new), F.slice(between, F.lit(2), F.size(F.col(new))), lambda m, g: F.concat(m, g)), ""))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    return rows.select(*[F.col(f"`{c}`") for c in keep],
                       F.when(F.size(found) > 0, joined).otherwise(F.col(was)).alias(text),
                       F.greatest(F.lit(0), changed).cast("long").alias(count)).select(
                           *[F.col(f"`{c}`") for c in dict.fromkeys([*docs.columns, count])])
