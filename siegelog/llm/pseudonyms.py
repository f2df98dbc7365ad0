"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass the checks of their kind are permuted within their
format by a keyed Feistel network, so a card number becomes another valid card
number of the same layout, and equal values stay equal across documents. With
the key the permutation can be undone; without it each kind is a permutation of its
whole domain. E-mail addresses, which are no numbers, become keyed hashes of
the same shape.

A Feistel network takes a value as a pair (a, b) below (M, N) and repeats
(a, b) -> (b, (a + f(b)) mod M), the moduli in turn. Any M and N will do, so
each kind states its domain as a product of two numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# A run of letters and digits is entered at its start only, so that long runs cost no more than short ones.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
# With a code: ten digits as in North America, or groups of any lengths (E.164 allows 15 digits in all).
INTERNATIONAL = r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}([.-])\d{3}[.-]\d{4}(?![\d-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_DAY_ENDS = r"(?![\w/-]|\.\d)"
DATE = rf"(?<![\w/.-])(?:\d{{4}}-\d{{2}}-\d{{2}}(?:(?=T\d{{2}}:)|{_DAY_ENDS})|\d{{4}}/\d{{2}}/\d{{2}}{_DAY_ENDS}|\d{{1,2}}([/.])\d{{1,2}}\1\d{{4}}{_DAY_ENDS})"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
ADDRESS = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
CARD = r"(?<![\w-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-])"
KINDS = {"phone": PHONE, "international": INTERNATIONAL, "ssn": SSN, "date": DATE, "address": ADDRESS, "card": CARD, "iban": IBAN}


def _one_of(patterns: dict[str, str]) -> str:
    """Any of the patterns; each back reference counts the groups of those before."""
    out, groups = [], 0
    for p in patterns.values():
        own = len(re.findall(r"(?<!\\)\((?!\?)", p))
        out.append("(?:" + re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + groups}", p) + ")")  # noqa: B023
        groups += own
    return "|".join(out)


# How they begin rules most places out at once.
NUMBER = "(?=[0-9+(]|[A-Z]{2}[0-9]{2})(?:" + _one_of(KINDS) + ")"

# Dates 1900-01-01 to 2099-12-31 are 73,049 days, 17 times 4,297.
_DAYS = (17, 4297)
# Times a short date is permuted until it is a day that exists: of its range 19 in 20 are.
WALK = 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs in there."""
    return F.transform(F.array(value), use)[0]


@dataclass(frozen=True)
class Cipher:
    """``key`` is the secret; ``inverse`` restores values."""

    key: str
    inverse: bool = False

    def permuted(self, a: Column, b: Column, m: Column | int, n: Column | int, kind: str) -> Column:
        """The pair (a, b) below (m, n), permuted; fields a and b."""
        m, n = (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in (m, n))
        a, b = a.cast("long"), b.cast("long")

        def value(r: Column, x: Column) -> Column:
            text = F.concat_ws("|", F.lit(self.key), F.lit(kind), m.cast("string"), n.cast("string"), r.cast("string"), x.cast("string"))
            return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

        def forward(s: Column, r: Column) -> Column:
            modulus = F.when(r % 2 == 0, m).otherwise(n)
            return F.struct(s["b"].alias("a"), ((s["a"] + value(r, s["b"]) % modulus) % modulus).alias("b"))

        def backward(s: Column, r: Column) -> Column:
            modulus = F.when(r % 2 == 0, m).otherwise(n)
            return F.struct(((s["b"] + modulus - value(r, s["a"]) % modulus) % modulus).alias("a"), s["a"].alias("b"))

        rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if self.inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(rounds, F.struct(a.alias("a"), b.alias("b")), backward if self.inverse else forward)

    def digits(self, text: Column, kind: str) -> Column:
        """A text of 2 to 36 digits, permuted among those of its length."""

        def permuted(x: Column) -> Column:
            a, b = F.substring(x["text"], F.lit(1), x["u"]), F.substring(x["text"], x["u"] + 1, x["v"])
            pair = self.permuted(a, b, x["m"], x["n"], kind)
            return let(
                pair,
                lambda p: F.concat(F.lpad(p["a"].cast("string"), x["u"], F.lit("0")), F.lpad(p["b"].cast("string"), x["v"], F.lit("0"))),
            )

        def halves(t: Column) -> Column:
            u = F.floor(F.length(t) / 2).cast("int")
            v = (F.length(t) - u).cast("int")
            m, n = (F.pow(F.lit(10.0), x).cast("long") for x in (u, v))
            return F.struct(t.alias("text"), u.alias("u"), v.alias("v"), m.alias("m"), n.alias("n"))

        return let(text, lambda t: let(halves(t), permuted))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced in order."""

    def fill(own: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            digit = c.between("0", "9")
            put = F.when(digit, F.substring(own, s["i"], F.lit(1))).otherwise(c)
            return F.struct(F.concat(s["out"], put).alias("out"), (s["i"] + F.when(digit, 1).otherwise(0)).alias("i"))

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
        return F.aggregate(F.split(layout, ""), start, step)["out"]

    return let(digits, fill)


def luhn_sum(digits: Column) -> Column:
    """Of a number with its check digit."""

    def total(own: Column) -> Column:
        def value(i: Column) -> Column:
            d = F.substring(own, F.length(own) - i, F.lit(1)).cast("int")
            doubled = d * 2
            return F.when(i % 2 == 0, d).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(0), F.length(own) - 1), F.lit(0), lambda s, i: s + value(i))

    return let(digits, total)


def _card(m: Column, cipher: Cipher) -> Column:
    """Passes the Luhn check: all digits but the first and the check digit."""

    def replaced(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), cipher.digits(F.substring(d, F.lit(2), F.length(d) - 2), "card"))
        check = lambda x: ((F.lit(10) - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")
        return F.when(luhn_sum(d) % 10 == 0, refilled(m, let(body, lambda x: F.concat(x, check(x))))).otherwise(m)

    return let(digits_of(m), replaced)


def _phone(m: Column, cipher: Cipher) -> Column:
    """The last ten digits; the country code stays. Numbers valid in North America become valid ones."""
    d = digits_of(m)
    code = F.substring(d, F.lit(1), F.length(d) - 10)
    own = F.substring(d, -10, 10)
    valid = own.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    pair = cipher.permuted(F.substring(own, 1, 3).cast("long") - 200, F.substring(own, 4, 7).cast("long") - 2_000_000, 800, 8_000_000, "phone")
    north = F.concat((pair["a"] + 200).cast("string"), (pair["b"] + 2_000_000).cast("string"))
    return refilled(m, F.concat(code, F.when(valid, north).otherwise(cipher.digits(own, "digits"))))


def _international(m: Column, cipher: Cipher) -> Column:
    """All digits but the country code, which is what comes before the first sign between digits, or two digits."""
    lead = F.regexp_extract(m, r"^\+(\d{1,3})(?=\D)", 1)

    def replaced(d: Column) -> Column:
        code = F.when(lead != "", F.length(lead)).otherwise(2)
        own = F.substring(d, code + 1, F.length(d) - code)
        new = F.concat(F.substring(d, F.lit(1), code), cipher.digits(own, "digits"))
        return F.when(F.length(d).between(8, 15), refilled(m, new)).otherwise(m)

    return let(digits_of(m), replaced)


def _rest_97(text: Column) -> Column:
    """A text of digits and capitals, of which A is 10 and Z is 35, modulo 97."""
    letter = lambda c: c.between("A", "Z")
    number = lambda c: F.when(letter(c), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * F.when(letter(c), 100).otherwise(10) + number(c)) % 97)


def _iban(m: Column, cipher: Cipher) -> Column:
    """Passes the check modulo 97: the digits of the account; the country stays, letters too, check digits follow."""

    def replaced(t: Column) -> Column:
        country, body = F.substring(t, 1, 2), F.substring(t, F.lit(5), F.length(t) - 4)
        valid = (_rest_97(F.concat(body, country, F.substring(t, 3, 2))) == 1) & F.length(t).between(15, 34) & (F.length(digits_of(body)) >= 2)

        def account(new: Column) -> Column:
            check = F.lit(98) - _rest_97(F.concat(new, country, F.lit("00")))
            return refilled(m, F.concat(F.lpad(check.cast("string"), 2, "0"), digits_of(new)))

        return F.when(valid, let(refilled(body, cipher.digits(digits_of(body), "iban")), account)).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), replaced)


def _ssn(m: Column, cipher: Cipher) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.split(m, "-")[k].cast("long") for k in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = cipher.permuted(rank, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
    new = pair["a"] + 1 + F.when(pair["a"] >= 665, 1).otherwise(0)
    parts = F.concat_ws(
        "-",
        F.lpad(new.cast("string"), 3, "0"),
        F.lpad((F.floor(pair["b"] / 9999) + 1).cast("string"), 2, "0"),
        F.lpad((pair["b"] % 9999 + 1).cast("string"), 4, "0"),
    )
    return F.when(valid, parts).otherwise(m)


def _date(m: Column, cipher: Cipher) -> Column:
    """Days of 1900 to 2099 that exist: year-month-day, year/month/day, month/day/year, day/month/year and day.month.year.

    A slash date is month/day/year where that can be; other dates with slashes, and those
    with parts of one digit, keep the lengths of their parts (``_short_date``).
    """
    first = F.substring(m, 1, 2)
    two = m.rlike(r"^\d{2}\.\d{2}\.") | (m.rlike(r"^\d{2}/\d{2}/") & (first <= "12"))
    return F.when(two | m.rlike(r"^\d{4}"), _full_date(m, cipher)).otherwise(_short_date(m, cipher))


def _short_date(m: Column, cipher: Cipher) -> Column:
    """Dates whose parts must stay in ranges: of one digit 1 to 9, of two 10 or more, days before a slash over 12.

    The pair (year, month and day) is permuted again until the day exists, which undoes as well.
    """

    def parts(p: Column) -> Column:
        a, b = p[0].cast("int"), p[1].cast("int")
        first_month = m.contains("/") & (a <= 12)
        size = lambda x, y: F.when(first_month, F.length(x)).otherwise(F.length(y))
        day_size, month_size = size(p[1], p[0]), size(p[0], p[1])
        both = m.contains("/") & ~first_month & (month_size == 2)  # a month after a day over 12 may begin with 0
        low = F.when(day_size == 1, 1).when(m.contains("/") & ~first_month, 13).otherwise(10)
        month_low = F.when((month_size == 1) | both, 1).otherwise(10)
        return F.struct(
            F.when(first_month, b).otherwise(a).alias("day"),
            F.when(first_month, a).otherwise(b).alias("month"),
            p[2].cast("int").alias("year"),
            first_month.alias("first_month"),
            *(day_size.alias("day_size"), month_size.alias("month_size")),
            *(low.alias("low"), (F.when(day_size == 1, 9).otherwise(31) - low + 1).alias("days")),
            *(month_low.alias("month_low"), (F.when(month_size == 1, 9).otherwise(12) - month_low + 1).alias("months")),
        )

    def replaced(q: Column) -> Column:
        day_of = lambda b: (b % q["days"] + q["low"]).cast("int")
        month_of = lambda b: (F.floor(b / q["days"]) + q["month_low"]).cast("int")
        some_month = lambda b: F.greatest(F.lit(1), F.least(F.lit(12), month_of(b)))
        exists = lambda a, b: day_of(b) <= F.day(F.last_day(F.make_date((a + 1900).cast("int"), some_month(b), F.lit(1))))
        in_ranges = q["day"].between(q["low"], q["low"] + q["days"] - 1) & q["month"].between(q["month_low"], q["month_low"] + q["months"] - 1)
        a, b = q["year"] - 1900, (q["month"] - q["month_low"]) * q["days"] + q["day"] - q["low"]

        def again(s: Column, _: Column) -> Column:
            pair = cipher.permuted(s["a"], s["b"], F.lit(200), q["days"] * q["months"], "date")
            return F.when(s["done"], s).otherwise(
                let(pair, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), exists(p["a"], p["b"]).alias("done")))
            )

        def text(s: Column) -> Column:
            day = F.lpad(day_of(s["b"]).cast("string"), q["day_size"], F.lit("0"))
            month = F.lpad(month_of(s["b"]).cast("string"), q["month_size"], F.lit("0"))
            year = (s["a"] + 1900).cast("string")
            ordered = F.when(q["first_month"], F.concat(month, day, year)).otherwise(F.concat(day, month, year))
            return F.when(s["done"], refilled(m, ordered)).otherwise(m)

        start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(False).alias("done"))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, again)
        known = in_ranges & q["year"].between(1900, 2099)
        # whether the day exists is only asked for months that do
        return F.when(F.when(known, exists(a, b)).otherwise(False), let(walked, text)).otherwise(m)

    return let(F.split(m, "[/.]"), lambda p: let(parts(p), replaced))


def _full_date(m: Column, cipher: Cipher) -> Column:
    """Dates with all their digits, permuted among all days."""
    early = m.rlike(r"^\d{4}")
    slash, dot = m.contains("/") & ~early, m.contains(".")
    iso = F.when(slash, F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))).when(
        dot, F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))
    )
    day = F.coalesce(iso, F.translate(m, "/", "-")).try_cast("date")
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    valid = day.isNotNull() & n.between(0, _DAYS[0] * _DAYS[1] - 1)
    pair = cipher.permuted(F.floor(n / _DAYS[1]), n % _DAYS[1], *_DAYS, "date")
    new = F.date_add(F.lit("1900-01-01").cast("date"), (pair["a"] * _DAYS[1] + pair["b"]).cast("int"))
    text = F.when(slash, F.date_format(new, "MM/dd/yyyy")).when(dot, F.date_format(new, "dd.MM.yyyy")).when(
        m.contains("/"), F.date_format(new, "yyyy/MM/dd")
    ).otherwise(F.date_format(new, "yyyy-MM-dd"))
    return F.when(valid, text).otherwise(m)


def _address(m: Column, cipher: Cipher) -> Column:
    """Four numbers up to 255."""
    p = [F.split(m, r"\.")[k].cast("long") for k in range(4)]
    valid = (p[0] < 256) & (p[1] < 256) & (p[2] < 256) & (p[3] < 256)
    pair = cipher.permuted(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "address")
    new = [F.floor(pair["a"] / 256), pair["a"] % 256, F.floor(pair["b"] / 256), pair["b"] % 256]
    return F.when(valid, F.concat_ws(".", *(x.cast("string") for x in new))).otherwise(m)


def _email(m: Column, cipher: Cipher) -> Column:
    """Keyed hashes of the address and of its domain; case doesn't matter."""
    lower = F.lower(m)
    domain = F.substring_index(lower, "@", -1)
    own, of = (F.sha2(F.concat_ws("|", F.lit(cipher.key), F.lit("email"), x), 256) for x in (lower, domain))
    return F.concat(F.lit("u"), F.substring(own, 1, 12), F.lit("@d"), F.substring(of, 1, 8), F.lit(".invalid"))


def _pseudonym(m: Column, cipher: Cipher) -> Column:
    def is_(kind: str) -> Column:
        return m.rlike(f"^(?:{KINDS[kind]})$")

    return (
        F.when(is_("phone"), _phone(m, cipher))
        .when(is_("international"), _international(m, cipher))
        .when(is_("iban"), _iban(m, cipher))
        .when(is_("ssn"), _ssn(m, cipher))
        .when(is_("date"), _date(m, cipher))
        .when(is_("address"), _address(m, cipher))
        .otherwise(_card(m, cipher))
    )


def pseudonymised(documents: DataFrame, key: str, text_column: str = "text", inverse: bool = False) -> DataFrame:
    """``documents`` with personal data in the text replaced, and ``n_replaced``, how many values changed.

    Kinds: e-mail addresses, phone numbers (also international ones in any grouping), social
    security numbers, dates, IPv4 addresses, card numbers and IBANs. What fails its kind's check stays as it is, and so
    does all other text. A null text stays null with 0 replaced. ``inverse`` restores
    all but e-mail addresses. Other columns pass through; one that is called
    ``n_replaced`` is replaced.
    """
    cipher = Cipher(key, inverse)
    out = documents.withColumn("n_replaced", F.lit(0).cast("long"))
    if not inverse:
        out = _replaced(out, text_column, EMAIL, F.col(text_column).contains("@"), lambda m: _email(m, cipher))
    return _replaced(out, text_column, NUMBER, F.col(text_column).rlike("[0-9]"), lambda m: _pseudonym(m, cipher))


def _replaced(documents: DataFrame, text_column: str, pattern: str, worth: Column, new: Callable[[Column], Column]) -> DataFrame:
    """Replaces what ``pattern`` finds in texts that are ``worth`` a search, and adds to ``n_replaced``."""
    text = F.col(text_column)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("old"), new(m).alias("new")))
    name = "_found"
    while name in {c.lower() for c in documents.columns}:
        name += "_"
    some = documents.withColumn(name, F.when(worth, found))
    rest = F.split(text, pattern, -1)
    between = F.concat(F.transform(name, lambda p: p["new"]), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(rest, between, lambda a, b: F.concat(a, b)), "")
    changed = F.size(F.filter(name, lambda p: p["old"] != p["new"]))
    any_ = F.size(name) > 0  # null without a search
    return (
        some.withColumn("n_replaced", F.col("n_replaced") + F.when(any_, changed).otherwise(0))
        .withColumn(text_column, F.when(any_, joined).otherwise(text))
        .drop(name)
    )
