"""PII pseudonyms by keyed Feistel networks (DataFrame functions only).

Validated values are permuted within their format: a card number stays a valid
card number, a phone number, an address or a date stays one, and equal values
get equal pseudonyms in all documents, so they stay linked. A value is split
into two numbers; each round adds to one of them a keyed hash of the other. That
is a permutation of the format's values, which the key can reverse.

Kinds: e-mail local parts, phone numbers, card numbers (Luhn), IPv4 addresses,
social security numbers, dates, access keys, and values of password and token.

Defined results: a null text stays null; what doesn't validate (a wrong check
digit, an octet over 255, a 13th month, a social security number with a part of zeros) stays as it is; rows that repeat are
treated alike; an empty table gives an empty table. Other columns are not read.
Each format is permuted within itself, so different values have different
pseudonyms: dates by what a reader can tell of their form, strings by the places
of their digits, small and large letters.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
KEY_SETTING, KEY = "spark.evidentia.pii.key", "change-me"  # where a session names its secret; without one, the tests' key
WALKS = 96  # a subset of at least 0.36 of its set: (1 - 0.36) ** 96 < 10 ** -18
DATE_FROM, DATE_A, DATE_B = "1900-01-01", 272, 268  # dates from 1900-01-01 on, DATE_A * DATE_B days: they stay among themselves
FIRST_DATE, DATES, ALL_A, ALL_B = "0001-01-01", 3_652_059, 1912, 1911  # all dates of four-digit years; ALL_A * ALL_B is a little more

# The forms of the values that are looked for. Lookbehinds keep the scan linear; a group without a bound is possessive, as Java recurses for others.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
DATE = r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w/-])"
ACCESS_KEY = r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)"
SECRET = r"(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key) ?= ?[\"']?)(?<![A-Za-z0-9])[A-Za-z0-9]{8,}+"
MAY_HOLD = r"(?i)[0-9@]|AKIA|password|passwd|pwd|secret|token|api[_-]?key"  # without one of these no form matches
ANY = "|".join([EMAIL, ACCESS_KEY, SECRET, DATE, SSN, IPV4, PHONE, CARD])


def _long(x) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(int(x)).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column, key: str) -> Column:
    """struct(a, b): the pair permuted within [0, size_a) x [0, size_b)."""

    def noise(i, value, size):
        text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), value.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size)

    def step(acc, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["a"] + noise(i, acc["b"], size_a), size_a)).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + noise(i, acc["a"], size_b), size_b)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(a).alias("a"), _long(b).alias("b")), step)


def permute_string(s: Column, base: int, tweak: Column, key: str) -> Column:
    """A string of digits 0-9a-z below ``base`` to another of its length, in pieces of at most ``width`` digits."""
    width = {10: 18, 26: 12, 36: 12}[base]  # half a piece fits a long

    def piece(k):
        x = F.substring(s, k * width + 1, F.lit(width))
        left = F.floor(F.char_length(x) / 2).cast("int")
        right = F.char_length(x) - left
        number = lambda y: F.coalesce(F.conv(y, base, 10).cast("long"), _long(0))
        power = lambda n: F.round(F.pow(F.lit(float(base)), n)).cast("long")
        out = feistel(number(F.substring(x, F.lit(1), left)), number(F.substring(x, left + 1, right)), power(left), power(right), F.concat_ws(".", tweak, F.char_length(s).cast("string"), k.cast("string")), key)
        digits = lambda n, wide: F.lower(F.lpad(F.conv(n.cast("string"), 10, base), wide, F.lit("0")))
        return F.concat(digits(out["a"], left), digits(out["b"], right))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(s) - 1) / width).cast("int")), piece)
    return F.when(s == "", s).otherwise(F.array_join(pieces, ""))


def walk(start: Column, step: Callable[[Column], Column], inside: Callable[[Column], Column]) -> Column:
    """A permutation of a set made one of the subset ``inside``: step on until the value lies in it again.

    WALKS steps are enough but for once in 10^18 values or less; then the start comes back.
    """
    first = F.struct(start.alias("x"), F.lit(False).alias("done"))

    def on(acc, _):
        # A value that lies inside is not stepped again; CASE evaluates only the branch it takes.
        return F.when(acc["done"], acc).otherwise(F.transform(F.array(step(acc["x"])), lambda x: F.struct(x.alias("x"), inside(x).alias("done")))[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, on, lambda acc: F.when(acc["done"], acc["x"]).otherwise(start))


# A-Z and a-z as digits of base 26.
BASE_26 = "0123456789abcdefghijklmnop"
SMALL, LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permute_classes(s: Column, tweak: Column, key: str) -> Column:
    """Digits, small and large letters each permuted among themselves; all other characters and the pattern of kinds stay.

    The pattern and the new values of the kinds before go into the next one's
    hashes, so the whole string is permuted: different strings never meet.
    """
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    seed = F.concat_ws("|", tweak, F.sha2(pattern, 256))
    only = lambda kind: F.regexp_replace(s, f"[^{kind}]", "")

    digits = permute_string(only("0-9"), 10, F.concat_ws("|", seed, F.lit("0")), key)
    small = lambda d: F.translate(permute_string(F.translate(only("a-z"), SMALL, BASE_26), 26, F.concat_ws("|", seed, F.lit("a"), d), key), BASE_26, SMALL)
    large = lambda d, x: F.translate(permute_string(F.translate(only("A-Z"), LARGE, BASE_26), 26, F.concat_ws("|", seed, F.lit("A"), d, x), key), BASE_26, LARGE)
    kinds = F.transform(F.array(digits), lambda d: F.struct(d.alias("d"), small(d).alias("s")))
    kinds = F.transform(kinds, lambda k: F.struct(k["d"].alias("d"), k["s"].alias("s"), large(k["d"], k["s"]).alias("l")))
    return F.transform(kinds, lambda k: refill_all(s, {"[0-9]": k["d"], "[a-z]": k["s"], "[A-Z]": k["l"]}))[0]


def refill(shape: Column, values: Column, pattern: str) -> Column:
    """The characters of ``values`` in the places where ``shape`` has a character of the class ``pattern``."""
    return refill_all(shape, {pattern: values})


def refill_all(shape: Column, values: dict[str, Column]) -> Column:
    """As refill(), for several disjoint classes at once."""
    chars = F.filter(F.split(shape, "", -1), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), *[F.lit(1).alias(f"n{i}") for i in range(len(values))])

    def put(acc, c):
        mine = [c.rlike(f"^{kind}$") for kind in values]
        new = c
        for i, (is_mine, value) in enumerate(zip(mine, values.values())):
            new = F.when(is_mine, F.substring(value, acc[f"n{i}"], F.lit(1))).otherwise(new)
        return F.struct(F.concat(acc["out"], new).alias("out"), *[(acc[f"n{i}"] + F.when(m, 1).otherwise(0)).alias(f"n{i}") for i, m in enumerate(mine)])

    return F.aggregate(chars, start, put, lambda acc: acc["out"])


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum of a digit string; double_last: its last digit is a doubled one."""
    reversed_ = F.filter(F.split(F.reverse(digits), "", -1), lambda c: c != "")
    odd = 0 if double_last else 1

    def value(c, i):
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == odd, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(reversed_, value), F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permute_string(F.substring(digits, F.lit(1), F.char_length(digits) - 1), 10, F.lit("card"), key)
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(body, True), F.lit(10)), F.lit(10))
    valid = luhn_sum(digits, False) % 10 == 0
    return F.when(valid, refill(m, F.concat(body, check.cast("string")), "[0-9]")).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    country, local = F.substring(digits, F.lit(1), F.char_length(digits) - 10), F.substring(digits, F.char_length(digits) - 9, F.lit(10))
    area, exchange, line = (F.substring(local, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    number = ((area - 200) * 800 + exchange - 200) * 10000 + line
    out = feistel(F.floor(number / 80000), F.pmod(number, _long(80000)), _long(80000), _long(80000), F.concat(F.lit("phone"), country), key)
    moved = out["a"] * 80000 + out["b"]
    rest = F.floor(moved / 10000)
    plan = F.format_string("%03d%03d%04d", F.floor(rest / 800) + 200, F.pmod(rest, _long(800)) + 200, F.pmod(moved, _long(10000)))
    # Numbers with an area or exchange under 200 stay among themselves.
    plain = walk(local, lambda x: permute_string(x, 10, F.concat(F.lit("number"), country), key), lambda x: ~x.rlike("^[2-9][0-9]{2}[2-9]"))
    return refill(m, F.concat(country, F.when((area >= 200) & (exchange >= 200), plan).otherwise(plain)), "[0-9]")


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda o: o.cast("long"))
    out = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], _long(65536), _long(65536), F.lit("ipv4"), key)
    high = lambda x: F.floor(x / 256).cast("string")
    low = lambda x: F.pmod(x, _long(256)).cast("string")
    stays = F.exists(octets, lambda o: o > 255) | m.rlike(r"(?:^|\.)0[0-9]")  # 01 would be read as 1: two forms, one address
    return F.when(stays, m).otherwise(F.concat_ws(".", high(out["a"]), low(out["a"]), high(out["b"]), low(out["b"])))


def _date(m: Column, key: str) -> Column:
    """Forms stay apart: yyyy-MM-dd; and, of nn/nn/yyyy, those with a day over 12 first, second, or in neither place (read dd/MM).

    Dates of the window from DATE_FROM stay among themselves, and so do the earlier and later ones.
    """
    first, shift, size = F.lit(FIRST_DATE).cast("date"), (datetime.date.fromisoformat(DATE_FROM) - datetime.date(1, 1, 1)).days, DATE_A * DATE_B
    x, y, z = (F.regexp_extract(m, r"^(\d+)[/-](\d+)[/-](\d+)$", i) for i in (1, 2, 3))
    to_date = lambda year, month, day: F.concat_ws("-", year, month, day).try_cast("date")
    kind = F.when(m.contains("-"), 0).when(x.cast("int") > 12, 1).when(y.cast("int") > 12, 2).otherwise(3)
    day = F.when(m.contains("-"), to_date(x, y, z)).when((x.cast("int") <= 12) & (y.cast("int") > 12), to_date(z, x, y)).otherwise(to_date(z, y, x))
    read = F.struct(F.datediff(day, first).cast("long").alias("n"), kind.alias("kind"))

    def moved(d):
        date = lambda n: F.date_add(first, n.cast("int"))

        def suits(n):
            of_month = F.dayofmonth(date(n))
            return (d["kind"] == 0) | F.when(d["kind"] == 3, of_month <= 12).otherwise(of_month > 12)

        def near(n):
            out = feistel(F.floor((n - shift) / DATE_B), F.pmod(n - shift, _long(DATE_B)), _long(DATE_A), _long(DATE_B), F.lit("date"), key)
            return out["a"] * DATE_B + out["b"] + shift

        def far(n):
            out = feistel(F.floor(n / ALL_B), F.pmod(n, _long(ALL_B)), _long(ALL_A), _long(ALL_B), F.lit("far date"), key)
            return out["a"] * ALL_B + out["b"]

        in_window = lambda n: (n >= shift) & (n < shift + size)
        there = F.when(in_window(d["n"]), walk(d["n"], near, suits)).otherwise(walk(d["n"], far, lambda n: F.when((n < DATES) & ~in_window(n), suits(n)).otherwise(False)))
        return F.struct(date(there).alias("date"), d["kind"].alias("kind"))

    form = lambda r: F.when(r["kind"] == 0, F.date_format(r["date"], "yyyy-MM-dd")).when(r["kind"] == 2, F.date_format(r["date"], "MM/dd/yyyy")).otherwise(F.date_format(r["date"], "dd/MM/yyyy"))
    valid = lambda d: (d["n"] >= 0) & (d["n"] < DATES)
    new = F.transform(F.transform(F.filter(F.array(read), valid), moved), form)
    return F.coalesce(F.get(new, F.lit(0)), m)


def _ssn(m: Column, digits: Column, key: str) -> Column:
    """Numbers with a part of zeros only were never given out, and stay; areas of 9.. are taxpayer numbers."""
    given = lambda d: ~d.rlike("^000|^...00|0000$")
    return F.when(given(digits), refill(m, walk(digits, lambda d: permute_string(d, 10, F.lit("ssn"), key), given), "[0-9]")).otherwise(m)


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(permute_classes(local, F.concat(F.lit("email"), domain), key), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    is_ = lambda p: m.rlike("^(?:" + p + ")$")
    digits_only = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(is_(r"AKIA[0-9A-Z]{16}"), F.concat(F.lit("AKIA"), F.upper(permute_string(F.lower(F.substring(m, 5, 16)), 36, F.lit("access"), key))))
        .when(is_(r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}"), _date(m, key))
        .when(is_(r"\d{3}-\d{2}-\d{4}"), _ssn(m, digits_only, key))
        .when(is_(r"\d{1,3}(?:\.\d{1,3}){3}"), _ipv4(m, key))
        .when(is_(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"), _phone(m, key))
        .when(is_(r"\d(?:[ -]?\d){12,18}"), _card(m, key))
        .otherwise(permute_classes(m, F.lit("secret"), key))
    )


def pseudonymize(docs: DataFrame, key: str = KEY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: id, text with pseudonyms, n_values changed."""
    t = F.col("__t")
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t"))
    rows = rows.withColumn("__m", F.when(t.rlike(MAY_HOLD), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    new = F.transform("__m", lambda m: pseudonym(m, key))
    rows = rows.withColumn("__n", F.when(F.size("__m") > 0, new).otherwise(F.array().cast("array<string>")))
    gaps = F.split(t, ANY, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("__n")), "__n", lambda g, n: F.concat(g, n)), ""), F.element_at(gaps, -1))
    changed = F.size(F.filter(F.zip_with("__m", "__n", lambda a, b: a != b), lambda x: x))
    return rows.select(F.col("__id").alias(doc_id), F.when(F.size("__m") > 0, joined).otherwise(t).alias("text"), F.coalesce(changed, F.lit(0)).alias("n_values"))


def session_key(spark) -> str:
    """The session's secret. Only a local session, as in tests, may go without one: it gets a fixed key that is no secret."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY_SETTING}")
    return key or KEY


def op7_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), session_key(spark))
