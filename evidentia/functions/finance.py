"""Financial value strings to typed values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Currencies in the order they are looked for, multipliers to millions and to counts.
CURRENCIES = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"))
CURRENCY_WORD = r"(?i)\b(usd|eur|gbp|jpy)\b"
TO_MILLIONS = {"b": 1000.0, "bn": 1000.0, "billion": 1000.0, "m": 1.0, "mm": 1.0, "million": 1.0, "k": 0.001, "thousand": 0.001}
TO_COUNT = {"b": 1e9, "bn": 1e9, "billion": 1e9, "m": 1e6, "mm": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3}
CONTEXT_UNITS = {"thousands": 0.001, "millions": 1.0, "billions": 1000.0}
NUMBER = r"^([\d,]*\.?\d+)\s*([a-zA-Z]+)?$"
RATIO = r"(?i)^([\d,]*\.?\d+)\s*x$"
PERCENT = r"(?i)%|\bpercent\b|\bpct\b"
SHARES = r"(?i)\bshares?\b"
SCAN = (
    r"(?i)\(?[-−–]?[\$€£¥]\s?[\d,]+(?:\.\d+)?\)?\s?(?:billion|bn|million|mm|thousand|k|b|m)?\b",
    r"(?i)\(?[-−–]?[\d,]+(?:\.\d+)?\)?\s?(?:billion|bn|million|thousand)\b",
    r"(?i)\(?[-−–]?[\d,]+(?:\.\d+)?\)?\s?(?:%|percent\b)",
    r"(?i)[-−–]?[\d,]+(?:\.\d+)?\s?(?:million|billion|thousand|mm|bn|[mbk])?\s*shares?\b",
)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^(?U:\s)+|(?U:\s)+$", "")


def number(x: Column) -> Column:
    return F.regexp_replace(x, ",", "").try_cast("double")


def _factor(table: dict[str, float], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), F.lower(name))


def normalize_value(raw: Column, context_unit: Column | None = None) -> Column:
    """struct(numeric_value, unit, currency, is_negative, confidence).

    Never fails: what can't be read is NaN, 'unknown', confidence 0. The value is
    unsigned; the sign is in is_negative.
    """
    context = F.coalesce(_factor(CONTEXT_UNITS, context_unit), F.lit(1.0)) if context_unit is not None else F.lit(1.0)
    return let(strip(F.coalesce(raw, F.lit(""))), lambda t: let(_without_currency(t), lambda c: let(_without_sign(c["rest"]), lambda b: _typed(t, c["currency"], b["body"], b["negative"], context))))


def let(x: Column, use) -> Column:
    """use(x) with x evaluated once: nested expressions would otherwise repeat it wherever it occurs."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _without_currency(t: Column) -> Column:
    symbol, rest = F.lit(None).cast("string"), t
    for sign, code in reversed(CURRENCIES):
        symbol = F.when(F.contains(t, F.lit(sign)), F.lit(code)).otherwise(symbol)
        rest = F.when(F.contains(t, F.lit(sign)), F.replace(t, F.lit(sign), F.lit(""))).otherwise(rest)
    word = F.regexp_extract(t, CURRENCY_WORD, 1)
    cut = F.concat(F.call_function("substring_index", t, word, F.lit(1)), F.substring(t, F.call_function("instr", t, word) + F.char_length(word), F.char_length(t)))
    rest = F.when(symbol.isNull() & (word != ""), cut).otherwise(rest)
    return F.struct(F.coalesce(symbol, F.when(word != "", F.upper(word))).alias("currency"), strip(rest).alias("rest"))


def _without_sign(rest: Column) -> Column:
    parens = r"^\((.*)\)(%?)$"
    in_parens, dash = rest.rlike(parens), rest.rlike("^[-−–]")
    inner = strip(F.concat(strip(F.regexp_extract(rest, parens, 1)), F.regexp_extract(rest, parens, 2)))
    body = F.when(in_parens, inner).when(dash, strip(F.substring(rest, F.lit(2), F.char_length(rest)))).otherwise(rest)
    return F.struct(body.alias("body"), (in_parens | dash).alias("negative"))


def _typed(t: Column, currency: Column, body: Column, negative: Column, context: Column) -> Column:
    def scaled(text: Column, table: dict[str, float], bare: Column) -> Column:
        def read(x):
            suffix = F.regexp_extract(x, NUMBER, 2)
            return F.when(x.rlike(NUMBER), number(F.regexp_extract(x, NUMBER, 1)) * F.when(suffix == "", bare).otherwise(_factor(table, suffix)))

        return let(strip(text), read)

    none = F.lit(None).cast("string")

    def value(x: Column, unit, code, confidence: float, failed_code=none) -> Column:
        return let(x, lambda v: F.struct(
            F.coalesce(v, F.lit(float("nan"))).alias("numeric_value"), F.when(v.isNotNull(), unit).otherwise("unknown").alias("unit"),
            F.when(v.isNotNull(), code).otherwise(failed_code).alias("currency"), negative.alias("is_negative"), F.when(v.isNotNull(), confidence).otherwise(0.0).alias("confidence"),
        ))

    unread = F.struct(F.lit(float("nan")).alias("numeric_value"), F.lit("unknown").alias("unit"), none.alias("currency"), F.lit(False).alias("is_negative"), F.lit(0.0).alias("confidence"))
    code = F.coalesce(currency, F.lit("USD"))
    return (
        F.when(~t.rlike(r"\d"), unread)
        .when(body.rlike(PERCENT), value(number(strip(F.regexp_replace(body, r"(?i)%|percent|pct", ""))), F.lit("percentage"), none, 0.9))
        .when(body.rlike(SHARES), value(scaled(F.regexp_replace(body, SHARES, ""), TO_COUNT, F.lit(1.0)), F.lit("count"), none, 0.9))
        .when(body.rlike(RATIO), value(number(F.regexp_extract(body, RATIO, 1)), F.lit("ratio"), none, 0.85))
        .otherwise(value(scaled(body, TO_MILLIONS, context), F.concat(code, F.lit("_millions")), code, 0.9, currency))
    )


def signed(value: Column) -> Column:
    """The signed number; null where nothing was read."""
    return let(value, lambda v: F.when(v["confidence"] > 0, F.when(v["is_negative"], -v["numeric_value"]).otherwise(v["numeric_value"])))


def percent_change(now: Column, before: Column) -> Column:
    """Change against the absolute prior value; null without a prior or with prior 0."""
    return F.when(before != 0, (now - before) / F.abs(before) * 100)


def scan_spans(text: Column) -> Column:
    """array(struct(start, match)) of financial values: leftmost, then longest, without overlaps.

    Positions come from what precedes each match: split() gives the gaps, a fold adds their lengths.
    """

    def spans(pattern: str) -> Column:
        hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))

        def step(acc, x):
            at = acc["at"] + F.char_length(x["gap"])
            return F.struct((at + F.char_length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), x["hit"].alias("match")))).alias("out"))

        pairs = F.transform(hits, lambda h, i: F.struct(h.alias("hit"), F.get(gaps, i).alias("gap")))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    every = F.concat(*[spans(p) for p in SCAN])
    order = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), (-F.char_length(x["match"])).alias("less"), x["match"].alias("match"))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))

    def keep(acc, x):
        free = x["start"] >= acc["end"]
        return F.struct(F.when(free, x["start"] - x["less"]).otherwise(acc["end"]).alias("end"), F.when(free, F.concat(acc["out"], F.array(F.struct(x["start"].alias("start"), x["match"].alias("match"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(order, start, keep, lambda acc: acc["out"])
