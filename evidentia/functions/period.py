"""Fiscal periods: from dates, from free text, and as sort keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The forms of periods in running text, in the order they are tried.
QUARTER = r"(?i)\bQ([1-4])\s*'?\s*(\d{2,4})\b"
WORD_QUARTER = r"(?i)\b(first|second|third|fourth)\s+quarter\b(?:\s+(?:fiscal\s+)?(\d{4}))?"
THREE_MONTHS = r"(?i)\bthree\s+months\s+ended\s+([A-Za-z]+)\.?\s+\d{1,2},?\s+(\d{4})"
TWELVE_MONTHS = r"(?i)\btwelve\s+months\s+ended\s+[A-Za-z]+\.?\s+\d{1,2},?\s+(\d{4})"
YEAR_ENDED = r"(?i)\byear\s+ended\s+[A-Za-z]+\.?\s+\d{1,2},?\s+(\d{4})"
FY = r"(?i)\bFY\s*'?\s*(\d{2,4})\b"
FISCAL_YEAR = r"(?i)\bfiscal\s+year\s+(\d{4})\b"
ANNUAL = r"(?i)\bannual\s+(\d{4})\b"
ORDINALS = ("first", "second", "third", "fourth")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def fiscal_period(filing_type: Column, report_date: Column) -> Column:
    """A quarterly report's quarter, any other filing's year."""
    return F.when(filing_type == "10-Q", F.concat(F.lit("Q"), F.quarter(report_date), F.lit(" "), F.year(report_date))).otherwise(F.concat(F.lit("FY"), F.year(report_date)))


def sort_key(period: Column) -> Column:
    """struct(year, quarter) of a period label, 0 where it has none."""
    year = F.regexp_extract(period, r"(\d{4})", 1).try_cast("int")
    quarter = F.regexp_extract(period, r"Q(\d)", 1).try_cast("int")
    return F.struct(F.coalesce(year, F.lit(0)).alias("year"), F.coalesce(quarter, F.lit(0)).alias("quarter"))


def _year(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def _place(names: tuple[str, ...], text: Column) -> Column:
    """1-based place of a name, null if it is none of them."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(text)).cast("int")
    return F.when(at > 0, at)


def normalize_period(raw: Column) -> Column:
    """struct(label, type, year, quarter); null where no form matches or the first that matches lacks a year or month."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    group = lambda pattern, g: F.regexp_extract(t, pattern, g)

    def annual(year: Column) -> Column:
        return F.struct(F.concat(F.lit("FY"), year).alias("label"), F.lit("annual").alias("type"), year.alias("year"), F.lit(None).cast("int").alias("quarter"))

    def quarterly(year: Column, quarter: Column) -> Column:
        return F.struct(F.concat(F.lit("Q"), quarter, F.lit(" "), year).alias("label"), F.lit("quarterly").alias("type"), year.alias("year"), quarter.cast("int").alias("quarter"))

    spoken_year = F.coalesce(group(WORD_QUARTER, 2).try_cast("int"), group(r"(\d{4})", 1).try_cast("int"))
    name = group(THREE_MONTHS, 1)
    month = F.coalesce(_place(MONTHS, name), _place(LONG_MONTHS, name), F.when(F.lower(name) == "sept", F.lit(9)))
    found = (
        F.when(t.rlike(QUARTER), quarterly(_year(group(QUARTER, 2)), group(QUARTER, 1).try_cast("int")))
        .when(t.rlike(WORD_QUARTER), quarterly(spoken_year, _place(ORDINALS, group(WORD_QUARTER, 1))))
        .when(t.rlike(THREE_MONTHS), quarterly(group(THREE_MONTHS, 2).try_cast("int"), F.ceil(month / 3)))
        .when(t.rlike(TWELVE_MONTHS), annual(group(TWELVE_MONTHS, 1).try_cast("int")))
        .when(t.rlike(YEAR_ENDED), annual(group(YEAR_ENDED, 1).try_cast("int")))
        .when(t.rlike(FY), annual(_year(group(FY, 1))))
        .when(t.rlike(FISCAL_YEAR), annual(group(FISCAL_YEAR, 1).try_cast("int")))
        .when(t.rlike(ANNUAL), annual(group(ANNUAL, 1).try_cast("int")))
    )
    return F.when(found["label"].isNotNull(), found)
