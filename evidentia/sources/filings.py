"""Filing indexes: parallel arrays in JSON to one row per filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.period import fiscal_period

ARRAYS = "struct<filings:struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>>>"


def list_filings(df: DataFrame, json: str, keep: list[str], form: str | None = None, years: int | None = None, today: Column | None = None) -> DataFrame:
    """Rows with accession, form, filed_date, report_date, document, period; newest first is the reader's ORDER BY.

    A filing without report date takes its filing date, one without document ''. The
    look-back is strict: a filing exactly ``years`` old is out.
    """
    r = F.col("__f.filings.recent")
    zipped = F.arrays_zip(r["form"], r["accessionNumber"], r["filingDate"], r["reportDate"], r["primaryDocument"])
    rows = df.select(*keep, F.from_json(json, ARRAYS).alias("__f")).select(*keep, F.explode(zipped).alias("x"))
    filed = F.col("x.filingDate").try_cast("date")
    report = F.coalesce(F.nullif(F.col("x.reportDate"), F.lit("")).try_cast("date"), filed)
    out = rows.select(*keep, F.col("x.accessionNumber").alias("accession"), F.col("x.form").alias("form"), filed.alias("filed_date"), report.alias("report_date"), F.coalesce("x.primaryDocument", F.lit("")).alias("document"))
    out = out.withColumn("period", fiscal_period(F.col("form"), F.col("report_date")))
    if form:
        out = out.filter(F.col("form") == form)
    if years:
        out = out.filter(F.col("filed_date") > F.add_months(today if today is not None else F.current_date(), -12 * years))
    return out


def pick_document(items: Column, primary: Column) -> Column:
    """The first PDF of a filing's files, else its primary document."""
    return F.coalesce(F.get(F.filter(items, lambda i: F.lower(i).endswith(".pdf")), F.lit(0)), primary)
