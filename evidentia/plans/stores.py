"""Tables that are really written: upserts, deletes and the daily sweep, read back after their last commit."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..sources.keyed_table import KeyedTable, restate
from ..sources.shared import shared_folder
from ..sources.views import Tables
from ..streaming.sweep import FilingSweep
from .registry import query

ROWS_A_BUCKET = 500_000  # of the observations: a task sorts and writes one bucket
SERIES = ["coverage_id", "kpi_name", "year", "quarter"]


@query("stored_notes_upsert", "SELECT coverage_id, max_by(document_id, (document_id % 3, document_id)) AS document_id, max_by(filing_type, (document_id % 3, document_id)) AS filing_type FROM v_filings GROUP BY 1")
def stored_notes_upsert(spark, d):
    """Three batches of notes by coverage; of a batch the newest note, and a later batch over an earlier one."""
    notes = Tables(spark, d).filings().select("coverage_id", "document_id", "filing_type")
    table = KeyedTable.create(spark, shared_folder(spark, "notes"), notes.schema, ["coverage_id"])
    for part in range(3):
        table.upsert(notes.filter(F.col("document_id") % 3 == part), F.desc("document_id"), txn=("notes", part))
    return table.read()


@query("stored_kpi_upserts", """WITH r AS (SELECT *, lag(value) OVER (PARTITION BY coverage_id, kpi_name, year, quarter ORDER BY extracted_at, obs) AS p FROM v_kpis)
    SELECT coverage_id, kpi_name, count(*) AS n_rows, count(*) FILTER (WHERE p IS NOT NULL) AS n_restated FROM r WHERE p IS NULL OR abs(value - p) >= 0.000001 GROUP BY 1, 2""")
def stored_kpi_upserts(spark, d):
    """Observations extracted before 1995, the later ones, and these once more: the replay changes nothing."""
    k = Tables(spark, d).kpis().select(*SERIES, "value", "extracted_at", "obs", F.lit(None).cast("boolean").alias("is_restated"), F.lit(None).cast("double").alias("prior_value"))
    table = KeyedTable.create(spark, shared_folder(spark, "kpis"), k.schema, ["coverage_id", "kpi_name"], max(16, -(-Tables(spark, d).raw("lineitem").count() // ROWS_A_BUCKET)))
    early = F.col("extracted_at") < F.lit("1995-01-01").cast("date")
    for number, batch in ((0, k.filter(early)), (1, k.filter(~early)), (1, k.filter(~early))):
        table.rewrite(batch, lambda current, new: restate(current, new, SERIES, ["extracted_at", "obs"], parts=table.buckets), txn=("kpis", number))
    return table.read().groupBy("coverage_id", "kpi_name").agg(F.count("*").alias("n_rows"), F.count_if("is_restated").alias("n_restated"))


@query("stored_vectors_delete", "SELECT chunk_id, industry_id, CAST(chunk_id % 5 AS INTEGER) AS tenant_id, len(vector) AS size FROM v_vectors WHERE NOT (chunk_id % 5 = 2 AND chunk_id % 7 = 3)")
def stored_vectors_delete(spark, d):
    """Vectors upserted in two batches by chunk; one tenant's chunks of a document are deleted by a filter."""
    v = Tables(spark, d).vectors().select("chunk_id", "industry_id", (F.col("chunk_id") % 5).cast("int").alias("tenant_id"), (F.col("chunk_id") % 7).alias("document_id"), "vector")
    table = KeyedTable.create(spark, shared_folder(spark, "vectors"), v.schema, ["chunk_id"])
    for part in range(2):
        table.upsert(v.filter(F.col("chunk_id") % 2 == part), F.col("document_id"), txn=("vectors", part))
    table.delete((F.col("tenant_id") == 2) & (F.col("document_id") == 3), txn=("vectors", 2))
    return table.read().select("chunk_id", "industry_id", "tenant_id", F.size("vector").cast("long").alias("size"))


SWEEP = "row_number() OVER (PARTITION BY coverage_id ORDER BY CASE filing_type WHEN '10-Q' THEN 0 ELSE 1 END, filed_date DESC, document_id DESC)"


@query("daily_sweep", f"""WITH f AS (SELECT coverage_id, document_id, filing_type, filed_date FROM v_filings WHERE filing_type IN ('10-Q', '10-K') AND filed_date > DATE '1993-01-01'),
    a AS (SELECT * FROM f WHERE document_id % 2 = 0 QUALIFY {SWEEP} = 1),
    b AS (SELECT * FROM f WHERE document_id NOT IN (SELECT document_id FROM a) QUALIFY {SWEEP} = 1)
    SELECT coverage_id, document_id, DATE '2024-05-01' AS swept_on FROM a UNION ALL SELECT coverage_id, document_id, DATE '2024-05-02' FROM b""")
def daily_sweep(spark, d):
    """Two days: the filings of even ids are listed before the first, the others before the second; the second day is run twice."""
    s = FilingSweep(spark, shared_folder(spark, "sweep"))
    f = Tables(spark, d).filings().select("document_id", "coverage_id", "filing_type", "filed_date")
    since, first, second = datetime.date(1993, 1, 1), datetime.date(2024, 5, 1), datetime.date(2024, 5, 2)
    for part, days in ((0, [first]), (1, [second, second])):
        f.filter(F.col("document_id") % 2 == part).write.mode("append").parquet(s.feed)
        for day in days:
            s.run(day, since)
    return s.documents.read().select("coverage_id", "document_id", "swept_on")
