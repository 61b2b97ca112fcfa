"""KPI series: latest, changes, restatements, evidence and report order."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.period import sort_key
from ..operators.frames import change, first_per, upsert_series
from ..sources.views import Tables
from .registry import query

PCT = "CASE WHEN p <> 0 THEN (value - p) / abs(p) * 100 END"


@query("kpi_period_change", f"SELECT coverage_id, kpi_name, period, value, p AS prior_value, {PCT} AS change_pct FROM (SELECT *, lag(value) OVER (PARTITION BY coverage_id, kpi_name, period_type ORDER BY year, quarter) AS p FROM v_series)")
def kpi_period_change(spark, d):
    return change(Tables(spark, d).series(), ["coverage_id", "kpi_name", "period_type"], [F.col("year"), F.col("quarter")]).select("coverage_id", "kpi_name", "period", "value", "prior_value", "change_pct")


@query("kpi_true_yoy", f"WITH s AS (SELECT *, first(value) OVER (PARTITION BY coverage_id, kpi_name, period_type, quarter ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS p FROM v_series) SELECT coverage_id, kpi_name, period, {PCT} AS yoy_pct FROM s")
def kpi_true_yoy(spark, d):
    """The same quarter a year before: a RANGE of exactly one year back in the window, no self join."""
    from ..functions.finance import percent_change

    w = Window.partitionBy("coverage_id", "kpi_name", "period_type", "quarter").orderBy("year").rangeBetween(-1, -1)
    s = Tables(spark, d).series().withColumn("before", F.first("value").over(w))
    return s.select("coverage_id", "kpi_name", "period", percent_change(F.col("value"), F.col("before")).alias("yoy_pct"))


@query("kpi_latest_two_annual_yoy", f"WITH r AS (SELECT *, lag(value) OVER (PARTITION BY coverage_id, kpi_name ORDER BY year) AS p, row_number() OVER (PARTITION BY coverage_id, kpi_name ORDER BY year DESC) AS rn FROM v_series WHERE period_type = 'annual') SELECT coverage_id, kpi_name, year, {PCT} AS yoy_pct FROM r WHERE rn = 1 AND p IS NOT NULL")
def kpi_latest_two_annual_yoy(spark, d):
    a = change(Tables(spark, d).series().filter("period_type = 'annual'"), ["coverage_id", "kpi_name"], [F.col("year")])
    return first_per(a, ["coverage_id", "kpi_name"], F.desc("year")).filter("prior_value is not null").select("coverage_id", "kpi_name", "year", F.col("change_pct").alias("yoy_pct"))


@query("kpi_latest_per_name", "SELECT coverage_id, kpi_name, arg_max(value, (extracted_at, obs)) AS value FROM v_kpis GROUP BY 1, 2")
def kpi_latest_per_name(spark, d):
    return Tables(spark, d).kpis().groupBy("coverage_id", "kpi_name").agg(F.max_by("value", F.struct("extracted_at", "obs")).alias("value"))


@query("kpi_last6_chrono", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY coverage_id, kpi_name ORDER BY extracted_at DESC, obs DESC) AS rn FROM v_kpis) SELECT coverage_id, kpi_name, string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY extracted_at, obs) AS cents FROM r WHERE rn <= 6 GROUP BY 1, 2")
def kpi_last6_chrono(spark, d):
    last = first_per(Tables(spark, d).kpis(), ["coverage_id", "kpi_name"], F.desc("extracted_at"), F.desc("obs"), n=6)
    values = F.array_sort(F.collect_list(F.struct("extracted_at", "obs", "value")))
    return last.groupBy("coverage_id", "kpi_name").agg(F.array_join(F.transform(values, lambda x: F.round(x["value"] * 100).cast("long").cast("string")), ",").alias("cents"))


@query("kpi_restatements", """WITH r AS (SELECT *, lag(value) OVER (PARTITION BY coverage_id, kpi_name, year, quarter ORDER BY extracted_at, obs) AS p FROM v_kpis)
    SELECT coverage_id, kpi_name, year, quarter, obs, value, p IS NOT NULL AS is_restated FROM r WHERE p IS NULL OR abs(value - p) >= 0.000001""")
def kpi_restatements(spark, d):
    out = upsert_series(Tables(spark, d).kpis(), ["coverage_id", "kpi_name", "year", "quarter"], [F.col("extracted_at"), F.col("obs")])
    return out.select("coverage_id", "kpi_name", "year", "quarter", "obs", "value", "is_restated")


@query("kpi_groups_nested", """SELECT coverage_id, kpi_name, count(*) AS n, '[' || string_agg('{"year":' || year || ',"quarter":' || quarter || ',"period":"' || period || '","value":"' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '"}', ',' ORDER BY year, quarter) || ']' AS points
    FROM v_series GROUP BY 1, 2""")
def kpi_groups_nested(spark, d):
    """Per coverage and KPI, its points in order of year and quarter, as the JSON that a client gets; a point per quarter and year bounds it."""
    s = Tables(spark, d).series().withColumn("value", F.col("value").cast("decimal(18,2)").cast("string"))
    points = F.to_json(F.array_sort(F.collect_list(F.struct("year", "quarter", "period", "value"))))
    return s.groupBy("coverage_id", "kpi_name").agg(F.count("*").alias("n"), points.alias("points"))


@query("kpi_points_count", "SELECT coverage_id, kpi_name, count(*) AS n, min(value) AS low, max(value) AS high FROM v_series GROUP BY 1, 2")
def kpi_points_count(spark, d):
    return Tables(spark, d).series().groupBy("coverage_id", "kpi_name").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("sort_period_key", "SELECT coverage_id, kpi_name, period, row_number() OVER (PARTITION BY coverage_id, kpi_name ORDER BY year, quarter, period) AS pos FROM v_series")
def sort_period_key(spark, d):
    key = sort_key(F.col("period"))
    return Tables(spark, d).series().select("coverage_id", "kpi_name", "period", F.row_number().over(Window.partitionBy("coverage_id", "kpi_name").orderBy(key["year"], key["quarter"], "period")).alias("pos"))


@query("sort_period_lexical", "SELECT coverage_id, kpi_name, period, row_number() OVER (PARTITION BY coverage_id, kpi_name ORDER BY period) AS pos FROM v_series")
def sort_period_lexical(spark, d):
    return Tables(spark, d).series().select("coverage_id", "kpi_name", "period", F.row_number().over(Window.partitionBy("coverage_id", "kpi_name").orderBy("period")).alias("pos"))


@query("output_latest_per_type", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY coverage_id, filing_type ORDER BY filed_date DESC, document_id DESC) AS rn FROM v_filings WHERE ingest_status = 'indexed') SELECT coverage_id, filing_type, document_id FROM r WHERE rn = 1")
def output_latest_per_type(spark, d):
    f = Tables(spark, d).filings().filter("ingest_status = 'indexed'")
    return first_per(f, ["coverage_id", "filing_type"], F.desc("filed_date"), F.desc("document_id")).select("coverage_id", "filing_type", "document_id")


@query("evidence_first_occurrence", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) SELECT l_partkey AS chunk_id, l_linenumber AS query_no, l_orderkey AS hit FROM r WHERE rn = 1")
def evidence_first_occurrence(spark, d):
    hits = Tables(spark, d).raw("lineitem").select("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey", "l_extendedprice")
    return first_per(hits, ["l_partkey"], F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_extendedprice")).select(F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("query_no"), F.col("l_orderkey").alias("hit"))


@query("footnote_numbering", "WITH f AS (SELECT coverage_id, file_name, min(document_id) AS pos FROM (SELECT coverage_id, filing_type || '/' || period AS file_name, document_id FROM v_filings) GROUP BY 1, 2) SELECT coverage_id, file_name AS citation, dense_rank() OVER (PARTITION BY coverage_id ORDER BY pos) AS footnote FROM f")
def footnote_numbering(spark, d):
    f = Tables(spark, d).filings().select("coverage_id", F.concat_ws("/", "filing_type", "period").alias("citation"), "document_id")
    f = f.groupBy("coverage_id", "citation").agg(F.min("document_id").alias("pos"))
    return f.select("coverage_id", "citation", F.dense_rank().over(Window.partitionBy("coverage_id").orderBy("pos")).alias("footnote"))


@query("inbox_newest_200", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS rn FROM v_audit) SELECT tenant_id, id FROM r WHERE rn <= 200")
def inbox_newest_200(spark, d):
    return first_per(Tables(spark, d).audit(), ["tenant_id"], F.desc("created_at"), F.desc("id"), n=200).select("tenant_id", "id")


LINE = "'- ' || kpi_name || ': FY' || py || ' -> FY' || year || ': ' || CASE WHEN tenths IS NULL THEN 'n/a' ELSE CASE WHEN tenths < 0 THEN '-' ELSE '+' END || abs(tenths) // 10 || '.' || abs(tenths) % 10 || '%' END"


@query("kpi_yoy_lines", f"""WITH r AS (SELECT *, lag(value) OVER w AS p, lag(year) OVER w AS py, row_number() OVER (PARTITION BY coverage_id, kpi_name ORDER BY year DESC) AS rn FROM v_series WHERE period_type = 'annual' WINDOW w AS (PARTITION BY coverage_id, kpi_name ORDER BY year)),
    t AS (SELECT *, CAST(floor({PCT} * 10 + 0.5::DOUBLE) AS BIGINT) AS tenths FROM r WHERE rn = 1 AND p IS NOT NULL) SELECT coverage_id, string_agg({LINE}, chr(10) ORDER BY kpi_name) AS lines, count(*) AS n FROM t GROUP BY 1""")
def kpi_yoy_lines(spark, d):
    """The update's summary: a line per KPI with its change over the year before, signed, to a tenth of a per cent."""
    keys = ["coverage_id", "kpi_name"]
    s = Tables(spark, d).series().filter("period_type = 'annual'").withColumn("py", F.lag("year").over(Window.partitionBy(*keys).orderBy("year")))
    a = first_per(change(s, keys, [F.col("year")]), keys, F.desc("year")).filter("prior_value is not null")
    x = F.floor(F.col("change_pct") * 10 + 0.5).cast("long")
    shown = F.when(x.isNull(), "n/a").otherwise(F.concat(F.when(x < 0, "-").otherwise("+"), F.expr("cast(abs(x) div 10 as string)"), F.lit("."), F.expr("cast(abs(x) % 10 as string)"), F.lit("%")))
    line = F.concat(F.lit("- "), "kpi_name", F.lit(": FY"), F.col("py").cast("string"), F.lit(" -> FY"), F.col("year").cast("string"), F.lit(": "), shown)
    lines = F.array_sort(F.collect_list(F.struct("kpi_name", "line")))
    return a.withColumn("x", x).withColumn("line", line).groupBy("coverage_id").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("lines"), F.count("*").alias("n"))


@query("kpi_report_tables", "SELECT coverage_id, kpi_name, string_agg(period, ',' ORDER BY period) AS periods, count(*) AS n FROM v_series GROUP BY 1, 2")
def kpi_report_tables(spark, d):
    """A report's KPI tables: rows in the order of the period's text."""
    s = Tables(spark, d).series().groupBy("coverage_id", "kpi_name")
    return s.agg(F.array_join(F.array_sort(F.collect_list("period")), ",").alias("periods"), F.count("*").alias("n"))
