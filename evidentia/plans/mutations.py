"""Set operations and mutations, as DataFrames that a sink would write."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.frames import first_per, merge_latest, upsert_series
from ..sources.views import Tables
from .registry import query


@query("set_new_urls_except", "SELECT url FROM pages WHERE page_id % 2 = 0 EXCEPT SELECT url FROM pages WHERE page_id % 3 = 0")
def set_new_urls_except(spark, d):
    p = Tables(spark, d).raw("pages").select("page_id", "url")
    return p.filter("page_id % 2 = 0").select("url").subtract(p.filter("page_id % 3 = 0").select("url"))


@query("set_wanted_intersect", "SELECT filing_type FROM v_filings INTERSECT SELECT * FROM (VALUES ('10-K'), ('8-K'), ('20-F'))")
def set_wanted_intersect(spark, d):
    wanted = spark.createDataFrame([("10-K",), ("8-K",), ("20-F",)], "filing_type string")
    return Tables(spark, d).filings().select("filing_type").intersect(wanted)


@query("upsert_kpi_idempotent", """WITH s AS (SELECT * FROM v_kpis UNION ALL SELECT * FROM v_kpis),
    r AS (SELECT *, lag(value) OVER (PARTITION BY coverage_id, kpi_name, year, quarter ORDER BY extracted_at, obs) AS p FROM s)
    SELECT coverage_id, kpi_name, count(*) AS n_rows, count(*) FILTER (WHERE p IS NOT NULL) AS n_restated FROM r WHERE p IS NULL OR abs(value - p) >= 0.000001 GROUP BY 1, 2""")
def upsert_kpi_idempotent(spark, d):
    """Extracting everything twice changes nothing."""
    k = Tables(spark, d).kpis()
    out = upsert_series(k.unionAll(k), ["coverage_id", "kpi_name", "year", "quarter"], [F.col("extracted_at"), F.col("obs")])
    return out.groupBy("coverage_id", "kpi_name").agg(F.count("*").alias("n_rows"), F.count_if("is_restated").alias("n_restated"))


@query("upsert_latest_wins", "SELECT coverage_id, max(document_id) AS document_id FROM v_filings GROUP BY 1")
def upsert_latest_wins(spark, d):
    f = Tables(spark, d).filings().select("coverage_id", "document_id")
    return merge_latest(f.filter("document_id % 2 = 0"), f.filter("document_id % 2 = 1"), ["coverage_id"], F.desc("document_id"))


@query("unique_guard_antijoin", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS rn FROM customer WHERE c_custkey >= 100) n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM customer o JOIN customer m ON m.c_custkey = n.c_custkey WHERE o.c_custkey < 100 AND o.c_nationkey = m.c_nationkey AND o.c_mktsegment = m.c_mktsegment)")
def unique_guard_antijoin(spark, d):
    c = Tables(spark, d).raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    key = ["c_nationkey", "c_mktsegment"]
    new = first_per(c.filter("c_custkey >= 100"), key, F.col("c_custkey")).drop("rn")
    return new.join(c.filter("c_custkey < 100").select(*key), key, "left_anti").select("c_custkey")


@query("cascade_delete", "SELECT count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = l.l_orderkey AND c.c_nationkey = 3)")
def cascade_delete(spark, d):
    """Deleting one nation's coverages takes their filings and the filings' observations along."""
    t = Tables(spark, d)
    gone = t.raw("customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    filings = t.raw("orders").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.raw("lineitem").join(filings, "l_orderkey", "left_anti").agg(F.count("*").alias("n"))


@query("credibility_history_map", """WITH q AS (SELECT coverage_id, kpi_name, 'Q' || quarter || ' ' || year AS q, arg_max(value, (extracted_at, obs)) AS v FROM v_kpis GROUP BY 1, 2, 3)
    SELECT coverage_id, kpi_name, '{' || string_agg('"' || q || '":"' || CAST(CAST(v AS DECIMAL(18,2)) AS VARCHAR) || '"', ',' ORDER BY q) || '}' AS history FROM q GROUP BY 1, 2""")
def credibility_history_map(spark, d):
    """Per coverage and KPI a map quarter -> value of the latest observation."""
    k = Tables(spark, d).kpis()
    q = k.groupBy("coverage_id", "kpi_name", F.format_string("Q%d %d", "quarter", "year").alias("q")).agg(F.max_by("value", F.struct("extracted_at", "obs")).cast("decimal(18,2)").cast("string").alias("v"))
    return q.groupBy("coverage_id", "kpi_name").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("q", "v"))))).alias("history"))


@query("audit_payload_hash", "SELECT id, sha256('{\"id\":' || id || ',\"tenant\":' || tenant_id || '}') AS input_hash FROM v_audit")
def audit_payload_hash(spark, d):
    """SHA-256 over the payload's JSON with sorted keys."""
    return Tables(spark, d).audit().select("id", F.sha2(F.to_json(F.struct(F.col("id"), F.col("tenant_id").alias("tenant"))), 256).alias("input_hash"))


@query("status_latest_state", "SELECT user_id AS task_id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def status_latest_state(spark, d):
    return Tables(spark, d).raw("events").groupBy(F.col("user_id").alias("task_id")).agg(F.max_by("event_type", "event_id").alias("state"))


@query("delete_by_filter", "SELECT doc_id FROM documents WHERE NOT (source = 'src3' AND doc_id % 5 = 3)")
def delete_by_filter(spark, d):
    docs = Tables(spark, d).raw("documents").select("doc_id", "source")
    return docs.filter(~((F.col("source") == "src3") & (F.col("doc_id") % 5 == 3))).select("doc_id")
