"""Rows that the service around the research writes and reads: tasks, inbox, settings, outputs, vocabulary, manifest."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.text import slug, word_count
from ..operators.frames import first_per
from ..sources.reports import read_manifest, read_vocabulary, write_manifests, write_vocabulary
from ..sources.shared import shared_folder
from ..sources.views import Tables
from .registry import query
from .texts import VERDICT, verdicts


@query("cik_lookup", "SELECT upper(c_name) AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer")
def cik_lookup(spark, d):
    """Company indexes as JSON maps of bounded size, exploded into a lookup of upper-cased tickers and padded numbers."""
    c = Tables(spark, d).raw("customer").select("c_custkey", F.create_map(F.col("c_custkey").cast("string"), F.struct(F.lower("c_name").alias("ticker"), F.col("c_custkey").alias("cik_str"))).alias("m"))
    pages = c.select(F.to_json("m").alias("json"))
    entries = pages.select(F.explode(F.map_values(F.from_json("json", "map<string, struct<ticker: string, cik_str: long>>"))).alias("e"))
    return entries.select(F.upper("e.ticker").alias("ticker"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"))


@query("fetch_filing", """WITH x AS (SELECT coverage_id, document_id, filing_type, period, row_number() OVER (PARTITION BY coverage_id, filing_type ORDER BY filed_date DESC, document_id DESC) AS rn FROM v_filings WHERE (filing_type = '10-Q' AND ends_with(period, ' 1997')) OR (filing_type = '10-K' AND period = 'FY1997'))
    SELECT coverage_id, filing_type, document_id, period FROM x WHERE rn = 1""")
def fetch_filing(spark, d, year: int = 1997):
    """The newest quarterly filing whose period ends with the year, and the annual one of the year."""
    f = Tables(spark, d).filings()
    match = ((F.col("filing_type") == "10-Q") & F.col("period").endswith(f" {year}")) | ((F.col("filing_type") == "10-K") & (F.col("period") == f"FY{year}"))
    return first_per(f.filter(match), ["coverage_id", "filing_type"], F.desc("filed_date"), F.desc("document_id")).select("coverage_id", "filing_type", "document_id", "period")


@query("kpi_vocabulary", """SELECT i.industry_id, coalesce(v.kpi, 'revenue') AS kpi FROM v_industries i LEFT JOIN (SELECT DISTINCT c_nationkey, lower(c_mktsegment) || '_sales' AS kpi FROM customer WHERE c_nationkey % 3 <> 0) v ON v.c_nationkey = i.industry_id""")
def kpi_vocabulary(spark, d):
    """An industry's KPIs from a YAML vocabulary (here made from the markets of its coverages); industries that it lacks have the default."""
    t = Tables(spark, d)
    i = t.industries().select("industry_id", slug(F.col("name")).alias("industry"))
    kpis = t.raw("customer").select(F.col("c_nationkey").alias("industry_id"), F.concat(F.lower("c_mktsegment"), F.lit("_sales")).alias("kpi")).filter("industry_id % 3 <> 0").distinct()
    path = shared_folder(spark, "vocabulary")
    write_vocabulary(kpis.join(i, "industry_id").select("industry", "kpi"), path)
    return i.join(read_vocabulary(spark, path), "industry", "left").select("industry_id", F.coalesce("kpi", F.lit("revenue")).alias("kpi"))


@query("case_resolution", "SELECT p.page_id, c.coverage_id, c.coverage_id IS NULL AS missing FROM (SELECT page_id, 'label_' || page_id % 400 AS label FROM pages) p LEFT JOIN (SELECT coverage_id, 'label_' || coverage_id AS label FROM v_coverages WHERE coverage_id % 3 <> 0) c ON c.label = p.label")
def case_resolution(spark, d):
    """Labels of cases against the manifests' JSON; a label that they lack is an error of its case."""
    t = Tables(spark, d)
    path = shared_folder(spark, "manifests")
    write_manifests(t.coverages().filter("coverage_id % 3 <> 0").select(F.concat(F.lit("label_"), F.col("coverage_id").cast("string")).alias("label"), "coverage_id"), path)
    cases = t.raw("pages").select("page_id", F.concat(F.lit("label_"), (F.col("page_id") % 400).cast("string")).alias("label"))
    manifest = read_manifest(spark, path).select("label", F.col("coverage_id").cast("long").alias("coverage_id"))
    return cases.join(manifest, "label", "left").select("page_id", "coverage_id", F.col("coverage_id").isNull().alias("missing"))


@query("reindex_scan", "SELECT document_id, coverage_id, 'ingest.document' AS task_type, 'queued' AS status FROM v_filings WHERE coverage_id = 7")
def reindex_scan(spark, d, coverage_id: int | None = 7):
    """The tasks that index a coverage's documents again, or with None everyone's."""
    f = Tables(spark, d).filings()
    f = f if coverage_id is None else f.filter(F.col("coverage_id") == coverage_id)
    return f.select("document_id", "coverage_id", F.lit("ingest.document").alias("task_type"), F.lit("queued").alias("status"))


@query("restated_from", r"SELECT l_orderkey, l_linenumber, l_extendedprice, TRY_CAST(nullif(regexp_extract(note, 'Restated from (-?[\d.]+) to', 1), '') AS DOUBLE) AS restated_from FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'Restated from -' || l_orderkey || '.5 to 9' WHEN 1 THEN 'Restated from 1.2.3 to 9' END AS note FROM lineitem)")
def restated_from(spark, d):
    n = F.col("l_linenumber") % 3
    note = F.when(n == 0, F.concat(F.lit("Restated from -"), F.col("l_orderkey").cast("string"), F.lit(".5 to 9"))).when(n == 1, F.lit("Restated from 1.2.3 to 9"))
    return Tables(spark, d).raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.nullif(F.regexp_extract(note, r"Restated from (-?[\d.]+) to", 1), F.lit("")).try_cast("double").alias("restated_from"))


STATUS = "CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'pending' END"


def _status(i):
    return F.element_at(F.array(*[F.lit(x) for x in ("approved", "partial", "failed", "pending")]), (i % 4 + 1).cast("int"))


@query("terminal_event", f"SELECT output_id AS doc_id, CASE WHEN status IN ('partial', 'failed') THEN 'partial' ELSE 'complete' END AS event FROM ({VERDICT})")
def terminal_event(spark, d):
    """What a task's stream ends with, by the enforcer's verdict on its output."""
    return verdicts(spark, d).select(F.col("output_id").alias("doc_id"), F.when(F.col("status").isin("partial", "failed"), "partial").otherwise("complete").alias("event"))


@query("object_paths", "SELECT doc_id, 'chunks_' || doc_id % 5 AS collection, 'tenant_' || doc_id % 5 AS bucket, 'raw/' || doc_id || '.pdf' AS object_key, doc_id % 3 = 0 AS own FROM documents")
def object_paths(spark, d):
    """Names of collections and objects; a path parts at its first slash, and must begin with its tenant's bucket."""
    i = F.col("doc_id")
    tenant = (i % 5).cast("string")
    path = F.concat(F.lit("tenant_"), tenant, F.lit("/raw/"), i.cast("string"), F.lit(".pdf"))
    asked = F.concat(F.lit("tenant_"), F.when(i % 3 == 0, tenant).otherwise(F.lit("x")), F.lit("/"))
    return Tables(spark, d).raw("documents").select("doc_id", F.concat(F.lit("chunks_"), tenant).alias("collection"), F.substring_index(path, "/", 1).alias("bucket"), F.regexp_replace(path, "^[^/]*/", "").alias("object_key"), F.startswith(path, asked).alias("own"))


@query("notify_latest_output", """WITH t AS (SELECT event_id AS task_id, user_id AS coverage_id, event_type = 'purchase' AS completed, event_id % 2 = 0 AS approved FROM events), o AS (SELECT coverage_id, max(output_id) AS output_id FROM v_reports GROUP BY 1)
    SELECT task_id, t.coverage_id, output_id FROM t JOIN o ON o.coverage_id = t.coverage_id WHERE completed AND approved""")
def notify_latest_output(spark, d):
    """After a task that completed with an approved output: its coverage's latest report."""
    t = Tables(spark, d)
    tasks = t.raw("events").filter("event_type = 'purchase' and event_id % 2 = 0").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("coverage_id"))
    return tasks.join(t.reports().groupBy("coverage_id").agg(F.max("output_id").alias("output_id")), "coverage_id").select("task_id", "coverage_id", "output_id")


@query("industries_by_name", "SELECT industry_id, name FROM v_industries ORDER BY name")
def industries_by_name(spark, d):
    return Tables(spark, d).industries().select("industry_id", "name").orderBy("name")


INBOX = "ib AS (SELECT event_id AS id, user_id, ts, value < 50 AS read FROM events)"


def _inbox(spark, d):
    return Tables(spark, d).raw("events").select(F.col("event_id").alias("id"), "user_id", "ts", (F.col("value") < 50).alias("read"))


@query("inbox_unread", f"WITH {INBOX} SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS pos FROM ib WHERE NOT read")
def inbox_unread(spark, d):
    """A user's unread notifications, newest first."""
    return first_per(_inbox(spark, d).filter(~F.col("read")), ["user_id"], F.desc("ts"), F.desc("id"), n=1 << 30).select("user_id", "id", F.col("rn").alias("pos"))


@query("inbox_mark_read", f"WITH {INBOX} SELECT id, user_id, read OR id % 10 = 3 AS read, strftime(ts, '%Y-%m-%d %H:%M') AS score FROM ib")
def inbox_mark_read(spark, d):
    """Some notifications become read; their place in the inbox stays."""
    return _inbox(spark, d).select("id", "user_id", (F.col("read") | (F.col("id") % 10 == 3)).alias("read"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("score"))


# The order of a report's sections.
SECTION_ORDER = ("industry_primer", "lynch_pitch", "munger_invert", "quarterly_update")
KIND = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate([*SECTION_ORDER, "kpi_snapshot"])) + " ELSE 'note' END"
PLACE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(SECTION_ORDER)) + " END"


def _outputs(spark, d):
    i = F.col("doc_id")
    kind = F.lit("note")
    for k, name in enumerate([*SECTION_ORDER, "kpi_snapshot"]):
        kind = F.when(i % 6 == k, name).otherwise(kind)
    return Tables(spark, d).raw("documents").select(i.alias("output_id"), (i % 50).alias("coverage_id"), kind.alias("kind"), _status(i).alias("status"), F.col("text").alias("content"))


OUTPUTS = f"ot AS (SELECT doc_id AS output_id, doc_id % 50 AS coverage_id, {KIND} AS kind, {STATUS} AS status, text AS content FROM documents)"


@query("report_section_order", f"WITH {OUTPUTS}, x AS (SELECT coverage_id, kind, max(output_id) AS output_id, {PLACE} AS place FROM ot WHERE status = 'approved' GROUP BY 1, 2) SELECT coverage_id, output_id, kind, row_number() OVER (PARTITION BY coverage_id ORDER BY place) AS pos FROM x WHERE place IS NOT NULL")
def report_section_order(spark, d):
    """A coverage's latest approved outputs in the fixed order; other kinds and missing ones are skipped."""
    order = spark.createDataFrame(list(enumerate(SECTION_ORDER)), "place int, kind string")
    latest = _outputs(spark, d).filter("status = 'approved'").groupBy("coverage_id", "kind").agg(F.max("output_id").alias("output_id"))
    return first_per(latest.join(order, "kind"), ["coverage_id"], F.col("place"), n=len(SECTION_ORDER)).select("coverage_id", "output_id", "kind", F.col("rn").alias("pos"))


@query("append_outputs", f"WITH {OUTPUTS} SELECT coverage_id, output_id, kind, status = 'approved' AS approved_by_enforcer FROM ot WHERE status = 'approved' AND kind IN ('lynch_pitch', 'munger_invert', 'quarterly_update')")
def append_outputs(spark, d):
    """The rows that a run appends to the research outputs: approved ones of a known kind."""
    o = _outputs(spark, d).filter((F.col("status") == "approved") & F.col("kind").isin("lynch_pitch", "munger_invert", "quarterly_update"))
    return o.select("coverage_id", "output_id", "kind", F.lit(True).alias("approved_by_enforcer"))


@query("state_lists_concat", "SELECT o_custkey AS coverage_id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END, o_orderkey) AS messages FROM orders GROUP BY 1")
def state_lists_concat(spark, d):
    """A state's list with the new messages appended: the old ones first."""
    o = Tables(spark, d).raw("orders").groupBy(F.col("o_custkey").alias("coverage_id"))
    keys = lambda rest: F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 2 == rest, F.col("o_orderkey"))))
    return o.agg(F.concat(keys(0), keys(1)).alias("m")).select("coverage_id", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("messages"))


@query("settings_merge", """SELECT tenant_id, '{"alert_threshold_usd":"' || CASE WHEN tenant_id % 2 = 0 THEN CAST(alert_threshold AS INTEGER) + n ELSE CAST(alert_threshold AS INTEGER) END || '","locale":"' || CASE WHEN tenant_id % 3 = 0 THEN lower(tenant_name) ELSE 'en' END || '"' || CASE WHEN tenant_id % 2 = 0 THEN ',"users":"' || n || '"' ELSE '' END || '}' AS settings
    FROM v_tenants JOIN (SELECT tenant_id, count(*) AS n FROM v_coverages GROUP BY 1) USING (tenant_id)""")
def settings_merge(spark, d):
    """The changed fields of a tenant's settings over the old ones: of equal keys the right side's value wins, the others stay, new ones come."""
    t = Tables(spark, d)
    n = t.coverages().groupBy("tenant_id").agg(F.count("*").alias("n"))
    limit, text = F.col("alert_threshold").cast("int"), lambda c: c.cast("string")
    old = F.create_map(F.lit("alert_threshold_usd"), text(limit), F.lit("locale"), F.lit("en"))
    none = F.create_map().cast("map<string,string>")
    change = F.when(F.col("tenant_id") % 2 == 0, F.create_map(F.lit("alert_threshold_usd"), text(limit + F.col("n")), F.lit("users"), text(F.col("n")))).otherwise(none)
    place = F.when(F.col("tenant_id") % 3 == 0, F.create_map(F.lit("locale"), F.lower("tenant_name"))).otherwise(none)
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    merged = over(over(old, change), place)
    return t.tenants().join(n, "tenant_id").select("tenant_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("settings"))


@query("get_or_create_industry", """WITH asked AS (SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN 'NEW ' || c_mktsegment ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT name, i.industry_id IS NULL AS created FROM asked LEFT JOIN v_industries i USING (name)""")
def get_or_create_industry(spark, d):
    """The industries that requests name: known ones, and those to be inserted once each."""
    t = Tables(spark, d)
    asked = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("NEW "), "c_mktsegment")).otherwise(F.col("n_name")).alias("name")).distinct()
    return asked.join(t.industries().select("name", F.lit(True).alias("known")), "name", "left").select("name", F.col("known").isNull().alias("created"))


@query("fill_coverage_industry", "SELECT coverage_id, coalesce(industry_id, 1000 + coverage_id % 5) AS industry_id FROM v_coverages")
def fill_coverage_industry(spark, d):
    """A coverage without an industry gets the one that was asked for; others keep theirs."""
    return Tables(spark, d).coverages().select("coverage_id", F.coalesce(F.col("industry_id"), F.lit(1000) + F.col("coverage_id") % 5).cast("long").alias("industry_id"))


@query("primer_save", r"""SELECT i.industry_id, p.industry_id IS NOT NULL AS updated, md5(coalesce(p.content, i.primer_content)) AS primer, len(list_filter(string_split_regex(p.content, '\s+'), lambda w: w <> '')) AS word_count FROM v_industries i LEFT JOIN v_primers p ON p.industry_id = i.industry_id""")
def primer_save(spark, d):
    """Primers overwrite their industry's text and word count; an industry that doesn't exist gets none."""
    t = Tables(spark, d)
    p = t.primers().select("industry_id", F.col("content"), word_count(F.col("content")).cast("long").alias("word_count"))
    j = t.industries().select("industry_id", "primer_content").join(p, "industry_id", "left")
    return j.select("industry_id", F.col("content").isNotNull().alias("updated"), F.md5(F.coalesce("content", "primer_content")).alias("primer"), "word_count")


@query("task_enqueue", "SELECT document_id, coverage_id, 'kpi_tracker.update_kpis' AS task_type, 'queued' AS status FROM v_filings WHERE ingest_status = 'indexed' AND filing_type IN ('10-Q', '10-K')")
def task_enqueue(spark, d):
    f = Tables(spark, d).filings().filter((F.col("ingest_status") == "indexed") & F.col("filing_type").isin("10-Q", "10-K"))
    return f.select("document_id", "coverage_id", F.concat_ws(".", F.lit("kpi_tracker"), F.lit("update_kpis")).alias("task_type"), F.lit("queued").alias("status"))


@query("validation_state", f"SELECT output_id, status = 'approved' AS approved_by_enforcer, status AS enforcer_status, count(CASE WHEN status <> 'approved' THEN 1 END) OVER (PARTITION BY output_id // 4 ORDER BY output_id) AS retry_count FROM ({VERDICT})")
def validation_state(spark, d):
    """The enforcer's result folded into the task's state after each attempt; a rejection counts as a retry."""
    so_far = Window.partitionBy(F.floor(F.col("output_id") / 4)).orderBy("output_id")
    return verdicts(spark, d).select("output_id", (F.col("status") == "approved").alias("approved_by_enforcer"), F.col("status").alias("enforcer_status"), F.count_if(F.col("status") != "approved").over(so_far).alias("retry_count"))

