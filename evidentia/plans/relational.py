"""Scans, projections, filters and joins over the tenant-scoped tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.text import page_text, slug, word_count
from ..operators.frames import first_per
from ..scope import TenantScope
from ..sources.filings import list_filings, pick_document
from ..sources.views import Tables
from .registry import query

ALLOWED = ("example.com", "worldbank.org", "imf.org", "oecd.org", "sec.gov")
STRIP = r"'^\s+|\s+$'"


@query("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark, d):
    return Tables(spark, d).raw("documents").select("doc_id", "lang", "source", "n_chars")


@query("scan_point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def scan_point_lookup(spark, d):
    return Tables(spark, d).raw("orders").filter("o_orderkey = 42").select("o_orderkey", "o_totalprice")


@query("proj_ticker_normalize", f"SELECT c_custkey, upper(regexp_replace('  ' || c_name || ' ', {STRIP}, '', 'g')) AS ticker, c_mktsegment IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') AS is_listed FROM customer")
def proj_ticker_normalize(spark, d):
    c = Tables(spark, d).raw("customer")
    return c.select("c_custkey", F.upper(F.regexp_replace(F.concat(F.lit("  "), "c_name", F.lit(" ")), r"^\s+|\s+$", "")).alias("ticker"), F.col("c_mktsegment").isin("MACHINERY", "BUILDING", "AUTOMOBILE").alias("is_listed"))


@query("proj_kpi_category", "SELECT DISTINCT kpi_name, CASE WHEN kpi_name IN ('revenue', 'net_income') THEN 'financial' ELSE 'operational' END AS category FROM v_kpis")
def proj_kpi_category(spark, d):
    return Tables(spark, d).kpis().select("kpi_name", F.when(F.col("kpi_name").isin("revenue", "net_income"), "financial").otherwise("operational").alias("category")).distinct()


@query("proj_industry_key", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type || ' & ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'default') AS industry_key FROM part")
def proj_industry_key(spark, d):
    key = slug(F.concat("p_type", F.lit(" & "), "p_brand"))
    return Tables(spark, d).raw("part").select("p_partkey", F.coalesce(F.nullif(key, F.lit("")), F.lit("default")).alias("industry_key"))


@query("proj_quality_tier", """SELECT d.doc_id, CASE WHEN q IS NULL THEN 'pending' WHEN least(1.0, greatest(0.0, q)) >= 0.8 THEN 'high' WHEN least(1.0, greatest(0.0, q)) >= 0.5 THEN 'mid' ELSE 'low' END AS tier
    FROM (SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN d.n_chars / 2000.0::DOUBLE END AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) d""")
def proj_quality_tier(spark, d):
    t = Tables(spark, d)
    q = F.when(F.col("quality").isNotNull(), F.col("n_chars") / 2000.0)
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("q")))
    rows = t.raw("documents").select("doc_id", "n_chars").join(t.raw("labels").select("doc_id", "quality"), "doc_id", "left").withColumn("q", q)
    return rows.select("doc_id", F.when(F.col("q").isNull() | F.isnan("q"), "pending").when(x >= 0.8, "high").when(x >= 0.5, "mid").otherwise("low").alias("tier"))


@query("proj_health_status", "SELECT user_id, CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0 THEN 'healthy' WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) <= 2 THEN 'degraded' ELSE 'unhealthy' END AS status FROM events GROUP BY user_id")
def proj_health_status(spark, d):
    e = Tables(spark, d).raw("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.select("user_id", F.when(F.col("errors") == 0, "healthy").when(F.col("errors") <= 2, "degraded").otherwise("unhealthy").alias("status"))


@query("proj_kpi_display_name", "SELECT DISTINCT kpi_name, upper(kpi_name[1]) || replace(kpi_name[2:], '_', ' ') AS display_name FROM v_kpis")
def proj_kpi_display_name(spark, d):
    name = F.concat(F.upper(F.left("kpi_name", F.lit(1))), F.translate(F.substring("kpi_name", 2, 100), "_", " "))
    return Tables(spark, d).kpis().select("kpi_name", name.alias("display_name")).distinct()


@query("proj_relative_time", """SELECT event_id, CASE WHEN s >= 604800 THEN CAST(round(s / 604800.0) AS BIGINT) || ' week' WHEN s >= 86400 THEN CAST(round(s / 86400.0) AS BIGINT) || ' day' WHEN s >= 3600 THEN CAST(round(s / 3600.0) AS BIGINT) || ' hour' WHEN s >= 60 THEN CAST(round(s / 60.0) AS BIGINT) || ' minute' ELSE s || ' second' END AS age
    FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) AS BIGINT) AS s FROM events)""")
def proj_relative_time(spark, d):
    s = F.lit(1706659200) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = Tables(spark, d).raw("events").select("event_id", s.alias("s"))
    out = F.concat(F.col("s"), F.lit(" second"))
    for unit, n in (("minute", 60), ("hour", 3600), ("day", 86400), ("week", 604800)):
        out = F.when(F.col("s") >= n, F.concat(F.round(F.col("s") / n).cast("long"), F.lit(f" {unit}"))).otherwise(out)
    return e.select("event_id", out.alias("age"))


@query("proj_role_rank", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 WHEN 'system' THEN 3 ELSE 0 END >= 2 AS may_write FROM conversations")
def proj_role_rank(spark, d):
    rank = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).when(F.col("role") == "system", 3).otherwise(0)
    return Tables(spark, d).raw("conversations").select("conv_id", "turn", (rank >= 2).alias("may_write"))


@query("filter_scope", "SELECT coverage_id, ticker FROM v_coverages WHERE tenant_id = 2")
def filter_scope(spark, d):
    return TenantScope(2).table(Tables(spark, d).coverages()).select("coverage_id", "ticker")


@query("filter_scope_kpis", "SELECT count(*) AS n FROM v_kpis k WHERE EXISTS (SELECT 1 FROM v_coverages c WHERE c.coverage_id = k.coverage_id AND c.tenant_id = 2)")
def filter_scope_kpis(spark, d):
    t = Tables(spark, d)
    return TenantScope(2).through(t.kpis().select("coverage_id"), t.coverages()).agg(F.count("*").alias("n"))


@query("filter_optional_status", "SELECT document_id FROM v_filings WHERE ingest_status = 'indexed'")
def filter_optional_status(spark, d):
    return Tables(spark, d).filings().filter("ingest_status = 'indexed'").select("document_id")


@query("filter_in_list", "SELECT document_id, filing_type FROM v_filings WHERE filing_type IN ('10-Q', '10-K')")
def filter_in_list(spark, d):
    return Tables(spark, d).filings().filter(F.col("filing_type").isin("10-Q", "10-K")).select("document_id", "filing_type")


@query("filter_not_null", "SELECT industry_id FROM v_industries WHERE primer_content IS NOT NULL")
def filter_not_null(spark, d):
    return Tables(spark, d).industries().filter("primer_content is not null").select("industry_id")


@query("json_path_distinct", "SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_distinct(spark, d):
    return Tables(spark, d).raw("events").select(F.get_json_object("props", "$.k").try_cast("long").alias("k")).distinct()


PAGE_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"""


@query("html_text_5000", f"SELECT page_id, left({PAGE_TEXT}, 5000) AS text FROM pages")
def html_text_5000(spark, d):
    return Tables(spark, d).raw("pages").select("page_id", F.left(page_text(F.col("html")), F.lit(5000)).alias("text"))


@query("url_allowlist", "SELECT page_id, regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '(^|\\.)(example\\.com|worldbank\\.org|imf\\.org|oecd\\.org|sec\\.gov)$') AS allowed FROM pages")
def url_allowlist(spark, d):
    host = F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit(""))
    ok = F.lit(False)
    for domain in ALLOWED:
        ok = ok | (host == domain) | host.endswith("." + domain)
    return Tables(spark, d).raw("pages").select("page_id", ok.alias("allowed"))


LISTED = "SELECT o_custkey % 50 AS company, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filed, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS report, CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' ELSE '8-K' END AS form FROM orders"


LISTING_PAGE = 10_000  # accession numbers a page covers: no JSON grows with the table


def _listings(spark, d):
    """Struct-of-arrays JSON as a filing index serves it: per company and page of at most LISTING_PAGE filings."""
    o = Tables(spark, d).raw("orders")
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").when(F.col("o_orderpriority") == "2-HIGH", "10-Q").otherwise("8-K")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = o.select((F.col("o_custkey") % 50).alias("company"), F.struct(F.col("o_orderkey").alias("a"), form.alias("f"), day.alias("d"), F.when(F.col("o_orderkey") % 7 != 0, day).otherwise("").alias("r")).alias("x"), F.floor(F.col("o_orderkey") / LISTING_PAGE).alias("page"))
    g = o.groupBy("company", "page").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pick = lambda f: F.transform("xs", lambda x: x[f].cast("string"))
    return g.select("company", F.to_json(F.struct(F.struct(F.struct(pick("f").alias("form"), pick("a").alias("accessionNumber"), pick("d").alias("filingDate"), pick("r").alias("reportDate"), F.transform("xs", lambda x: F.lit("main.htm")).alias("primaryDocument")).alias("recent")).alias("filings"))).alias("json"))


@query("filings_unzip_arrays", f"SELECT company, CAST(accession AS VARCHAR) AS accession, form, CAST(filed AS VARCHAR) AS filed_date, CAST(coalesce(report, filed) AS VARCHAR) AS report_date FROM ({LISTED})")
def filings_unzip_arrays(spark, d):
    f = list_filings(_listings(spark, d), "json", ["company"])
    return f.select("company", "accession", "form", F.col("filed_date").cast("string").alias("filed_date"), F.col("report_date").cast("string").alias("report_date"))


@query("filings_list_recent", f"SELECT company, CAST(accession AS VARCHAR) AS accession, CASE WHEN form = '10-Q' THEN 'Q' || quarter(coalesce(report, filed)) || ' ' || year(coalesce(report, filed)) ELSE 'FY' || year(coalesce(report, filed)) END AS period FROM ({LISTED}) WHERE form = '10-Q' AND filed > DATE '2001-08-02' - INTERVAL 5 YEAR")
def filings_list_recent(spark, d):
    return list_filings(_listings(spark, d), "json", ["company"], form="10-Q", years=5, today=F.lit("2001-08-02").cast("date")).select("company", "accession", "period")


@query("filings_pick_document", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'B.PDF' ELSE 'main.htm' END AS document FROM pages")
def filings_pick_document(spark, d):
    items = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("a.xml"), F.lit("B.PDF"))).otherwise(F.array(F.lit("a.xml")))
    return Tables(spark, d).raw("pages").select("page_id", pick_document(items, F.lit("main.htm")).alias("document"))


@query("join_coverage_industry_left", "SELECT coverage_id, i.name AS industry_name FROM v_coverages c LEFT JOIN v_industries i ON c.industry_id = i.industry_id")
def join_coverage_industry_left(spark, d):
    t = Tables(spark, d)
    return t.coverages().join(t.industries(), "industry_id", "left").select("coverage_id", F.col("name").alias("industry_name"))


@query("join_primer_loaded_semi", "SELECT coverage_id FROM v_coverages c WHERE EXISTS (SELECT 1 FROM v_industries i WHERE i.industry_id = c.industry_id AND primer_content IS NOT NULL)")
def join_primer_loaded_semi(spark, d):
    t = Tables(spark, d)
    return t.coverages().join(t.industries().filter("primer_content is not null"), "industry_id", "left_semi").select("coverage_id")


@query("join_unextracted_docs_anti", "SELECT document_id FROM v_filings f WHERE ingest_status = 'indexed' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE 'doc_' || l.l_orderkey = f.file_name)")
def join_unextracted_docs_anti(spark, d):
    t = Tables(spark, d)
    cited = t.raw("lineitem").select(F.concat(F.lit("doc_"), F.col("l_orderkey").cast("string")).alias("file_name"))
    return t.filings().filter("ingest_status = 'indexed'").join(cited, "file_name", "left_anti").select("document_id")


@query("join_new_filings_anti_top1", """WITH n AS (SELECT f.*, row_number() OVER (PARTITION BY coverage_id ORDER BY CASE filing_type WHEN '10-Q' THEN 0 ELSE 1 END, filed_date DESC, document_id DESC) AS rn
    FROM v_filings f WHERE filing_type IN ('10-Q', '10-K') AND filed_date > DATE '2000-01-01' AND NOT EXISTS (SELECT 1 FROM v_filings x WHERE x.document_id = f.document_id AND x.ingest_status = 'indexed'))
    SELECT coverage_id, document_id FROM n WHERE rn = 1""")
def join_new_filings_anti_top1(spark, d):
    f = Tables(spark, d).filings()
    known = f.filter("ingest_status = 'indexed'").select("document_id")
    new = f.filter(F.col("filing_type").isin("10-Q", "10-K") & (F.col("filed_date") > F.lit("2000-01-01").cast("date"))).join(known, "document_id", "left_anti")
    return first_per(new, ["coverage_id"], F.when(F.col("filing_type") == "10-Q", 0).otherwise(1), F.desc("filed_date"), F.desc("document_id")).select("coverage_id", "document_id")


@query("join_duplicate_hash", """WITH h AS (SELECT document_id, coverage_id, min(document_id) OVER (PARTITION BY coverage_id, sha256(content)) AS first_id FROM v_corpus)
    SELECT document_id, first_id FROM h WHERE document_id <> first_id""")
def join_duplicate_hash(spark, d):
    """The first document of each (coverage, hash) by a partial aggregation; copies join it by hash, so no text moves."""
    c = Tables(spark, d).corpus().select("document_id", "coverage_id", F.sha2("content", 256).alias("hash"))
    first = c.groupBy("coverage_id", "hash").agg(F.min("document_id").alias("first_id"))
    return c.join(first, ["coverage_id", "hash"]).filter("document_id <> first_id").select("document_id", "first_id")


@query("join_prior_docs_self", "SELECT f.coverage_id, f.document_id, count(p.document_id) AS n_prior FROM v_filings f LEFT JOIN v_filings p ON p.coverage_id = f.coverage_id AND p.filed_date < f.filed_date GROUP BY 1, 2")
def join_prior_docs_self(spark, d):
    """Earlier filings of the coverage: a RANGE frame counts them, where a self join would pair them."""
    w = Window.partitionBy("coverage_id").orderBy(F.datediff("filed_date", F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
    return Tables(spark, d).filings().select("coverage_id", "document_id", F.count("*").over(w).alias("n_prior"))


@query("join_table_section_unknown", "SELECT c.document_id, coalesce(q.quality, -1) AS quality, coalesce(CASE WHEN q.quality = 1 THEN section END, 'unknown') AS section FROM v_corpus c LEFT JOIN labels q ON q.doc_id = c.document_id")
def join_table_section_unknown(spark, d):
    t = Tables(spark, d)
    j = t.corpus().select("document_id", "section").join(t.raw("labels").select(F.col("doc_id").alias("document_id"), "quality"), "document_id", "left")
    return j.select("document_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.when(F.col("quality") == 1, F.col("section")), F.lit("unknown")).alias("section"))


@query("join_recipients_role", "SELECT t.tenant_id, c_custkey AS user_id FROM v_tenants t JOIN nation ON n_regionkey = t.tenant_id JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def join_recipients_role(spark, d):
    t = Tables(spark, d)
    users = t.raw("customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.tenants().join(users, F.col("tenant_id") == F.col("n_regionkey")).select("tenant_id", F.col("c_custkey").alias("user_id"))


@query("filing_count_years", "SELECT coverage_id, count(*) AS n, count(DISTINCT period) AS n_periods, count(DISTINCT period) >= 3 AS enough FROM v_filings GROUP BY coverage_id")
def filing_count_years(spark, d):
    return Tables(spark, d).filings().groupBy("coverage_id").agg(F.count("*").alias("n"), F.count_distinct("period").alias("n_periods"), (F.count_distinct("period") >= 3).alias("enough"))


@query("doc_count_recompute", "SELECT coverage_id, count(*) FILTER (WHERE ingest_status = 'indexed') AS document_count FROM v_filings GROUP BY 1")
def doc_count_recompute(spark, d):
    return Tables(spark, d).filings().groupBy("coverage_id").agg(F.count_if(F.col("ingest_status") == "indexed").alias("document_count"))


@query("word_count", "SELECT document_id, len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS n_words FROM v_corpus")
def word_count_query(spark, d):
    return Tables(spark, d).corpus().select("document_id", word_count(F.col("content")).cast("long").alias("n_words"))


@query("median_font", "SELECT o_custkey AS document_id, o_orderkey % 7 + 1 AS page_number, median(6 + floor(o_totalprice) % 18) AS median_size, max(6 + floor(o_totalprice) % 18) AS max_size FROM orders GROUP BY 1, 2")
def median_font(spark, d):
    """Per page the median (mean of the two middles) and the largest of its blocks' font sizes."""
    size = 6 + F.floor("o_totalprice").cast("double") % 18
    blocks = Tables(spark, d).raw("orders").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 7 + 1).alias("page_number"), size.alias("size"))
    return blocks.groupBy("document_id", "page_number").agg(F.median("size").alias("median_size"), F.max("size").alias("max_size"))


@query("hydrate_notes_default", "SELECT c.coverage_id, coalesce(n.text, '') AS note FROM v_coverages c LEFT JOIN (SELECT item_id, text FROM benchmark) n ON n.item_id = c.coverage_id")
def hydrate_notes_default(spark, d):
    t = Tables(spark, d)
    return t.coverages().select("coverage_id").join(t.raw("benchmark").select(F.col("item_id").alias("coverage_id"), "text"), "coverage_id", "left").select("coverage_id", F.coalesce("text", F.lit("")).alias("note"))
