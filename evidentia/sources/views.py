"""The domain's tables over the synthetic tables: each as a DataFrame and as SQL for the twin."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.citation import BLANKS


class Tables:
    """Lazy domain tables of one folder; only the columns a query uses are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        """The documents for work that is heavy per row: a table of fewer files than cores is dealt out, since its scan has few tasks.

        Their number isn't fixed: adaptive execution splits what is over the advisory size, so a task's share doesn't grow with the table.
        """
        d, cores = self.raw("documents"), self.spark.sparkContext.defaultParallelism
        return d.hint("rebalance", "doc_id") if len(d.inputFiles()) < cores else d

    def tenants(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("tenant_id"), F.col("r_name").alias("tenant_name"), (F.lit(1000) * (F.col("r_regionkey") + 1)).cast("double").alias("alert_threshold"))

    def industries(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("industry_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("primer")).alias("primer_content"))

    def coverages(self) -> DataFrame:
        exchange = F.create_map(*[F.lit(x) for pair in (("MACHINERY", "NYSE"), ("BUILDING", "NASDAQ"), ("AUTOMOBILE", "LSE"), ("FURNITURE", "TSX"), ("HOUSEHOLD", "ASX")) for x in pair])
        status = F.array(*[F.lit(x) for x in ("setup", "active", "archived")])
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        c = self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select(
            F.col("c_custkey").alias("coverage_id"), F.col("n_regionkey").alias("tenant_id"), F.upper("c_name").alias("ticker"), F.try_element_at(exchange, F.col("c_mktsegment")).alias("exchange"),
            F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("industry_id"), F.element_at(status, (F.col("c_custkey") % 3 + 1).cast("int")).alias("status"),
        )

    def filings(self) -> DataFrame:
        kind = F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").when(F.col("o_orderpriority") == "2-HIGH", "10-Q").when(F.col("o_orderpriority") == "3-MEDIUM", "8-K").otherwise("Custom")
        status = F.when(F.col("o_orderstatus") == "F", "indexed").when(F.col("o_orderstatus") == "O", "pending").otherwise("review_needed")
        o = self.raw("orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("coverage_id"), kind.alias("filing_type"), F.col("o_orderdate").cast("date").alias("filed_date"), status.alias("ingest_status"), F.concat(F.lit("doc_"), F.col("o_orderkey").cast("string")).alias("file_name"))
        from ..functions.period import fiscal_period

        return o.withColumn("period", fiscal_period(F.col("filing_type"), F.col("filed_date")))

    def kpis(self) -> DataFrame:
        """One row per observation: no key of lineitem is unique, so ``obs`` orders equal dates."""
        name = F.when(F.col("l_returnflag") == "A", "revenue").when(F.col("l_returnflag") == "N", "gross_profit").otherwise("net_income")
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        k = self.raw("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        obs = F.format_string("%012d-%03d-%012d-%012d-%018d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
        return k.select(F.col("o_custkey").alias("coverage_id"), name.alias("kpi_name"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"), F.col("l_extendedprice").alias("value"), F.col("o_orderdate").cast("date").alias("extracted_at"), obs.alias("obs"), "l_orderkey")

    def series(self) -> DataFrame:
        """Sums by coverage, KPI and year or quarter; money adds up as decimals."""
        k = self.kpis().select("coverage_id", "kpi_name", "year", "quarter", F.col("value").cast("decimal(18,2)").alias("v"))
        k = k.groupBy("coverage_id", "kpi_name", "year", "quarter").agg(F.sum("v").alias("v"))  # the years add up the quarters
        annual = k.groupBy("coverage_id", "kpi_name", "year").agg(F.sum("v").cast("double").alias("value")).select("coverage_id", "kpi_name", F.lit("annual").alias("period_type"), "year", F.lit(0).alias("quarter"), F.concat(F.lit("FY"), F.col("year")).alias("period"), "value")
        quarterly = k.select("coverage_id", "kpi_name", F.lit("quarterly").alias("period_type"), "year", "quarter", F.concat(F.lit("Q"), F.col("quarter"), F.lit(" "), F.col("year")).alias("period"), F.col("v").cast("double").alias("value"))
        return annual.unionByName(quarterly)

    def audit(self) -> DataFrame:
        t = F.col("event_type")
        model = F.when(t == "view", "claude-large").when(t == "click", "gpt-4o").when(t == "purchase", "ollama/llama").when(t == "signup", "")
        return self.raw("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).cast("int").alias("tenant_id"), F.when(t != "signup", F.col("user_id")).alias("coverage_id"), model.alias("llm_used"), F.floor(F.col("value") * 1000).cast("long").alias("tokens_used"), F.col("ts").alias("created_at"))

    def task_events(self) -> DataFrame:
        t = F.col("event_type")
        kind = F.when(t == "view", "progress").when(t == "click", "chunk").when(t == "signup", "citation_found").when(t == "purchase", "complete").otherwise("error")
        return self.raw("events").select(F.col("user_id").alias("task_id"), kind.alias("type"), "ts", "event_id", "value")

    def corpus(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("coverage_id"), (F.col("doc_id") % 5).cast("int").alias("tenant_id"), F.col("text").alias("content"), F.col("lang").alias("section"), "n_chars")

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("industry_id"))

    def quotes(self) -> DataFrame:
        """Quotes to check against the corpus; every third is spelt backwards, so its words stand nowhere."""
        return self.raw("benchmark").select(F.col("item_id").alias("quote_id"), F.when(F.col("item_id") % 3 == 1, F.reverse("text")).otherwise(F.col("text")).alias("text"))

    def claims(self) -> DataFrame:
        """Every benchmark item's text as it stands, and besides every third spelt backwards, under a negative id."""
        b = self.raw("benchmark").select(F.col("item_id").alias("quote_id"), "text")
        return b.unionAll(b.filter("quote_id % 3 = 1").select((-1 - F.col("quote_id")).alias("quote_id"), F.reverse("text").alias("text")))

    def answers(self) -> DataFrame:
        """Markdown answers made from whole documents: a paragraph per sentence or line; on even ids every second one cites itself in full."""
        d = self.documents()
        parts = F.transform(F.split(F.replace("text", F.lit('"'), F.lit(" ")), r"\n|(?<=[.!?])\s+", -1), lambda p: F.btrim(p, F.lit(BLANKS)))
        d = d.withColumn("parts", F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>")))
        even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
        cite = lambda p: F.concat(F.lit(" [doc_"), F.col("doc_id").cast("string"), F.lit(", "), F.coalesce("source", F.lit("unknown")), F.lit(']: "'), p, F.lit('"'))
        paragraphs = F.array_join(F.transform("parts", lambda p, i: F.when(even & (i % 2 == 0), F.concat(p, cite(p))).otherwise(p)), "\n\n")
        number = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Revenue increased to "), F.coalesce(F.col("n_chars"), F.lit(0)).cast("string"), F.lit(" million.")))
        last = F.when(even & (F.size("parts") > 0), cite(F.get("parts", F.size("parts") - 1))).otherwise("")
        spec = F.when(F.col("doc_id") % 5 == 0, F.lit(" We expect growth to continue. This suggests strength.")).otherwise("")
        kind = F.when(F.col("doc_id") % 4 == 0, "Fast Grower").when(F.col("doc_id") % 4 == 1, "Stalwart").otherwise("Not found in uploaded documents.")
        body = F.concat(F.lit("### Q1: Business\n"), paragraphs, F.lit("\n\n### Q2: Numbers\n"), F.coalesce(number, F.lit("Margins declined over time.")), last, spec, F.lit("\n\n### Q5: Type\n"), kind)
        return d.select(F.col("doc_id").alias("output_id"), F.col("source").alias("coverage_id"), body.alias("content"))

    def _body(self):
        """A document's whole text on one line, without double quotes."""
        return F.regexp_replace(F.coalesce("text", F.lit("")), '["\\r\\n]+', " ")

    def reports(self) -> DataFrame:
        """Quarterly updates made from whole texts: three sections, and a summary in which every fourth report lacks a verdict."""
        d, i = self.documents(), F.col("doc_id")
        pick = lambda n, *words: F.element_at(F.array(*[F.lit(w) for w in words]), (i % n + 1).cast("int"))
        cite = F.concat(F.lit(" [doc_"), i.cast("string"), F.lit(", "), F.coalesce("source", F.lit("web")), F.lit(']: "as reported in filing '), i.cast("string"), F.lit('"'))
        content = F.concat(
            F.lit("## SECTION 1: Guidance\n"), self._body(), F.when(i % 2 == 0, cite).otherwise(""),
            F.lit("\n\n## SECTION 2: Results\nRevenue increased to "), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit(" million."), F.when(i % 3 == 0, cite).otherwise(""),
            F.lit("\n\n## SECTION 3: Outlook\n"), F.when(i % 5 == 0, "Not found in uploaded documents.").otherwise("Margins declined over time."),
            F.lit("\n\n## FINAL SUMMARY\nExecution vs expectations: "), pick(3, "Improving", "Stable", "deteriorating"),
            pick(4, "\nManagement credibility: Strong", "\nManagement credibility: Mixed", "\nmanagement credibility: weak", ""), F.lit("\nBusiness momentum vs last year: "), pick(2, "Better", "Same"),
        )
        return d.select(i.alias("output_id"), (i % 50).alias("coverage_id"), content.alias("content"))

    def primers(self) -> DataFrame:
        """Industry primers of six numbered sections and five bullets; some lack one of them."""
        d, i = self.documents(), F.col("doc_id")
        cite = F.concat(F.lit(' [web, https://example.com, 2024]: "as reported by source '), i.cast("string"), F.lit('"'))
        heads = ("Market", "Players", "Rules", "Technology", "Economics")
        short = F.concat(*[F.lit(f"\n\n## {k}. {h}\nShort and plain.") for k, h in enumerate(heads, 2)])
        bullets = F.lit("\n- engine\n- lever\n- constraint\n- risk")
        content = F.concat(F.lit("## 1. Overview\n"), self._body(), F.when(i % 2 == 0, cite).otherwise(""), F.when(i % 4 == 3, F.regexp_replace(short, r"\n\n## 6\. Economics\nShort and plain\.", "")).otherwise(short), F.lit("\n\n## Investor Synthesis"), bullets, F.when(i % 3 != 0, "\n- winners").otherwise(""))
        return d.select(i.alias("industry_id"), content.alias("content"))

    def cases(self) -> DataFrame:
        """Outputs under evaluation, by suite; every 29th failed to run. Each second one cites a benchmark item."""
        d, i = self.documents(), F.col("doc_id")
        cite = F.concat(F.lit(" [item_"), (i % 40).cast("string"), F.lit(", "), F.coalesce("source", F.lit("web")), F.lit(']: "as reported in filing '), i.cast("string"), F.lit('"'))
        content = F.concat(
            F.lit("### Q1: Business\n"), self._body(), F.lit("\n\n### Q2: Numbers\nRevenue increased to "), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit(" million."), F.when(i % 2 == 0, cite).otherwise(""),
            F.lit("\n\n### Q3: Margin\n"), F.when(i % 5 == 0, "Not found in uploaded documents.").otherwise("Gross margin was 41% of sales."),
            F.lit("\n\n### Q5: Type\n"), F.when(i % 4 == 0, "Fast Grower").otherwise("Stalwart"), F.lit("\n\n"), (i % 7).cast("string"), F.lit(" KPI value(s) upserted"),
        )
        return d.select(i.alias("case_id"), (i % 3).cast("int").alias("suite"), F.when(i % 29 != 0, content).alias("content"))

    def cells(self) -> DataFrame:
        """Tables of orders as cells, as a layout model returns them; some cells and page numbers are missing."""
        x = self.raw("lineitem").join(self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("document_id")), "l_orderkey")
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        x = x.select("document_id", F.col("l_orderkey").alias("table_id"), F.row_number().over(w).alias("row"), F.concat(F.lit(" line "), F.col("l_linenumber").cast("string"), F.lit(" ")).alias("a"), F.col("l_quantity").cast("long").cast("string").alias("b"), F.col("l_returnflag").alias("c"))
        cell = lambda row, col, value, column_header, row_header: F.struct(row.alias("row"), F.lit(col).alias("col"), value.alias("value"), F.lit(column_header).alias("column_header"), F.lit(row_header).alias("row_header"))
        body = [cell(F.col("row"), 0, F.col("a"), False, True), cell(F.col("row"), 1, F.col("b"), False, False), cell(F.col("row"), 2, F.col("c"), False, False)]
        top = [cell(F.lit(0), k, F.lit(v), True, False) for k, v in enumerate(("Item", " Quantity", "Flag "))]
        every = x.select("document_id", "table_id", F.explode(F.when(F.col("row") == 1, F.array(*body, *top)).otherwise(F.array(*body))).alias("x"))
        page = F.when(F.col("table_id") % 5 != 0, F.col("table_id") % 7 + 1)
        return every.select("document_id", "table_id", page.alias("page_no"), "x.*").filter((F.col("table_id") + F.col("row") * 3 + F.col("col")) % 11 != 0)

    def page_blocks(self) -> DataFrame:
        """Text blocks of the pages that the tables stand on: captions, sentences, and the cells' own texts."""
        o = self.raw("orders")
        k = F.col("o_orderkey")
        text = F.when(k % 4 == 0, F.concat(F.lit(" Table of order "), k.cast("string"))).when(k % 4 == 1, F.lit("17")).when(k % 4 == 2, "It ends here.").otherwise("Item")
        return o.select(F.col("o_custkey").alias("document_id"), (k % 7 + 1).alias("page_number"), k.alias("seq"), text.alias("text"))


VIEWS = {
    "v_tenants": "SELECT r_regionkey AS tenant_id, r_name AS tenant_name, CAST(1000 * (r_regionkey + 1) AS DOUBLE) AS alert_threshold FROM region",
    "v_industries": "SELECT n_nationkey AS industry_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'primer' END AS primer_content FROM nation",
    "v_coverages": """SELECT c_custkey AS coverage_id, n_regionkey AS tenant_id, upper(c_name) AS ticker,
        CASE c_mktsegment WHEN 'MACHINERY' THEN 'NYSE' WHEN 'BUILDING' THEN 'NASDAQ' WHEN 'AUTOMOBILE' THEN 'LSE' WHEN 'FURNITURE' THEN 'TSX' WHEN 'HOUSEHOLD' THEN 'ASX' END AS exchange,
        CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS industry_id, CASE c_custkey % 3 WHEN 0 THEN 'setup' WHEN 1 THEN 'active' ELSE 'archived' END AS status
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_filings": """SELECT o_orderkey AS document_id, o_custkey AS coverage_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '8-K' ELSE 'Custom' END AS filing_type,
        CAST(o_orderdate AS DATE) AS filed_date, CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'pending' ELSE 'review_needed' END AS ingest_status,
        'doc_' || o_orderkey AS file_name,
        CASE WHEN o_orderpriority = '2-HIGH' THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) ELSE 'FY' || year(o_orderdate) END AS period FROM orders""",
    "v_kpis": """SELECT o_custkey AS coverage_id, CASE l_returnflag WHEN 'A' THEN 'revenue' WHEN 'N' THEN 'gross_profit' ELSE 'net_income' END AS kpi_name,
        year(l_shipdate) AS year, quarter(l_shipdate) AS quarter, l_extendedprice AS value, CAST(o_orderdate AS DATE) AS extracted_at,
        printf('%012d-%03d-%012d-%012d-%018d', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS obs, l_orderkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_series": """SELECT coverage_id, kpi_name, 'annual' AS period_type, year, 0 AS quarter, 'FY' || year AS period, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM v_kpis GROUP BY coverage_id, kpi_name, year
        UNION ALL SELECT coverage_id, kpi_name, 'quarterly', year, quarter, 'Q' || quarter || ' ' || year, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) FROM v_kpis GROUP BY coverage_id, kpi_name, year, quarter""",
    "v_audit": """SELECT event_id AS id, CAST(user_id % 5 AS INTEGER) AS tenant_id, CASE WHEN event_type <> 'signup' THEN user_id END AS coverage_id,
        CASE event_type WHEN 'view' THEN 'claude-large' WHEN 'click' THEN 'gpt-4o' WHEN 'purchase' THEN 'ollama/llama' WHEN 'signup' THEN '' END AS llm_used,
        CAST(floor(value * 1000) AS BIGINT) AS tokens_used, ts AS created_at FROM events""",
    "v_task_events": """SELECT user_id AS task_id, CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'chunk' WHEN 'signup' THEN 'citation_found' WHEN 'purchase' THEN 'complete' ELSE 'error' END AS type, ts, event_id, value FROM events""",
    "v_corpus": "SELECT doc_id AS document_id, source AS coverage_id, CAST(doc_id % 5 AS INTEGER) AS tenant_id, text AS content, lang AS section, n_chars FROM documents",
    "v_vectors": "SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS vector, label AS industry_id FROM embeddings",
    "v_quotes": "SELECT item_id AS quote_id, CASE WHEN item_id % 3 = 1 THEN reverse(text) ELSE text END AS text FROM benchmark",
    "v_claims": "SELECT item_id AS quote_id, text FROM benchmark UNION ALL SELECT -1 - item_id, reverse(text) FROM benchmark WHERE item_id % 3 = 1",
    "v_answers": """SELECT doc_id AS output_id, source AS coverage_id, '### Q1: Business' || chr(10)
        || array_to_string(list_transform(parts, lambda p, i: CASE WHEN doc_id % 2 = 0 AND i % 2 = 1 THEN p || cite || p || '"' ELSE p END), chr(10) || chr(10)) || chr(10) || chr(10) || '### Q2: Numbers' || chr(10)
        || CASE WHEN doc_id % 3 = 0 THEN 'Revenue increased to ' || coalesce(n_chars, 0) || ' million.' ELSE 'Margins declined over time.' END
        || CASE WHEN doc_id % 2 = 0 AND len(parts) > 0 THEN cite || parts[len(parts)] || '"' ELSE '' END
        || CASE WHEN doc_id % 5 = 0 THEN ' We expect growth to continue. This suggests strength.' ELSE '' END
        || chr(10) || chr(10) || '### Q5: Type' || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Fast Grower' WHEN 1 THEN 'Stalwart' ELSE 'Not found in uploaded documents.' END AS content
        FROM (SELECT doc_id, source, n_chars, ' [doc_' || doc_id || ', ' || coalesce(source, 'unknown') || ']: "' AS cite,
            list_filter(list_transform(string_split(regexp_replace(replace(coalesce(text, ''), '"', ' '), '([.!?])\\s+|\\n', '\\1' || chr(10), 'g'), chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS parts FROM documents)""",
    "v_reports": """SELECT doc_id AS output_id, doc_id % 50 AS coverage_id,
        '## SECTION 1: Guidance' || chr(10) || regexp_replace(coalesce(text, ''), '["\\r\\n]+', ' ', 'g') || CASE WHEN doc_id % 2 = 0 THEN ' [doc_' || doc_id || ', ' || coalesce(source, 'web') || ']: "as reported in filing ' || doc_id || '"' ELSE '' END
        || chr(10) || chr(10) || '## SECTION 2: Results' || chr(10) || 'Revenue increased to ' || coalesce(n_chars, 0) || ' million.' || CASE WHEN doc_id % 3 = 0 THEN ' [doc_' || doc_id || ', ' || coalesce(source, 'web') || ']: "as reported in filing ' || doc_id || '"' ELSE '' END
        || chr(10) || chr(10) || '## SECTION 3: Outlook' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'Not found in uploaded documents.' ELSE 'Margins declined over time.' END
        || chr(10) || chr(10) || '## FINAL SUMMARY' || chr(10) || 'Execution vs expectations: ' || CASE doc_id % 3 WHEN 0 THEN 'Improving' WHEN 1 THEN 'Stable' ELSE 'deteriorating' END
        || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'Management credibility: Strong' WHEN 1 THEN chr(10) || 'Management credibility: Mixed' WHEN 2 THEN chr(10) || 'management credibility: weak' ELSE '' END
        || chr(10) || 'Business momentum vs last year: ' || CASE doc_id % 2 WHEN 0 THEN 'Better' ELSE 'Same' END AS content FROM documents""",
    "v_primers": """SELECT doc_id AS industry_id, '## 1. Overview' || chr(10) || regexp_replace(coalesce(text, ''), '["\\r\\n]+', ' ', 'g') || CASE WHEN doc_id % 2 = 0 THEN ' [web, https://example.com, 2024]: "as reported by source ' || doc_id || '"' ELSE '' END
        || list_aggregate(list_transform(CASE WHEN doc_id % 4 = 3 THEN ['2. Market', '3. Players', '4. Rules', '5. Technology'] ELSE ['2. Market', '3. Players', '4. Rules', '5. Technology', '6. Economics'] END, lambda h: chr(10) || chr(10) || '## ' || h || chr(10) || 'Short and plain.'), 'string_agg', '')
        || chr(10) || chr(10) || '## Investor Synthesis' || chr(10) || '- engine' || chr(10) || '- lever' || chr(10) || '- constraint' || chr(10) || '- risk' || CASE WHEN doc_id % 3 <> 0 THEN chr(10) || '- winners' ELSE '' END AS content FROM documents""",
    "v_cases": """SELECT doc_id AS case_id, CAST(doc_id % 3 AS INTEGER) AS suite, CASE WHEN doc_id % 29 <> 0 THEN
        '### Q1: Business' || chr(10) || regexp_replace(coalesce(text, ''), '["\\r\\n]+', ' ', 'g') || chr(10) || chr(10) || '### Q2: Numbers' || chr(10) || 'Revenue increased to ' || coalesce(n_chars, 0) || ' million.'
        || CASE WHEN doc_id % 2 = 0 THEN ' [item_' || doc_id % 40 || ', ' || coalesce(source, 'web') || ']: "as reported in filing ' || doc_id || '"' ELSE '' END
        || chr(10) || chr(10) || '### Q3: Margin' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'Not found in uploaded documents.' ELSE 'Gross margin was 41% of sales.' END
        || chr(10) || chr(10) || '### Q5: Type' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN 'Fast Grower' ELSE 'Stalwart' END || chr(10) || chr(10) || doc_id % 7 || ' KPI value(s) upserted' END AS content FROM documents""",
    "v_cells": """SELECT document_id, table_id, CASE WHEN table_id % 5 <> 0 THEN table_id % 7 + 1 END AS page_no, row, col, value, row = 0 AS column_header, row > 0 AND col = 0 AS row_header FROM (
        SELECT o_custkey AS document_id, l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row,
            unnest([0, 1, 2]) AS col, unnest([' line ' || l_linenumber || ' ', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), l_returnflag]) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        UNION ALL SELECT DISTINCT o_custkey, l_orderkey, 0, unnest([0, 1, 2]), unnest(['Item', ' Quantity', 'Flag ']) FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
        WHERE (table_id + row * 3 + col) % 11 <> 0""",
    "v_page_blocks": """SELECT o_custkey AS document_id, o_orderkey % 7 + 1 AS page_number, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN ' Table of order ' || o_orderkey WHEN 1 THEN '17' WHEN 2 THEN 'It ends here.' ELSE 'Item' END AS text FROM orders""",
}


def with_views(sql: str) -> str:
    """Put the views that a statement names before it as common table expressions."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEWS and name not in wanted:
                need(VIEWS[name])
                wanted.append(name)

    need(sql)
    if not wanted:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
