"""Tables and pages as a layout model returns them: cells, headers, captions, sections, coverage."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.markdown import strip
from ..operators.chunking import grid_markdown
from ..sources.views import Tables
from .registry import query

CELLS = "cl AS (SELECT document_id, table_id, coalesce(page_no, 1) AS page_number, row, col, trim(value) AS value, column_header OR row_header AS is_header FROM v_cells)"
CAPTION_LENGTH = 150
HEADS = """hd AS (SELECT table_id, list_transform(range(0, max(col) + 1), lambda c: coalesce(list_filter(list({'c': col, 'v': value}) FILTER (WHERE row = 0), lambda x: x.c = c)[1].v, '')) AS column_headers,
    list_transform(range(1, max(row) + 1), lambda r: coalesce(list_filter(list({'r': row, 'v': value}) FILTER (WHERE col = 0), lambda x: x.r = r)[1].v, '')) AS row_headers FROM cl GROUP BY 1)"""
CAPTIONS = f"""tb AS (SELECT DISTINCT document_id, table_id, page_number FROM cl),
    cap AS (SELECT t.table_id, arg_max(trim(b.text), b.seq) AS c FROM tb t JOIN v_page_blocks b ON b.document_id = t.document_id AND b.page_number = t.page_number
        WHERE trim(b.text) <> '' AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.table_id = t.table_id AND cl.value = trim(b.text)) GROUP BY 1),
    cpt AS (SELECT tb.table_id, CASE WHEN length(c) < {CAPTION_LENGTH} AND NOT ends_with(c, '.') THEN c END AS caption FROM tb LEFT JOIN cap ON cap.table_id = tb.table_id)"""


def _cells(spark, d):
    c = Tables(spark, d).cells()
    return c.select("document_id", "table_id", F.coalesce("page_no", F.lit(1)).alias("page_number"), "row", "col", strip(F.col("value")).alias("value"), (F.col("column_header") | F.col("row_header")).alias("is_header"))


def _headers(cells):
    """Row 0 names the columns, column 0 of the other rows names the rows; what is missing is empty. One row per table."""
    at = lambda key, cond: F.map_from_entries(F.collect_list(F.when(cond, F.struct(key, "value"))))
    g = cells.groupBy("table_id").agg(at("col", F.col("row") == 0).alias("top"), at("row", (F.col("col") == 0) & (F.col("row") > 0)).alias("left"), F.max("col").alias("n"), F.max("row").alias("m"))
    pick = lambda m, a, b: F.when(b >= a, F.transform(F.sequence(a, b), lambda i: F.coalesce(F.try_element_at(m, i), F.lit("")))).otherwise(F.array().cast("array<string>"))
    return g.select("table_id", pick(F.col("top"), F.lit(0), F.col("n")).alias("column_headers"), pick(F.col("left"), F.lit(1), F.col("m")).alias("row_headers"))


def _candidates(spark, d, cells):
    """(table_id, places, c): the last block of a table's page that isn't one of its cells. A table's cells are gathered once, and blocks meet that one row."""
    tables = cells.groupBy("table_id").agg(F.collect_set(F.struct("document_id", "page_number")).alias("places"), F.collect_set("value").alias("values"))
    tables = tables.select("table_id", "values", F.explode("places").alias("p")).select("table_id", "values", "p.*")
    blocks = Tables(spark, d).page_blocks().withColumn("text", strip(F.col("text"))).filter("text <> ''")
    other = ~F.array_contains("values", F.col("text"))
    near = tables.join(blocks, ["document_id", "page_number"], "left").withColumn("place", F.struct("document_id", "page_number"))
    return near.groupBy("table_id").agg(F.collect_set("place").alias("places"), F.max_by(F.when(other, F.col("text")), F.when(other, F.col("seq"))).alias("c"))


def _captions(spark, d, cells):
    """A table's candidate, if it is short and no sentence: one row per place of a table."""
    fits = (F.char_length("c") < CAPTION_LENGTH) & ~F.col("c").endswith(".")
    return _candidates(spark, d, cells).select("table_id", F.when(fits, F.col("c")).alias("caption"), F.explode("places")).select("table_id", "caption")


@query("table_cells", f"WITH {CELLS} SELECT * FROM cl")
def table_cells(spark, d):
    return _cells(spark, d)


@query("table_headers", f"WITH {CELLS}, {HEADS} SELECT table_id, array_to_string(column_headers, '|') AS column_headers, array_to_string(row_headers, '|') AS row_headers FROM hd")
def table_headers(spark, d):
    return _headers(_cells(spark, d)).select("table_id", F.array_join("column_headers", "|").alias("column_headers"), F.array_join("row_headers", "|").alias("row_headers"))


@query("table_index_per_page", f"WITH {CELLS} SELECT document_id, table_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY table_id) - 1 AS table_index FROM (SELECT DISTINCT document_id, table_id, page_number FROM cl)")
def table_index_per_page(spark, d):
    t = _cells(spark, d).select("document_id", "table_id", "page_number").distinct()
    return t.withColumn("table_index", F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("table_id")) - 1)


@query("table_caption", f"WITH {CELLS}, {CAPTIONS} SELECT table_id, caption FROM cpt")
def table_caption(spark, d):
    return _captions(spark, d, _cells(spark, d))


@query("caption_candidates", f"WITH {CELLS}, {CAPTIONS} SELECT table_id, c AS candidate FROM cap")
def caption_candidates(spark, d):
    return _candidates(spark, d, _cells(spark, d)).filter("c is not null").select("table_id", F.col("c").alias("candidate"))


@query("chunk_table_render", f"""WITH {CELLS}, {CAPTIONS}, g AS (SELECT table_id, row, list_transform([0, 1, 2], lambda c: coalesce(list_filter(list({{'c': col, 'v': value}}), lambda x: x.c = c)[1].v, '')) AS v FROM cl GROUP BY 1, 2),
    m AS (SELECT table_id, string_agg('| ' || array_to_string(v, ' | ') || ' |' || CASE WHEN row = 0 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY row) AS md, min(row) AS first_row FROM g GROUP BY 1)
    SELECT m.table_id, 'TABLE: ' || coalesce(caption, 'Untitled') || chr(10) || chr(10) || md AS content FROM m JOIN cpt ON cpt.table_id = m.table_id WHERE first_row = 0""")
def chunk_table_render(spark, d):
    """A table's chunk: its caption and its whole grid, for tables that have a header row."""
    cells = _cells(spark, d)
    value = lambda i: F.coalesce(F.max(F.when(F.col("col") == i, F.col("value"))), F.lit(""))
    rows = cells.groupBy("table_id", "row").agg(F.array(*map(value, range(3))).alias("v"))
    grids = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "v"))).alias("rows")).filter(F.col("rows")[0]["row"] == 0)
    md = grids.select("table_id", grid_markdown(F.transform("rows", lambda r: r["v"])).alias("md"))
    return md.join(_captions(spark, d, cells), "table_id").select("table_id", F.concat(F.lit("TABLE: "), F.coalesce("caption", F.lit("Untitled")), F.lit("\n\n"), "md").alias("content"))


@query("sections_tables_leftovers", f"""WITH {CELLS}, t AS (SELECT DISTINCT document_id, table_id, 'p' || page_number AS section FROM cl), s AS (SELECT DISTINCT document_id, 'p' || page_number AS section FROM v_page_blocks WHERE seq % 3 = 0)
    SELECT coalesce(s.document_id, t.document_id) AS document_id, coalesce(s.section, t.section) AS section, table_id, s.section IS NULL AS leftover FROM s FULL JOIN t ON s.document_id = t.document_id AND s.section = t.section""")
def sections_tables_leftovers(spark, d):
    """Sections with their tables, sections without any, and tables whose section has no text."""
    part = F.concat(F.lit("p"), F.col("page_number").cast("string")).alias("section")
    tables = _cells(spark, d).select("document_id", "table_id", part).distinct()
    sections = Tables(spark, d).page_blocks().filter("seq % 3 = 0").select("document_id", part).distinct().withColumn("known", F.lit(True))
    return sections.join(tables, ["document_id", "section"], "full").select("document_id", "section", "table_id", F.col("known").isNull().alias("leftover"))


AREA = "greatest((doc_id % 4) * 612.0::DOUBLE * 792, 1.0::DOUBLE)"


def _pages(spark, d):
    """Documents as pages of some area; a page without area counts as 1."""
    area = F.greatest((F.col("doc_id") % 4) * 612.0 * 792, F.lit(1.0))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\na\tb\tc"))).otherwise(F.coalesce("text", F.lit("")))
    return Tables(spark, d).raw("documents").select("doc_id", "source", text.alias("text"), area.alias("area"))


PAGES = f"pg AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || chr(10) || 'a' || chr(9) || 'b' || chr(9) || 'c' ELSE coalesce(text, '') END AS text, {AREA} AS area FROM documents)"


@query("page_text_coverage", f"WITH {PAGES} SELECT doc_id, round(length(text) / (area / 100), 9) AS coverage FROM pg")
def page_text_coverage(spark, d):
    return _pages(spark, d).select("doc_id", F.round(F.char_length("text") / (F.col("area") / 100), 9).alias("coverage"))


@query("page_coverage_mean", f"WITH {PAGES} SELECT coalesce(source, '') AS source, round(coalesce(avg(length(text) / (area / 100)), 0.0::DOUBLE), 6) AS coverage FROM pg GROUP BY 1")
def page_coverage_mean(spark, d):
    p = _pages(spark, d).groupBy(F.coalesce("source", F.lit("")).alias("source"))
    return p.agg(F.round(F.coalesce(F.avg(F.char_length("text") / (F.col("area") / 100)), F.lit(0.0)), 6).alias("coverage"))


@query("page_has_tables", rf"WITH {PAGES} SELECT doc_id, regexp_matches(text, '\t.*\t|│') AS has_tables FROM pg")
def page_has_tables(spark, d):
    return _pages(spark, d).select("doc_id", F.exists(F.split("text", "\n", -1), lambda b: b.rlike(r"\t.*\t|│")).alias("has_tables"))
