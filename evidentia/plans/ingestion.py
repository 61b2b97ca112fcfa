"""Sections, block kinds, chunks and tables of documents."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.text import block_kind, section_of
from ..operators.chunking import child_counts, children, grid_json, grid_markdown, parent_texts
from ..sources.views import Tables
from .registry import query

HEADED = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CASE WHEN role = 'user' THEN 'mda' ELSE 'risk_factors' END END AS found FROM conversations"


def _blocks(spark, d):
    """Conversations as documents of blocks; every third block is a heading."""
    c = Tables(spark, d).raw("conversations")
    heading = F.when(F.col("turn") % 3 == 0, F.when(F.col("role") == "user", "Item 7. Management's Discussion and Analysis").otherwise("ITEM 1A. RISK FACTORS"))
    return c.select("conv_id", "turn", F.char_length("text").alias("n"), section_of(heading).alias("found"))


def _filled(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return _blocks(spark, d).withColumn("section", F.coalesce(F.last("found", ignorenulls=True).over(w), F.lit("cover")))


@query("section_detect", f"SELECT conv_id, turn, found FROM ({HEADED}) WHERE found IS NOT NULL")
def section_detect(spark, d):
    return _blocks(spark, d).filter("found is not null").select("conv_id", "turn", "found")


@query("section_forward_fill", f"SELECT conv_id, turn, coalesce(last_value(found IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'cover') AS section FROM ({HEADED})")
def section_forward_fill(spark, d):
    return _filled(spark, d).select("conv_id", "turn", "section")


@query("section_first_page", f"SELECT conv_id, section, min(turn) AS first_page FROM (SELECT conv_id, turn, coalesce(last_value(found IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'cover') AS section FROM ({HEADED})) GROUP BY 1, 2")
def section_first_page(spark, d):
    return _filled(spark, d).groupBy("conv_id", "section").agg(F.min("turn").alias("first_page"))


@query("section_char_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM conversations")
def section_char_offsets(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return _blocks(spark, d).select("conv_id", "turn", F.coalesce(F.sum(F.col("n") + 2).over(w), F.lit(0)).cast("long").alias("char_start"))


@query("block_classify", r"""WITH b AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '- ' || text WHEN 1 THEN 'Table 3: ' || text ELSE text END AS t, length(text)::DOUBLE AS size FROM conversations),
    s AS (SELECT *, max(size) OVER (PARTITION BY conv_id) AS largest, median(size) OVER (PARTITION BY conv_id) AS med FROM b)
    SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'list_item' WHEN turn % 4 = 1 THEN 'caption' WHEN size >= largest - 0.5 AND (size > med * 1.15 OR size - med > 2) THEN 'heading' ELSE 'paragraph' END AS kind FROM s""")
def block_classify(spark, d):
    k = F.col("turn") % 4
    t = F.when(k == 0, F.concat(F.lit("- "), "text")).when(k == 1, F.concat(F.lit("Table 3: "), "text")).otherwise(F.col("text"))
    c = Tables(spark, d).raw("conversations").select("conv_id", "turn", t.alias("t"), F.char_length("text").cast("double").alias("size"))
    per = c.groupBy("conv_id").agg(F.max("size").alias("largest"), F.median("size").alias("med"))
    return c.join(per, "conv_id").select("conv_id", "turn", block_kind(F.col("t"), F.col("size"), F.col("largest"), F.col("med")).alias("kind"))


def _parents(spark, d):
    c = Tables(spark, d).corpus().withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
    return c.select("document_id", F.posexplode(parent_texts(F.col("content"))).alias("parent", "content")).withColumn("chunk_id", F.col("document_id") * 10000 + F.col("parent"))


@query("chunk_parents")
def chunk_parents(spark, d):
    return _parents(spark, d).select("chunk_id", "document_id", F.char_length("content").alias("n_chars"))


@query("chunk_children")
def chunk_children(spark, d):
    return children(_parents(spark, d), "chunk_id", "content").select("chunk_id", "child", "content", "token_estimate")


@query("chunk_offsets")
def chunk_offsets(spark, d):
    return children(_parents(spark, d), "chunk_id", "content").select("chunk_id", "child", "char_start", "char_end")


@query("chunk_searchable_count")
def chunk_searchable_count(spark, d):
    counts = child_counts(_parents(spark, d).select("document_id", "content"), "document_id", "content")
    return counts.groupBy("document_id").agg(F.sum("n").alias("n_searchable"))


def _grid(spark, d):
    t = Tables(spark, d).raw("nation")
    grid = F.array(F.array(F.lit("Metric"), F.lit("2024"), F.lit("2023")), F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")), F.array(F.lit("Total"), F.lit("1")))
    return t.select("n_nationkey", grid.alias("grid"))


@query("grid_markdown", "SELECT n_nationkey, '| Metric | 2024 | 2023 |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || n_name || ' | ' || n_nationkey || ' | ' || n_regionkey || ' |' || chr(10) || '| Total | 1 |  |' AS markdown FROM nation")
def grid_markdown_query(spark, d):
    return _grid(spark, d).select("n_nationkey", grid_markdown(F.col("grid")).alias("markdown"))


@query("grid_json", """SELECT n_nationkey, '[{"label":"' || n_name || '","values":{"2024":"' || n_nationkey || '","2023":"' || n_regionkey || '"}},{"label":"Total","values":{"2024":"1","2023":""}}]' AS json FROM nation""")
def grid_json_query(spark, d):
    return _grid(spark, d).select("n_nationkey", grid_json(F.col("grid")).alias("json"))


@query("chunk_tables", "SELECT n_nationkey, 'TABLE: ' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Untitled' END || chr(10) || chr(10) || '| Metric | 2024 | 2023 |' AS head FROM nation")
def chunk_tables(spark, d):
    t = Tables(spark, d).raw("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("caption"))
    g = _grid(spark, d).select("n_nationkey", F.substring_index(grid_markdown(F.col("grid")), "\n", 1).alias("md"))
    return t.join(g, "n_nationkey").select("n_nationkey", F.concat(F.lit("TABLE: "), F.coalesce("caption", F.lit("Untitled")), F.lit("\n\n"), "md").alias("head"))
