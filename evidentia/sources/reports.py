"""JSON and YAML that sit beside the tables: golden cases, manifests, vocabularies, and the evaluation's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(label, coverage_id) of the coverages of a manifest, or of a folder of them; Spark's error if it is missing."""
    m = spark.read.schema("coverages map<string, struct<coverage_id: string>>").json(path, multiLine=True)
    return m.select(F.explode("coverages").alias("label", "c")).select("label", "c.coverage_id")


def read_golden(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per test case of a golden dataset."""
    return spark.read.schema(f"test_cases array<struct<{schema}>>").json(path, multiLine=True).select(F.explode("test_cases").alias("c")).select("c.*")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(industry, kpi) of a YAML file of the form industries / name / kpis / - item."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=  [^\s-])", -1)).alias("block"))
    name = F.regexp_extract("block", r"^  ([^\s:][^:]*):", 1)
    items = F.regexp_extract_all("block", F.lit(r"(?m)^\s+-\s+(\S.*?)\s*$"), F.lit(1))
    return lines.select(name.alias("industry"), F.explode(items).alias("kpi")).filter("industry <> ''")


def write_manifests(coverages: DataFrame, path: str, per_file: int = 1000) -> None:
    """(label, coverage_id) as manifests of about ``per_file`` coverages, a file each, so that none grows with the table."""
    part = F.pmod(F.xxhash64("label"), F.lit(max(1, -(-coverages.count() // per_file))))
    entry = F.struct("label", F.struct(F.col("coverage_id").cast("string").alias("coverage_id")).alias("c"))
    files = coverages.groupBy(part.alias("part")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("coverages"))).alias("value"))
    files.write.partitionBy("part").text(path)


def write_vocabulary(words: DataFrame, path: str) -> None:
    """(industry, kpi) as YAML, a file per task: a bounded list of words per industry."""
    block = F.concat(F.lit("  "), F.col("industry"), F.lit(":\n    kpis:\n"), F.array_join(F.transform(F.array_sort(F.collect_set("kpi")), lambda k: F.concat(F.lit("      - "), k)), "\n"))
    words.groupBy("industry").agg(block.alias("value")).select("value").write.text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The report's figures as JSON lines, for a gate to read."""
    summary.coalesce(1).write.mode("overwrite").json(path)
