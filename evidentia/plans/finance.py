"""Value and period normalisation over strings made from numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.finance import normalize_value, percent_change, scan_spans, signed
from ..functions.period import normalize_period
from ..sources.views import Tables
from .registry import query

RAW = """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '$' || p_size || 'B' WHEN 1 THEN '(' || p_size || ')' WHEN 2 THEN p_size || '.5%' WHEN 3 THEN p_size || 'M shares' WHEN 4 THEN p_size || '.25x' WHEN 5 THEN '€' || p_size || ' thousand' ELSE 'n/a' END AS raw FROM part"""


def _raw(spark, d):
    p, n = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    raw = F.when(p == 0, F.concat(F.lit("$"), n, F.lit("B"))).when(p == 1, F.concat(F.lit("("), n, F.lit(")"))).when(p == 2, F.concat(n, F.lit(".5%"))).when(p == 3, F.concat(n, F.lit("M shares"))).when(p == 4, F.concat(n, F.lit(".25x"))).when(p == 5, F.concat(F.lit("€"), n, F.lit(" thousand"))).otherwise("n/a")
    return Tables(spark, d).raw("part").select("p_partkey", "p_size", raw.alias("raw"))


@query("normalize_value", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size * 1000.0::DOUBLE WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size + 0.5::DOUBLE WHEN 3 THEN p_size * 1000000.0::DOUBLE WHEN 4 THEN p_size + 0.25::DOUBLE WHEN 5 THEN p_size * 0.001::DOUBLE END AS value,
    CASE p_partkey % 7 WHEN 0 THEN 'USD_millions' WHEN 1 THEN 'USD_millions' WHEN 2 THEN 'percentage' WHEN 3 THEN 'count' WHEN 4 THEN 'ratio' WHEN 5 THEN 'EUR_millions' ELSE 'unknown' END AS unit,
    CASE p_partkey % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 5 THEN 'EUR' END AS currency, p_partkey % 7 = 1 AS is_negative,
    CASE p_partkey % 7 WHEN 4 THEN 0.85::DOUBLE WHEN 6 THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM part""")
def normalize_value_query(spark, d):
    v = _raw(spark, d).select("p_partkey", normalize_value(F.col("raw")).alias("v"))
    return v.select("p_partkey", F.when(F.col("v.confidence") > 0, F.col("v.numeric_value")).alias("value"), "v.unit", "v.currency", "v.is_negative", "v.confidence")


@query("signed_kpi_values", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 1 THEN -CAST(p_size AS DOUBLE) ELSE p_size * 1000.0::DOUBLE END AS value FROM part WHERE p_partkey % 7 IN (0, 1)")
def signed_kpi_values(spark, d):
    return _raw(spark, d).filter("p_partkey % 7 in (0, 1)").select("p_partkey", signed(normalize_value(F.col("raw"))).alias("value")).filter("value is not null")


@query("extract_values_from_text", """WITH t AS (SELECT p_partkey, unnest([{'k': 0, 'v': p_size * 1000.0::DOUBLE, 'u': 'USD_millions'}, {'k': 1, 'v': p_size + 0.3::DOUBLE, 'u': 'percentage'}, {'k': 2, 'v': p_size * 1000000.0::DOUBLE, 'u': 'count'}]) AS x FROM part)
    SELECT p_partkey, x.k AS pos, x.v AS value, x.u AS unit FROM t""")
def extract_values_from_text(spark, d):
    n = F.col("p_size").cast("string")
    text = F.concat(F.lit("Revenue grew to $"), n, F.lit("B, up "), n, F.lit(".3%, while 2024 stores and "), n, F.lit("M shares were outstanding."))
    found = Tables(spark, d).raw("part").select("p_partkey", F.posexplode(scan_spans(text)).alias("pos", "x"))
    v = normalize_value(F.regexp_replace(F.col("x.match"), r"^\s+|\s+$", ""))
    return found.select("p_partkey", "pos", v.alias("v")).select("p_partkey", "pos", F.col("v.numeric_value").alias("value"), F.col("v.unit").alias("unit"))


PERIODS = "CASE o_orderkey % 8 WHEN 0 THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) WHEN 1 THEN 'FY' || year(o_orderdate) ELSE '' END"


@query("normalize_period", """SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 2, 3) THEN 'Q' || q || ' ' || y WHEN o_orderkey % 8 = 7 THEN NULL ELSE 'FY' || y END AS label,
    CASE WHEN o_orderkey % 8 IN (0, 1, 2, 3) THEN 'quarterly' WHEN o_orderkey % 8 = 7 THEN NULL ELSE 'annual' END AS type,
    CASE WHEN o_orderkey % 8 <> 7 THEN y END AS year, CASE WHEN o_orderkey % 8 IN (0, 1, 2, 3) THEN q END AS quarter
    FROM (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders)""")
def normalize_period_query(spark, d):
    y, q, k = F.year("o_orderdate"), F.quarter("o_orderdate"), F.col("o_orderkey") % 8
    word = F.element_at(F.array(*[F.lit(x) for x in ("first", "second", "third", "fourth")]), q)
    month = F.element_at(F.array(*[F.lit(x) for x in ("March", "Jun", "September", "Dec")]), q)
    raw = F.when(k == 0, F.concat(F.lit("Q"), q, F.lit(" "), y)).when(k == 1, F.concat(F.lit("Q"), q, F.lit("'"), y)).when(k == 2, F.concat(word, F.lit(" quarter fiscal "), y)).when(k == 3, F.concat(F.lit("three months ended "), month, F.lit(" 30, "), y))
    raw = raw.when(k == 4, F.concat(F.lit("FY"), y)).when(k == 5, F.concat(F.lit("fiscal year "), y)).when(k == 6, F.concat(F.lit("year ended December 31, "), y)).otherwise("sometime last summer")
    p = Tables(spark, d).raw("orders").select("o_orderkey", normalize_period(raw).alias("p"))
    return p.select("o_orderkey", "p.label", "p.type", "p.year", "p.quarter")


@query("pct_change_abs_den", "SELECT c_custkey, CASE WHEN c_nationkey - 12 <> 0 THEN (c_acctbal - (c_nationkey - 12)) / abs(c_nationkey - 12) * 100 END AS change_pct FROM customer")
def pct_change_abs_den(spark, d):
    before = (F.col("c_nationkey") - 12).cast("double")
    return Tables(spark, d).raw("customer").select("c_custkey", percent_change(F.col("c_acctbal"), before).alias("change_pct"))
