"""Usage and cost analytics over the audit log."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators.frames import densify, first_per
from ..operators.usage import cost, model_class, rollup
from ..sources.views import Tables
from .registry import query

# Exact on both sides: tokens are summed as integers before they meet the price.
CLASS_SQL = "CASE WHEN llm_used IS NULL OR llm_used = '' THEN 'local' WHEN llm_used LIKE '%claude%' THEN 'claude' WHEN llm_used LIKE '%gpt%' THEN 'gpt-4o' ELSE 'local' END"
PRICED = f"(SELECT *, {CLASS_SQL} AS model, CASE {CLASS_SQL} WHEN 'claude' THEN 30.0::DECIMAL(18,6) WHEN 'gpt-4o' THEN 4.375::DECIMAL(18,6) ELSE 0.0::DECIMAL(18,6) END AS price FROM v_audit)"
COST_SQL = "round_even(CAST(sum(tokens_used * price) AS DOUBLE) / 1000000, 2)"


def _log(spark, d):
    log = Tables(spark, d).audit()
    return log.withColumn("model", model_class(F.col("llm_used"))).withColumn("month", F.date_format("created_at", "yyyy-MM"))


@query("proj_model_class_cost", f"SELECT id, model, CAST(tokens_used * price AS DOUBLE) / 1000000 AS cost FROM {PRICED}")
def proj_model_class_cost(spark, d):
    log = _log(spark, d)
    return log.select("id", "model", cost(F.col("tokens_used"), F.col("model")).alias("cost"))


@query("usage_by_tenant_month", f"SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, {COST_SQL} AS cost_usd FROM {PRICED} GROUP BY 1, 2")
def usage_by_tenant_month(spark, d):
    return rollup(_log(spark, d), ["tenant_id", "month"]).select("tenant_id", "month", "cost_usd")


@query("usage_by_tenant_model", f"SELECT tenant_id, model, CAST(sum(tokens_used) AS BIGINT) AS tokens, {COST_SQL} AS cost_usd FROM {PRICED} GROUP BY 1, 2")
def usage_by_tenant_model(spark, d):
    return rollup(_log(spark, d), ["tenant_id", "model"])


@query("usage_by_tenant_coverage", f"SELECT tenant_id, coverage_id, CAST(sum(tokens_used) AS BIGINT) AS tokens, {COST_SQL} AS cost_usd FROM {PRICED} WHERE coverage_id IS NOT NULL GROUP BY 1, 2")
def usage_by_tenant_coverage(spark, d):
    return rollup(_log(spark, d).filter("coverage_id is not null"), ["tenant_id", "coverage_id"])


@query("usage_grouping_sets", f"""SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, model, coverage_id, CAST(sum(tokens_used) AS BIGINT) AS tokens
    FROM {PRICED} p GROUP BY GROUPING SETS ((tenant_id, strftime(created_at, '%Y-%m')), (tenant_id, model), (tenant_id, coverage_id))""")
def usage_grouping_sets(spark, d):
    sets = [[F.col("tenant_id"), F.col("month")], [F.col("tenant_id"), F.col("model")], [F.col("tenant_id"), F.col("coverage_id")]]
    return _log(spark, d).groupingSets(sets, "tenant_id", "month", "model", "coverage_id").agg(F.sum("tokens_used").cast("long").alias("tokens")).select("tenant_id", "month", "model", "coverage_id", "tokens")


COVERAGE_PAGE, RANK_BUCKETS = 10_000, 1000
JSON_COST = "CAST(CAST(cost_usd AS DECIMAL(18,2)) AS VARCHAR)"
NESTED = f"""WITH p AS (SELECT * FROM {PRICED}),
    m AS (SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, {COST_SQL} AS cost_usd FROM p GROUP BY 1, 2),
    o AS (SELECT tenant_id, model, CAST(sum(tokens_used) AS BIGINT) AS tokens, {COST_SQL} AS cost_usd FROM p GROUP BY 1, 2),
    c AS (SELECT tenant_id, coverage_id, CAST(sum(tokens_used) AS BIGINT) AS tokens, {COST_SQL} AS cost_usd FROM p WHERE coverage_id IS NOT NULL GROUP BY 1, 2),
    ms AS (SELECT tenant_id, '[' || string_agg('{{"month":"' || month || '","cost_usd":"' || {JSON_COST} || '"}}', ',' ORDER BY month) || ']' AS months FROM m GROUP BY 1),
    os AS (SELECT tenant_id, '[' || string_agg('{{"model":"' || model || '","tokens":' || tokens || ',"cost_usd":"' || {JSON_COST} || '"}}', ',' ORDER BY model) || ']' AS models FROM o GROUP BY 1),
    cs AS (SELECT tenant_id, coverage_id // {COVERAGE_PAGE} AS page, '[' || string_agg('{{"coverage_id":' || coverage_id || ',"tokens":' || tokens || ',"cost_usd":"' || {JSON_COST} || '"}}', ',' ORDER BY coverage_id) || ']' AS coverages FROM c GROUP BY 1, 2)
    SELECT t.tenant_id, tenant_name, coalesce(page, 0) AS page, coalesce(months, '[]') AS months, coalesce(models, '[]') AS models, coalesce(coverages, '[]') AS coverages
    FROM v_tenants t LEFT JOIN ms ON ms.tenant_id = t.tenant_id LEFT JOIN os ON os.tenant_id = t.tenant_id LEFT JOIN cs ON cs.tenant_id = t.tenant_id"""


@query("usage_nested_per_tenant", NESTED)
def usage_nested_per_tenant(spark, d):
    """One row per tenant with its months, models and coverages as the JSON a client gets; empty lists without usage.

    Months and models are few. Coverages grow with the table: further pages of them are further rows of the tenant.
    """
    t, log = Tables(spark, d), _log(spark, d)

    def nest(df, keys, cols, name):
        row = F.struct(*cols, F.col("cost_usd").cast("decimal(18,2)").cast("string").alias("cost_usd"))
        return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(row))).alias(name))

    months = nest(rollup(log, ["tenant_id", "month"]), ["tenant_id"], ["month"], "months")
    models = nest(rollup(log, ["tenant_id", "model"]), ["tenant_id"], ["model", "tokens"], "models")
    covered = rollup(log.filter("coverage_id is not null"), ["tenant_id", "coverage_id"]).withColumn("page", F.floor(F.col("coverage_id") / COVERAGE_PAGE))
    covered = nest(covered, ["tenant_id", "page"], ["coverage_id", "tokens"], "coverages")
    out = t.tenants().join(months, "tenant_id", "left").join(models, "tenant_id", "left").join(covered, "tenant_id", "left")
    return out.select("tenant_id", "tenant_name", F.coalesce("page", F.lit(0)).alias("page"), *[F.coalesce(c, F.lit("[]")).alias(c) for c in ("months", "models", "coverages")])


@query("usage_over_threshold", f"""WITH m AS (SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, {COST_SQL} AS c FROM {PRICED} GROUP BY 1, 2),
    l AS (SELECT tenant_id, arg_max(c, month) AS latest_cost FROM m GROUP BY 1)
    SELECT t.tenant_id, latest_cost, coalesce(latest_cost > alert_threshold, false) AS over_threshold FROM v_tenants t LEFT JOIN l ON t.tenant_id = l.tenant_id""")
def usage_over_threshold(spark, d):
    latest = rollup(_log(spark, d), ["tenant_id", "month"]).groupBy("tenant_id").agg(F.max_by("cost_usd", "month").alias("latest_cost"))
    out = Tables(spark, d).tenants().join(latest, "tenant_id", "left")
    return out.select("tenant_id", "latest_cost", F.coalesce(F.col("latest_cost") > F.col("alert_threshold"), F.lit(False)).alias("over_threshold"))


@query("join_log_ticker_default", "SELECT a.id, coalesce(c.ticker, 'Unknown') AS ticker FROM v_audit a LEFT JOIN v_coverages c ON a.coverage_id = c.coverage_id")
def join_log_ticker_default(spark, d):
    t = Tables(spark, d)
    return t.audit().select("id", "coverage_id").join(t.coverages().select("coverage_id", "ticker"), "coverage_id", "left").select("id", F.coalesce("ticker", F.lit("Unknown")).alias("ticker"))


@query("join_month_tenant_densify", f"""WITH m AS (SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM {PRICED} GROUP BY 1, 2)
    SELECT t.tenant_id, x.month, coalesce(m.tokens, 0) AS tokens FROM v_tenants t CROSS JOIN (SELECT DISTINCT month FROM m) x LEFT JOIN m ON m.tenant_id = t.tenant_id AND m.month = x.month""")
def join_month_tenant_densify(spark, d):
    by_month = rollup(_log(spark, d), ["tenant_id", "month"]).select("tenant_id", "month", "tokens")
    return densify(Tables(spark, d).tenants().select("tenant_id"), by_month.select("month").distinct(), by_month, ["tenant_id", "month"], {"tokens": 0})


@query("topk_cost", f"""WITH m AS (SELECT coverage_id, CAST(sum(tokens_used) AS BIGINT) AS tokens, {COST_SQL} AS cost_usd FROM {PRICED} WHERE coverage_id IS NOT NULL GROUP BY 1)
    SELECT coverage_id, tokens, cost_usd FROM m ORDER BY cost_usd DESC, coverage_id LIMIT 8""")
def topk_cost(spark, d):
    return rollup(_log(spark, d).filter("coverage_id is not null"), ["coverage_id"]).orderBy(F.desc("cost_usd"), "coverage_id").limit(8)


@query("latency_p95_nearest_rank", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, value AS p95 FROM r WHERE rn = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) + 1""")
def latency_p95_nearest_rank(spark, d):
    """Exact: the values' range is cut into buckets, whose counts tell the one that holds the rank; only its values are ranked."""
    e = Tables(spark, d).raw("events").filter("value is not null").select("event_type", "value")
    ends = e.groupBy(F.col("event_type").alias("type")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    share = F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    placed = e.join(ends, F.col("event_type").eqNullSafe(F.col("type"))).select("event_type", "value", "n", F.floor(share * RANK_BUCKETS).alias("bucket"))
    w = Window.partitionBy("event_type")
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)) + 1
    counts = placed.groupBy("event_type", "n", "bucket").agg(F.count("*").alias("c"))  # at most RANK_BUCKETS + 1 rows a type
    counts = counts.withColumn("upto", F.sum("c").over(w.orderBy("bucket"))).filter((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at))
    wanted = counts.select(F.col("event_type").alias("type"), F.col("bucket").alias("held"), (at - F.col("upto") + F.col("c")).alias("rank"))
    inside = placed.join(wanted, F.col("event_type").eqNullSafe(F.col("type")) & (F.col("bucket") == F.col("held"))).groupBy("event_type", "value", "rank").agg(F.count("*").alias("c"))
    inside = inside.withColumn("upto", F.sum("c").over(w.orderBy("value")))
    return inside.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank"))).select("event_type", F.col("value").alias("p95"))


@query("audit_distinct_months", "SELECT DISTINCT strftime(created_at, '%Y-%m') AS month FROM v_audit")
def audit_distinct_months(spark, d):
    return _log(spark, d).select("month").distinct()


@query("audit_latest_per_tenant", "SELECT tenant_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS rn FROM v_audit) WHERE rn = 1")
def audit_latest_per_tenant(spark, d):
    return first_per(Tables(spark, d).audit(), ["tenant_id"], F.desc("created_at"), F.desc("id")).select("tenant_id", "id", "created_at")


@query("audit_window_365", "SELECT tenant_id, count(*) AS n FROM v_audit WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 365 DAY GROUP BY 1")
def audit_window_365(spark, d):
    """The look-back predicate, with now pinned; it reaches the scan as a pushed filter."""
    log = Tables(spark, d).audit().filter(F.col("created_at") >= F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL 365 DAYS"))
    return log.groupBy("tenant_id").agg(F.count("*").alias("n"))
