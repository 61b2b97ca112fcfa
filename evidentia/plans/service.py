"""What the service answers: scoped search, dashboards, task lookups, dispatch errors, prompts from optional parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.frames import first_per
from ..operators.quantiles import LOG_GROWTH, MIDDLE, merge, quantile, sketch
from ..scope import TenantScope, check_scope
from ..sources.shared import shared_folder
from ..sources.views import Tables
from .registry import query
from .texts import VERDICT, verdicts
from .workflow import OUTPUTS, _outputs

CHUNKS = "ch AS (SELECT document_id, tenant_id, coverage_id, section, n_chars, CASE document_id % 3 WHEN 0 THEN 'child' WHEN 1 THEN 'table' ELSE 'parent' END AS chunk_type FROM v_corpus)"


def stored_chunks(spark, d):
    """The chunks as a table that lies by tenant: a scoped read lists one tenant's files."""
    kind = F.when(F.col("document_id") % 3 == 0, "child").when(F.col("document_id") % 3 == 1, "table").otherwise("parent")
    path = shared_folder(spark, "chunks")
    Tables(spark, d).corpus().select("document_id", "tenant_id", "coverage_id", "section", "n_chars", kind.alias("chunk_type")).write.partitionBy("tenant_id").parquet(path)
    return spark.read.parquet(path)


@query("searchable", f"WITH {CHUNKS} SELECT document_id, chunk_type FROM ch WHERE tenant_id = 2 AND coverage_id = 'src7' AND chunk_type IN ('child', 'table')")
def searchable(spark, d):
    """A tenant's and coverage's searchable chunks; the plan is checked for the tenant's predicate."""
    return TenantScope(2, "src7").searchable(stored_chunks(spark, d)).select("document_id", "chunk_type")


@query("section_search", f"WITH {CHUNKS}, m AS (SELECT * FROM ch WHERE tenant_id = 2 AND coverage_id = 'src7' AND chunk_type IN ('child', 'table') AND section IN ('en', 'de')) SELECT document_id, row_number() OVER (ORDER BY n_chars DESC, document_id) AS rank FROM m QUALIFY rank <= 8")
def section_search(spark, d):
    """The section condition is added to the scope's own, and holds before the best eight are taken."""
    rows = TenantScope(2, "src7").searchable(stored_chunks(spark, d), F.col("section").isin("en", "de"))
    return first_per(rows, ["tenant_id"], F.desc("n_chars"), F.col("document_id"), n=8).select("document_id", F.col("rn").alias("rank"))


@query("session_scope", "SELECT document_id FROM v_corpus WHERE tenant_id = 3")
def session_scope(spark, d):
    """Rows of the tenant that the session is set to; a session without one sees none."""
    session = spark.newSession()
    session.conf.set("evidentia.tenant", "3")
    rows = stored_chunks(spark, d)
    return check_scope(TenantScope.of_session(session).table(rows), 3).select("document_id")


@query("latency_p95_sketch", f"""WITH z AS (SELECT event_type, CASE WHEN value > 0 THEN 1 ELSE 0 END AS sign, CASE WHEN value > 0 THEN ceil(ln(value) / {LOG_GROWTH!r}::DOUBLE)::BIGINT ELSE 0 END AS power, count(*) AS n FROM events WHERE value >= 0 GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY sign, power) AS upto, greatest(ceil(sum(n) OVER (PARTITION BY event_type) * 0.95::DOUBLE), 1) AS rank FROM z)
    SELECT event_type, round(sign * exp(power * {LOG_GROWTH!r}::DOUBLE) * {MIDDLE!r}::DOUBLE, 6) AS p95 FROM c WHERE upto >= rank AND upto - n < rank""")
def latency_p95_sketch(spark, d):
    """Sketches per hour, merged per day, then over all days: one pass over the events, at most 1 % off the exact value."""
    e = Tables(spark, d).raw("events").select("event_type", "value", F.date_trunc("hour", "ts").alias("hour"))
    hours = sketch(e.filter("value >= 0"), ["event_type", "hour"], "value")
    days = merge(hours.withColumn("day", F.date_trunc("day", "hour")), ["event_type", "day"])
    return quantile(merge(days, ["event_type"]), ["event_type"], 0.95, "p95").withColumn("p95", F.round("p95", 6))


@query("dashboard_metrics", """SELECT strftime(time_bucket(INTERVAL 5 MINUTES, created_at), '%Y-%m-%d %H:%M') AS at, tenant_id, coalesce(llm_used, '') AS model, sum(tokens_used)::BIGINT AS tokens, round(avg(tokens_used), 6) AS avg_tokens, count(*) / 300.0::DOUBLE AS rate FROM v_audit GROUP BY 1, 2, 3""")
def dashboard_metrics(spark, d):
    """Per five minutes, tenant and model: the sum, the average, and calls per second."""
    a = Tables(spark, d).audit().groupBy(F.window(F.col("created_at").cast("timestamp"), "5 minutes").alias("w"), "tenant_id", F.coalesce("llm_used", F.lit("")).alias("model"))
    a = a.agg(F.sum("tokens_used").alias("tokens"), F.round(F.avg("tokens_used"), 6).alias("avg_tokens"), (F.count("*") / 300.0).alias("rate"))
    return a.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("at"), "tenant_id", "model", "tokens", "avg_tokens", "rate")


@query("task_lookup", "SELECT a.task_id, coalesce(e.state, 'not_found') AS status FROM (SELECT DISTINCT page_id * 3 AS task_id FROM pages) a LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1) e ON e.user_id = a.task_id")
def task_lookup(spark, d):
    """Asked task ids with their state, or not_found."""
    t = Tables(spark, d)
    asked = t.raw("pages").select((F.col("page_id") * 3).alias("task_id")).distinct()
    known = t.raw("events").groupBy(F.col("user_id").alias("task_id")).agg(F.max_by("event_type", "event_id").alias("state"))
    return asked.join(known, "task_id", "left").select("task_id", F.coalesce("state", F.lit("not_found")).alias("status"))


# The agents that a task can name.
AGENTS = ("lynch_pitch", "munger_invert", "quarterly_update", "kpi_tracker")
KNOWN = ", ".join(f"'{a}'" for a in AGENTS)


@query("agent_dispatch", f"""WITH {OUTPUTS} SELECT output_id, CASE WHEN kind IN ({KNOWN}) THEN 'running' ELSE 'failed' END AS status, CASE WHEN kind NOT IN ({KNOWN}) THEN '{{"type":"error","error":"ValueError","message":"Unknown agent: ' || kind || '"}}' END AS event FROM ot""")
def agent_dispatch(spark, d):
    """A task for an agent that nobody knows fails at once, with an error event; the others run."""
    known = F.col("kind").isin(*AGENTS)
    event = F.to_json(F.struct(F.lit("error").alias("type"), F.lit("ValueError").alias("error"), F.concat(F.lit("Unknown agent: "), "kind").alias("message")))
    return _outputs(spark, d).select("output_id", F.when(known, "running").otherwise("failed").alias("status"), F.when(~known, event).alias("event"))


@query("outputs_newest_first", f"WITH {OUTPUTS} SELECT coverage_id, output_id, row_number() OVER (PARTITION BY coverage_id ORDER BY output_id DESC) AS pos FROM ot WHERE kind = 'lynch_pitch'")
def outputs_newest_first(spark, d, kind: str | None = "lynch_pitch"):
    """A coverage's outputs of one type, or with None of all, newest first."""
    o = _outputs(spark, d).select("coverage_id", "output_id", "kind")
    o = o if kind is None else o.filter(F.col("kind") == kind)
    return first_per(o, ["coverage_id"], F.desc("output_id"), n=(1 << 31) - 1).select("coverage_id", "output_id", F.col("rn").alias("pos"))


@query("prompt_assembly", rf"""WITH v AS ({VERDICT}), f AS (SELECT coverage_id, count(*) AS n FROM v_filings GROUP BY 1), s AS (SELECT coverage_id, max_by(value, (year, period)) AS value FROM v_series WHERE period_type = 'annual' AND kpi_name = 'revenue' GROUP BY 1)
    SELECT c.coverage_id, 'Company: ' || c.ticker || CASE WHEN f.n IS NOT NULL THEN chr(10) || chr(10) || 'Filings: ' || f.n ELSE '' END || CASE WHEN s.value IS NOT NULL THEN chr(10) || chr(10) || 'Revenue: ' || CAST(CAST(s.value AS DECIMAL(18,2)) AS VARCHAR) ELSE '' END
        || CASE WHEN v.status <> 'approved' THEN chr(10) || chr(10) || 'Retry: the last answer was ' || v.status ELSE '' END AS prompt
    FROM v_coverages c LEFT JOIN f ON f.coverage_id = c.coverage_id LEFT JOIN s ON s.coverage_id = c.coverage_id LEFT JOIN v ON v.output_id = c.coverage_id""")
def prompt_assembly(spark, d):
    """A prompt's parts where they exist: company, filings, latest revenue, and the retry's reason after a rejection."""
    t = Tables(spark, d)
    filings = t.filings().groupBy("coverage_id").agg(F.count("*").alias("n"))
    revenue = t.series().filter("period_type = 'annual' and kpi_name = 'revenue'").groupBy("coverage_id").agg(F.max_by("value", F.struct("year", "period")).cast("decimal(18,2)").cast("string").alias("value"))
    judged = verdicts(spark, d).filter("status <> 'approved'").select(F.col("output_id").alias("coverage_id"), "status")
    rows = t.coverages().select("coverage_id", "ticker").join(filings, "coverage_id", "left").join(revenue, "coverage_id", "left").join(judged, "coverage_id", "left")
    part = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))  # null where the part is missing
    return rows.select("coverage_id", F.concat_ws("\n\n", part("Company: ", "ticker"), part("Filings: ", "n"), part("Revenue: ", "value"), part("Retry: the last answer was ", "status")).alias("prompt"))
