"""Event streams in their batch form; tests run the same functions on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.views import Tables
from ..streaming.tasks import fold, safe_pieces, sessions, terminal_state, windowed_counts
from .registry import query


@query("task_terminal_state", "SELECT task_id, arg_min(type, (ts, event_id)) AS type, arg_min(event_id, (ts, event_id)) AS event_id FROM v_task_events WHERE type IN ('complete', 'error', 'partial') GROUP BY 1")
def task_terminal_state(spark, d):
    return terminal_state(Tables(spark, d).task_events())


@query("stream_content_fold", """WITH e AS (SELECT task_id, arg_min(event_id, (ts, event_id)) AS last_id FROM v_task_events WHERE type IN ('complete', 'error', 'partial') GROUP BY 1)
    SELECT t.task_id, count(*) FILTER (WHERE type = 'chunk') AS n_chunks, count(*) FILTER (WHERE type = 'citation_found') AS n_citations, max(event_id) AS last_event FROM v_task_events t LEFT JOIN e ON e.task_id = t.task_id WHERE last_id IS NULL OR event_id <= last_id GROUP BY 1""")
def stream_content_fold(spark, d):
    return fold(Tables(spark, d).task_events())


@query("tumbling_window", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, type, count(*) AS n FROM v_task_events GROUP BY 1, 2")
def tumbling_window(spark, d):
    w = windowed_counts(Tables(spark, d).task_events())
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "type", "n")


@query("session_window", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM v_task_events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g)
    SELECT task_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS began, count(*) AS n FROM s GROUP BY task_id, nr""")
def session_window_query(spark, d):
    s = sessions(Tables(spark, d).task_events())
    return s.select("task_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm").alias("began"), "n")


@query("citation_safe_chunks")
def citation_safe_chunks(spark, d):
    """Batch form: a conversation's turns as the chunks of one task, walked in order; its state is one buffer."""
    turns = Tables(spark, d).raw("conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"), "text")
    turns = turns.repartition("task_id").sortWithinPartitions("task_id", "seq", "text")
    return turns.mapInArrow(safe_pieces, "task_id long, pos long, text string")
