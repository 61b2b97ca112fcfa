"""Task event streams: terminal state, content fold, citation-safe chunks, event-time windows."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TERMINAL = ("complete", "error", "partial")
FLUSH, FORCE = 100, 2000


def terminal_state(events: DataFrame) -> DataFrame:
    """Per task the first terminal event; what follows it is not part of the task."""
    ends = events.filter(F.col("type").isin(*TERMINAL))
    return ends.groupBy("task_id").agg(F.min_by(F.struct("type", "event_id"), F.struct("ts", "event_id")).alias("end")).select("task_id", "end.type", "end.event_id")


def fold(events: DataFrame) -> DataFrame:
    """Per task counts and the ordered ids of its chunks up to the terminal event."""
    ends = terminal_state(events).select("task_id", F.col("event_id").alias("last_id"))
    own = events.join(ends, "task_id", "left").filter(F.col("last_id").isNull() | (F.col("event_id") <= F.col("last_id")))
    return own.groupBy("task_id").agg(F.count_if(F.col("type") == "chunk").alias("n_chunks"), F.count_if(F.col("type") == "citation_found").alias("n_citations"), F.max("event_id").alias("last_event"))


def cut_safe(text: str, done: bool) -> tuple[str, str]:
    """(what may go out, what waits): nothing goes before FLUSH characters, and no citation is cut in two."""
    if done or len(text) >= FORCE:
        return text, ""
    if len(text) < FLUSH:
        return "", text
    open_ = text.rfind("[")
    if open_ < 0:
        return text, ""
    tail = text[open_:]
    close = tail.find("]")
    quote = tail.find('"', close) if close >= 0 else -1
    whole = close >= 0 and (not tail[close + 1 :].startswith(":") and len(tail) > close + 1 or quote >= 0 and tail.find('"', quote + 1) >= 0)
    return (text, "") if whole else (text[:open_], tail)


def safe_chunks(stream: DataFrame, idle: str = "1 hour") -> DataFrame:
    """Streaming (task_id, seq, text, done) to (task_id, text) pieces that never split a citation.

    A task's buffer is dropped when the task is done; one that hears nothing for ``idle`` gives out what it holds.
    """

    def step(key, batches, state):
        held = state.get[0] if state.exists else ""
        out, done = [], state.hasTimedOut
        if done and held:
            out, held = [held], ""
        for pdf in batches:
            for text, done in pdf.sort_values("seq")[["text", "done"]].itertuples(index=False):
                ready, held = cut_safe(held + (text or ""), bool(done))
                if ready:
                    out.append(ready)
        if done:
            state.remove()
        else:
            state.update((held,))
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"task_id": [key[0]] * len(out), "text": out})

    return stream.groupBy("task_id").applyInPandasWithState(step, "task_id long, text string", "held string", "append", "ProcessingTimeTimeout")


def safe_pieces(batches):
    """Batch form of safe_chunks: sorted (task_id, seq, text) batches to (task_id, pos, text), one turn and one buffer in memory.

    A task's last text closes it. Tasks may span batches; texts that are missing add nothing.
    """
    out, last, held, pos = [], None, "", 0

    def cut(done: bool) -> None:
        nonlocal held, pos
        ready, held = cut_safe(held + (last[1] or ""), done)
        if ready:
            out.append((last[0], pos, ready))
            pos += 1

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.int64(), pa.string()))]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, ["task_id", "pos", "text"])

    for batch in batches:
        for task, text in zip(batch.column("task_id").to_pylist(), batch.column("text").to_pylist()):
            if last is not None:
                cut(task != last[0])
                if task != last[0]:
                    held, pos = "", 0
            last = (task, text)
        yield flush()
    if last is not None:
        cut(True)
    yield flush()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time windows; the watermark bounds the state of a streaming run."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "task_id").agg(F.count("*").alias("n"))
