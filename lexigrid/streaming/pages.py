"""Pages as a stream: batches, language decisions, job progress, expiry.

Each operator keeps a small state a document (or job) in the state store and is keyed by it, so documents spread over
the cluster.  The batch operators of ``lexigrid.operators`` give the same rows on finished input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexigrid.functions.text import CJK, THAI
from lexigrid.operators.segments import BATCH_CHARACTERS, BATCH_ITEMS, BATCH_PAGES

DECIDE_PAGES = 5
BATCHES = "key long, pos long, batch int"
LANGUAGE = "key long, language string, pages int"
PROGRESS = "job string, status string, completed int, total int"


def pack_stream(segments: DataFrame, items: int = BATCH_ITEMS, characters: int = BATCH_CHARACTERS, pages: int = BATCH_PAGES) -> DataFrame:
    """(key, pos, batch) of a stream of segments (key, pos, page, n): the open batch of each document is the state."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, held, chars, seen = state.get if state.exists else (0, 0, 0, "")
        open_ = {int(x) for x in seen.split(",") if x}
        out = []
        for r in pd.concat(list(frames)).sort_values("pos").itertuples():
            if held and (held >= items or chars + r.n > characters or (r.page not in open_ and len(open_) >= pages)):
                batch, held, chars, open_ = batch + 1, 0, 0, set()
            held, chars = held + 1, chars + int(r.n)
            open_.add(int(r.page))
            out.append((key[0], r.pos, batch))
        state.update((batch, held, chars, ",".join(map(str, sorted(open_)))))
        yield pd.DataFrame(out, columns=["key", "pos", "batch"])

    return segments.groupBy("key").applyInPandasWithState(
        step, BATCHES, "batch int, held int, chars int, seen string", "append", GroupStateTimeout.NoTimeout
    )


def decide_language(pages: DataFrame, wait: int = DECIDE_PAGES) -> DataFrame:
    """(key, language, pages) once ``wait`` pages with some text came, or the last page, of (key, page, text, is_last)."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        th, zh, en, n, done = state.get if state.exists else (0, 0, 0, 0, False)
        out = []
        for r in pd.concat(list(frames)).sort_values("page").itertuples():
            if done:
                break
            s = pd.Series([r.text or ""])
            th += int(s.str.count(f"[{THAI}]").iloc[0])
            zh += int(s.str.count(f"[{CJK}]").iloc[0])
            en += int(s.str.count("[A-Za-z]+(?:['-][A-Za-z]+)*").iloc[0])
            n += 1
            if r.is_last or (n >= wait and th + zh + en):
                most = max(th, zh, en)
                out.append((key[0], "en" if not most else "th" if th == most else "zh" if zh == most else "en", n))
                done = True
        state.update((th, zh, en, n, done))
        yield pd.DataFrame(out, columns=["key", "language", "pages"])

    return pages.groupBy("key").applyInPandasWithState(
        step, LANGUAGE, "th int, zh int, en int, n int, done boolean", "append", GroupStateTimeout.NoTimeout
    )


def job_progress(events: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """(job, status, completed, total) after each batch of events (job, kind, pages, total).

    A job goes from processing to completed, failed or cancelled and never back; a finished job's state is dropped after
    the time to live.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, done, total = state.get if state.exists else ("processing", 0, 0)
        for r in pd.concat(list(frames)).itertuples():
            if status != "processing":
                continue
            total = max(total, int(r.total or 0))
            done = min(total, done + int(r.pages or 0)) if total else done + int(r.pages or 0)
            if r.kind in ("completed", "failed", "cancelled"):
                status = r.kind
                done = total if r.kind == "completed" else done
        state.update((status, done, total))
        if status != "processing":
            state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame([(key[0], status, done, total)], columns=["job", "status", "completed", "total"])

    return events.groupBy("job").applyInPandasWithState(
        step, PROGRESS, "status string, done int, total int", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def page_events(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each kind an hour, late ones up to the delay included."""
    kinds = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return kinds.agg(F.count("*").alias("n")).select(F.col("window.start").alias("started_at"), "event_type", "n")
