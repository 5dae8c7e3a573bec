"""History, attempts and job rows: appends, partial updates folded from events, visibility and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB_SECONDS = 3600


def of_owner(rows: DataFrame, owner, column: str = "owner_id") -> DataFrame:
    """Only the rows of one owner: a plain comparison that reaches the scan."""
    return rows.where(F.col(column) == owner)


def fold_updates(events: DataFrame, key: str, seq: str, fields: list[str], ts: str | None = None) -> DataFrame:
    """The state of each key: of each field the latest value that isn't null, and the time of the last event."""
    agg: list[Column] = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in fields]
    if ts:
        agg += [F.min(ts).alias("created_at"), F.max(ts).alias("updated_at")]
    return events.groupBy(key).agg(*agg)


def apply_update(state: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """State with the non-null fields of a patch written over; patches of unknown keys are dropped."""
    new = patch.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    out = state.join(new, key, "left")
    return out.select(key, *(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in fields), *(c for c in state.columns if c != key and c not in fields))


def add_warning(warnings: Column, warning: Column) -> Column:
    w = F.coalesce(warnings, F.array().cast("array<string>"))
    return F.when(F.array_contains(w, warning), w).otherwise(F.array_append(w, warning))


def expired(jobs: DataFrame, now: Column, seconds: int = JOB_SECONDS) -> Column:
    """Finished jobs that were last touched longer ago than ``seconds``."""
    return F.col("status").isin("completed", "failed") & (F.col("updated_at") < now - F.expr(f"interval {seconds} seconds"))


def progress(completed, total) -> Column:
    """Percent done, rounded half to even, at most 100."""
    return F.least(F.lit(100), F.bround(F.col(completed) / F.col(total) * 100).cast("int"))


def retry_delay(retry_after: Column, attempt: Column, base: float) -> Column:
    """Seconds to wait: what the server asks, within 0.1 and 30, else the base doubled for each attempt, at most 30."""
    asked = F.expr(f"try_cast({retry_after._jc.toString()} as double)")
    return F.when(asked.isNotNull(), F.greatest(F.lit(0.1), F.least(F.lit(30.0), asked))).otherwise(
        F.least(F.lit(30.0), F.lit(base) * F.pow(F.lit(2.0), attempt))
    )


def to_export(history: DataFrame, target: str = "zh", suffix: str = ".pdf") -> DataFrame:
    """Rows whose export is rebuilt, oldest first."""
    return history.where((F.col("target_language") == target) & F.col("export_filename").like(f"%{suffix}")).orderBy("created_at", "id")


def merge_metadata(old: Column, new: Column) -> Column:
    """One map of both: the new value of a key that both have; a null map is empty."""
    none = F.expr("cast(map() as map<string,string>)")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def utc_text(ts) -> Column:
    """A time as ISO-8601 text in UTC with microseconds, which sorts as the time does."""
    return F.concat(F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times in seconds, rounded half to even."""
    return F.bround((end - start) * 1000).cast("bigint")
