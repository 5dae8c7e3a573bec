"""Reports over events, job snapshots, audits and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_timing(events: DataFrame, stage: str, elapsed: str) -> DataFrame:
    return events.groupBy(F.col(stage).alias("stage")).agg(
        F.count("*").alias("call_count"), F.sum(elapsed).alias("sum_elapsed_ms"),
        F.max(elapsed).alias("max_elapsed_ms"), F.min(elapsed).alias("min_elapsed_ms"),
    )


def phase_summary(requests: DataFrame) -> DataFrame:
    """Requests (phase, started_ms, elapsed_ms, status, request_bytes) by phase; a null phase is ``unattributed``."""
    end = F.col("started_ms") + F.col("elapsed_ms")
    return requests.groupBy(F.coalesce(F.nullif("phase", F.lit("")), F.lit("unattributed")).alias("phase")).agg(
        F.count("*").alias("request_count"), (F.max(end) - F.min("started_ms")).alias("wall_elapsed_ms"),
        F.sum("elapsed_ms").alias("sum_elapsed_ms"), F.count_if(F.col("status") == "error").alias("error_count"),
        F.sum(F.coalesce("request_bytes", F.lit(0))).alias("request_bytes"),
    )


def peak_concurrency(requests: DataFrame, part: list[str], started: str, elapsed: str) -> DataFrame:
    """(part, peak): the most requests at once; at one instant starts come before ends."""
    edges = requests.select(
        *part,
        F.explode(F.array(F.struct(F.col(started).alias("at"), F.lit(1).alias("d")), F.struct((F.col(started) + F.col(elapsed)).alias("at"), F.lit(-1).alias("d")))).alias("e"),
    )
    steps = edges.groupBy(*part, F.col("e.at").alias("at"), F.col("e.d").alias("d")).agg(F.sum("e.d").alias("s"))
    w = Window.partitionBy(*part).orderBy("at", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("now", F.sum("s").over(w)).groupBy(*part).agg(F.max("now").alias("peak"))


def state_changes(snapshots: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """The snapshots whose state differs from the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*state)
    out = snapshots.withColumn("_before", F.lag(now).over(w))
    return out.where(F.col("_before").isNull() | (F.col("_before") != now)).drop("_before")


def run_summary(snapshots: DataFrame, key: str) -> DataFrame:
    """(key, first_page_seconds, total_seconds, seconds_per_page) of job snapshots."""
    return snapshots.groupBy(key).agg(
        F.min(F.when(F.col("completed_pages") > 0, F.col("elapsed_seconds"))).alias("first_page_seconds"),
        F.max("elapsed_seconds").alias("total_seconds"),
        F.round(F.max("elapsed_seconds") / F.greatest(F.lit(1), F.max("total_pages")), 3).alias("seconds_per_page"),
    )


def audit(rows: DataFrame, page: str, ident: str, score: Column, exact: Column, failing: Column) -> DataFrame:
    """By page: how many, how many exact, median and least score, and the failing ids in order."""
    bad = F.array_sort(F.collect_list(F.when(failing, F.col(ident))))
    return rows.withColumn("_s", score).groupBy(page).agg(
        F.count("*").alias("n"), F.count_if(exact).alias("n_exact"), F.median("_s").alias("median_score"),
        F.min("_s").alias("min_score"), bad.alias("failing"),
    )


def cache_reuse(rows: DataFrame, page: str, key: str) -> DataFrame:
    """By page: rows, rows with a key, repeats within the page, keys met on an earlier page, and rows left to do."""
    w = Window.partitionBy(key)
    each = rows.groupBy(page, key).agg(F.count("*").alias("n"))
    each = each.withColumn("first", F.min(page).over(w))
    keyed = F.col(key).isNotNull()
    return each.groupBy(page).agg(
        F.sum("n").alias("candidates"), F.sum(F.when(keyed, F.col("n")).otherwise(0)).alias("fingerprinted"),
        F.sum(F.when(keyed, F.col("n") - 1).otherwise(0)).alias("within_page"),
        F.count_if(keyed & (F.col("first") < F.col(page))).alias("cross_page"),
    ).withColumn("left_to_do", F.expr("candidates - within_page - cross_page"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def repeated_sources(rows: DataFrame, part: str, key: str) -> DataFrame:
    return rows.groupBy(part).agg((F.count("*") - F.count_distinct(key)).alias("n_repeated"))


def remaining_work(rows: DataFrame, page: str, done: Column) -> DataFrame:
    """By page: how many rows are left, and whether the page is done."""
    return rows.groupBy(page).agg(F.count_if(~done).alias("left_to_do")).withColumn("is_done", F.col("left_to_do") == 0)


def stratified_sample(blocks: DataFrame, part: str, ident: str, confidence: str, x: str, y: str, most: int) -> DataFrame:
    """(part, ident): of each part at most ``most`` blocks: the least sure half, then evenly spaced ones in (y, x) order.

    Parts with no more blocks than that are taken whole.  The evenly spaced places that fall on blocks taken already
    are filled from the front, in the same order.
    """
    low = max(3, most // 2)
    rest = most - low
    by = Window.partitionBy(part)
    out = blocks.withColumn("_n", F.count("*").over(by))
    out = out.withColumn("_c", F.row_number().over(by.orderBy(F.coalesce(confidence, F.lit(-1.0)), y, x, ident)))
    out = out.withColumn("_p", F.row_number().over(by.orderBy(y, x, ident)) - 1)
    places = F.expr("array(_n div 2)") if rest == 1 else F.expr(f"transform(sequence(0, {max(rest, 1) - 1}), i -> cast(bround(i * (_n - 1) / {max(1, rest - 1)}D, 0) as bigint))")
    spaced = F.array_contains(places, F.col("_p")) if rest > 0 else F.lit(False)
    out = out.withColumn("_rank", F.when(F.col("_c") <= low, 0).when(spaced, 1).otherwise(2))
    out = out.withColumn("_take", F.row_number().over(by.orderBy("_rank", "_p")))
    return out.where((F.col("_n") <= most) | (F.col("_take") <= most)).select(part, ident)


def reading_scores(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Lists of expected and returned ids matched by place: (key, pos, expected, returned, ok)."""
    a = expected.select(key, F.posexplode("ids").alias("pos", "expected"))
    b = got.select(key, F.posexplode("ids").alias("pos", "returned"))
    return a.join(b, [key, "pos"], "left").withColumn("ok", F.coalesce(F.col("expected") == F.col("returned"), F.lit(False)))
