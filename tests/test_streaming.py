from pyspark.sql import functions as F

from lexigrid.operators import segments
from lexigrid.streaming import pages


def _run(spark, df_rows, schema, path, op, mode, name):
    """Write rows as files, a batch at a time, run the stream over them, and return its rows."""
    for i, part in enumerate(df_rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{path}/in")
    q = op(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/ck").trigger(once=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_packing_matches_the_batch_operator(spark, tmp_path):
    rows = [(k, i, i // 3, 40 + (i * 37 + k) % 50) for k in (1, 2) for i in range(30)]
    got = _run(spark, [rows], "key long, pos long, page long, n int", str(tmp_path), lambda s: pages.pack_stream(s, 4, 250, 2), "append", "packed")
    df = spark.createDataFrame(rows, "key long, pos long, page long, n int").withColumn("text", F.expr("repeat('x', n)"))
    want = segments.pack_batches(df, "key", "pos", "page", "text", 4, 250, 2)
    assert sorted(got) == sorted(tuple(r) for r in want.collect())


def test_language_is_decided_once(spark, tmp_path):
    rows = [(1, p, "อาคาร" if p < 4 else "English words here", p == 9) for p in range(10)] + [(2, 0, "only page", True)]
    got = _run(spark, [rows], "key long, page int, text string, is_last boolean", str(tmp_path), pages.decide_language, "append", "decided")
    assert sorted(got) == [(1, "th", 5), (2, "en", 1)]


def test_job_state_never_goes_back(spark, tmp_path):
    rows = [("j", "job_progress", 2, 4), ("j", "completed", 0, 4), ("j", "failed", 0, 4), ("k", "job_progress", 1, 3)]
    got = _run(spark, [rows], "job string, kind string, pages int, total int", str(tmp_path), pages.job_progress, "update", "jobs")
    assert sorted(got) == [("j", "completed", 4, 4), ("k", "processing", 1, 3)]


def test_windowed_events_match_batch(spark, tmp_path):
    from oracle import SF

    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type")
    events.write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    q = pages.page_events(stream).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()
