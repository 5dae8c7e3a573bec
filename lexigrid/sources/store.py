"""Stored tables and sinks: appends, event lines, text downloads, exports by writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.text import archive_suffix, txt_download


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append rows; readers take up columns that were added later."""
    writer = df.write.mode("append").format("parquet")
    (writer.partitionBy(*by) if by else writer).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def with_identity(df: DataFrame) -> DataFrame:
    """Rows with a random id and the current time, as stored rows have them."""
    return df.withColumn("id", F.uuid()).withColumn("created_at", F.current_timestamp())


def event_lines(events: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """(line): one log line an event, its fields as JSON sorted by name."""
    own = F.to_json(F.struct(*(F.col(c) for c in sorted(fields))))
    return events.select(F.concat(F.lit("document_event="), F.col(name), F.lit(" fields="), own).alias("line"))


def archived(uploads_: DataFrame) -> DataFrame:
    """Where each upload is archived: a folder an attempt, and an allowed suffix."""
    return uploads_.withColumn("archive_name", F.concat(F.lit("source"), archive_suffix("name")))


def text_downloads(history: DataFrame) -> DataFrame:
    return history.select("id", txt_download("translated_text").alias("content"))


def missing_exports(history: DataFrame, existing: DataFrame) -> DataFrame:
    """History rows whose export is not there yet."""
    return history.join(existing.select("id"), "id", "left_anti")


def download_source(history: DataFrame) -> DataFrame:
    """Which file an unformatted export is built from: the source, else the formatted file; null is not found."""
    return history.withColumn("download_from", F.coalesce("source_path", "formatted_path"))


def write_by_writer(segments: DataFrame, path: str) -> None:
    """Export rows, a folder for each writer."""
    segments.write.mode("overwrite").partitionBy("writer").parquet(path)
