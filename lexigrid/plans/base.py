"""The table of queries, and what the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import geometry as g
from lexigrid.plans.inline import fill

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = fill(sql)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def boxed(df: DataFrame) -> DataFrame:
    return df.withColumn("bbox", g.box("x0", "y0", "x1", "y1"))


EMB = "SELECT vec_id % 20 AS page, vec_id AS id, 100 * abs(embedding[1]) AS x0, 100 * abs(embedding[2]) AS y0, 100 * abs(embedding[1]) + 5 + 40 * abs(embedding[3]) AS x1, 100 * abs(embedding[2]) + 5 + 40 * abs(embedding[4]) AS y1 FROM embeddings"


def vector_boxes(spark, sf):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    v = table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("page"), F.col("vec_id").alias("id"), (100 * e(0)).alias("x0"), (100 * e(1)).alias("y0"), (100 * e(0) + 5 + 40 * e(2)).alias("x1"), (100 * e(1) + 5 + 40 * e(3)).alias("y1"))
    return v


BOXES = EMB.replace("embedding[", "CAST(embedding[").replace("])", "] AS DOUBLE))")
HELD = """greatest(least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0), 0) * greatest(least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0), 0)
 / greatest(1, least(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0), ({1}.x1 - {1}.x0) * ({1}.y1 - {1}.y0)))"""
