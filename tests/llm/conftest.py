import pytest
from oddrows import CLASH, DOCS, rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
