import pytest
from pyspark.sql import functions as F

from brute import CLASHING, ROWS, SF


def with_clashes(df):
    return df.withColumns({name: F.lit("x") for name in CLASHING})


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return with_clashes(df.repartition(3).withColumn("n_chars", F.length("text").cast("long")))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("doc_id = -1")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {row["doc_id"]: row["text"] or "" for row in docs.collect()}
