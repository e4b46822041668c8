import pytest
from llm_rows import SCHEMA, make_rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns named as the operators' own."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("sid", "n", "token", "tokens", "row", "rank", "bucket", "kept", "kinds", "_c0", "_text", "_lang", "_gone", "_id", "limit", "key", "guest", "length", "pos", "prefix")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
