import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType()), T.StructField("kept", T.StringType())])


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS).repartition(3)

    return make
