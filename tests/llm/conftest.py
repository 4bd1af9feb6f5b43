import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # Columns that clash with what operators add.
        T.StructField("score", T.StringType()),
        T.StructField("ids", T.StringType()),
        T.StructField("Row", T.StringType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts; ids count from 0, extra columns have clashing names."""

    def make(texts, ids=None, parts=3):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "s", "x", "r", "w", "k") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return make
