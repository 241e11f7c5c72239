import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
#: Extra columns whose names clash with the operators' outputs.
WIDE = T.StructType([*DOCS.fields, T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()),
                     T.StructField("row", T.StringType()), T.StructField("ids", T.LongType())])


@pytest.fixture()
def docs(spark):
    """Makes a documents table from (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame(rows, DOCS).coalesce(2)


@pytest.fixture()
def wide(spark):
    """The same with extra columns of clashing names."""
    return lambda rows: spark.createDataFrame([(*r, 7, "x", "y", 9) for r in rows], WIDE).coalesce(2)


#: Null, empty, blank, repeated and long texts; null and repeated ids.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a b"), (6, "Same text here"), (7, "Same text here"), (7, "Same text here"),
       (None, "no id"), (8, "word " * 5000), (9, "x" * 20_000), (10, "é ß 日本 \U0001f600 end")]


@pytest.fixture()
def odd():
    return list(ODD)
