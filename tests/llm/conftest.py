import pytest
from pyspark.sql import types as T
from samples import prose


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) as a documents table with further columns, some named like the operators' own."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
        T.StructField("start", T.IntegerType()), T.StructField("fp", T.StringType()), T.StructField("difference", T.StringType()),
        T.StructField("length", T.StringType()), T.StructField("anchor", T.StringType()), T.StructField("n_words", T.StringType()),
    ])

    def make(rows):
        full = [(i, t, None, "s", None if t is None else len(t), "own", 7, "own", "own", "own", "own", "own") for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def messy():
    """Nulls, empty and blank texts, repeated rows, ties, a long text, odd blanks, characters beyond ASCII."""
    long = prose(1, 6000)
    return [
        (1, prose(1, 130)), (2, prose(1, 130)), (3, None), (4, ""), (5, " \n\t "), (None, prose(1, 130)), (6, long), (7, long + " more"),
        (8, prose(3, 80)), (8, prose(3, 80)), (9, "tiny"), (10, "two words"), (11, "ÄÖ ñandú x " * 30), (12, prose(4, 49)),
        (13, prose(5, 50)), (14, prose(5, 50) + "\x0b" + prose(6, 60)), (15, ("same line here\n" * 40)), (-5, prose(6, 60)),
        (16, "\x00\x01 <|endoftext|> <|ENDOFTEXT|> Ḵ İ ΑΣ"), (None, None),
    ]


@pytest.fixture
def small_partitions(spark):
    """Spark takes small partitions for large ones, and broadcasts nothing."""
    values = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4000"}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
