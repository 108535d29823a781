"""Inputs that the tests of the corpus operators share."""

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def documents(spark, rows, partitions=3):
    """Documents of (doc_id, text) pairs."""
    full = [(i, t, None if t is None else "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCUMENT).repartition(partitions)


#: Null and empty texts, a null id, repeated rows and ids, one long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a text without an id"), (5, "one"), (5, "one"), (6, "one"), (7, "Same id, one text"),
    (7, "same id, another text"), (8, "word " * 60_000), (9, "é ß 你好   x"), (10, "x" * 5000),
]
