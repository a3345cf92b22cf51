"""Small tables with the awkward rows every operator must stand."""

from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("hash", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("rank", T.IntegerType()),
    ]
)


def documents(spark, rows):
    """rows: (doc_id, text, source)."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 1, 7) for i, t, s in rows]
    return spark.createDataFrame(full, DOCUMENTS)


AWKWARD = [
    (1, None, None),
    (2, "", "a"),
    (3, " \t\n\r ", "a"),
    (4, "one", None),
    (4, "one", None),
    (None, "no id here at all", "b"),
    (5, "word " * 30_000, "b"),
    (6, "é" * 5000 + " 中文 mail a@b.co", "c"),
    (7, "x" * 200_000, "c"),
]
