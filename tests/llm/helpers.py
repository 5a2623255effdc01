"""Small documents with every awkward case, and plain versions of the shared rules."""
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("row", T.StringType()), T.StructField("size", T.StringType()), T.StructField("digest", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("TEXT", T.StringType()),
])
AWKWARD = [
    (1, "alpha beta  gamma\tdelta", "en", "a", 5), (2, "alpha beta gamma delta", "en", "b", 5), (3, None, None, None, None),
    (4, "", "en", "a", 0), (5, "   ", "de", None, 3), (6, " word x\u0085 1 2", "fr", "b", 3),
    (7, "long " * 3000 + "x" * 9000, "en", "c", 7), (8, "alpha beta gamma delta", "en", "a", 5),
    (8, "alpha beta gamma delta", "en", "a", 5), (None, "alpha beta gamma delta", None, "b", 1),
    (None, "no id at all", "en", "c", 1), (9, "İstanbul \U0001F600 你好 café é", "es", "c", 1),
    (10, "tie one two", "en", "b", 1), (11, "tie one two", "en", "b", 1),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "s", "d", "q", "T") for r in rows], SCHEMA)


def awkward(spark):
    return frame(spark, AWKWARD).repartition(3)


def empty(spark):
    return frame(spark, [])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
