"""Small documents tables for the tests."""

from pyspark.sql import functions as F

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, rows, extra=()):
    """Rows of (doc_id, text, lang, source), with ``extra`` columns whose names may clash."""
    df = spark.createDataFrame([(i, t, la, so, None if t is None else len(t)) for i, t, la, so in rows], DOCS)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return df
