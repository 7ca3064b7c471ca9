"""Rows that every operator has to survive."""

from pyspark.sql import types as T

CLASHING = ["id", "words", "bits", "_bits", "_words", "rate", "low", "high", "replica", "shuffle_key", "_steps", "bin_id", "rank", "node", "content", "perplexity", "_gone", "start", "seed", "start_", "key"]
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000

BASE = [
    (None, None, None, None, None),
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "  \n \t ", "de", None, 6),
    (4, LONG, "en", "a", len(LONG)),
    (5, "the quick brown fox jumps over the lazy dog near mail jo.doe@example.com today", "en", "b", 78),
    (6, "the quick brown fox jumps over the lazy dog near mail jo.doe@example.com today", "en", "b", 78),
    (6, "the quick brown fox jumps over the lazy dog near mail jo.doe@example.com today", "en", "b", 78),
    (7, "Ünïcödé — 漢字かな交じり文 \U0001f600 ñandú çà et là", None, "b", 40),
    (8, "one", "xx", "c", 3),
    (None, "the quick brown fox has no number", "en", "c", 33),
]


def docs(spark, rows=BASE, extra=True):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    if extra:
        fields += [T.StructField(c, T.StringType()) for c in CLASHING]
        rows = [(*r, *("x" if i % 2 else None for i in range(len(CLASHING)))) for r in rows]
    return spark.createDataFrame(rows, T.StructType(fields))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
