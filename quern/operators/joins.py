"""Range joins as equi joins on a bucket (JN-08, JN-16), and keyed lookups as one join (JN-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ahead_pairs(df: DataFrame, block: list[str], key: str, width: int, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs (a, b) of one block with a.key < b.key < a.key + width, aliased ``a`` and ``b``.

    A row meets only its own bucket of keys and the next one, so the pairs built
    grow with the rows, however few blocks there are.
    """
    bucket = F.floor(F.col(key) / width)
    left = df.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))).alias(a)
    right = df.withColumn("_bucket", bucket).alias(b)
    same = F.col(f"{a}._bucket") == F.col(f"{b}._bucket")
    for c in block:
        same = same & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return left.join(right, same & (F.col(f"{b}.{key}") > F.col(f"{a}.{key}")) & (F.col(f"{b}.{key}") < F.col(f"{a}.{key}") + width))


def lookup(rows: DataFrame, state: DataFrame, keys: list[str], columns: list[str], prefix: str = "stored_") -> DataFrame:
    """``rows`` with ``columns`` of the state's row of their key, NULL where there is none (JN-15): a batch is one join, not a lookup a row."""
    return rows.join(state.select(*keys, *(F.col(c).alias(prefix + c) for c in columns)), keys, "left")
