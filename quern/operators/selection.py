"""First-of-key, quotas and fair ordering (WN-01..11, TK-01..05, TK-07..09), without collecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STATUS_ORDER = {"HOT": 0, "INTERESTING": 1, "MANUAL_REVIEW": 2, "LOW_PRIORITY": 3, "REJECT": 4}


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in that order; rows tied in all of it are equal in what the order sees."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def status_rank(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS_ORDER.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), F.lit(len(STATUS_ORDER)))


def quota_select(df: DataFrame, status: str, order: list[Column], most: int, reserved: int, review: str = "MANUAL_REVIEW") -> DataFrame:
    """At most ``most`` rows: the top ``reserved`` reviews, the best others in the rest, then backfill by rank (TK-04).

    Only the first ``most`` of reviews and of others can be chosen, so they are
    cut out by TakeOrdered before anything is ranked over the whole.
    """
    ranked = df.withColumn("_s", status_rank(F.col(status)))
    by = [F.asc("_s"), *order]
    reviews = ranked.where(F.col(status) == review).orderBy(*by).limit(most).withColumn("_review", F.lit(True))
    others = ranked.where(F.col(status) != review).orderBy(*by).limit(most).withColumn("_review", F.lit(False))
    small = reviews.unionByName(others)
    rank = F.row_number().over(W.partitionBy("_review").orderBy(*by))
    held = F.least(F.lit(reserved), F.sum(F.col("_review").cast("int")).over(W.partitionBy(F.lit(1))))
    first = small.withColumn("_rank", rank).withColumn("_pick", F.when(F.col("_review"), F.col("_rank") <= reserved).otherwise(F.col("_rank") <= most - held))
    room = F.lit(most) - F.sum(F.col("_pick").cast("int")).over(W.partitionBy(F.lit(1)))
    rest = F.row_number().over(W.partitionBy("_pick").orderBy(*by))
    return first.withColumn("_room", room).withColumn("_rest", rest).where("_pick OR _rest <= _room").select(*df.columns)


def source_ranks(df: DataFrame, source: str, status: str, order: list[Column]) -> DataFrame:
    """``df`` with ``source_rank``: turn of a row within its source, from 0 (WN-02)."""
    w = W.partitionBy(source).orderBy(status_rank(F.col(status)), *order)
    return df.withColumn("source_rank", (F.row_number().over(w) - 1).cast("int"))


def head_tail(df: DataFrame, status: str, score: str, key: str, n: int) -> DataFrame:
    """The best ceil(n/2) and worst floor(n/2) rows of each status (WN-11)."""
    best = F.row_number().over(W.partitionBy(status).orderBy(F.desc(score), F.asc(key)))
    worst = F.row_number().over(W.partitionBy(status).orderBy(F.asc(score), F.desc(key)))
    ranked = df.withColumn("_b", best).withColumn("_w", worst)
    return ranked.where((F.col("_b") <= (n + 1) // 2) | (F.col("_w") <= n // 2)).withColumn("part", F.when(F.col("_b") <= (n + 1) // 2, "head").otherwise("tail")).drop("_b", "_w")


def suppressed(listings: DataFrame, keys: list[str], mode: str, order: list[Column], most: int) -> DataFrame:
    """Keys that a first run registers without a notice (TK-06): all, all but the first ``most``, or none."""
    own = listings.select(*keys)
    if mode == "skip_existing":
        return own.distinct()
    if mode == "send_latest":
        return own.join(listings.orderBy(*order).limit(most).select(*keys), keys, "left_anti").distinct()
    if mode == "send_all":
        return own.limit(0)
    raise ValueError(f"unknown mode {mode}")
