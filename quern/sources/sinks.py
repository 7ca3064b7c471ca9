"""Writers of reports and cards (SNK-10..13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text


def write_report(df: DataFrame, folder: str) -> None:
    """CSV with a header and JSON lines of one result (SNK-12)."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(f"{folder}/csv")
    df.write.mode("overwrite").json(f"{folder}/json")


def backup(spark: SparkSession, source: str, target: str) -> int:
    """Copy of a table with its schema, row count and the sum of its rows' hashes checked (SNK-13)."""
    df = spark.read.parquet(source)
    df.write.mode("errorifexists").parquet(target)
    copy = spark.read.parquet(target)
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64(*(c for c, t in x.dtypes if not t.startswith("map"))).cast("decimal(38,0)"))).first()
    before, after = mark(df), mark(copy)
    if before != after or df.dtypes != copy.dtypes:
        raise OSError(f"backup of {source} has {after[0]} rows instead of {before[0]}, or differs in them")
    return after[0]


def cards(df: DataFrame) -> DataFrame:
    """(source, external_id, card): headline, price and link of a listing as escaped text (SNK-10, SUP-20)."""
    head = F.concat(F.lit("<b>"), text.escape_html(F.coalesce(F.nullif("title", F.lit("")), F.lit("?"))), F.lit("</b>"))
    price = F.when(F.col("price_czk").isNotNull(), text.money(F.col("price_czk"), "Kč")).otherwise("price unknown")
    return df.select("source", "external_id", F.concat_ws("\n", head, price, F.nullif("location", F.lit("")), "url").alias("card"))
