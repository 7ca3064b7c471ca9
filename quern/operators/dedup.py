"""Blocked duplicate pairs, levels, groups and canonical pick (JN-06, JN-07, JN-09, AG-18, AG-19, WN-06, SNK-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators.components import connected_components, group_id
from quern.session import cut


def blocked_pairs(df: DataFrame, block: list[str], key: str, source: str, columns: list[str]) -> DataFrame:
    """Pairs a < b of different sources that agree on the block; the block turns a nested loop into an equi join (JN-06)."""
    a = df.select(*block, *(F.col(c).alias(f"{c}_a") for c in (key, source, *columns)))
    b = df.select(*block, *(F.col(c).alias(f"{c}_b") for c in (key, source, *columns)))
    return a.join(b, block).where((F.col(f"{source}_a") != F.col(f"{source}_b")) & (F.col(f"{key}_a") < F.col(f"{key}_b")))


def duplicate_level(description: Column, title: Column, same_contact: Column) -> Column:
    """A8: confirmed, possible or none."""
    return F.when((description >= 0.95) & ((title >= 0.70) | same_contact), "confirmed").when((description >= 0.85) & (title >= 0.60), "possible").otherwise("none")


def groups(pairs: DataFrame, a: str, b: str, level: str) -> DataFrame:
    """(id, component, group_id, level): a group is confirmed if any of its edges is (AG-18, AG-19)."""
    pairs = cut(pairs)  # read twice
    parts = cut(connected_components(pairs.where(F.col(level) != "none"), a, b))
    edge = pairs.where(F.col(level) == "confirmed").select(F.col(a).alias("id")).distinct()
    sure = parts.join(edge, "id", "left_semi").select("component", F.lit(True).alias("sure")).distinct()
    ids = parts.groupBy("component").agg(group_id(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string"))).alias("group_id"), F.count("*").alias("members"))
    return parts.join(ids, "component").join(sure, "component", "left").select("id", "component", "group_id", "members", F.when(F.col("sure"), "confirmed").otherwise("possible").alias("level"))


def canonical(df: DataFrame, group: str, first_seen: str, seconds: int, order: list[Column]) -> DataFrame:
    """``df`` with ``is_canonical``: of those seen within ``seconds`` of the group's first, the first in ``order`` (WN-06)."""
    w = W.partitionBy(group)
    early = F.col(first_seen).cast("timestamp").cast("double") - F.min(F.col(first_seen).cast("timestamp").cast("double")).over(w) <= seconds
    ranked = df.withColumn("_early", early)
    rank = F.row_number().over(w.orderBy(F.desc("_early"), *order))
    return ranked.withColumn("is_canonical", rank == 1).drop("_early")


def exclude_copies(candidates: DataFrame, target_key: str, key: str, url: str, target_url: str, fingerprint: str, target_fingerprint: str, group: str, target_group: str) -> DataFrame:
    """``candidates`` without the target itself and its copies by key, address, fingerprint or group (JN-07, JN-09)."""
    eq = lambda x, y: (F.coalesce(F.col(x), F.lit("")) != "") & (F.col(x) == F.col(y))
    same = (F.col(key) == F.col(target_key)) | eq(url, target_url) | eq(fingerprint, target_fingerprint) | eq(group, target_group)
    return candidates.where(~F.coalesce(same, F.lit(False)))


def rebuild(new: DataFrame, old: DataFrame, keep: str = "detected_at") -> DataFrame:
    """Rebuilt duplicate table that keeps each group's earliest detection (SNK-15)."""
    before = old.groupBy("group_id").agg(F.min(keep).alias("_old"))
    return new.join(before, "group_id", "left").withColumn(keep, F.least(F.col(keep), F.col("_old"))).drop("_old")
