"""Robust statistics over groups (AG-01..05, AG-08, AG-13, AG-27), as DataFrame operations.

Medians, deviations and quantiles are taken from a histogram of each group, summed
on the map side: windows sort distinct values, never rows, so a group of any
number of rows is a small matter for the task that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def histogram(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, _n rows, _w sum of the positive weights) for every value but NULL, summed on the map side."""
    w = F.sum(F.when(F.col(weight) > 0, F.col(weight))) if weight else F.count("*")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), w.alias("_w"))


def quantiles_of(hist: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row a group of a histogram: for each name the least value whose running weight reaches that share (AG-02).

    Values that aren't positive don't count, nor those without weight.
    """
    part = W.partitionBy(*keys)
    run = hist.where((F.col(value) > 0) & (F.col("_w") > 0)).withColumn("_run", F.sum("_w").over(part.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(part))
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("_run") >= F.col("_all") * q, F.col(value))).alias(n) for n, q in quantiles.items()))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, quantiles: dict[str, float]) -> DataFrame:
    """AG-02 over rows: NULL values and weights that are not positive don't count."""
    return quantiles_of(histogram(df, keys, value, weight), keys, value, quantiles)


def _middle(x: Column, run: Column, total: Column, part) -> Column:
    """Mean of the middle two of the values x with running count ``run`` of ``total``, over the window ``part``."""
    low, high = (F.min(F.when(run >= at, x)).over(part) for at in (F.floor((total + 1) / 2), F.floor(total / 2) + 1))
    return (low + high) / 2


def medians_of(hist: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name, n, low, high): median, number, least and greatest value of each group of a histogram."""
    part = W.partitionBy(*keys)
    run = hist.withColumn("_all", F.sum("_n").over(part)).withColumn("_run", F.sum("_n").over(part.orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    at = lambda position: F.min(F.when(F.col("_run") >= position, F.col(value)))
    middle = (at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2
    return run.groupBy(*keys).agg(middle.alias(name), F.sum("_n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def judged(hist: DataFrame, keys: list[str], value: str, low: float, high: float, least: int, mad: float | None, keep_all: bool) -> DataFrame:
    """The histogram with ``kept``: inside low..high medians and, with ``mad``, within that many absolute deviations.

    Groups under ``least`` values stay whole; a deviation of 0 passes everything;
    ``keep_all`` restores a group of which nothing would be left (AG-03, 04, 05).
    Every window is over distinct values, in one partitioning.
    """
    part = W.partitionBy(*keys)
    up_to = lambda order: part.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    wide = hist.withColumn("_all", F.sum("_n").over(part)).withColumn("_run", F.sum("_n").over(up_to(value)))
    wide = wide.withColumn("_m", _middle(F.col(value), F.col("_run"), F.col("_all"), part))
    ratio = F.col(value).between(F.col("_m") * low, F.col("_m") * high)
    if mad is not None:
        wide = wide.withColumn("_gap", F.abs(F.col(value) - F.col("_m"))).withColumn("_run", F.sum("_n").over(up_to("_gap")))
        wide = wide.withColumn("_d", _middle(F.col("_gap"), F.col("_run"), F.col("_all"), part))
        ratio = ratio & ((F.col("_d") == 0) | (F.col("_gap") <= F.col("_d") * mad))
    wide = wide.withColumn("kept", F.when(F.col("_all") < least, True).otherwise(ratio))
    if keep_all:
        wide = wide.withColumn("kept", F.col("kept") | ~F.max("kept").over(part))
    return wide.select(*hist.columns, "kept")


#: Rules of ``judged``: AG-03 market (keeps all rather than none), AG-04 offers (may keep none), AG-05 ratio alone.
MARKET, OFFERS, RATIO = (0.50, 1.90, 4, 3.5, True), (0.55, 1.80, 3, 3.5, False), (0.55, 1.80, 3, None, False)


def outliers(df: DataFrame, keys: list[str], value: str, rule: tuple) -> DataFrame:
    """``df`` with ``kept`` by a rule of ``judged``; rows look their value up in the judged histogram, NULL ones aren't kept."""
    table = judged(histogram(df, keys, value), keys, value, *rule).select(*keys, value, "kept")
    return df.join(table, [*keys, value], "left").select(*df.columns, F.coalesce("kept", F.lit(False)).alias("kept"))


def market_outliers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AG-03: 0.50 to 1.90 medians and 3.5 deviations from 4 values on; keeps all rather than none."""
    return outliers(df, keys, value, MARKET)


def offer_outliers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AG-04: 0.55 to 1.80 medians and 3.5 deviations from 3 values on; may keep none."""
    return outliers(df, keys, value, OFFERS)


def ratio_outliers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AG-05: 0.55 to 1.80 medians from 3 values on."""
    return outliers(df, keys, value, RATIO)


def weighted_mean_renormalised(parts: list[tuple[Column, float]]) -> Column:
    """Mean over the components that are known, weights rescaled to them; NULL where none is (AG-13)."""
    top = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    bottom = sum((F.when(x.isNotNull(), F.lit(float(w))).otherwise(0.0) for x, w in parts), F.lit(0.0))
    return F.try_divide(top, F.nullif(bottom, F.lit(0.0)))


def spread(low: Column, high: Column, price: Column) -> Column:
    """(max - min) / price (AG-08)."""
    return F.try_divide(high - low, price)
