"""Group valuation (SCR-05, 19, 20, 22, 23, 24; ladders A1-A4) and breaker runs (WN-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions import numeric, stats

#: Weight of a comparable by match type and geography.
MATCH_WEIGHTS = {
    "exact_home": 1.0, "exact_abroad": 0.65, "close_home": 0.75, "close_abroad": 0.5, "model_family_home": 0.45,
    "model_family_abroad": 0.3, "component_class_home": 0.2, "component_class_abroad": 0.12,
}
#: Share of the new price by age in years; older keeps the last.
DEPRECIATION = [0.80, 0.70, 0.62, 0.55, 0.48, 0.42, 0.35]
GENERATION_ONLY = 0.55


def value_groups(rows: DataFrame, keys: list[str], price: str, weight: str) -> DataFrame:
    """Robust market price of every group: outliers out, weighted quantiles, range, confidence, status, lifetime."""
    kept = stats.judged(stats.histogram(rows, keys, price, weight), keys, price, *stats.MARKET).where("kept")
    part = W.partitionBy(*keys)
    counts = (F.col(price) > 0) & (F.col("_w") > 0)
    run = kept.withColumn("_run", F.sum(F.when(counts, F.col("_w"))).over(part.orderBy(price).rowsBetween(W.unboundedPreceding, 0))).withColumn("_sum", F.sum(F.when(counts, F.col("_w"))).over(part))
    at = lambda q: F.min(F.when(counts & (F.col("_run") >= F.col("_sum") * q), F.col(price)))
    z = run.groupBy(*keys).agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"), F.sum("_n").alias("n"), F.min(price).alias("pmin"), F.max(price).alias("pmax")).where("mid IS NOT NULL")
    s = stats.spread(F.col("pmin"), F.col("pmax"), F.col("mid"))
    lo = F.when(F.col("n") >= 3, F.col("low").cast("double")).when(F.col("n") == 2, F.col("pmin") * 0.95).otherwise(F.col("mid") * 0.85)
    hi = F.when(F.col("n") >= 3, F.col("high").cast("double")).when(F.col("n") == 2, F.col("pmax") * 1.05).otherwise(F.col("mid") * 1.15)
    confidence = F.when((F.col("n") >= 5) & (s <= 0.35), "high").when((F.col("n") >= 3) & (s <= 0.55), "medium").otherwise("low")
    market = numeric.step_round(F.col("mid"))
    out = z.select(*keys, "n", F.round(s, 6).alias("spread"), confidence.alias("confidence"), market.alias("market_price"), numeric.step_round(lo).alias("low_price"), numeric.step_round(hi).alias("high_price"))
    return out.select(
        "*",
        F.when(F.col("n") <= 2, "market_price_low_confidence").otherwise("market_price_found").alias("status"),
        F.when(F.col("confidence") == "high", 168).otherwise(72).alias("ttl_hours"),
        numeric.step_round(F.col("market_price") * 0.85).alias("quick_price"),
    )


def retail_confidence(stores: Column, spread: Column) -> Column:
    """SCR-19: 1 store low; 2 medium up to 0.35; 3 and more high up to 0.25, medium up to 0.50."""
    two = F.when(spread <= 0.35, "medium").otherwise("low")
    more = F.when(spread <= 0.25, "high").when(spread <= 0.50, "medium").otherwise("low")
    return F.when(stores <= 1, "low").when(stores == 2, two).otherwise(more)


def liquidity(exact: Column, close: Column, family: Column, component: Column, sources: Column, home: Column) -> Column:
    """SCR-05 points, 0 to 100."""
    points = 12 * exact + 8 * close + 4 * family + 2 * component + 5 * F.least(sources, F.lit(4)) + F.when(home, 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int")


def liquidity_level(points: Column) -> Column:
    return F.when(points >= 70, "high").when(points >= 50, "medium").otherwise("low")


def days_to_sell(points: Column) -> Column:
    return F.when(points >= 70, 21).when(points >= 50, 45).otherwise(75)


def market_scope(home: Column, abroad: Column) -> Column:
    """SCR-04."""
    return F.when((home > 0) & (abroad > 0), "mixed").when(home > 0, "home_only").when(abroad > 0, "foreign_only").otherwise("unknown")


def comparable_weight(match_type: Column, at_home: Column, score: Column, age_days: Column) -> Column:
    """SCR-22: table weight, at least 0.35 of it by score, less when older than 30 and 90 days."""
    table = F.create_map(*[F.lit(x) for pair in MATCH_WEIGHTS.items() for x in pair])
    base = F.coalesce(F.try_element_at(table, F.concat_ws("_", match_type, F.when(at_home, "home").otherwise("abroad"))), F.lit(0.0))
    fresh = F.when(age_days.isNull() | (age_days <= 30), 1.0).when(age_days <= 90, 0.9).otherwise(0.75)
    return numeric.half_even_score(base * F.greatest(F.lit(0.35), score) * fresh, 4)


def depreciated(new_price: Column, age_years: Column, generation: Column) -> Column:
    """SCR-23: step-rounded share of the whole new price by age, else by generation alone, else NULL.

    The share is taken in decimals: as floats 0.55 of 27,000 lies above the tie it is.
    """
    share = lambda x: F.lit(str(x)).cast("decimal(2,2)")
    by_age = F.element_at(F.array(*[share(x) for x in DEPRECIATION]), F.greatest(F.lit(1), F.least(age_years, F.lit(len(DEPRECIATION)))).cast("int"))
    rate = F.when(age_years.isNotNull(), by_age).when(F.coalesce(generation, F.lit("")) != "", share(GENERATION_ONLY))
    return numeric.step_round((new_price.cast("decimal(20,0)") * rate).cast("double"))


def error_runs(events: DataFrame, key: str, order: list[str], is_error: Column) -> DataFrame:
    """``events`` with ``errors_in_a_row``: errors since the last success of the key (gaps and islands)."""
    w = W.partitionBy(key).orderBy(*order)
    marked = events.withColumn("_bad", F.when(is_error, 1).otherwise(0)).withColumn("_island", F.sum(1 - F.col("_bad")).over(w))
    run = F.sum("_bad").over(W.partitionBy(key, "_island").orderBy(*order))
    return marked.withColumn("errors_in_a_row", run.cast("long")).drop("_bad", "_island")
