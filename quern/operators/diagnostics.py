"""Why a valuation or a decision is what it is (SCR-28, SUP-09, SUP-22, SUP-27, SUP-28), as columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import identity

#: Causes of a low confidence; the first one that holds is the primary one.
CAUSES = "duplicate_only_results|no_unique_comparables|foreign_market|weak_model_match|few_comparables|large_price_spread|one_source|other".split("|")
NEGATIVE = "nefunkcni|poskozene|nepojizdne|na opravu|pred servisem|potrebuje servis|nutny servis".split("|")


def confidence_causes(v: Column, spread: Column) -> Column:
    """All causes of a low confidence, in the order of ``CAUSES``; none where it isn't low.

    ``v`` has confidence, status, comparables_unique, exact_comparables,
    close_comparables, home_comparables, foreign_comparables and sources_used.
    """
    unique, sources = F.coalesce(v["comparables_unique"], F.lit(0)), F.size(F.array_distinct(F.coalesce(v["sources_used"], F.array().cast("array<string>"))))
    holds = {
        "duplicate_only_results": v["status"] == "duplicate_only_results", "no_unique_comparables": unique <= 0,
        "foreign_market": (v["status"] == "foreign_only_estimate") | ((v["foreign_comparables"] > 0) & (v["home_comparables"] == 0)),
        "weak_model_match": (unique > 0) & (v["exact_comparables"] + v["close_comparables"] == 0), "few_comparables": (unique > 0) & (unique < 3), "large_price_spread": spread > 0.55, "one_source": sources == 1,
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in holds.items()]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(v["confidence"], F.lit("")) != "low", none).when(F.size(found) == 0, F.array(F.lit("other"))).otherwise(found)


def primary_cause(causes: Column) -> Column:
    return F.coalesce(F.get(causes, F.lit(0)), F.lit("other"))


def missing_price_cause(v: Column, brand: Column, model: Column) -> Column:
    """Why there is no quick-sale price, '' if there is one; first match wins."""
    unnamed = (F.coalesce(brand, F.lit("")) == "") | (F.coalesce(model, F.lit("")) == "")
    return (
        F.when(v["quick_sale_price"].isNotNull(), "")
        .when(v["status"].isin("no_matching_comparables", "duplicate_only_results"), v["status"])
        .when(v["market_price"].isNull() & (v["comparables_unique"] > 0), "no_market_median")
        .when((v["status"] == "ambiguous_model") | unnamed, "insufficient_model_identification")
        .when(v["status"].isin("currency_error", "source_unavailable"), "technical_error")
        .otherwise("other")
    )


def condition_group(whole: Column, description: Column, has_image: Column, positive: list[str], least_chars: int) -> tuple[Column, Column]:
    """(primary, labels) of what a normalised text says about the condition."""
    good, bad = identity.any_part(whole, positive), identity.any_part(whole, NEGATIVE)
    silent, short = ~good & ~bad, F.length(description) < least_chars
    labels = {
        "positive_negative_conflict": good & bad, "unrecognized_positive_condition_phrase": good & ~bad, "short_description": short, "photos_but_no_textual_condition": silent & has_image,
        "no_condition_information_in_text": silent, "other_unrecognized_negative_condition": bad & ~good,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in labels.items()]), lambda x: x.isNotNull())
    first = F.get(F.filter(found, lambda x: x != "other_unrecognized_negative_condition"), F.lit(0))
    return F.coalesce(first, F.lit("other")), found


def hard_filter_provenance(title: Column, audience: Column, stored_class: Column, stored_status: Column, stored_reason: Column) -> Column:
    """(result, reason, computed_reason, computed_source) of an exclusion, from what is computed now and what was stored."""
    now = identity.hard_filter_reason(title, audience)
    before = F.coalesce((stored_class == "excluded") | (stored_status == "excluded"), F.lit(False))
    said = F.when(before, F.coalesce(stored_reason, F.lit(""))).otherwise("")
    reason = F.when(now != "", now).when(said != "", said).when(before, "stored_excluded").otherwise("")
    source = F.when(now == "hard_filter_kids_bike", "identity.audience").when(now != "", "title accessory terms").otherwise("")
    return F.struct(F.when((now != "") | before, "excluded").otherwise("pass").alias("result"), reason.alias("reason"), now.alias("computed_reason"), source.alias("computed_source"))


#: Where a flag comes from.
FLAG_SOURCES = {
    "condition_unknown": "title and description", "low_market_confidence": "stored valuation", "purchase_price_outlier": "price-outlier rule", "manual_risk": "stored analysis",
    "hard_filter_kids_bike": "identity.audience", "hard_filter_accessory_or_part": "title accessory terms", "deal_evaluation_error": "evaluator", "price_anomaly": "evaluator", "estimated_price": "evaluator",
}


def blocker_sources(flags: Column, values: Column) -> Column:
    """[(flag, source, value)] of the flags whose source is known; ``values`` is a map of what each rests on."""
    table = F.create_map(*[F.lit(x) for p in FLAG_SOURCES.items() for x in p])
    known = F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.map_contains_key(table, f))
    return F.transform(known, lambda f: F.struct(f.alias("flag"), F.element_at(table, f).alias("source"), F.try_element_at(values, f).alias("value")))


def diagnostic_sample(listings: DataFrame, limit: int, at: str = "last_seen_at", who: str = "identity") -> DataFrame:
    """The latest ``limit`` listings with a brand and a model, raising where there are fewer (SUP-09)."""
    i = F.col(who)
    out = listings.where((F.coalesce(i["brand"], F.lit("")) != "") & (F.coalesce(i["model"], F.lit("")) != "")).orderBy(F.desc(at), "key").limit(limit)
    if (n := out.count()) < limit:
        raise ValueError(f"only {n} listings with an identity for {limit} diagnostics")
    return out


def distribution(df: DataFrame, column: str, labels: list[str] | None = None) -> DataFrame:
    """(label, n, percent) of a column, zero-filled in the order of ``labels`` where given (SUP-28, AG-23)."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    if labels:
        dim = df.sparkSession.createDataFrame(list(enumerate(labels)), "at int, label string")
        counts = F.broadcast(dim).join(counts, "label", "left").select("at", "label", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("percent", F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("all")), F.lit(0.0)), 1))
    return out.orderBy("at").select("label", "n", "percent") if labels else out.select("label", "n", "percent")


def report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(section, label, n, percent): the distributions of several columns as one table, ready for ``sinks.write_report`` (SUP-28)."""
    parts = [distribution(df, c).select(F.lit(c).alias("section"), "label", "n", "percent") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decode_analysis(stored: DataFrame, column: str, schema: str) -> DataFrame:
    """Stored JSON read back (SUP-22): unknown keys dropped, rows that can't be read left out."""
    parsed = stored.withColumn("_a", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    return parsed.where("_a IS NOT NULL").select(*(c for c in stored.columns if c != column), "_a.*")
