"""One cycle as a single DataFrame plan: union, dedup, upsert, score, gate, select, funnel.

Fetching, model calls and delivery are at the edges (``quern.sources``); what
lies between them is one plan over listings, state, valuations and answers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import scoring, selection, state, valuation
from quern.sources.config import Config

KEYS = ["source", "external_id"]


@dataclass
class Cycle:
    new: DataFrame
    state: DataFrame
    scored: DataFrame
    selected: DataFrame
    funnel: DataFrame


def run(batch: DataFrame, before: DataFrame, valuations: DataFrame, costs: DataFrame, config: Config, now: Column) -> Cycle:
    """``batch`` and ``before`` hold listings (source, external_id, title, description, url, price_czk, published_at, ..., first_seen_at, last_seen_at).

    ``valuations`` is (source, external_id, quick_price, market_price, exact, close, family, component, sources, home, confidence),
    ``costs`` (source, external_id, acquisition, logistics, platform).
    """
    arrivals = selection.first_per_key(batch, KEYS, [F.desc_nulls_last("published_at"), F.asc("url"), F.asc("title")])
    new = state.upsert(before, arrivals, KEYS, [], new_only=True)
    after = state.upsert(before, arrivals, KEYS, [c for c in before.columns if c not in (*KEYS, "first_seen_at")])
    x = new.join(valuations, KEYS, "left").join(costs, KEYS, "left")
    money = scoring.financials(F.col("price_czk"), F.col("acquisition"), F.col("logistics"), F.col("platform"), F.col("quick_price"))
    x = x.select("*", *(c.alias(n) for n, c in money.items()))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    x = x.withColumn("liquidity", valuation.liquidity(zero("exact"), zero("close"), zero("family"), zero("component"), zero("sources"), F.coalesce("home", F.lit(False))))
    points = F.when(F.col("confidence") == "high", 90).when(F.col("confidence") == "medium", 65).otherwise(30)
    reasons = scoring.manual_reasons(price_missing=F.col("price_czk").isNull(), valuation_missing=F.col("quick_price").isNull(), confidence_low=F.coalesce("confidence", F.lit("low")) == "low")
    x = x.withColumn("reasons", reasons).withColumn("confidence_score", points)
    manual = F.size("reasons") > 0
    status = F.coalesce(scoring.deal_status(F.lit(False), manual, F.coalesce("profit", F.lit(1)), F.coalesce("roi", F.lit(1)), F.col("liquidity"), F.col("confidence_score"), valuation.liquidity_level(F.col("liquidity"))), F.lit("MANUAL_REVIEW"))
    x = x.withColumn("status", status)
    x = x.withColumn("notification_score", scoring.notification_priority(F.col("status"), F.col("profit"), F.col("roi"), F.col("liquidity"), F.col("confidence_score"), F.lit(0), F.lit(0)))
    age = (now.cast("double") - F.col("published_at").cast("double")) / 3600
    x = x.withColumn("age_hours", age).withColumn("gate", scoring.send_decision(F.col("status"), F.col("notification_score"), F.lit(False), F.lit(False), F.lit(False)))
    able = x.where(F.col("status").isin(*config.enabled_statuses) & (F.coalesce("age_hours", F.lit(0.0)) <= config.max_age_hours) & (F.col("gate") == "SEND"))
    order = [F.desc("notification_score"), *(F.asc(k) for k in KEYS)]
    selected = selection.source_ranks(selection.quota_select(able, "status", order, config.max_notifications, config.reserved_reviews), "source", "status", order)
    sent = x.join(selected.select(*KEYS, F.lit(True).alias("sent")), KEYS, "left").withColumn("sent", F.coalesce("sent", F.lit(False)))
    scored = sent.withColumn("final", scoring.final_status(F.lit(False), F.coalesce("age_hours", F.lit(0.0)), F.col("status"), F.col("gate"), F.col("sent")))
    funnel = scored.agg(F.count("*").alias("new"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in selection.STATUS_ORDER), F.count_if("sent").alias("sent"), F.count_if(F.col("final") == "expired").alias("expired"), F.round(F.avg("notification_score"), 1).alias("average_priority"))
    return Cycle(new, after, scored, selected, funnel)
