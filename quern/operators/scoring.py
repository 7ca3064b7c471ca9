"""Scores, ladders and gates (SCR-01..17, SCR-25..27, SCR-29; ladders A5-A9) as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import numeric, stats

SEVERITY = {"none": 0, "info": 0, "low": 5, "medium": 15, "high": 40, "blocking": 40}
MAX_RISK = 40


@dataclass(frozen=True)
class DealRules:
    """Thresholds of the deal ladder, with the defaults of the blueprint."""

    reserve: float = 0.10
    hot_profit: int = 4000
    hot_roi: int = 20
    hot_roi_alone: int = 100
    good_roi: int = 15
    quality: int = 50
    target_profit: float = 8000.0
    target_roi: float = 100.0


def financials(price: Column, acquisition: Column, logistics: Column, platform: Column, quick: Column, reserve: float = 0.10) -> dict[str, Column]:
    """SCR-06 in exact decimals: base, reserve, total, profit, roi percent."""
    d = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(14,2)")
    base = numeric.cents(price.cast("decimal(14,2)") + d(acquisition) + d(logistics) + d(platform))
    held = numeric.cents(base * F.lit(str(reserve)).cast("decimal(4,2)"))
    total = numeric.cents(base + held)
    profit = numeric.cents(quick.cast("decimal(14,2)") - total)
    roi = numeric.cents(F.try_divide((profit * 100).cast("decimal(20,2)"), total))
    return {"base_cost": base, "reserve": held, "total_cost": total, "profit": profit, "roi": roi}


def deal_status(hard_reject: Column, manual: Column, profit: Column, roi: Column, liquidity: Column, confidence: Column, level: Column, r: DealRules = DealRules()) -> Column:
    """SCR-08, A6: first match wins."""
    money = ((profit >= r.hot_profit) & (roi >= r.hot_roi)) | (roi >= r.hot_roi_alone)
    good = (liquidity >= r.quality) & (confidence >= r.quality) & level.isin("medium", "high")
    solid = ((profit >= r.hot_profit) & (roi >= r.good_roi)) | ((profit > 0) & (roi >= r.good_roi) & level.isin("medium", "high"))
    return (F.when(hard_reject, "REJECT").when(profit <= 0, "REJECT").when(roi <= 0, "REJECT").when(manual, "MANUAL_REVIEW")
            .when(money & good, "HOT").when(money, "INTERESTING").when(solid, "INTERESTING").otherwise("LOW_PRIORITY"))


def manual_reasons(**flags: Column) -> Column:
    """Names of the flags that hold, in the order given (SCR-07, A5)."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())


def cap_hot(status: Column, estimated: Column) -> Column:
    """SCR-09: HOT on an estimated price is at most INTERESTING."""
    return F.when((status == "HOT") & estimated, "INTERESTING").otherwise(status)


def purchase_price(price: Column, amount: Column, currency: Column, rates: Column) -> Column:
    """PRJ-06: the home price, else the amount in the home currency, else by the map of rates, else NULL."""
    ccy = F.upper(F.coalesce(currency, F.lit("CZK")))
    rate = F.try_element_at(rates, ccy)
    return F.coalesce(price.cast("double"), F.when(ccy == "CZK", amount.cast("double")).when(rate != 0, amount.cast("double") * rate))


def isolate_errors(broken: Column, status: Column, flags: Column) -> Column:
    """(status, flags): a row whose figures couldn't be worked out becomes a review of its own and leaves the others alone (SCR-11)."""
    return F.struct(F.when(broken, "MANUAL_REVIEW").otherwise(status).alias("status"), F.when(broken, F.array(F.lit("deal_evaluation_error"))).otherwise(flags).alias("flags"))


def count_facts(values: list[Column]) -> Column:
    """How many of the values are known: neither NULL, empty, 0 nor false (AG-29)."""
    known = (F.when(F.coalesce(v.cast("string"), F.lit("")).isin("", "0", "0.0", "false"), 0).otherwise(1) for v in values)
    return sum(known, F.lit(0))


def deal_score(profit: Column, roi: Column, liquidity: Column, confidence: Column, condition: Column, flags: Column, r: DealRules = DealRules()) -> Column:
    """SCR-10: weighted mean of what is known, 0 to 100."""
    share = lambda c, top: numeric.clamp(c.cast("double") / top * 100, 0.0, 100.0)
    known = lambda c, x: F.when(c.isNotNull(), x)
    parts = [(known(profit, share(profit, r.target_profit)), 25.0), (known(roi, share(roi, r.target_roi)), 25.0), (liquidity.cast("double"), 20.0), (confidence.cast("double"), 15.0), (condition.cast("double"), 10.0), (F.greatest(F.lit(0.0), 100.0 - 20.0 * flags), 5.0)]
    return numeric.half_even_score(stats.weighted_mean_renormalised(parts), 2)


def risk_penalty(severities: Column) -> Column:
    """Sum of severities, at most 40 (SCR-12, AG-28)."""
    table = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.least(F.lit(MAX_RISK), F.aggregate(severities, F.lit(0), lambda s, x: s + F.coalesce(F.try_element_at(table, x), F.lit(0))))


def analysis_priority(hidden: Column, urgency: Column, quality: Column, identity: Column, facts: Column, severities: Column) -> tuple[Column, Column]:
    """SCR-13: (score, action)."""
    points = (F.lit(25) + F.when(hidden, 30).otherwise(0) + F.when(urgency == "high", 20).when(urgency == "medium", 8).otherwise(0) + F.when(quality == "high", 5).when(quality == "medium", 3).otherwise(0)
              + F.when(identity >= 0.80, 10).when(identity >= 0.55, 5).otherwise(-5) + F.when(facts >= 3, 5).otherwise(0) - risk_penalty(severities))
    action = F.when(F.array_contains(severities, "blocking"), "BLOCKED").when(points >= 30, "DEEP").otherwise("SHALLOW")
    return points, action


def price_anomaly(outlier: Column, discount: Column) -> Column:
    """SCR-14."""
    return outlier | F.coalesce(discount >= 35, F.lit(False))


def notification_priority(status: Column, profit: Column, roi: Column, liquidity: Column, confidence: Column, signals: Column, penalty: Column) -> Column:
    """SCR-15: base by status and capped shares of the figures."""
    base = F.when(status == "HOT", 55).when(status == "INTERESTING", 40).when(status == "MANUAL_REVIEW", 20).when(status == "LOW_PRIORITY", 5).otherwise(0)
    part = lambda c, top, most: F.coalesce(numeric.clamp(c.cast("double") / top * most, 0.0, float(most)), F.lit(0.0))
    total = base + part(profit, 8000.0, 20) + part(roi, 100.0, 15) + part(liquidity, 100.0, 10) + part(confidence, 100.0, 10) + signals - penalty
    return numeric.half_even_score(total, 1)


def send_decision(status: Column, score: Column, blocking: Column, strong: Column, has_signals: Column) -> Column:
    """SCR-16, A7."""
    review = F.when(strong | (score >= 60) | ~has_signals, "SEND").otherwise("SKIP")
    return (F.when(status.isNull(), "SEND").when(blocking, "BLOCK").when(status == "HOT", F.when(score >= 0, "SEND").otherwise("SKIP"))
            .when(status == "INTERESTING", F.when(score >= 40, "SEND").otherwise("SKIP")).when(status == "MANUAL_REVIEW", review).otherwise("SEND"))


def final_status(excluded: Column, age_hours: Column, status: Column, gate: Column, selected: Column) -> Column:
    """SCR-17, A9."""
    return (F.when(selected, "sent").when(excluded, "excluded").when(age_hours > 6, "expired").when(status == "LOW_PRIORITY", "low_priority").when(status == "REJECT", "excluded")
            .when(gate == "BLOCK", "excluded").otherwise("not_selected"))


def preliminary_score(age_hours: Column, brand: Column, model: Column, year: Column, size: Column, price: Column, long_text: Column, location: Column, cached: Column, discount: Column, used_discount: Column, used_confidence: Column, negotiable: Column, urgent: Column) -> Column:
    """SCR-01."""
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    new = F.when(discount >= 60, 25).when(discount >= 45, 20).when(discount >= 30, 12).when(discount >= 15, 5).otherwise(0)
    used = F.when(used_confidence.isin("medium", "high"), F.when(used_discount >= 30, 12).when(used_discount >= 15, 7).otherwise(0)).otherwise(0)
    total = flag(age_hours.between(-1, 6), 15) + flag(brand, 5) + flag(model, 10) + flag(year, 3) + flag(size, 3) + flag(price, 5) + flag(long_text, 5) + flag(location, 2) + flag(cached, 10) + new + used + flag(negotiable, 3) + flag(urgent, 5)
    held = numeric.clamp(total, 0, 100)
    return F.when(~F.coalesce(model, F.lit(False)) & (price | long_text), F.greatest(held, F.lit(35))).otherwise(held).cast("int")


def priority_class(score: Column, hard_reject: Column, discount: Column) -> Column:
    """SCR-02."""
    by_score = F.when(score >= 80, "urgent").when(score >= 60, "interesting").when(score >= 35, "manual").otherwise("low")
    return F.when(hard_reject | (score <= 0), "excluded").when(F.coalesce(discount >= 80, F.lit(False)), "manual").otherwise(by_score)


def condition(x: Column, positive: list[str], done: list[str], service: list[str], problem: list[str]) -> Column:
    """SCR-03 on normalised text: completed service counts as positive even if negated, and is blanked before service terms are sought."""
    from quern.functions.text import any_term_unless_negated, any_word

    finished = any_word(x, done)
    rest = x
    for phrase in done:
        rest = F.replace(rest, F.lit(phrase), F.lit(" "))
    rest = F.trim(F.regexp_replace(rest, " +", " "))
    good = finished | any_term_unless_negated(x, positive)
    broken, needs = any_term_unless_negated(rest, problem), any_term_unless_negated(rest, service)
    return F.when(good & (broken | needs), "contradictory").when(broken, "problematic").when(needs, "service_required").when(good, "good").otherwise("unknown")


def estimate_check(low: Column, mid: Column, high: Column, asking: Column) -> Column:
    """SCR-25: reason an estimate is rejected, '' if it stands."""
    return (F.when(mid.isNull() | ~mid.between(500, 500_000), "out_of_bounds").when((low > mid) | (high < mid), "range_order").when(F.try_divide(high, low) > 2.5, "range_too_wide")
            .when(~F.coalesce(F.try_divide(mid, asking).between(0.15, 8.0), F.lit(True)), "asking_ratio").otherwise(""))


def invariant_gap(a: Column, b: Column, tolerance: float = 0.011) -> Column:
    """SCR-29: the two differ by more than the tolerance, or one is not a number."""
    x, y = a.cast("double"), b.cast("double")
    return F.coalesce(F.isnan(x) | F.isnan(y) | (F.abs(x - y) > tolerance), F.lit(True))
