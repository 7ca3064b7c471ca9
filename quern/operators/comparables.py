"""Comparables of an offer: match ladder (JN-08, SCR-21), reject terms (FIL-07), pre-filter (FIL-06, FIL-12), duplicates (JN-06)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import identity
from quern.operators.dedup import duplicate_level
from quern.session import cut

#: Parts of a comparable's text that say it is a deposit, for rent or wanted.
REJECT = "gezocht|gesucht|suche|koupim|wanted|pronajem|rent|mesicne|monthly payment|zaloha|depozit|deposit".split("|")
WANTED = "szukam|kupie|zoek|kaufe|looking for|hledam|poptavam|poptavka|shanim|kupim|gezocht|gesucht|suche|koupim|wanted".split("|")
COMPONENTS = ("frame_material", "fork_class", "drivetrain_class", "brake_class", "suspension_type")
#: Attributes that must not differ between duplicates, in the order in which they are named as a reason.
DUPLICATE_FIELDS = ("generation", "model_year", "wheel_size", "frame_size", "trim", "bike_type", "electric", "audience")


def _known(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("")) != ""


def _norm(x: Column) -> Column:
    return text.normalize_text(F.coalesce(x.cast("string"), F.lit("")))


def compatible(a: Column, b: Column) -> Column:
    """Equal when normalised, or unknown on a side (FIL-15)."""
    return ~_known(a) | ~_known(b) | (_norm(a) == _norm(b))


def prepared(i: Column) -> Column:
    """An identity with its words normalised, '' and 0 where unknown: taken once a row, before rows are paired."""
    words, labels = ("brand", "model", "model_family", "generation", "trim"), ("audience", "bike_type", *COMPONENTS)
    power = F.when(i["electric"], "yes").when(~i["electric"], "no").otherwise("")
    return F.struct(*(_norm(i[c]).alias(c) for c in words), *(F.coalesce(i[c], F.lit("")).alias(c) for c in labels), power.alias("electric"), F.coalesce(i["model_year"], F.lit(0)).alias("model_year"), F.coalesce(i["travel_mm"], F.lit(0)).alias("travel_mm"))


def refused(title: Column, combined: Column) -> Column:
    """FIL-07: a comparable that is a part, a deposit, for rent or wanted, by its normalised title and whole text."""
    return identity.has_accessory_terms(title) | identity.any_part(combined, REJECT)


def _facts(t: Column, c: Column) -> dict[str, Column]:
    """What the match ladder asks about a pair of ``prepared`` identities, each answer once."""
    both = lambda f: (t[f] != "") & (c[f] != "")
    same = lambda f: both(f) & (t[f] == c[f])
    travel = (t["travel_mm"] != 0) & (c["travel_mm"] != 0)
    out = {f"_{f}_differs": both(f) & (t[f] != c[f]) for f in ("electric", "audience", "bike_type", "suspension_type", "generation", "trim")}
    out |= {f"_same_{f}": same(f) for f in ("brand", "model", "model_family", "bike_type")}
    out["_years"] = F.when((t["model_year"] != 0) & (c["model_year"] != 0), F.abs(t["model_year"] - c["model_year"]))
    out["_known"] = reduce(lambda x, y: x + y, (both(f).cast("int") for f in COMPONENTS), travel.cast("int"))
    out["_agree"] = reduce(lambda x, y: x + y, (same(f).cast("int") for f in COMPONENTS), (travel & (F.abs(t["travel_mm"] - c["travel_mm"]) <= 20)).cast("int"))
    return out


def _reason(no: Column) -> Column:
    """Why a comparable matches or doesn't, from the columns of ``_facts``; first rule wins (SCR-21)."""
    is_ = lambda name: F.col(f"_{name}")
    brand, years = is_("same_brand"), is_("years")
    model, family = brand & is_("same_model"), brand & is_("same_model_family") & ~is_("generation_differs")
    out = F.when(no, "part_payment_rental_or_wanted")
    for f in ("electric", "audience", "bike_type", "suspension_type"):
        out = out.when(is_(f"{f}_differs"), f"{f}_mismatch")
    return (
        out.when(model & is_("generation_differs"), "generation_mismatch")
        .when(model & is_("trim_differs"), "trim_differs_same_model_family")
        .when(model, F.when(years <= 1, "exact_brand_model").when(years.isNull(), "exact_model_year_unknown").when(years <= 2, "exact_model_close_year").otherwise("model_year_too_far"))
        .when(family, F.when(years.isNull() | (years <= 3), "same_model_family").otherwise("family_year_too_far"))
        .when(is_("same_bike_type") & (is_("known") >= 2) & (is_("agree") >= 0.67 * is_("known")), "similar_component_class")
        .when(~brand, "brand_mismatch")
        .otherwise("model_mismatch")
    )


#: Match type and score of each reason that isn't a rejection; exact ones lose 0.05 for a year.
MATCHES = {
    "exact_brand_model": ("exact", 1.0), "exact_model_year_unknown": ("close", 0.82), "exact_model_close_year": ("close", 0.78), "trim_differs_same_model_family": ("model_family", 0.62),
    "same_model_family": ("model_family", 0.60), "similar_component_class": ("component_class", 0.38),
}


def match_comparables(pairs: DataFrame, t: str, c: str, no: str) -> DataFrame:
    """``pairs`` with match_type, score and reason (JN-08); ``t`` and ``c`` are ``prepared``, ``no`` is whether the comparable is ``refused``."""
    table = F.create_map(*[F.lit(x) for k, (kind, _) in MATCHES.items() for x in (k, kind)])
    points = F.create_map(*[F.lit(x) for k, (_, score) in MATCHES.items() for x in (k, score)])
    out = pairs.withColumns(_facts(F.col(t), F.col(c))).withColumn("reason", _reason(F.col(no)))
    gap = F.when(F.col("reason") == "exact_brand_model", 0.05 * F.col("_years")).otherwise(0.0)
    score = F.round(F.coalesce(F.try_element_at(points, F.col("reason")), F.lit(0.0)) - gap, 3)
    return out.select(*pairs.columns, "reason", F.coalesce(F.try_element_at(table, F.col("reason")), F.lit("rejected")).alias("match_type"), score.alias("score"))


def wanted_term(title: Column) -> Column:
    """The first word of a normalised title that says something is sought, else ''."""
    return F.regexp_extract(title, r"\b(" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in WANTED) + r")\b", 1)


def prefilter(title: Column, audience: Column, price: Column, is_duplicate: Column, low: int | None = None, high: int | None = None, need_price: bool = False) -> Column:
    """(passed, reason_code, matched_rule): the first rule that keeps an offer from analysis (FIL-06, A4)."""
    row = lambda code, rule: F.struct(F.lit(code == "").alias("passed"), F.lit(code).alias("reason_code"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("matched_rule"))
    hard, wanted = identity.hard_filter_reason(title, audience), wanted_term(title)
    out = F.when(F.coalesce(is_duplicate, F.lit(False)), row("DUPLICATE", "confirmed_cross_source_duplicate"))
    out = out.when(hard == "hard_filter_accessory_or_part", row("PARTS_OR_ACCESSORY", hard)).when(hard != "", row("KIDS_BIKE", hard))
    out = out.when(wanted != "", row("WANTED_AD", F.concat(F.lit("wanted_keyword:"), wanted)))
    out = out.when(price.isNull(), row("NO_PRICE", "price_missing") if need_price else row("", ""))
    if low is not None:
        out = out.when(price < low, row("PRICE_OUT_OF_RANGE", f"below_min:{low}"))
    if high is not None:
        out = out.when(price > high, row("PRICE_OUT_OF_RANGE", f"above_max:{high}"))
    return out.otherwise(row("", ""))


def lookup_eligible(cached: Column, excluded: Column, brand: Column, model: Column) -> Column:
    """FIL-12: worth a lookup, as it isn't cached, not excluded, and has a brand and a model."""
    return ~F.coalesce(cached, F.lit(False)) & ~F.coalesce(excluded, F.lit(False)) & _known(brand) & _known(model)


def contact_fingerprint(x: Column) -> Column:
    """Hash of the sorted contacts in a text, '' without any."""
    joined = F.array_join(text.contacts(x), "|")
    return F.when(joined == "", "").otherwise(F.sha2(joined, 256))


def duplicate_pairs(df: DataFrame, key: str = "key", source: str = "source", price: str = "price", who: str = "identity", title: str = "title", description: str = "description") -> DataFrame:
    """(a, b, level, reason, similarity, title_similarity) of the pairs of different sources with equal price, brand and model (JN-06).

    Price, brand and model are the block of an equi join; rows without one of them
    have no pair.  Rows of a block that agree in all that is compared form a class:
    pairs of classes are judged, conflicts of attributes before any text, and the
    verdict is joined to their rows, so texts that repeat are compared once, however
    many rows have them.  What is compared is worked out once a row and kept in the
    shared folder, so ``df`` is read once.
    """
    i = F.col(who)
    known = df.where((F.coalesce(F.col(price), F.lit(0)) != 0) & _known(i["brand"]) & _known(i["model"]) & F.col(key).isNotNull() & F.col(source).isNotNull())
    block = known.select(
        F.col(price).alias("_price"), _norm(i["brand"]).alias("_brand"), _norm(i["model"]).alias("_model"), F.col(key).alias("key"), F.col(source).alias("source"), *(F.when(_known(i[f]), _norm(i[f])).alias(f) for f in DUPLICATE_FIELDS),
        F.coalesce(F.col(title), F.lit("")).alias("title"), F.coalesce(F.col(description), F.lit("")).alias("description"),
    )
    block = block.withColumns({"contact": contact_fingerprint(F.concat_ws("\n", "title", "description")), "_t": text.duplicate_text(F.col("title")), "_d": text.duplicate_text(F.col("description"))})
    block = cut(block.drop("title", "description"))
    compared = ["source", *DUPLICATE_FIELDS, "contact", "_t", "_d"]
    named = block.withColumn("class", F.unhex(F.md5(F.to_json(F.struct("_price", "_brand", "_model", *compared)))))
    classes = named.groupBy("class", "_price", "_brand", "_model", *compared).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    side = lambda x: classes.select("_price", "_brand", "_model", *(F.col(c).alias(f"{c}_{x}") for c in ("class", "low", "high", *compared)))
    pairs = side("a").join(side("b"), ["_price", "_brand", "_model"]).where("source_a <> source_b AND low_a < high_b")
    differ = lambda f: F.coalesce(F.col(f"{f}_a") != F.col(f"{f}_b"), F.lit(False))
    reason = reduce(lambda out, f: out.when(differ(f), f"{f}_mismatch"), DUPLICATE_FIELDS[1:], F.when(differ(DUPLICATE_FIELDS[0]), f"{DUPLICATE_FIELDS[0]}_mismatch")).otherwise("")
    pairs = pairs.withColumn("_why", reason)
    none = F.lit("")
    if_free = lambda c: F.when(F.col("_why") == "", F.col(c)).otherwise(none)
    scored = pairs.withColumns({"similarity": text.similarity_long(if_free("_d_a"), if_free("_d_b")), "title_similarity": text.similarity_short(if_free("_t_a"), if_free("_t_b"))})
    same_contact = (F.col("contact_a") != "") & (F.col("contact_a") == F.col("contact_b"))
    level = F.when(F.col("_why") != "", "none").otherwise(duplicate_level(F.col("similarity"), F.col("title_similarity"), same_contact))
    said = F.when(F.col("_why") != "", F.col("_why")).when(level == "confirmed", "same_price_identity_and_description").when(level == "possible", "same_price_identity_and_similar_text").otherwise("text_similarity_below_threshold")
    judged = scored.select("class_a", "class_b", level.alias("level"), said.alias("reason"), "similarity", "title_similarity")
    members = lambda x: named.select(F.col("class").alias(f"class_{x}"), F.col("key").alias(x))
    return judged.join(members("a"), "class_a").join(members("b"), "class_b").where("a < b").select("a", "b", "level", "reason", "similarity", "title_similarity")
