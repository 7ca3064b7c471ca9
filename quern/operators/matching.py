"""Null-tolerant predicates, price ladders, alias and comparable matching (FIL, SRC-09, ENT, JN-08..12, SCR-18..21)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import numeric, text


def within_when_known(x: Column, low, high) -> Column:
    """Bounds that hold only for known values (FIL-01)."""
    return x.isNull() | x.between(low, high)


def same_or_unknown(a: Column, b: Column) -> Column:
    """Equality that an unknown ('' or NULL) side passes (FIL-15)."""
    x, y = F.coalesce(F.lower(a), F.lit("")), F.coalesce(F.lower(b), F.lit(""))
    return (x == "") | (y == "") | (x == y)


def differ_when_known(a: Column, b: Column) -> Column:
    """Mismatch only where both sides are known (FIL-16)."""
    return ~same_or_unknown(a, b)


def price_status(raw: Column) -> Column:
    """Price text to missing, negotiable, free, in_description, numeric or parse_error (SRC-09)."""
    t = text.strip_accents(F.trim(F.coalesce(raw, F.lit(""))))
    return (F.when(t == "", "missing").when(t.contains("dohod"), "negotiable").when(t.contains("zdarma"), "free")
            .when(t.contains("v textu"), "in_description").when(t.rlike("[0-9]"), "numeric").otherwise("parse_error"))


def price_amount(raw: Column) -> Column:
    """First run of digits as an integer, NULL if none or too large (SRC-04)."""
    return F.regexp_extract(F.coalesce(raw, F.lit("")), "([0-9]+)", 1).try_cast("int")


def currency(x: Column, default: str) -> Column:
    """Currency by the first marker in order (SRC-17)."""
    t = F.lower(x)
    marks = [("kč", "CZK"), ("kc", "CZK"), ("czk", "CZK"), ("€", "EUR"), ("eur", "EUR"), ("zł", "PLN"), ("pln", "PLN"), ("chf", "CHF"), ("£", "GBP"), ("$", "USD")]
    out = F.lit(default)
    for mark, code in reversed(marks):
        out = F.when(t.contains(mark), code).otherwise(out)
    return out


def longest_alias(df: DataFrame, key: str, x: str, aliases: DataFrame) -> DataFrame:
    """(key, alias, canonical): the longest alias that stands at word boundaries (ENT-01, ENT-03).

    The dictionary is a fixed dimension, so every row is tested against all of it.
    """
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    hits = df.join(F.broadcast(aliases), pad(F.col(x)).contains(pad(F.col("alias"))))
    best = F.min_by(F.struct("alias", "canonical"), F.struct(-F.length("alias"), F.col("alias"))).alias("b")
    return hits.groupBy(key).agg(best).select(key, "b.alias", "b.canonical")


def offer_score(brand: Column, model_equal: Column, model_jaccard: Column, subset: Column, matches: list[tuple[Column, Column, float]]) -> tuple[Column, Column]:
    """(score, reason) of an offer (SCR-18): the first known mismatch rejects, agreements add up.

    ``matches`` holds (offer side, wanted side, points) of further attributes.
    """
    model = F.when(model_equal, 0.45).when((model_jaccard >= 0.75) & subset, 0.30 * model_jaccard)
    reason = F.when(~brand, "brand").when(model.isNull(), "model")
    total = F.lit(0.35) + model
    for i, (x, y, points) in enumerate(matches):
        reason = reason.when(differ_when_known(x, y), f"attribute_{i}")
        known = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
        total = total + F.when(known, points).otherwise(0.0)
    reason = reason.otherwise("")
    return F.when(reason == "", numeric.half_even_score(F.least(total, F.lit(1.0)), 4)).otherwise(0.0), reason


def market_route(brand: Column, category: Column, by_brand: dict[str, list[str]], by_category: dict[str, list[str]], default: list[str], home: str, last: str) -> Column:
    """Markets to ask in order: home, at most two national ones by brand, category or default, the continental last (SCR-20)."""

    def pick(x: Column, table: dict[str, list[str]]) -> Column:
        cells = F.create_map(*[c for k, v in table.items() for c in (F.lit(k), F.array(*[F.lit(m) for m in v]))])
        return F.try_element_at(cells, F.lower(x))

    national = F.coalesce(pick(brand, by_brand), pick(category, by_category), F.array(*[F.lit(m) for m in default]))
    return F.array_distinct(F.concat(F.array(F.lit(home)), F.slice(F.filter(national, lambda m: ~m.isin(home, last)), 1, 2), F.array(F.lit(last))))


def identity_confidence(brand: Column, confirmed: Column, candidate: Column, gen: Column, year: Column, wheel: Column, kind: Column) -> Column:
    """ENT-10: brand .40, confirmed model .40 or candidate .20, details; unconfirmed at most .65."""
    some = lambda c, w: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", w).otherwise(0.0)
    total = some(brand, 0.40) + F.when(confirmed, 0.40).when(F.coalesce(candidate, F.lit("")) != "", 0.20).otherwise(0.0) + some(gen, 0.07) + some(year, 0.06) + some(wheel, 0.04) + some(kind, 0.03)
    return numeric.half_even_score(F.when(confirmed, total).otherwise(F.least(total, F.lit(0.65))), 2)


def fuzzy_alias_udf(aliases: list[str], least: float = 0.90):
    """Arrow kernel of the fuzzy fallback (ENT-04): best ratio above ``least`` of alias and token window."""
    long_enough = [(a, len(a.split())) for a in aliases if len(a) >= 4]

    def best(s: str | None) -> str | None:
        words = (s or "").lower().split()
        top, name = least, None
        for alias, n in long_enough:
            for i in range(max(0, len(words) - n + 1)):
                m = difflib.SequenceMatcher(None, alias, " ".join(words[i : i + n]))
                if m.real_quick_ratio() > top and m.quick_ratio() > top and (r := m.ratio()) > top:
                    top, name = r, alias
        return name

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(best)

    return run


def greedy_clusters(df: DataFrame, target: str, order: list[str], key: str, x: str, least: float) -> DataFrame:
    """``df`` with ``cluster``: each row joins the first cluster whose first member is similar enough (JN-10).

    The order is explicit, so the result doesn't depend on arrival; one target's
    candidates are few, which is what a group of applyInPandas holds.
    """
    from quern.functions.text import _ratio

    schema = T.StructType([*df.schema.fields, T.StructField("cluster", df.schema[key].dataType)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        heads: list[tuple] = []
        names = []
        for k, s in zip(group[key], group[x], strict=True):
            name = next((h for h, t in heads if _ratio(t, s, True) >= least), None)
            if name is None:
                heads.append((k, s))
                name = k
            names.append(name)
        return group.assign(cluster=names)

    return df.groupBy(target).applyInPandas(run, schema)
