"""Scoring and decision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import matching, scoring, valuation
from quern.plans.registry import query, table

BASE = """
b AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS BIGINT) AS price, CAST(l_quantity AS INTEGER) AS q, CAST(p_retailprice * l_quantity * 1.25 AS BIGINT) AS quick, p_size, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT *, CAST(price AS DECIMAL(18,2)) + CAST(q AS DECIMAL(18,2)) * 2 + 50 + 25 AS base_cost FROM b),
d AS (SELECT *, CAST(round(base_cost * 0.10, 2) AS DECIMAL(18,2)) AS reserve FROM c),
e AS (SELECT *, base_cost + reserve AS total_cost, CAST(quick AS DECIMAL(18,2)) - base_cost - reserve AS profit FROM d),
f AS (SELECT *, CAST(sign(profit) * floor(abs(CAST(profit AS DOUBLE)) * 10000 / CAST(total_cost AS DOUBLE) + 0.5) / 100 AS DECIMAL(18,2)) AS roi FROM e)"""


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    x = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    x = x.select("l_orderkey", "l_linenumber", "l_returnflag", "p_size", F.bround("l_extendedprice").cast("long").alias("price"), F.col("l_quantity").cast("int").alias("q"), F.bround(F.col("p_retailprice") * F.col("l_quantity") * 1.25).cast("long").alias("quick"))
    money = scoring.financials(F.col("price"), F.col("q") * 2, F.lit(50), F.lit(25), F.col("quick"))
    return x.select("*", *(c.alias(n) for n, c in money.items()))


@query(f"WITH {BASE} SELECT l_orderkey, l_linenumber, CAST(base_cost AS DOUBLE) AS base_cost, CAST(total_cost AS DOUBLE) AS total_cost, CAST(profit AS DOUBLE) AS profit, CAST(roi AS DOUBLE) AS roi FROM f")
def deal_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-06, MTH-03."""
    return _deals(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in ("base_cost", "total_cost", "profit", "roi")))


STATUS = f"""WITH {BASE},
g AS (SELECT *, least(100, p_size * 2) AS liquidity, least(100, q * 2) AS confidence FROM f),
h AS (SELECT *, CASE WHEN liquidity >= 70 THEN 'high' WHEN liquidity >= 50 THEN 'medium' ELSE 'low' END AS level FROM g),
s AS (SELECT *, (profit >= 4000 AND roi >= 20) OR roi >= 100 AS money FROM h),
z AS (SELECT *, CASE WHEN l_returnflag = 'R' AND q = 1 THEN 'REJECT' WHEN profit <= 0 THEN 'REJECT' WHEN roi <= 0 THEN 'REJECT' WHEN q % 10 = 0 THEN 'MANUAL_REVIEW'
 WHEN money AND liquidity >= 50 AND confidence >= 50 AND level IN ('medium', 'high') THEN 'HOT' WHEN money THEN 'INTERESTING'
 WHEN (profit >= 4000 AND roi >= 15) OR (profit > 0 AND roi >= 15 AND level IN ('medium', 'high')) THEN 'INTERESTING' ELSE 'LOW_PRIORITY' END AS status FROM s)"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _deals(spark, sf_dir).withColumn("liquidity", F.least(F.lit(100), F.col("p_size") * 2)).withColumn("confidence", F.least(F.lit(100), F.col("q") * 2))
    status = scoring.deal_status((F.col("l_returnflag") == "R") & (F.col("q") == 1), F.col("q") % 10 == 0, F.col("profit"), F.col("roi"), F.col("liquidity"), F.col("confidence"), valuation.liquidity_level(F.col("liquidity")))
    return x.withColumn("status", status)


@query(f"{STATUS} SELECT l_orderkey, l_linenumber, status, q % 10 = 0 AS manual FROM z")
def deal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-07, SCR-08, SCR-09."""
    return _statuses(spark, sf_dir).select("l_orderkey", "l_linenumber", "status", (F.col("q") % 10 == 0).alias("manual"))


@query(f"""{STATUS} SELECT l_orderkey, l_linenumber, round_even(round((CASE status WHEN 'HOT' THEN 55 WHEN 'INTERESTING' THEN 40 WHEN 'MANUAL_REVIEW' THEN 20 WHEN 'LOW_PRIORITY' THEN 5 ELSE 0 END
 + least(greatest(CAST(profit AS DOUBLE) / 8000.0 * 20, 0.0), 20.0) + least(greatest(CAST(roi AS DOUBLE) / 100.0 * 15, 0.0), 15.0) + liquidity / 100.0 * 10 + confidence / 100.0 * 10 + 0 - 5 * CAST(q % 10 = 0 AS INTEGER)) * 10, 6), 0) / 10 AS score FROM z""")
def notification_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-15."""
    x = _statuses(spark, sf_dir)
    s = scoring.notification_priority(F.col("status"), F.col("profit"), F.col("roi"), F.col("liquidity"), F.col("confidence"), F.lit(0), F.when(F.col("q") % 10 == 0, 5).otherwise(0))
    return x.select("l_orderkey", "l_linenumber", s.alias("score"))


@query(f"""{STATUS} SELECT l_orderkey, l_linenumber, CASE WHEN q = 50 THEN 'BLOCK' WHEN status = 'HOT' THEN 'SEND' WHEN status = 'INTERESTING' THEN CASE WHEN p_size >= 20 THEN 'SEND' ELSE 'SKIP' END WHEN status = 'MANUAL_REVIEW' THEN CASE WHEN q = 40 OR p_size * 2 >= 60 THEN 'SEND' ELSE 'SKIP' END ELSE 'SEND' END AS gate,
CASE WHEN l_returnflag = 'A' AND q = 2 THEN 'excluded' WHEN p_size % 9 > 6 THEN 'expired' WHEN status = 'LOW_PRIORITY' THEN 'low_priority' WHEN status = 'REJECT' THEN 'excluded' WHEN q = 50 THEN 'excluded' ELSE 'not_selected' END AS final FROM z""")
def send_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-16, SCR-17."""
    x = _statuses(spark, sf_dir)
    gate = scoring.send_decision(F.col("status"), F.col("p_size") * 2, F.col("q") == 50, F.col("q") == 40, F.lit(True))
    final = scoring.final_status((F.col("l_returnflag") == "A") & (F.col("q") == 2), F.col("p_size") % 9, F.col("status"), gate, F.lit(False))
    return x.select("l_orderkey", "l_linenumber", gate.alias("gate"), final.alias("final"))


@query("""WITH e AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS hidden, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'low' END AS urgency, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS quality, (o_orderkey % 100) / 100.0 AS identity, o_orderkey % 5 AS facts, o_orderkey % 7 AS sev FROM orders),
s AS (SELECT *, 25 + CASE WHEN hidden THEN 30 ELSE 0 END + CASE urgency WHEN 'high' THEN 20 WHEN 'medium' THEN 8 ELSE 0 END + CASE quality WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 0 END + CASE WHEN identity >= 0.80 THEN 10 WHEN identity >= 0.55 THEN 5 ELSE -5 END + CASE WHEN facts >= 3 THEN 5 ELSE 0 END - CASE sev WHEN 0 THEN 40 WHEN 1 THEN 20 WHEN 2 THEN 5 ELSE 0 END AS score FROM e)
SELECT k, CAST(score AS INTEGER) AS score, CASE WHEN sev = 0 THEN 'BLOCKED' WHEN score >= 30 THEN 'DEEP' ELSE 'SHALLOW' END AS action FROM s""")
def analysis_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-12, SCR-13."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    urgency = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("low")
    quality = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    sev = F.when(F.col("k") % 7 == 0, arr("blocking", "medium")).when(F.col("k") % 7 == 1, arr("low", "medium")).when(F.col("k") % 7 == 2, arr("low")).otherwise(F.array().cast("array<string>"))
    score, action = scoring.analysis_priority(F.col("k") % 3 == 0, urgency, quality, (F.col("k") % 100) / 100.0, F.col("k") % 5, sev)
    return o.select("k", score.cast("int").alias("score"), action.alias("action"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 11 END AS age, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'Gen 2' END AS gen, CAST(round_even(p_retailprice * 30, 0) AS BIGINT) AS p FROM part),
r AS (SELECT p_partkey, p * CASE WHEN age IS NOT NULL THEN [0.80, 0.70, 0.62, 0.55, 0.48, 0.42, 0.35][CAST(greatest(1, least(age, 7)) AS INTEGER)] WHEN gen <> '' THEN 0.55 END AS v FROM x)
SELECT p_partkey, CAST(round_even(v / (CASE WHEN v >= 50000 THEN 500 ELSE 100 END), 0) * (CASE WHEN v >= 50000 THEN 500 ELSE 100 END) AS BIGINT) AS price FROM r""")
def depreciation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-23, MTH-02."""
    part = table(spark, sf_dir, "part")
    age = F.when(F.col("p_size") % 6 != 0, F.col("p_size") % 11)
    gen = F.when(F.col("p_size") % 4 == 0, "").otherwise("Gen 2")
    return part.select("p_partkey", valuation.depreciated(F.bround(F.col("p_retailprice") * 30).cast("long"), age, gen).alias("price"))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 12 < 6 THEN 'exact' WHEN event_id % 12 < 9 THEN 'close' ELSE 'model_family' END AS kind, event_id % 2 = 0 AS home, (event_id % 100) / 100.0 AS score, CAST(epoch(TIMESTAMP '2024-03-01' - ts) / 86400 AS DOUBLE) AS age FROM events)
SELECT event_id, round_even(round(CAST((CASE kind WHEN 'exact' THEN CASE WHEN home THEN 1.0 ELSE 0.65 END WHEN 'close' THEN CASE WHEN home THEN 0.75 ELSE 0.5 END ELSE CASE WHEN home THEN 0.45 ELSE 0.3 END END * greatest(0.35, CAST(score AS DOUBLE)) * CASE WHEN age <= 30 THEN 1.0 WHEN age <= 90 THEN 0.9 ELSE 0.75 END) AS DOUBLE) * 10000, 6), 0) / 10000 AS weight FROM x""")
def comparable_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-22."""
    k = F.col("event_id")
    kind = F.when(k % 12 < 6, "exact").when(k % 12 < 9, "close").otherwise("model_family")
    age = (F.lit("2024-03-01").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400
    return table(spark, sf_dir, "events").select("event_id", valuation.comparable_weight(kind, k % 2 == 0, (k % 100) / 100.0, age).alias("weight"))


@query("""WITH x AS (SELECT p_partkey, p_size, lower(p_brand) AS b, lower(split_part(p_type, ' ', 1)) AS c FROM part)
SELECT p_partkey, array_to_string(list_concat(list_concat(['HOME'], CASE WHEN b = 'brand#11' THEN ['DE', 'NL'] WHEN c = 'economy' THEN ['PL'] WHEN c = 'promo' THEN ['AT', 'DE'] ELSE ['DE', 'NL'] END), ['EU']), ',') AS route FROM x""")
def market_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-20: home, two national, the continental last."""
    route = matching.market_route(F.col("p_brand"), F.split_part("p_type", F.lit(" "), F.lit(1)), {"brand#11": ["DE", "NL", "PL"]}, {"economy": ["PL"], "promo": ["AT", "DE", "EU"]}, ["DE", "NL"], "HOME", "EU")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(route, ",").alias("route"))


@query("""WITH x AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_brand = b.p_brand AS sb, string_split(lower(a.p_type), ' ') AS ta, string_split(lower(b.p_type), ' ') AS tb, a.p_size % 3 AS ga, b.p_size % 3 AS gb FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
j AS (SELECT *, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) AS jac, len(list_filter(ta, lambda t: NOT list_contains(tb, t))) = 0 AS sub, list_sort(ta) = list_sort(tb) AS eq FROM x),
m AS (SELECT *, CASE WHEN eq THEN 0.45 WHEN jac >= 0.75 AND sub THEN 0.30 * jac END AS model FROM j),
r AS (SELECT *, CASE WHEN NOT sb THEN 'brand' WHEN model IS NULL THEN 'model' WHEN ga <> 0 AND gb <> 0 AND ga <> gb THEN 'attribute_0' ELSE '' END AS reason FROM m)
SELECT a, b, reason, CASE WHEN reason = '' THEN round_even(round(CAST(least(0.35 + model + CASE WHEN ga <> 0 AND gb <> 0 THEN 0.12 ELSE 0.0 END, 1.0) AS DOUBLE) * 10000, 6), 0) / 10000 ELSE 0.0 END AS score FROM r""")
def offer_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11, SCR-18, SRC-26."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split(F.lower("p_type"), " ").alias("t"), F.when(F.col("p_size") % 3 == 0, "").otherwise((F.col("p_size") % 3).cast("string")).alias("g"))
    x = p.alias("a").join(p.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    ta, tb = F.col("a.t"), F.col("b.t")
    jac = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    score, reason = matching.offer_score(F.col("a.p_brand") == F.col("b.p_brand"), F.array_sort(ta) == F.array_sort(tb), jac, F.size(F.array_except(ta, tb)) == 0, [(F.col("a.g"), F.col("b.g"), 0.12)])
    return x.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), reason.alias("reason"), score.alias("score"))


@query("""WITH x AS (SELECT o_orderkey AS k, CAST(o_orderkey % 11 AS INTEGER) - 2 AS age, o_orderkey % 2 = 0 AS model, o_orderkey % 3 = 0 AS price, o_orderkey % 5 = 0 AS txt, CAST(o_orderkey % 90 AS INTEGER) AS d, o_orderkey % 7 = 0 AS rej FROM orders),
s AS (SELECT *, least(100, CASE WHEN age BETWEEN -1 AND 6 THEN 15 ELSE 0 END + 5 + CASE WHEN model THEN 10 ELSE 0 END + CASE WHEN price THEN 5 ELSE 0 END + CASE WHEN txt THEN 5 ELSE 0 END + 2 + CASE WHEN d >= 60 THEN 25 WHEN d >= 45 THEN 20 WHEN d >= 30 THEN 12 WHEN d >= 15 THEN 5 ELSE 0 END + CASE WHEN d >= 30 THEN 12 WHEN d >= 15 THEN 7 ELSE 0 END) AS t FROM x),
u AS (SELECT *, CAST(CASE WHEN NOT model AND (price OR txt) THEN greatest(t, 35) ELSE t END AS INTEGER) AS score FROM s)
SELECT k, score, CASE WHEN rej OR score <= 0 THEN 'excluded' WHEN d >= 80 THEN 'manual' WHEN score >= 80 THEN 'urgent' WHEN score >= 60 THEN 'interesting' WHEN score >= 35 THEN 'manual' ELSE 'low' END AS class FROM u""")
def preliminary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-01, SCR-02."""
    k, no = F.col("o_orderkey"), F.lit(False)
    d = (k % 90).cast("int")
    s = scoring.preliminary_score((k % 11).cast("int") - 2, F.lit(True), k % 2 == 0, no, no, k % 3 == 0, k % 5 == 0, F.lit(True), no, d, d, F.lit("high"), no, no)
    x = table(spark, sf_dir, "orders").select(k.alias("k"), s.alias("score"), d.alias("d"))
    return x.select("k", "score", scoring.priority_class(F.col("score"), F.col("k") % 7 == 0, F.col("d")).alias("class"))


@query("""SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE abs(l_extendedprice * (1 - l_discount) * (1 + l_tax) - (l_extendedprice - l_extendedprice * l_discount + (l_extendedprice - l_extendedprice * l_discount) * l_tax)) > 0.011) AS gaps, COUNT(*) FILTER (WHERE l_quantity < 0 OR l_extendedprice < 0) AS negative, COUNT(*) FILTER (WHERE NOT isfinite(l_extendedprice)) AS not_finite FROM lineitem""")
def invariant_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-29, SUP-26."""
    p, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    gap = scoring.invariant_gap(p * (1 - d) * (1 + t), (p - p * d) + (p - p * d) * t)
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows"), F.count_if(gap).alias("gaps"), F.count_if((F.col("l_quantity") < 0) | (p < 0)).alias("negative"), F.count_if(F.isnan(p) | (F.abs(p) == float("inf"))).alias("not_finite"))


@query(f"""{STATUS} SELECT l_orderkey, l_linenumber, round_even(round(((least(greatest(CAST(profit AS DOUBLE) / 8000.0 * 100, 0.0), 100.0) * 25 + least(greatest(CAST(roi AS DOUBLE) / 100.0 * 100, 0.0), 100.0) * 25 + liquidity * 20.0 + confidence * 15.0 + CASE WHEN q % 2 = 0 THEN 80.0 * 10 ELSE 0.0 END + greatest(0.0, 100.0 - 20.0 * (q % 3)) * 5) / (90.0 + CASE WHEN q % 2 = 0 THEN 10.0 ELSE 0.0 END)) * 100, 6), 0) / 100 AS score FROM z""")
def deal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-10."""
    x = _statuses(spark, sf_dir)
    s = scoring.deal_score(F.col("profit"), F.col("roi"), F.col("liquidity"), F.col("confidence"), F.when(F.col("q") % 2 == 0, 80.0), F.col("q") % 3)
    return x.select("l_orderkey", "l_linenumber", s.alias("score"))


@query("""WITH x AS (SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS mid, CAST(p_retailprice * (1 - (p_size % 10) / 10.0) AS BIGINT) AS low, CAST(p_retailprice * 1.3 AS BIGINT) AS high, CAST(p_retailprice / (1 + p_size % 9) AS BIGINT) AS asking FROM part)
SELECT p_partkey, CASE WHEN NOT mid BETWEEN 500 AND 500000 THEN 'out_of_bounds' WHEN low > mid OR high < mid THEN 'range_order' WHEN high / nullif(low, 0) > 2.5 THEN 'range_too_wide' WHEN NOT coalesce(mid / nullif(asking, 0) BETWEEN 0.15 AND 8.0, true) THEN 'asking_ratio' ELSE '' END AS rejected FROM x""")
def estimate_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-25, SCR-26, SUP-12."""
    r, s = F.col("p_retailprice"), F.col("p_size")
    n = lambda c: F.bround(c).cast("long")
    x = table(spark, sf_dir, "part").select("p_partkey", n(r).alias("mid"), n(r * (1 - (s % 10) / F.lit(10.0))).alias("low"), n(r * 1.3).alias("high"), n(r / (1 + s % 9)).alias("asking"))
    return x.select("p_partkey", scoring.estimate_check(F.col("low"), F.col("mid"), F.col("high"), F.col("asking")).alias("rejected"))


@query()
def condition_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-03 on document heads; the terms are frequent words of the texts."""
    from quern.functions.text import normalize_text

    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", normalize_text(F.col("text")).alias("t"))
    return d.select("doc_id", scoring.condition(F.col("t"), ["with"], ["of the"], ["from"], ["that"]).alias("condition"))
