"""Golden values of rounding, statistics and text."""

import pytest
from pyspark.sql import functions as F

from quern.functions import numeric, stats, text
from quern.operators import dedup, matching, scoring, selection, valuation
from quern.operators.components import connected_components, group_id


def one(spark, *cols, **values):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("v,want", [(12050, 12000), (12150, 12200), (12049, 12000), (50250, 50000), (50750, 51000), (49999, 50000)])
def test_step_round(spark, v, want):
    assert one(spark, numeric.step_round(F.lit(v)))[0] == want


def test_half_even_and_discount(spark):
    r = one(spark, numeric.half_even(F.lit(2.5)), numeric.half_even(F.lit(1.5)), numeric.percent_discount(F.lit(14900), F.lit(30000)), numeric.percent_discount(F.lit(10), F.lit(16)), numeric.percent_discount(F.lit(0), F.lit(16)))
    assert list(r) == [2.0, 2.0, 50, 38, None]


def test_lookup_budget(spark):
    want = {0: 0, 1: 1, 10: 10, 11: 10, 30: 10, 31: 15, 70: 15, 71: 15, 100: 20, 500: 20}
    rows = spark.createDataFrame([(n,) for n in want], "n int").select("n", numeric.lookup_budget(F.col("n")).alias("b")).collect()
    assert {r["n"]: r["b"] for r in rows} == want


def test_financials(spark):
    m = scoring.financials(F.lit(10001), F.lit(100), F.lit(50), F.lit(25), F.lit(17000))
    r = one(spark, *(c.cast("double").alias(n) for n, c in m.items()))
    assert r.asDict() == {"base_cost": 10176.0, "reserve": 1017.6, "total_cost": 11193.6, "profit": 5806.4, "roi": 51.87}


def test_convert_missing_rate(spark):
    assert list(one(spark, numeric.convert(F.lit(500), F.lit(24.0)), numeric.convert(F.lit(500), F.lit(None).cast("double")), numeric.convert(F.lit(5), F.lit(0.0)))) == [12000, None, None]


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 20, 1.0), (1, 30, 5.0), (2, 10, 1.0), (2, 20, 1.0), (3, None, 1.0), (3, 5, 0.0), (4, 0, 1.0)], "k int, v int, w double")
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in stats.weighted_quantiles(df, ["k"], "v", "w", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()}
    assert got == {1: (20, 30, 30), 2: (10, 10, 20)}


def test_outliers(spark):
    df = spark.createDataFrame([(1, v) for v in (19000, 19500, 20000, 20500, 100000)] + [(2, 1), (2, 100)], "k int, v int")
    kept = {(r["k"], r["v"]) for r in stats.market_outliers(df, ["k"], "v").where("kept").collect()}
    assert kept == {(1, 19000), (1, 19500), (1, 20000), (1, 20500), (2, 1), (2, 100)}


def test_valuation_of_even_prices(spark):
    df = spark.createDataFrame([("a", p, 1) for p in range(19000, 21001, 500)], "k string, p int, w int")
    r = valuation.value_groups(df, ["k"], "p", "w").first()
    assert (r["market_price"], r["confidence"], r["quick_price"]) == (20000, "high", 17000)


def test_valuation_of_one_price(spark):
    r = valuation.value_groups(spark.createDataFrame([("a", 20000, 1)], "k string, p int, w int"), ["k"], "p", "w").first()
    assert (r["quick_price"], r["low_price"], r["high_price"], r["confidence"]) == (17000, 17000, 23000, "low")


def test_renormalised_mean(spark):
    none = F.lit(None).cast("double")
    r = one(spark, stats.weighted_mean_renormalised([(F.lit(80.0), 25.0), (none, 75.0)]), stats.weighted_mean_renormalised([(none, 1.0)]))
    assert list(r) == [80.0, None]


def test_liquidity(spark):
    r = one(spark, valuation.liquidity(F.lit(2), F.lit(2), F.lit(0), F.lit(0), F.lit(2), F.lit(True)).alias("p"))
    assert r["p"] == 60 and one(spark, valuation.liquidity_level(F.lit(60)))[0] == "medium"


@pytest.mark.parametrize("raw,want", [('Dětské kolo, 27,5" – Cervélo R5', 'detske kolo 27.5" cervelo r5'), ("Straße 1,599.00", "strasse 1.599.00")])
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(text.normalize_text(F.col("x"))).first()[0] == want
    assert df.select(text.normalize_text_exact("x")).first()[0] == want


def test_similarity(spark):
    df = spark.createDataFrame([("abc def", "abc deg"), ("a b", "b a"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text.text_similarity(F.col("a"), F.col("b"))).collect()] == [0.8571, 0.3333, 0.0]


def test_group_id(spark):
    assert one(spark, group_id(F.array(F.lit("b:1"), F.lit("a:2"))))[0] == "dup-5b76de22492a3101171e"


def test_negation(spark):
    rows = [("velmi dobry stav", True), ("neni dobry stav", False), ("neni v dobry stav", False), ("is not dobry", False), ("dobrycz", False), ("ne dobry ale dobry", True)]
    df = spark.createDataFrame(rows, "x string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", text.any_term_unless_negated(F.col("x"), ["dobry"])).collect())


def test_condition(spark):
    rows = [("delal jsem servis vidlice", "good"), ("nutny servis", "service_required"), ("rozbity ram", "problematic"), ("jako nove ale rozbity ram", "contradictory"), ("kolo", "unknown")]
    df = spark.createDataFrame(rows, "x string, want string")
    c = scoring.condition(F.col("x"), ["jako nove"], ["delal jsem servis"], ["servis"], ["rozbity"])
    assert [r["c"] for r in df.withColumn("c", c).collect()] == [w for _, w in rows]


def test_components_chain_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 110)] + [(200, 201), (201, 202), (202, 200)] + [(1, 1), (None, 3), (39, 40), (39, 40)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int").repartition(5)).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{k: 100 for k in range(100, 110)}, 200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_components_meet_in_common_larger_node(spark):
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame([("a", "z"), ("b", "z")], "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "z": "a"}


def test_quota_backfill(spark):
    rows = [(i, "MANUAL_REVIEW", 100 - i) for i in range(8)] + [(100 + i, "HOT", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, status string, score int")
    got = selection.quota_select(df, "status", [F.desc("score"), F.asc("k")], 6, 2)
    assert {r["k"] for r in got.collect()} == {100, 101, 102, 0, 1, 2}


def test_fuzzy_alias(spark):
    df = spark.createDataFrame([("trek marln 7 2024",), ("nothing here",)], "x string")
    assert [r[0] for r in df.select(matching.fuzzy_alias_udf(["marlin 7"])(F.col("x"))).collect()] == ["marlin 7", None]


def test_duplicate_level(spark):
    f, t = F.lit(False), F.lit(True)
    r = one(spark, *(dedup.duplicate_level(F.lit(d), F.lit(h), c) for d, h, c in [(0.96, 0.7, f), (0.96, 0.1, t), (0.9, 0.6, f), (0.9, 0.5, t)]))
    assert list(r) == ["confirmed", "confirmed", "possible", "none"]


def test_contacts_and_scrub(spark):
    df = spark.createDataFrame([("Mail Jan@Example.com or +420 123 456 789 <b>x</b>",)], "x string")
    r = df.select(text.contacts(F.col("x")), text.scrub(F.col("x"))).first()
    assert r[0] == ["420123456789", "jan@example.com"] and r[1] == "Mail [email] or [phone] x"
