"""Readers on small files, keyed state and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import state
from quern.sources import api, feeds, sinks
from quern.streaming import events as streams

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0"><channel><title>t</title>
<item><title>Bike A: 12 500</title><link>https://shop.example/ad/1234567/bike-a</link><description><![CDATA[<img src="/i/a.jpg"> Nice<br>Praha<br>110 00 Praha 1]]></description><pubDate>Sun, 19 Jul 2026 12:00:00 +0200</pubDate></item>
<item><title>Bike B</title><link>https://shop.example/x</link><guid>id-7654321</guid><description>Price 9 900 Kč</description><pubDate>bad</pubDate></item>
<item><title></title><link>https://shop.example/y</link></item>
<item><title>Bike C</title><link>https://shop.example/z</link><description>text</description></item>
</channel></rss>"""

CARDS = """<a href="/ad/1/first-bike"><img src="a.jpg"></a><a href="/ad/1/first-bike"><h3>First</h3><time>pred 5 minutami</time><p>long text</p><strong>9 000 Kc</strong><span class="location">Brno</span></a>
<a href="/ad/2/second-bike"><p></p></a><a href="/other">x</a>"""


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS, encoding="utf-8")
    rows = {r["external_id"]: r for r in feeds.read_rss(spark, str(tmp_path / "f.xml"), "p").collect()}
    assert len(rows) == 3 and {"1234567", "7654321"} < set(rows)
    a, b = rows["1234567"], rows["7654321"]
    assert a["price_czk"] == 12500 and b["price_czk"] == 9900
    assert str(a["published_at"]) == "2026-07-19 10:00:00" and b["published_at"] is None
    assert a["image_url"] == "https://shop.example/i/a.jpg" and a["location"] == "Praha, 110 00 Praha 1"
    kept = feeds.profile_filter(feeds.read_rss(spark, str(tmp_path / "f.xml"), "p"), ["bike"], ["c"], None, 10000)
    assert {r["external_id"] for r in kept.collect()} == {"7654321"}


def test_cards(spark):
    pages = spark.createDataFrame([(CARDS,), (None,)], "html string")
    rows = {r["id"]: r for r in feeds.cards(pages, "html", "/ad/([0-9]+)/").collect()}
    assert rows["1"]["title"] == "First" and rows["1"]["image"] == "a.jpg" and rows["1"]["location"] == "Brno"
    assert rows["2"]["title"] == "Second Bike"


def test_cards_captcha(spark):
    with pytest.raises(Exception, match="captcha"):
        feeds.cards(spark.createDataFrame([("Captcha please",)], "html string"), "html", "/ad/([0-9]+)/").collect()


def test_relative_time(spark):
    now = F.lit("2026-07-19 12:00:00").cast("timestamp")
    df = spark.createDataFrame([("před 5 minutami",), ("včera",), ("kdysi",)], "x string").select(feeds.relative_time(F.col("x"), now).alias("t"))
    assert [str(r["t"]) for r in df.collect()] == ["2026-07-19 11:55:00", "2026-07-18 12:00:00", "None"]


def test_marketplace(spark, tmp_path):
    page = {"listings": [{"id": "1", "title": "A", "price": {"amount": "1500", "formatted_amount": "1 500 Kč"}, "location": {"city": "Brno", "state": "JM"}, "creation_time": 0, "extra": 1}, {"id": "2", "title": "B", "is_sold": True}, {"id": "3", "title": "C", "price": {"formatted_amount": "€20"}}, {"id": "4", "title": "D", "price": {"amount": "0"}}], "cursor": "x"}
    (tmp_path / "p.json").write_text(json.dumps(page), encoding="utf-8")
    rows = {r["id"]: r for r in feeds.read_marketplace(spark, str(tmp_path / "p.json")).collect()}
    assert set(rows) == {"1", "3", "4"}
    assert rows["1"]["price_czk"] == 1500 and rows["1"]["location"] == "Brno, JM"
    assert rows["3"]["currency"] == "EUR" and rows["3"]["price_czk"] is None and rows["4"]["price_status"] == "free"


def test_detail_never_erases(spark):
    base = spark.createDataFrame([("1", "t", "old"), ("2", "t", "old")], "id string, title string, description string")
    detail = spark.createDataFrame([("1", "", None, None), ("2", "new", ["p", "p", "q"], [("size", "L")])], "id string, description string, photos array<string>, attributes array<struct<name:string,label:string>>")
    rows = {r["id"]: r for r in feeds.merge_detail(base, detail).collect()}
    assert rows["1"]["description"] == "old" and rows["2"]["description"] == "new\nsize: L" and rows["2"]["image_urls"] == ["p", "q"]


def test_embedded_offers(spark):
    data = {"props": {"pageProps": {"data": {"results": {"results": [{"type": "offer", "name": "A", "url": "u1", "price": 1999900, "shop": {"name": "S"}}, {"type": "offer", "name": "dup", "url": "u1", "price": 1, "shop": {"name": "S"}}, {"type": "product", "name": "P", "url": "u2"}]}}}}}
    page = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'
    rows = feeds.embedded_offers(spark.createDataFrame([(page,), ("<html>",)], "html string"), "html").collect()
    assert [(r["seller"], r["product_name"], r["price_czk"]) for r in rows] == [("S", "A", 19999)]


def test_fx(spark, tmp_path):
    (tmp_path / "fx.txt").write_text("19 Jul 2026 #138\nCountry|Currency|Amount|Code|Rate\nEMU|euro|1|EUR|24,500\nHungary|forint|100|HUF|6.2\n")
    rows = {r["currency"]: r["rate"] for r in feeds.read_fx(spark, str(tmp_path / "fx.txt")).collect()}
    assert rows == {"EUR": 24.5, "HUF": pytest.approx(0.062), "CZK": 1.0}


def test_catalog(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"brands": [{"name": "Trek", "models": [{"name": "Marlin 7", "aliases": ["marlin7"]}]}]}))
    assert {(r["canonical"], r["alias"]) for r in feeds.read_catalog(spark, str(tmp_path / "c.json")).collect()} == {("Marlin 7", "marlin 7"), ("Marlin 7", "marlin7")}
    assert feeds.read_catalog(spark, str(tmp_path / "none.json")).count() == 0


def test_small_parsers(spark):
    df = spark.createDataFrame([("1.299,50 €", "12 999"), ("x", "1.200")], "a string, b string")
    assert [tuple(r) for r in df.select(feeds.local_number(F.col("a")), feeds.local_number(F.col("b"))).collect()] == [(1299.5, 12999.0), (None, 1200.0)]
    f = spark.createDataFrame([("https://i/a.jpg?w=100",), ("https://i/a.jpg?w=200",), ("",)], "u string").select(feeds.image_fingerprint(F.col("u"))).collect()
    assert f[0] == f[1] and f[2][0] == ""
    page = spark.createDataFrame([('<script type="application/ld+json">{"offers": {"price": "12 000", "priceCurrency": "CZK"}}</script>',)], "h string")
    price, ccy = feeds.json_ld_price(F.col("h"))
    assert tuple(page.select(price, ccy).first()) == (12000.0, "CZK")
    fb = feeds.decode_feedback(spark.createDataFrame([("fb:market:12:good",), ("market:12:bad",), ("x",)], "p string"), "p").collect()
    assert [(r["source"], r["label"]) for r in fb] == [("market", "good"), ("market", "bad")]
    assert df.limit(1).select(feeds.html_unescape(F.lit("a &amp; b"))).first()[0] == "a & b"


def test_api_pushdown(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"listings": [{"id": f"{i}{j}", "title": "t", "price": 100 * j, "currency": "CZK", "created": j, "url": "u"} for j in range(5)]}))
    spark.dataSource.register(api.PagedJson)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("paged_json").option("pages", str(tmp_path)).load().where("price >= 300")
    assert {r["id"] for r in df.collect()} == {"03", "04", "13", "14"}


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError(503)
        return "ok"

    assert api.with_retries(flaky, lambda e: e.args[0], sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        api.with_retries(lambda: (_ for _ in ()).throw(OSError(401)), lambda e: e.args[0], sleep=waits.append)


def test_upsert_and_append(spark):
    s = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, first int")
    b = spark.createDataFrame([(2, "B", 9), (3, "C", 9)], "k int, v string, first int")
    out = {r["k"]: (r["v"], r["first"]) for r in state.upsert(s, b, ["k"], ["v"]).collect()}
    assert out == {1: ("a", 1), 2: ("B", 1), 3: ("C", 9)}
    assert [r["k"] for r in state.upsert(s, b, ["k"], ["v"], new_only=True).collect()] == [3]
    assert [r["k"] for r in state.append_new(s, b.unionAll(b), ["k"]).collect()] == [3]


def test_nullable_dedup_latest_migrate(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 3), (None, 4)], "c string, n int")
    assert state.dedup_nullable(df, "c").count() == 3
    assert state.latest(df.where("c is not null"), ["c"], "n").first()["n"] == 2
    m = state.migrate(df, {"s": F.lit(None).cast("string")}, {"s": F.when(F.col("n") > 2, "new").otherwise("old")})
    assert [r["s"] for r in m.orderBy("n").collect()] == ["old", "old", "new", "new"]


def test_snapshots(spark, tmp_path):
    t = state.Snapshots(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.write(spark.range(3))
    t.write(t.read().where("id > 0"))
    assert t.read().count() == 2


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("s", "1", "A & B", 1500, "", "u", [1, 2])], "source string, external_id string, title string, price_czk int, location string, url string, a array<int>")
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/json")).count() == 1
    assert sinks.cards(df).first()["card"] == "<b>A &amp; B</b>\n1 500 Kč\nu"
    df.write.parquet(str(tmp_path / "p"))
    assert sinks.backup(spark, str(tmp_path / "p"), str(tmp_path / "q")) == 1


def test_breaker_stream(spark):
    e = streams.read_events(spark, "/root/testdata/sf0.001").select("user_id", "event_id", "ts", "event_type")
    rows = streams.run_available(streams.breaker(e, limit=2, open_minutes=60 * 24)).collect()
    assert len(rows) == 1000 and any(r["refused"] for r in rows)


def test_sliding_stream(spark):
    out = streams.run_available(streams.sliding_calls(streams.read_events(spark, "/root/testdata/sf0.001"), "2 hours", "1 hour"), "complete")
    assert out.agg(F.sum("calls")).first()[0] == 2000
