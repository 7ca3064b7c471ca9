import difflib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from test_identity import CATALOGUE

from quern.functions import stats, text
from quern.operators import comparables as C
from quern.operators import identity as I
from quern.operators import joins, matching, state
from quern.plans import catalogue
from quern.session import cut
from quern.sources import config, cycle, feeds, markets
from quern.streaming import events as streams

SF = "/root/testdata/sf0.001"


def ladder(spark, target, *others):
    """(match_type, reason) of each comparable (title, description) for a target."""
    rows = [(i, *(r if isinstance(r, tuple) else (r, ""))) for i, r in enumerate([target, *others])]
    df = I.identify(spark.createDataFrame(rows, "n int, title string, description string"), "title", "description", "i", CATALOGUE)
    norm = text.normalize_text
    x = df.select("n", C.prepared(F.col("i")).alias("i"), C.refused(norm(F.col("title")), norm(F.concat_ws(" ", "title", "description"))).alias("no"))
    pairs = x.where("n = 0").select(F.col("i").alias("t")).crossJoin(x.where("n > 0").select("n", F.col("i").alias("c"), "no"))
    return [(r["match_type"], r["reason"], r["score"]) for r in C.match_comparables(pairs, "t", "c", "no").orderBy("n").collect()]


def test_years_and_unknown_years(spark):
    got = ladder(spark, "Trek Marlin 7 Gen 3 2025", "Trek Marlin 7 Gen 3 2024", "Trek Marlin 7 Gen 3 2023", "Trek Marlin 7 Gen 3 2022", "Trek Marlin 7 Gen 3", "Trek Marlin 6", "Trek Marlin 6 Gen 2 2025", "Trek Marlin 6 2020", "Trek Marlin 6 2022")
    assert got == [
        ("exact", "exact_brand_model", 0.95), ("close", "exact_model_close_year", 0.78), ("rejected", "model_year_too_far", 0.0), ("close", "exact_model_year_unknown", 0.82),
        ("model_family", "same_model_family", 0.60), ("rejected", "model_mismatch", 0.0), ("rejected", "family_year_too_far", 0.0), ("model_family", "same_model_family", 0.60),
    ]


def test_conflicts(spark):
    same = "Trek Fuel EX 8 GX Gen 3 2025"
    got = ladder(spark, (same, "Full suspension mountain bike hydraulic brakes aluminium frame"), "Trek Fuel EX 8 GX Gen 2 2025", "Trek Fuel EX 8 SX Gen 3 2025", same + " e-bike", (same, "Hardtail mountain bike"), "Trek Fuel EX 8 GX frame only", (same, "deposit only"), ("Giant Fathom 2 2025", "mountain"))
    assert [r for _, r, _ in got] == ["generation_mismatch", "trim_differs_same_model_family", "electric_mismatch", "suspension_type_mismatch", "part_payment_rental_or_wanted", "part_payment_rental_or_wanted", "brand_mismatch"]


def test_component_class(spark):
    parts = "Hardtail aluminium Shimano Deore hydraulic brakes Rockshox Judy"
    assert ladder(spark, ("Trek Roscoe 7 2024 mountain bike", parts), ("Giant Fathom 2 2024 mountain bike", parts)) == [("component_class", "similar_component_class", 0.38)]


@pytest.mark.parametrize(
    ("title", "price", "more", "want"),
    [
        ("Author Vision sada kol 29", 5000, {}, ("PARTS_OR_ACCESSORY", "hard_filter_accessory_or_part")), ("Woom 4 detske", 5000, {}, ("KIDS_BIKE", "hard_filter_kids_bike")),
        ("Koupím horské kolo Trek", 5000, {}, ("WANTED_AD", "wanted_keyword:koupim")), ("Looking for Trek", 5000, {}, ("WANTED_AD", "wanted_keyword:looking for")),
        ("Trek Marlin 7", 500, {"low": 3000}, ("PRICE_OUT_OF_RANGE", "below_min:3000")), ("Trek Marlin 7", 900000, {"high": 90000}, ("PRICE_OUT_OF_RANGE", "above_max:90000")),
        ("Trek Marlin 7", None, {}, ("", "")), ("Trek Marlin 7", None, {"need_price": True}, ("NO_PRICE", "price_missing")), ("Prodám kolo Trek + helma zdarma", 5000, {"low": 1, "high": 9000}, ("", "")),
    ],
)
def test_prefilter(spark, title, price, more, want):
    df = spark.createDataFrame([(title, price)], "t string, p int").withColumn("t", text.normalize_text(F.col("t")))
    r = df.select(C.prefilter(F.col("t"), I.class_of(F.col("t"), "audience"), F.col("p"), F.lit(None).cast("boolean"), **more).alias("r")).first()["r"]
    assert (r["reason_code"], r["matched_rule"]) == want and r["passed"] == (want[0] == "")
    assert df.select(C.prefilter(F.col("t"), F.lit(""), F.col("p"), F.lit(True)).alias("r")).first()["r"]["reason_code"] == "DUPLICATE"


BODY = "Prodávám horské kolo Merida, velikost rámu L, kola 29, garážované, po velkém servisu, nové pláště, nový řetěz, brzdy odvzdušněné, vidlice po výměně oleje, bez vůlí, jezdí skvěle"


def test_duplicates(spark):
    title = "Merida Big Nine 400 velikost L kola 29"
    words = BODY.split()
    rows = [
        ("a1", "a", 9000, title, BODY), ("b1", "b", 9000, title, BODY + "!!!"), ("b2", "b", 9000, title, " ".join(w for i, w in enumerate(words) if not 4 <= i < 9) + " odlišný stav komponentů"),
        ("b3", "b", 9000, title, "Kolo po závodech, poškozený rám, prodává se bez kol, pouze osobní převzetí, žádný servis ani další příslušenství není součástí této nabídky"),
        ("b4", "b", 9000, "Trek Marlin 7 velikost L kola 29", BODY), ("b5", "b", 9500, title, BODY), ("a2", "a", 9000, title, BODY), ("b6", "b", 9000, title + " Elite", BODY), ("b7", "b", 9000, title + " Comp", BODY), ("b8", "b", None, title, BODY), (None, "b", 9000, None, None),
    ]
    df = cut(I.identify(spark.createDataFrame(rows, "key string, source string, price int, title string, description string"), "title", "description", "identity", CATALOGUE))
    got = {(r["a"], r["b"]): r for r in C.duplicate_pairs(df).collect()}
    assert {b: got["a1", b]["level"] for b in ("b1", "b2", "b3")} == {"b1": "confirmed", "b2": "possible", "b3": "none"}
    assert ("a1", "b4") not in got and ("a1", "b5") not in got and ("a1", "a2") not in got and not any("b8" in k for k in got)
    kinds = cut(I.identify(spark.createDataFrame([("x", "a", 1, "Merida Big Nine 400 Comp", BODY), ("y", "b", 1, "Merida Big Nine 400 Elite", BODY)], "key string, source string, price int, title string, description string"), "title", "description", "identity", CATALOGUE))
    assert C.duplicate_pairs(kinds).first()["reason"] == "trim_mismatch"
    for (a, b), r in got.items():  # against difflib
        x, y = (text._exact(rows[[z[0] for z in rows].index(k)][4]) for k in (a, b))
        if not r["reason"].endswith("mismatch"):
            assert r["similarity"] >= round(difflib.SequenceMatcher(None, x, y).ratio(), 4) - 0.02


def ratio(a, b):
    least = min(len(set(a.split())), len(set(b.split())))
    return round(max(difflib.SequenceMatcher(None, a, b).ratio(), len(set(a.split()) & set(b.split())) / least), 4)


def test_queries_without_sql_equal_plain_python(spark):
    q = {n: [r.asDict() for r in catalogue.QUERIES[n](spark, SF).collect()] for n in ("greedy_clusters", "fuzzy_alias", "seq_ratio_pairs")}
    heads = {}
    for r in sorted(q["greedy_clusters"], key=lambda r: r["p_partkey"]):
        mine = heads.setdefault(r["target"], [])
        name = next((k for k, t in mine if t == r["p_name"] or ratio(t, r["p_name"]) >= 0.6), None)
        if name is None:
            mine.append((name := r["p_partkey"], r["p_name"]))
        assert r["cluster"] == name
    names = ["economy", "standard", "promo", "medium", "large", "small"]
    for r in q["fuzzy_alias"]:
        best = max(((difflib.SequenceMatcher(None, a, r["t"]).ratio(), -i) for i, a in enumerate(names)))
        assert r["alias"] == (names[-best[1]] if best[0] > 0.90 else None)
    texts = {r["doc_id"]: r["t"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", text.duplicate_text(F.col("text")).alias("t")).collect()}
    for r in q["seq_ratio_pairs"]:
        a, b = texts[r["doc_id_a"]], texts[r["doc_id_b"]]
        assert r["similarity"] == (1.0 if a == b else text._ratio(a, b, False))


def test_condition_query_equals_plain_python(spark):
    got = {r["doc_id"]: r["condition"] for r in catalogue.QUERIES["condition_detector"](spark, SF).collect()}
    neg = ("ne ", "neni ", "not ", "is not ", "neni v ", "neni ve ")
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("doc_id", text.normalize_text(F.col("text")).alias("t")).collect():
        whole = f" {r['t']} "
        rest = " ".join(r["t"].replace("of the", " ").split())

        def has(x, term):
            at = [i for i in range(len(x)) if x.startswith(term, i) and not x[i - 1 : i].isalnum() * i and not x[i + len(term) : i + len(term) + 1].isalnum()]
            return any(not any(x[:i] == n or x[:i].endswith(" " + n) for n in neg) for i in at)

        good, broken, needs = " of the " in whole or has(r["t"], "with"), has(rest, "that"), has(rest, "from")
        assert got[r["doc_id"]] == ("contradictory" if good and (broken or needs) else "problematic" if broken else "service_required" if needs else "good" if good else "unknown")


def test_breaker_equals_plain_python(spark):
    e = streams.read_events(spark, SF).select("user_id", "event_id", "ts", "event_type")
    got = {r["event_id"]: (r["errors_in_a_row"], r["refused"]) for r in streams.run_available(streams.breaker(e, limit=2, open_minutes=60 * 24)).collect()}
    held = {}
    rows = sorted(((r["ts"], r["event_id"], r["user_id"], r["event_type"]) for r in spark.read.parquet(f"{SF}/events.parquet").collect()))
    for ts, event, user, kind in rows:
        count, until = held.get(user, (0, 0))
        now = int(ts.replace(tzinfo=timezone.utc).timestamp())
        refused = now < until
        if not refused:
            count = count + 1 if kind == "error" else 0
            until = now + 86400 if count >= 2 else until
        held[user] = (count, until)
        assert got[event] == (count, refused)


def test_isolated_streams(spark):
    good = streams.read_events(spark, SF).select("event_id", "ts")
    bad = good.withColumn("x", F.raise_error(F.lit("429 from the source")).cast("string"))
    done, errors = streams.run_isolated({"good": good, "bad": bad})
    assert done["good"].count() == 1000 and list(errors) == ["bad"]
    with pytest.raises(RuntimeError):
        streams.run_isolated({"bad": bad})


def test_late_events_give_no_alert(spark):
    now = "2024-01-20 06:00:00"
    out = streams.run_available(streams.alerts(streams.read_events(spark, SF).select("event_id", "ts"), now))
    want = {r["event_id"] for r in spark.read.parquet(f"{SF}/events.parquet").collect() if 0 <= (datetime(2024, 1, 20, 6) - r["ts"]).total_seconds() <= 6 * 3600}
    assert {r["event_id"] for r in out.collect()} == want


def test_ahead_pairs_equal_brute_force(spark):
    rows = [(i * i % 97, "xy"[i % 2]) for i in range(60)] + [(None, "x")]
    df = spark.createDataFrame(rows, "k int, g string")
    got = sorted((r[0], r[1], r[2]) for r in joins.ahead_pairs(df, ["g"], "k", 10).select("a.g", "a.k", "b.k").collect())
    assert got == sorted((g, a, b) for a, g in rows for b, h in rows if g == h and a is not None and b is not None and a < b < a + 10)


def test_histogram_rules_equal_rows(spark):
    import statistics

    rows = [(k, v) for k in range(4) for v in [10, 10, 11, 12, 13, 50, 200][: 3 + k]] + [(9, None), (9, 5)]
    got = sorted((r["k"], r["v"], r["kept"]) for r in stats.outliers(spark.createDataFrame(rows, "k int, v int"), ["k"], "v", stats.MARKET).collect() if r["v"] is not None)
    want = []
    for k in (0, 1, 2, 3, 9):
        vs = [v for g, v in rows if g == k and v is not None]
        m = statistics.median(vs)
        d = statistics.median(abs(v - m) for v in vs)
        ok = [len(vs) < 4 or (0.5 * m <= v <= 1.9 * m and (d == 0 or abs(v - m) <= 3.5 * d)) for v in vs]
        want += [(k, v, x or not any(ok)) for v, x in zip(vs, ok, strict=True)]
    assert got == sorted(want)


def test_snapshots_survive_a_failed_write(spark, tmp_path):
    t = state.Snapshots(spark, str(tmp_path / "t"))
    t.write(spark.range(3))
    with pytest.raises(Exception, match="broken"):
        t.write(spark.range(5).withColumn("id", F.when(F.col("id") > 3, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id"))))
    assert t.read().count() == 3
    (tmp_path / "t" / "v-000000000007").mkdir()  # a writer that died before its _SUCCESS
    assert t.read().count() == 3 and t.write(spark.range(9)) == "v-000000000008" and t.read().count() == 9
    t.prune(1)
    assert t.read().count() == 9 and not (tmp_path / "t" / "v-000000000001").exists()


def test_append_keeps_the_least_row(spark):
    s = spark.createDataFrame([], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "k int, v string")
    assert {(r["k"], r["v"]) for r in state.append_new(s, b, ["k"]).collect()} == {(1, "a"), (2, None)}


def test_rates(spark, tmp_path):
    now, calls = datetime(2026, 7, 19, 12, tzinfo=timezone.utc), []

    def fetch():
        calls.append(1)
        return {"EUR": 24.0, "PLN": 5.8}, "2026-07-18"

    def down():
        raise TimeoutError

    store = state.Snapshots(spark, str(tmp_path / "fx"))
    none = cycle.RateProvider(store, down).get(now)
    assert none.rates == {"CZK": 1.0} and "none are stored" in none.warnings[0]
    assert cycle.RateProvider(store, fetch).get(now, read_only=True).rates["EUR"] == 24.0 and store.read() is None
    fresh = cycle.RateProvider(store, fetch).get(now)
    assert not fresh.cached and fresh.rates["CZK"] == 1.0 and fresh.warnings == ()
    provider = cycle.RateProvider(store, down, ttl_hours=1e6)
    provider.store.write(store.read().withColumn("fetched_at", F.lit(now.replace(tzinfo=None)).cast("timestamp")))
    assert provider.get(now.replace(tzinfo=None)).cached
    stale = cycle.RateProvider(store, down, ttl_hours=0.0).get(datetime(2026, 8, 1))
    assert stale.cached and stale.rates["PLN"] == 5.8 and len(stale.warnings) == 2 and "TimeoutError" in stale.warnings[1]


def test_sources_fail_alone(spark):
    good = spark.createDataFrame([(1, "a")], "id int, t string")
    tries = []

    def limited():
        raise OSError("HTTP 429")

    def once():
        tries.append(1)
        if len(tries) == 1:
            raise TimeoutError("timed out")
        return spark.createDataFrame([(2,)], "id int")

    c = cycle.SourceCycle(poll_seconds=100, most_seconds=150)
    out = c.fetch({"good": lambda: good, "limited": limited, "once": once, "bad": lambda: good.select(F.raise_error(F.lit("row")).alias("id"))}, 0.0)
    assert sorted((r["id"], r["t"]) for r in out.collect()) == [(1, "a"), (2, None)] and sorted(c.errors) == ["bad", "limited"] and c.pauses["limited"] == (100.0, 100)
    c.fetch({"good": lambda: good, "limited": limited}, 50.0)
    assert c.errors == {}
    c.fetch({"good": lambda: good, "limited": limited}, 101.0)
    assert c.pauses["limited"] == (251.0, 150)
    with pytest.raises(RuntimeError, match="429"):
        c.fetch({"limited": limited}, 1000.0)


def test_price_enrichment(spark):
    cards = spark.createDataFrame([("1", None, "CZK", "missing"), ("2", None, "CZK", "parse_error"), ("3", 500, "CZK", "numeric"), ("4", None, "CZK", "missing")], "id string, price_amount int, currency string, price_status string")
    stored = spark.createDataFrame([("1", 900, "EUR", "numeric"), ("2", None, "CZK", "missing")], "id string, price_amount int, currency string, price_status string")
    details = spark.createDataFrame([("1", 1.0, "CZK"), ("2", 1200.0, None), ("3", 1.0, "EUR")], "id string, amount double, currency string")
    out = cycle.enrich_prices(cards, stored, details)
    assert {r["id"]: (r["price_amount"], r["currency"], r["price_status"], r["price_origin"]) for r in out.collect()} == {"1": (900, "EUR", "numeric", "stored"), "2": (1200, "CZK", "numeric", "detail"), "3": (500, "CZK", "numeric", "card"), "4": (None, "CZK", "missing", "card")}
    assert cycle.price_stats(out).count() == 4


def test_markets(spark):
    page = lambda s: spark.createDataFrame([(s,), (None,), ("",)], "h string")
    de = """<article class="aditem" data-adid="123" data-href="/s-anzeige/trek/123-217-1"><script type="application/ld+json">{"title":"Trek Marlin 7","description":"Gebraucht","contentUrl":"https://img.example/b.jpg"}</script>
    <div class="aditem-main--top--left">10115 Berlin</div><p class="aditem-main--middle--price-shipping--price">1.650,50 EUR VB</p></article>
    <article class="aditem" data-adid="5" data-href="/x"><a class="ellipsis" href="/x">Cube &amp; Co</a><p class="aditem-main--middle--price-shipping--price">zu verschenken</p></article>"""
    (r,) = markets.german(page(de), "h").collect()
    assert (r["source_listing_id"], r["url"], r["title"], r["price_original"], r["currency"], r["country"], r["location"]) == ("123", "https://www.kleinanzeigen.de/s-anzeige/trek/123-217-1", "Trek Marlin 7", 1650.5, "EUR", "DE", "10115 Berlin")
    card = '<li class="hz-Listing hz-Listing--list-item"><a href="/v/fietsen/m{0}-bike"><span class="ListingTitle_x">Trek {0}</span><h5 class="ListingPrice_x">EUR 525,00</h5><span class="hz-Listing-seller-name-new">Jo</span><span data-testid="location-label">Utrecht</span><img src="https://img.example/a.jpg?width=3"/></a></li>'
    nl = markets.dutch(page(card.format(123) + card.format(123) + card.format(9)), "h").orderBy("source_listing_id").collect()
    assert [(r["source_listing_id"], r["price_original"], r["seller"], r["location"], r["country"]) for r in nl] == [("123", 525.0, "Jo", "Utrecht", "NL"), ("9", 525.0, "Jo", "Utrecht", "NL")]
    assert len(markets.dutch(page(card.format(1) + card.format(2)), "h", most=1).collect()) == 1
    eu = '<div data-cnstrc-item-id="{0}" data-cnstrc-item-name="{1}" data-cnstrc-item-price="710">\n<a href="/en-us/product/p{0}"><img src="https://d1mgeijqpfaspl.cloudfront.net/b.webp"/> nice</a></div>'
    rows = markets.european(page(eu.format(77, "Marlin 7") + eu.format(78, "Trek FX")), "h", "Trek").orderBy("source_listing_id").collect()
    assert [(r["title"], r["price_original"], r["url"], r["description"]) for r in rows] == [("Trek Marlin 7", 710.0, "https://buycycle.com/en-us/product/p77", "nice"), ("Trek FX", 710.0, "https://buycycle.com/en-us/product/p78", "nice")]


def test_records_and_deep_prices(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "Scott", "price_czk": 5000, "other": 1}')
    assert feeds.read_record(spark, str(tmp_path / "a.json")).first().asDict() == {"title": "Scott", "description": None, "price_czk": 5000, "location": None}
    deep = '<script type="application/ld+json">{"@graph": [{"x": 1}, {"a": {"b": [{"offers": [{"priceCurrency": "EUR", "price": "1 299,5"}]}]}}]}</script>'
    df = spark.createDataFrame([(deep,), ("<p>none</p>",)], "h string")
    assert [tuple(r) for r in df.select(*feeds.json_ld_price(F.col("h"))).collect()] == [(1299.5, "EUR"), (None, None)]


def test_two_lazy_card_tables(spark):
    page = lambda n: spark.createDataFrame([(f'<a href="/ad/{n}"><h3>Bike {n}</h3></a>',), (None,)], "h string")
    a, b = feeds.cards(page(1), "h", "/ad/([0-9]+)"), feeds.cards(page(2), "h", "/ad/(?:'x')?([0-9]+)")
    assert [r["title"] for r in a.collect()] == ["Bike 1"] and [r["title"] for r in b.collect()] == ["Bike 2"]


def test_env_file(tmp_path):
    (tmp_path / "c.json").write_text('{"sources": [{"name": "m", "kind": "api", "path": "p"}]}')
    (tmp_path / ".env").write_text("QUERN_POLL_SECONDS=600\nQUERN_M_API_KEY='k'\n")
    c = config.load(tmp_path / "c.json", {"QUERN_MAX_NOTIFICATIONS": "5"})
    assert (c.poll_seconds, c.max_notifications, c.usable_sources()[0].api_key) == (600, 5, "k")
    assert config.load(tmp_path / "c.json", {"QUERN_POLL_SECONDS": "700"}).poll_seconds == 700


def test_similarity_normalises_first(spark):
    df = spark.createDataFrame([("Kolo, TREK!", "kolo trek")], "a string, b string")
    assert df.select(text.text_similarity(F.col("a"), F.col("b"))).first()[0] == 1.0 and matching.same_or_unknown is not None


def test_diagnostics(spark):
    from quern.operators import diagnostics as D

    df = spark.createDataFrame([("dobry stav", "dobry stav", True), ("dobry stav nutny servis", "x" * 50, False), ("na opravu", "x" * 50, False), ("kolo", "x" * 50, True), ("kolo", "kolo", True)], "w string, d string, i boolean")
    primary, labels = D.condition_group(F.col("w"), F.col("d"), F.col("i"), ["dobry stav"], 20)
    assert [r[0] for r in df.select(primary).collect()] == ["unrecognized_positive_condition_phrase", "positive_negative_conflict", "other", "photos_but_no_textual_condition", "short_description"]
    assert df.select(labels).collect()[2][0] == ["other_unrecognized_negative_condition"]
    row = spark.createDataFrame([("helma poc", "", "x", "y", None), ("kolo", "", "excluded", "y", None), ("kolo", "kids", "x", "y", None), ("kolo", "", "x", "y", None)], "t string, a string, c string, s string, r string")
    got = [r["p"] for r in row.select(D.hard_filter_provenance(F.col("t"), F.col("a"), F.col("c"), F.col("s"), F.col("r")).alias("p")).collect()]
    assert [(p["result"], p["reason"], p["computed_source"]) for p in got] == [("excluded", "hard_filter_accessory_or_part", "title accessory terms"), ("excluded", "stored_excluded", ""), ("excluded", "hard_filter_kids_bike", "identity.audience"), ("pass", "", "")]
    f = spark.createDataFrame([(["price_anomaly", "unknown"], {"price_anomaly": "discount 60"})], "f array<string>, v map<string,string>")
    assert [tuple(x) for x in f.select(D.blocker_sources(F.col("f"), F.col("v"))).first()[0]] == [("price_anomaly", "evaluator", "discount 60")]
    d = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert [tuple(r) for r in D.distribution(d, "x", ["b", "a"]).collect()] == [("b", 0, 0.0), ("a", 2, 100.0)] and D.report(d, ["x", "x"]).count() == 4
    with pytest.raises(ValueError, match="only 1"):
        D.diagnostic_sample(spark.createDataFrame([("k", 1, ("Trek", "Marlin"))], "key string, last_seen_at int, identity struct<brand:string,model:string>"), 2)
    s = spark.createDataFrame([(1, '{"brand": "Trek", "other": 1}')], "k int, j string")
    assert D.decode_analysis(s, "j", "brand STRING, model STRING").first().asDict() == {"k": 1, "brand": "Trek", "model": None}


def test_prompt_messages():
    from quern.sources import calls

    assert calls.prompt_label("a", "v1") == "a-v1" and calls.user_message("DATA:", {"b": 1, "a": "č"}) == 'DATA:{"a": "č", "b": 1}'
    calls.clear_caches()
