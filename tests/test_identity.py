import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import identity as I

CATALOGUE = I.Catalogue(
    [
        I.Entry("Trek", "Marlin"), I.Entry("Trek", "Fuel EX"), I.Entry("Trek", "FX"), I.Entry("Trek", "Roscoe"), I.Entry("Trek", "Rail", ("rail e",), True), I.Entry("Woom", "4", (), None, "kids"),
        I.Entry("Specialized", "Rockhopper"), I.Entry("Cube", "Aim"), I.Entry("Haibike", "AllMtn", ("all mtn",), True), I.Entry("Merida", "Big Nine"), I.Entry("Scott", "Scale"), I.Entry("Giant", "Fathom"),
    ],
    motors=["shimano steps"],
)


def identities(spark, rows, catalogue=CATALOGUE, **more):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r, ""))) for i, r in enumerate(rows)], "n int, title string, description string")
    got = I.identify(df, "title", "description", "i", catalogue, normalize=text.normalize_text_exact, **more)
    keyed = got.select("n", "i.*", I.normalized_key(F.col("i")).alias("key"), I.query_variants(F.col("i")).alias("queries"), I.display_name(F.col("i")).alias("name"))
    return [r.asDict() for r in keyed.orderBy("n").collect()]


def test_golden_identities(spark):
    rows = ["Trek Marlin 7 Gen 3 29 2025", "Cube kolo po servisu", "Trek Marln 7 2024", "Kellys Xyzzy 900", "Woom 4", "Trek Fuel EX 8 GX Gen 2 2023", "Trek horské kolo ve skvělém stavu", "Specialized prodám levně", "Scott kolo rychle", "kolo bez značky", None]
    a, cube, typo, kellys, woom, fuel, *rest = identities(spark, rows)
    assert (a["brand"], a["model"], a["generation"], a["model_year"], a["wheel_size"], a["confidence"], a["model_source"]) == ("Trek", "Marlin 7", "Gen 3", 2025, "29", 0.97, "catalog")
    assert a["key"] == "trek|marlin-7|gen-3|2025|29" and a["queries"] == ["Trek Marlin 7 Gen 3 2025 29", "Trek Marlin 7 Gen 3 2025", "Trek Marlin 7 29"] and a["name"] == a["queries"][0]
    assert (cube["brand"], cube["model"], cube["confidence"], cube["model_source"]) == ("Cube", "", 0.40, "")
    assert (typo["model"], typo["model_source"], typo["confidence"]) == ("Marlin 7", "catalog_fuzzy", 0.86)
    assert (kellys["model"], kellys["model_source"], kellys["confidence"]) == ("Xyzzy 900", "tail", 0.60)
    assert (woom["model"], woom["audience"], woom["confidence"], woom["model_confirmed"]) == ("4", "kids", 0.80, True)
    assert (fuel["model"], fuel["trim"], fuel["model_family"], fuel["generation"]) == ("Fuel EX 8", "GX", "Fuel Ex", "Gen 2")
    assert all(r["model"] == "" and not r["model_confirmed"] for r in rest) and [r["brand"] for r in rest] == ["Trek", "Specialized", "Scott", "", ""]
    assert rest[-1]["confidence"] == 0.0 and rest[-1]["key"] == "?|?|?|?|?"


def test_without_catalogue_and_electric(spark):
    (plain,) = identities(spark, ["Trek Marlin 7"], None)
    assert (plain["model"], plain["model_confirmed"], plain["model_source"], plain["electric"]) == ("Marlin 7", False, "tail", False)
    motor, known, unknown, number = identities(spark, [("Trek Marlin", "pohon Shimano Steps"), "Haibike AllMtn 7", "kolo", ("Cube kolo 29 palcu", "vyska 190 cm a model Aim 29")])
    assert (motor["electric"], known["electric"], known["model"], unknown["electric"]) == (True, True, "AllMtn 7", None)
    assert number["model"] == "Aim 29"


def test_sizes(spark):
    rows = ['MERIDA (vel. 16") jezdí na klasických 26" kolech', "Trek velikost kol 26", "Trek rám 17.5 kola 29", "Trek frame L 27,5", "Trek vel. 29", "Trek size XL"]
    got = [(r["wheel_size"], r["frame_size"]) for r in identities(spark, rows)]
    assert got == [("26", "16"), ("26", ""), ("29", "17.5"), ("27.5", "L"), ("", ""), ("", "XL")]


def test_components(spark):
    (r,) = identities(spark, [("Trek Roscoe 7 2024 mountain bike", "Full suspension hlinik Shimano Deore XT hydraulic brakes Fox 34 140 mm women")])
    assert [r[c] for c in ("suspension_type", "frame_material", "fork_class", "drivetrain_class", "brake_class", "travel_mm", "bike_type", "audience")] == ["full_suspension", "aluminium", "mid", "upper", "hydraulic_disc", 140, "mountain", "women"]


@pytest.mark.parametrize(
    ("title", "want"),
    [("Helma POC", True), ("Kolo Trek + helma", False), ("sedačka na kolo", True), ("Prodám rám Trek", True), ("Vidlice RockShox", True), ("Košík na kolo", True), ("Kross Level s nosičem na 29 kolech", False), ("Trek Marlin 7, adresa v popisu", False), ("Horské kolo Merida s nosičem a blatníky", False), ("Brýle Rudy Project", True)],
)
def test_accessories(spark, title, want):
    df = spark.createDataFrame([(title,)], "t string").select(text.normalize_text_exact("t").alias("t"))
    assert df.select(I.has_accessory_terms(F.col("t"))).first()[0] is want


def test_suggestions_only_through_the_catalogue(spark):
    df = spark.createDataFrame([("Trek", "marlin 7"), ("Trek", "Dreamliner"), ("Nobody", "Marlin"), (None, None)], "b string, m string")
    assert [r["confirmed"] for r in I.confirm_suggestion(df, "b", "m", CATALOGUE).collect()] == ["Marlin 7", "", "", ""]


def test_search_pages_and_cache_keys(spark):
    df = spark.createDataFrame([("Trek Marlin 7",)], "q string")
    urls = df.select(*(I.search_url(F.col("q"), m).alias(m) for m in I.SEARCH_PAGES)).first()
    assert urls["cz"].endswith("hledat=Trek+Marlin+7") and urls["de"].endswith("/trek-marlin-7/k0c217")
    one = I.identify(spark.createDataFrame([("Trek Marlin 7 GX", "")], "t string, d string"), "t", "d", "i", CATALOGUE)
    assert one.select(I.market_cache_key(F.col("i"), "s", "cz")).first()[0] == "market-v2|trek|marlin-7|?|?|?|family=marlin|trim=gx|type=?|electric=False|source=s|market=cz"
    assert one.select(I.retail_cache_key(F.col("i"))).first()[0] == "trek|marlin-7|?|?|?|trim=gx"
