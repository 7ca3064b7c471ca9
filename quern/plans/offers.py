"""Identity, filters, match ladder, duplicates and guarded decisions over offers made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import numeric
from quern.operators import comparables, dedup, diagnostics, identity, joins, scoring, selection, valuation
from quern.plans.registry import query, spread, table

#: Normalised titles that take each branch of the filters.
TITLES = (
    "kolo trek marlin|helma poc axion|kolo trek a helma|sedacka na kolo|prodam ram trek|vidlice rockshox|ram bez vidlice|kross level s nosicem na 29 kolech|suche mountainbike cube|"
    "looking for a road bike|koupim horske kolo|bazar kolo|kolo vyprodano|trek marlin adresa v popisu|zamek abus|detske kolo woom|kolo damske|e bike haibike"
).split("|")


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _sql_word(x: str, words) -> str:
    return _sql_any(f"(' ' || {x} || ' ')", [f" {w} " for w in words])


def _sql_class(x: str, name: str) -> str:
    whole, rows = identity.CLASSES[name]
    return "CASE " + " ".join(f"WHEN {(_sql_word if whole else _sql_any)(x, terms.split('|'))} THEN '{label}'" for label, terms in rows) + " ELSE '' END"


ACCESSORY_SQL = f"(regexp_matches(t, '{identity._ACCESSORY}') OR {_sql_any('t', identity.SPARE)} OR (NOT regexp_matches(t, '{identity._BIKE}') AND {_sql_any('t', identity.GEAR)}))"
HARD_SQL = f"CASE WHEN {ACCESSORY_SQL} THEN 'hard_filter_accessory_or_part' WHEN audience = 'kids' THEN 'hard_filter_kids_bike' ELSE '' END"
TITLE_SQL = f"SELECT p_partkey AS k, p_size, p_retailprice, {_sql_list(TITLES)}[1 + p_partkey % {len(TITLES)}] || CASE WHEN p_size % 10 = 0 THEN ' zaloha' ELSE '' END AS t FROM part"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.get(F.array(*[F.lit(x) for x in TITLES]), (F.col("p_partkey") % len(TITLES)).cast("int"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice", F.concat(t, F.when(F.col("p_size") % 10 == 0, " zaloha").otherwise("")).alias("t"))
    return part.withColumn("audience", identity.class_of(F.col("t"), "audience"))


@query(f"""WITH a AS ({TITLE_SQL}), b AS (SELECT *, {_sql_class("t", "audience")} AS audience FROM a)
SELECT k, audience, {HARD_SQL} AS hard, {_sql_any("t", identity.USED)} AS used, {_sql_any("t", identity.UNAVAILABLE)} AS unavailable, {_sql_any("t", comparables.REJECT)} AS reject FROM b""")
def hard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-03, FIL-04, FIL-05, FIL-07: accessory, children's, used, unavailable and reject terms of a title."""
    x, t = _titles(spark, sf_dir), F.col("t")
    return x.select("k", "audience", identity.hard_filter_reason(t, F.col("audience")).alias("hard"), identity.has_used_terms(t).alias("used"), identity.has_unavailable_terms(t).alias("unavailable"), identity.any_part(t, comparables.REJECT).alias("reject"))


WANTED_SQL = "regexp_extract(t, '\\b(" + "|".join(w.replace(" ", "\\s+") for w in comparables.WANTED) + ")\\b', 1)"


@query(f"""WITH a AS ({TITLE_SQL}), b AS (SELECT *, {_sql_class("t", "audience")} AS audience, CASE WHEN p_size % 13 <> 0 THEN CAST(floor(p_retailprice) AS INTEGER) END AS price, k % 31 = 0 AS dup FROM a),
c AS (SELECT *, {HARD_SQL} AS hard, {WANTED_SQL} AS wanted FROM b)
SELECT k, CASE WHEN dup THEN 'DUPLICATE' WHEN hard = 'hard_filter_accessory_or_part' THEN 'PARTS_OR_ACCESSORY' WHEN hard <> '' THEN 'KIDS_BIKE' WHEN wanted <> '' THEN 'WANTED_AD' WHEN price IS NULL THEN 'NO_PRICE' WHEN price < 950 OR price > 1500 THEN 'PRICE_OUT_OF_RANGE' ELSE '' END AS reason_code,
CASE WHEN dup THEN 'confirmed_cross_source_duplicate' WHEN hard <> '' THEN hard WHEN wanted <> '' THEN 'wanted_keyword:' || wanted WHEN price IS NULL THEN 'price_missing' WHEN price < 950 THEN 'below_min:950' WHEN price > 1500 THEN 'above_max:1500' ELSE '' END AS matched_rule FROM c""")
def prefilter_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-06: first rule of the pre-filter that holds."""
    x = _titles(spark, sf_dir)
    price = F.when(F.col("p_size") % 13 != 0, F.floor("p_retailprice").cast("int"))
    r = x.select("k", comparables.prefilter(F.col("t"), F.col("audience"), price, F.col("k") % 31 == 0, 950, 1500, need_price=True).alias("r"))
    return r.select("k", "r.reason_code", "r.matched_rule")


#: Words of each attribute, picked by different remainders of the key.
SAYS = {
    "bike_type": ["gravel", "silnicni", "mestske", "bmx", "enduro", "citybike"], "suspension": ["full suspension", "hardtail", "pevnak", "dvojodpruzeny", "tuhe"],
    "frame_material": ["carbon", "hlinik", "ocel", "carbonovy", "titan"], "fork_class": ["fox 36", "rockshox reba", "suntour xcm", "bez vidlice"],
    "drivetrain_class": ["shimano deore xt", "deore", "sram nx eagle", "altus", "xtr", "jednostupnove"], "brake_class": ["hydraulicke brzdy", "mechanical disc", "v brake", "torpedo"],
    "travel": ["120 mm", "150mm", "200 mm", "45 mm"], "audience": ["damske", "kids", "men's", "pro kazdeho"],
}
_STEP = dict(zip(SAYS, (1, 2, 3, 5, 7, 11, 13, 17), strict=True))
SAYS_SQL = " || ' ' || ".join(f"{_sql_list(v)}[CAST(1 + (p_partkey // {_STEP[k]}) % {len(v)} AS BIGINT)]" for k, v in SAYS.items())


@query(f"""WITH a AS (SELECT p_partkey AS k, {SAYS_SQL} AS t FROM part)
SELECT k, {", ".join(f"{_sql_class('t', n)} AS {n}" for n in identity.CLASSES)}, CASE WHEN {_sql_any("t", ["dvojodpruz", "fully", "celoodpruz", "full suspension"])} THEN 'full_suspension' WHEN {_sql_word("t", ["pevnak", "hardtail"])} THEN 'hardtail' ELSE '' END AS suspension_type,
TRY_CAST(nullif(regexp_extract(t, '\\b(80|90|1[0-9]0|200)\\s*mm\\b', 1), '') AS INTEGER) AS travel_mm FROM a""")
def identity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT-08, ENT-09: component classes, suspension, travel, type and audience of a text."""
    words = [F.get(F.array(*[F.lit(w) for w in v]), (F.floor(F.col("p_partkey") / _STEP[k]) % len(v)).cast("int")) for k, v in SAYS.items()]
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(" ", *words).alias("t"))
    t = F.col("t")
    return x.select("k", *(identity.class_of(t, n).alias(n) for n in identity.CLASSES), identity.suspension(t).alias("suspension_type"), identity.travel_mm(t).alias("travel_mm"))


_PARTS_SQL = """SELECT p_partkey AS k, p_brand AS brand, CASE WHEN p_size % 11 = 0 THEN '' ELSE split_part(p_type, ' ', 1) || ' ' || (p_size % 3) END AS model, CASE WHEN p_size % 11 = 0 THEN '' ELSE split_part(p_type, ' ', 1) END AS family,
CASE WHEN p_size % 4 = 0 THEN '' ELSE 'Gen ' || (p_size % 4) END AS gen, CASE WHEN p_size % 7 <> 0 THEN 2010 + p_size % 9 END AS y, CASE p_size % 5 WHEN 0 THEN 'PRO' WHEN 1 THEN 'EVO' ELSE '' END AS trim_,
CASE p_partkey % 9 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS electric, CASE p_partkey % 17 WHEN 0 THEN 'kids' WHEN 1 THEN 'women' ELSE '' END AS audience, CASE p_partkey % 13 WHEN 0 THEN 'road' WHEN 1 THEN '' ELSE 'mountain' END AS bike,
CASE p_partkey % 19 WHEN 0 THEN 'full_suspension' WHEN 1 THEN 'hardtail' ELSE '' END AS susp, CASE WHEN p_size % 3 = 0 THEN 'carbon' ELSE 'steel' END AS frame, CASE p_partkey % 3 WHEN 1 THEN 'mid' WHEN 2 THEN 'entry' ELSE '' END AS fork, CASE WHEN p_size % 2 = 0 THEN 'mid' ELSE 'upper' END AS drive,
CASE WHEN p_size % 4 <> 0 THEN 100 + 10 * (p_size % 5) END AS travel, CASE p_partkey % 23 WHEN 0 THEN 'helma' WHEN 1 THEN 'kolo helma' ELSE 'kolo' END AS title, CASE WHEN p_partkey % 29 = 0 THEN ' zaloha' ELSE '' END AS more, p_size % 5 AS block FROM part"""


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, block, title, combined, i): a part as an offer with an identity."""
    k, size, word = F.col("p_partkey"), F.col("p_size"), F.split_part("p_type", F.lit(" "), F.lit(1))
    pick = lambda x, table, other: F.coalesce(*[F.when(x == v, F.lit(c)) for v, c in table.items()], F.lit(other))
    family = F.when(size % 11 == 0, "").otherwise(word)
    i = {
        "brand": F.col("p_brand"), "model": F.when(size % 11 == 0, "").otherwise(F.concat_ws(" ", word, (size % 3).cast("string"))), "model_family": family,
        "generation": F.when(size % 4 == 0, "").otherwise(F.concat(F.lit("Gen "), (size % 4).cast("string"))), "model_year": F.when(size % 7 != 0, 2010 + size % 9), "trim": pick(size % 5, {0: "PRO", 1: "EVO"}, ""),
        "electric": F.when(k % 9 == 0, True).when(k % 9 != 1, False), "audience": pick(k % 17, {0: "kids", 1: "women"}, ""), "bike_type": pick(k % 13, {0: "road", 1: ""}, "mountain"),
        "suspension_type": pick(k % 19, {0: "full_suspension", 1: "hardtail"}, ""), "frame_material": F.when(size % 3 == 0, "carbon").otherwise("steel"), "fork_class": pick(k % 3, {1: "mid", 2: "entry"}, ""),
        "drivetrain_class": F.when(size % 2 == 0, "mid").otherwise("upper"), "brake_class": F.lit(""), "travel_mm": F.when(size % 4 != 0, 100 + 10 * (size % 5)), "wheel_size": F.lit("29"), "frame_size": F.lit(""),
    }
    title = pick(k % 23, {0: "helma", 1: "kolo helma"}, "kolo")
    return table(spark, sf_dir, "part").select(k.alias("k"), (size % 5).alias("block"), title.alias("title"), F.concat(title, F.when(k % 29 == 0, " zaloha").otherwise("")).alias("combined"), F.struct(*(c.alias(n) for n, c in i.items())).alias("i"))


MATCH_SQL = f"""
WITH s AS ({_PARTS_SQL}),
p AS (SELECT a.k AS target, b.k AS other, b.title AS t, b.title || b.more AS combined, a.electric <> b.electric AS de, a.audience <> '' AND b.audience <> '' AND a.audience <> b.audience AS da, a.bike <> '' AND b.bike <> '' AND a.bike <> b.bike AS dt,
 a.susp <> '' AND b.susp <> '' AND a.susp <> b.susp AS ds, a.brand = b.brand AS sb, a.model <> '' AND a.model = b.model AS sm, a.family <> '' AND a.family = b.family AS sf, a.gen = '' OR b.gen = '' OR a.gen = b.gen AS sg, a.trim_ = '' OR b.trim_ = '' OR a.trim_ = b.trim_ AS st,
 abs(a.y - b.y) AS dy, a.bike <> '' AND a.bike = b.bike AS same_bike, 2 + CAST(a.fork <> '' AND b.fork <> '' AS INTEGER) + CAST(a.susp <> '' AND b.susp <> '' AS INTEGER) + CAST(a.travel IS NOT NULL AND b.travel IS NOT NULL AS INTEGER) AS known,
 CAST(a.frame = b.frame AS INTEGER) + CAST(a.drive = b.drive AS INTEGER) + CAST(a.fork <> '' AND a.fork = b.fork AS INTEGER) + CAST(a.susp <> '' AND a.susp = b.susp AS INTEGER) + CAST(coalesce(abs(a.travel - b.travel) <= 20, false) AS INTEGER) AS agree
 FROM s a JOIN s b ON a.block = b.block AND a.k < b.k AND b.k < a.k + 200),
r AS (SELECT target, other, dy, CASE WHEN {ACCESSORY_SQL} OR {_sql_any("combined", comparables.REJECT)} THEN 'part_payment_rental_or_wanted' WHEN de THEN 'electric_mismatch' WHEN da THEN 'audience_mismatch' WHEN dt THEN 'bike_type_mismatch' WHEN ds THEN 'suspension_type_mismatch'
 WHEN sb AND sm AND NOT sg THEN 'generation_mismatch' WHEN sb AND sm AND NOT st THEN 'trim_differs_same_model_family' WHEN sb AND sm AND dy <= 1 THEN 'exact_brand_model' WHEN sb AND sm AND dy IS NULL THEN 'exact_model_year_unknown' WHEN sb AND sm AND dy <= 2 THEN 'exact_model_close_year' WHEN sb AND sm THEN 'model_year_too_far'
 WHEN sb AND sf AND sg AND (dy IS NULL OR dy <= 3) THEN 'same_model_family' WHEN sb AND sf AND sg THEN 'family_year_too_far' WHEN same_bike AND agree / known >= 0.67 THEN 'similar_component_class' WHEN NOT sb THEN 'brand_mismatch' ELSE 'model_mismatch' END AS reason FROM p)
SELECT target, other, reason, CASE reason WHEN 'exact_brand_model' THEN 'exact' WHEN 'exact_model_year_unknown' THEN 'close' WHEN 'exact_model_close_year' THEN 'close' WHEN 'trim_differs_same_model_family' THEN 'model_family' WHEN 'same_model_family' THEN 'model_family' WHEN 'similar_component_class' THEN 'component_class' ELSE 'rejected' END AS match_type,
CAST(CASE reason WHEN 'exact_brand_model' THEN round(1.0 - dy * 0.05, 3) WHEN 'exact_model_year_unknown' THEN 0.82 WHEN 'exact_model_close_year' THEN 0.78 WHEN 'trim_differs_same_model_family' THEN 0.62 WHEN 'same_model_family' THEN 0.6 WHEN 'similar_component_class' THEN 0.38 ELSE 0.0 END AS DOUBLE) AS score FROM r
"""


@query(MATCH_SQL)
def match_ladder_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08, SCR-21: every target with the comparables after it, through all branches of the match ladder."""
    x = _offers(spark, sf_dir).select("k", "block", comparables.prepared(F.col("i")).alias("i"), comparables.refused(F.col("title"), F.col("combined")).alias("no"))
    x = x.repartition("k")  # identities are prepared once and apart from the pairs, whose code stays small enough to compile
    pairs = joins.ahead_pairs(x, ["block"], "k", 200).select(F.col("a.k").alias("target"), F.col("b.k").alias("other"), F.col("a.i").alias("t"), F.col("b.i").alias("c"), F.col("b.no").alias("no"))
    return comparables.match_comparables(pairs, "t", "c", "no").select("target", "other", "reason", "match_type", "score")


def _slug_sql(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), '?')"


_QUERIES_SQL = [f"array_to_string(list_filter([{', '.join(p)}], lambda x: x IS NOT NULL AND x <> ''), ' ')" for p in (["brand", "model", "gen", "CAST(y AS VARCHAR)", "'29'"], ["brand", "model", "gen", "CAST(y AS VARCHAR)"], ["brand", "model", "'29'"])]


@query(f"""WITH s AS ({_PARTS_SQL}), q AS (SELECT *, {", ".join(f"{e} AS q{n}" for n, e in enumerate(_QUERIES_SQL))} FROM s),
n AS (SELECT *, {_slug_sql("brand")} || '|' || {_slug_sql("model")} || '|' || {_slug_sql("gen")} || '|' || coalesce(CAST(y AS VARCHAR), '?') || '|29' AS key FROM q)
SELECT k, q0 AS name, key, q0 || CASE WHEN q1 <> q0 THEN ';' || q1 ELSE '' END || CASE WHEN q2 NOT IN (q0, q1) THEN ';' || q2 ELSE '' END AS queries,
'market-v2|' || key || '|family=' || lower(family) || '|trim=' || lower(trim_) || '|type=' || coalesce(nullif(bike, ''), '?') || '|electric=' || CASE WHEN electric IS NULL THEN 'None' WHEN electric THEN 'True' ELSE 'False' END || '|source=s|market=cz' AS market_key, key || '|trim=' || lower(trim_) AS retail_key FROM n""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-03, ENT-12, SUP-08: display name, key, query variants and cache keys of an identity."""
    i = F.col("i")
    return _offers(spark, sf_dir).select("k", identity.display_name(i).alias("name"), identity.normalized_key(i).alias("key"), F.array_join(identity.query_variants(i), ";").alias("queries"), identity.market_cache_key(i, "s", "cz").alias("market_key"), identity.retail_cache_key(i).alias("retail_key"))


@query(f"""WITH s AS ({_PARTS_SQL}) SELECT k, CAST(brand <> '' AS INTEGER) + CAST(model <> '' AS INTEGER) + CAST(coalesce(y, 0) <> 0 AS INTEGER) + CAST(bike <> '' AS INTEGER) + CAST(fork <> '' AS INTEGER) AS facts,
k % 3 <> 0 AND NOT (k % 17 = 0) AND brand <> '' AND model <> '' AS eligible FROM s""")
def known_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-29, FIL-12: facts that are known, and whether an offer is worth a lookup."""
    i = F.col("i")
    facts = scoring.count_facts([i["brand"], i["model"], i["model_year"], i["bike_type"], i["fork_class"]])
    return _offers(spark, sf_dir).select("k", facts.alias("facts"), comparables.lookup_eligible(F.col("k") % 3 == 0, i["audience"] == "kids", i["brand"], i["model"]).alias("eligible"))


FX = {"EUR": 24.0, "PLN": 5.8, "CHF": 26.0}


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS price_czk, CASE WHEN o_custkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS amount, CASE o_custkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'pln' WHEN 2 THEN 'CZK' WHEN 3 THEN NULL ELSE 'USD' END AS ccy FROM orders)
SELECT o_orderkey, CASE WHEN price_czk IS NOT NULL THEN CAST(price_czk AS DOUBLE) WHEN amount IS NULL THEN NULL WHEN upper(coalesce(ccy, 'CZK')) = 'CZK' THEN CAST(amount AS DOUBLE) WHEN upper(ccy) = 'EUR' THEN amount * 24.0 WHEN upper(ccy) = 'PLN' THEN CAST(amount AS DOUBLE) * 5.8 WHEN upper(ccy) = 'CHF' THEN amount * 26.0 END AS price FROM o""")
def purchase_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06: the home price, else the amount by the valuation's rate, else NULL."""
    c = F.col("o_custkey")
    ccy = F.when(c % 5 == 0, "EUR").when(c % 5 == 1, "pln").when(c % 5 == 2, "CZK").when(c % 5 == 4, "USD")
    whole = F.floor("o_totalprice").cast("long")
    rates = F.create_map(*[F.lit(x) for p in FX.items() for x in p])
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.purchase_price(F.when(c % 4 == 0, whole), F.when(c % 7 != 0, whole), ccy, rates).alias("price"))


@query("""WITH s AS (SELECT user_id, MAX(event_id) AS last_id FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view')
SELECT b.user_id, s.last_id AS stored_last_id FROM b LEFT JOIN s USING (user_id)""")
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15: a batch of keys against the keyed table, in one join."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    stored = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last_id"))
    return joins.lookup(e.where("event_type = 'view'").select("user_id").distinct(), stored, ["user_id"], ["last_id"])


GUARD_SQL = """WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS raw, CAST(floor(l_extendedprice * 1.2) AS BIGINT) AS quick, l_discount * 100 >= 4 AS estimated, l_tax * 100 >= 7 AS outlier, CAST(round(l_tax * 1000) AS INTEGER) AS discount FROM lineitem),
c AS (SELECT *, TRY_CAST(raw AS BIGINT) AS price FROM b), d AS (SELECT *, quick - price AS profit FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN price IS NULL THEN 'MANUAL_REVIEW' WHEN profit >= 8000 AND estimated THEN 'INTERESTING' WHEN profit >= 8000 THEN 'HOT' WHEN profit > 0 THEN 'LOW_PRIORITY' ELSE 'REJECT' END AS status,
CASE WHEN price IS NULL THEN 'deal_evaluation_error' ELSE array_to_string(list_filter([CASE WHEN outlier OR discount >= 60 THEN 'price_anomaly' END, CASE WHEN estimated THEN 'estimated_price' END], lambda x: x IS NOT NULL), ',') END AS flags FROM d"""


@query(GUARD_SQL)
def guarded_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-07, SCR-09, SCR-11, SCR-14: a row that can't be worked out becomes a review, HOT on an estimate is capped, flags are listed."""
    line = table(spark, sf_dir, "lineitem")
    raw = F.when(F.col("l_orderkey") % 50 == 0, "n/a").otherwise(F.floor("l_extendedprice").cast("long").cast("string"))
    x = line.select("l_orderkey", "l_linenumber", raw.try_cast("long").alias("price"), F.floor(F.col("l_extendedprice") * 1.2).cast("long").alias("quick"), (F.col("l_discount") * 100 >= 4).alias("estimated"), (F.col("l_tax") * 100 >= 7).alias("outlier"), F.round(F.col("l_tax") * 1000).cast("int").alias("discount"))
    x = x.withColumn("profit", F.col("quick") - F.col("price"))
    base = F.when(F.col("profit") >= 8000, "HOT").when(F.col("profit") > 0, "LOW_PRIORITY").otherwise("REJECT")
    flags = scoring.manual_reasons(price_anomaly=scoring.price_anomaly(F.col("outlier"), F.col("discount") - 25), estimated_price=F.col("estimated"))
    row = scoring.isolate_errors(F.col("price").isNull(), scoring.cap_hot(base, F.col("estimated")), flags)
    return x.select("l_orderkey", "l_linenumber", row["status"].alias("status"), F.array_join(row["flags"], ",").alias("flags"))


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT doc_id, true AS skip_existing, rn > 5 AS send_latest, false AS send_all FROM d""")
def bootstrap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-06: what a first run suppresses in each of its modes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    order = [F.desc("n_chars"), F.asc("doc_id")]
    out = d
    for mode in ("skip_existing", "send_latest", "send_all"):
        gone = selection.suppressed(d, ["doc_id"], mode, order, 5).withColumn(mode, F.lit(True))
        out = out.join(gone, "doc_id", "left").withColumn(mode, F.coalesce(mode, F.lit(False)))
    return out.select("doc_id", "skip_existing", "send_latest", "send_all")


@query("""SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2.0, 0) AS BIGINT) AS half, least(greatest(l_extendedprice / 1000, 2.0), 40.0) AS held, CAST(ceil(l_extendedprice / 700) AS BIGINT) AS up, CASE WHEN l_linenumber = 3 THEN 0.0 ELSE l_quantity / (l_linenumber - 3) END AS ratio,
abs(l_extendedprice - l_quantity * 1000) / greatest(l_extendedprice, l_quantity * 1000) AS gap, l_linenumber <> 3 AS finite, CASE WHEN l_quantity >= 10 THEN CAST(round_even((100000 - l_extendedprice) / 100000 * 100, 0) AS INTEGER) END AS discount,
CASE WHEN l_linenumber % 3 > 0 AND l_linenumber % 2 > 0 THEN 'mixed' WHEN l_linenumber % 3 > 0 THEN 'home_only' WHEN l_linenumber % 2 > 0 THEN 'foreign_only' ELSE 'unknown' END AS scope FROM lineitem""")
def number_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-01, MTH-04, MTH-06, SCR-04: rounding, bounds, guarded division, finite numbers, discount, market scope."""
    price, q, n = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber")
    wild = F.when(n == 3, F.lit(float("inf"))).otherwise(q)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.half_even(q / 2.0).cast("long").alias("half"), numeric.clamp(price / 1000, 2.0, 40.0).alias("held"), F.ceil(price / 700).cast("long").alias("up"), numeric.ratio(q, n - 3).alias("ratio"),
        numeric.relative_gap(price, q * 1000).alias("gap"), numeric.finite(wild).alias("finite"), numeric.percent_discount(F.when(q >= 10, price), F.lit(100000)).alias("discount"), valuation.market_scope(n % 3, n % 2).alias("scope"),
    )


@query("""WITH n AS (SELECT user_id AS group_id, MAX(ts) AS detected_at FROM events WHERE event_id % 2 = 0 GROUP BY 1), o AS (SELECT user_id AS group_id, MIN(ts) AS old FROM events WHERE event_id % 5 = 1 GROUP BY 1)
SELECT group_id, least(detected_at, coalesce(old, detected_at)) AS detected_at FROM n LEFT JOIN o USING (group_id)""")
def rebuilt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-15: a table rebuilt whole keeps each group's earliest detection."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("group_id"), F.col("ts").alias("detected_at"), "event_id")
    new = e.where("event_id % 2 = 0").groupBy("group_id").agg(F.max("detected_at").alias("detected_at"))
    return dedup.rebuild(new, e.where("event_id % 5 = 1").select("group_id", "detected_at"))


@query()
def offer_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT-02, ENT-05, ENT-06, ENT-07, ENT-10, ENT-11: whole identities of made-up titles (golden tests in tests/test_identity.py)."""
    brands = F.array(*[F.lit(b) for b in list(identity.BRANDS.values())])
    k = F.col("p_partkey")
    title = F.concat_ws(" ", F.lit("Prodám"), F.get(brands, (k % len(identity.BRANDS)).cast("int")), F.initcap(F.split_part("p_type", F.lit(" "), F.lit(1))), (k % 9).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("Gen "), (1 + k % 4).cast("string"))), F.lit("29 palcu"), (2015 + k % 10).cast("string"))
    part = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), F.concat_ws(" ", F.lit("velikost L"), "p_name", F.lit("horské kolo, hydraulické brzdy")).alias("description"))
    return identity.identify(spread(part, "p_partkey"), "title", "description").select("p_partkey", "title", "identity.*")


@query()
def duplicate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06, STR-03, STR-07: duplicates with identity, contact and both similarities (held against difflib in tests/test_offers.py)."""
    x = spread(_offers(spark, sf_dir), "k")
    k = F.col("k")
    words = "prodam kolo v dobrem stavu po celkovem servisu jezdene rekreacne garazovane nove plaste a retez k videni kdykoliv po domluve"
    body = F.concat(F.lit(words), F.when(k % 3 == 0, " volejte 777 123 456").when(k % 3 == 1, " nova baterie").otherwise(""))
    rows = x.select(k.alias("key"), (k % 3).cast("string").alias("source"), (1000 + F.col("block") * 10).alias("price"), F.col("i").alias("identity"), F.concat_ws(" ", "i.brand", "i.model", "i.trim").alias("title"), body.alias("description"))
    return comparables.duplicate_pairs(rows)


CAUSES_SQL = """WITH v AS (SELECT p_partkey AS k, p_size % 5 AS uniq, p_size % 3 AS exact_n, p_size % 2 AS close_n, p_partkey % 3 AS home, p_partkey % 4 AS abroad, CASE p_partkey % 6 WHEN 0 THEN 'duplicate_only_results' WHEN 1 THEN 'foreign_only_estimate' WHEN 2 THEN 'no_matching_comparables' WHEN 3 THEN 'currency_error' ELSE 'market_price_found' END AS status,
 CASE p_partkey % 7 WHEN 0 THEN 'high' ELSE 'low' END AS confidence, 1 + p_size % 2 AS sources, p_size / 50.0 AS spread, CASE WHEN p_size % 4 = 0 THEN p_retailprice END AS quick, CASE WHEN p_size % 8 = 1 THEN p_retailprice END AS market, p_partkey % 11 <> 0 AS named FROM part),
c AS (SELECT *, list_filter([CASE WHEN status = 'duplicate_only_results' THEN 'duplicate_only_results' END, CASE WHEN uniq <= 0 THEN 'no_unique_comparables' END, CASE WHEN status = 'foreign_only_estimate' OR (abroad > 0 AND home = 0) THEN 'foreign_market' END,
 CASE WHEN uniq > 0 AND exact_n + close_n = 0 THEN 'weak_model_match' END, CASE WHEN uniq > 0 AND uniq < 3 THEN 'few_comparables' END, CASE WHEN spread > 0.55 THEN 'large_price_spread' END, CASE WHEN sources = 1 THEN 'one_source' END], lambda x: x IS NOT NULL) AS l FROM v)
SELECT k, CASE WHEN confidence <> 'low' THEN '' WHEN len(l) = 0 THEN 'other' ELSE array_to_string(l, ',') END AS causes, CASE WHEN confidence <> 'low' OR len(l) = 0 THEN 'other' ELSE l[1] END AS first_cause,
CASE WHEN quick IS NOT NULL THEN '' WHEN status IN ('no_matching_comparables', 'duplicate_only_results') THEN status WHEN market IS NULL AND uniq > 0 THEN 'no_market_median' WHEN NOT named THEN 'insufficient_model_identification' WHEN status = 'currency_error' THEN 'technical_error' ELSE 'other' END AS missing FROM c"""


@query(CAUSES_SQL)
def diagnostic_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-28: causes of a low confidence and of a missing price."""
    k, size = F.col("p_partkey"), F.col("p_size")
    status = F.get(F.array(*[F.lit(s) for s in ("duplicate_only_results", "foreign_only_estimate", "no_matching_comparables", "currency_error", "market_price_found", "market_price_found")]), (k % 6).cast("int"))
    v = {
        "confidence": F.when(k % 7 == 0, "high").otherwise("low"), "status": status, "comparables_unique": size % 5, "exact_comparables": size % 3, "close_comparables": size % 2, "home_comparables": k % 3, "foreign_comparables": k % 4,
        "sources_used": F.when(size % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))), "quick_sale_price": F.when(size % 4 == 0, F.col("p_retailprice")), "market_price": F.when(size % 8 == 1, F.col("p_retailprice")),
    }
    x = table(spark, sf_dir, "part").select(k.alias("k"), (size / 50.0).alias("spread"), F.when(k % 11 != 0, "m").otherwise("").alias("model"), F.struct(*(c.alias(n) for n, c in v.items())).alias("v"))
    x = x.select("k", diagnostics.confidence_causes(F.col("v"), F.col("spread")).alias("c"), diagnostics.missing_price_cause(F.col("v"), F.lit("b"), F.col("model")).alias("missing"))
    return x.select("k", F.array_join("c", ",").alias("causes"), diagnostics.primary_cause(F.col("c")).alias("first_cause"), "missing")
