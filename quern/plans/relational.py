"""Filters, projections, joins, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions import numeric, text
from quern.operators import joins, matching, selection
from quern.plans.registry import query, table

RATES = [("EUR", 24.0), ("PLN", 5.8), ("CHF", 26.0), ("CZK", 1.0)]


@query("""SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-01: first arrival of a key."""
    return selection.first_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "ts")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-03: latest row of a key by one partial aggregation, without a sort."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("r")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", "r.*")


@query("""SELECT doc_id FROM documents WHERE (contains(' ' || lower(text) || ' ', ' the ') OR contains(' ' || lower(text) || ' ', ' der ')) AND NOT contains(lower(substr(text, 1, 200)), 'license') AND (n_chars IS NULL OR n_chars BETWEEN 200 AND 5000)""")
def profile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-01, FIL-02: any keyword as a whole word, no excluded word in the head, bounds only when known."""
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    d = table(spark, sf_dir, "documents")
    return d.where((padded.contains(" the ") | padded.contains(" der ")) & ~F.lower(F.substring("text", 1, 200)).contains("license") & matching.within_when_known(F.col("n_chars"), 200, 5000)).select("doc_id")


@query("""WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'dohodou' WHEN 'signup' THEN 'zdarma' WHEN 'error' THEN 'v textu' WHEN 'click' THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' Kc' END AS raw FROM events)
SELECT event_id, CASE WHEN raw = '' THEN 'missing' WHEN contains(raw, 'dohod') THEN 'negotiable' WHEN contains(raw, 'zdarma') THEN 'free' WHEN contains(raw, 'v textu') THEN 'in_description' WHEN regexp_matches(raw, '[0-9]') THEN 'numeric' ELSE 'parse_error' END AS status, TRY_CAST(nullif(regexp_extract(raw, '([0-9]+)', 1), '') AS INTEGER) AS amount FROM t""")
def price_class_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, SRC-09: price text to status and amount."""
    kind = F.col("event_type")
    raw = F.when(kind == "view", "dohodou").when(kind == "signup", "zdarma").when(kind == "error", "v textu").when(kind == "click", "").otherwise(F.concat(F.floor("value").cast("string"), F.lit(" Kc")))
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", matching.price_status(F.col("raw")).alias("status"), matching.price_amount(F.col("raw")).alias("amount"))


@query("""WITH s AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS t FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND b.p_partkey < a.p_partkey + 50 WHERE a.t = '' OR b.t = '' OR lower(a.t) = lower(b.t)""")
def null_tolerant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-15, FIL-16: an unknown side passes."""
    s = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("t"))
    return joins.ahead_pairs(s, ["p_brand"], "p_partkey", 50).where(matching.same_or_unknown(F.col("a.t"), F.col("b.t"))).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"))


@query("SELECT o_orderkey, l_linenumber, o_totalprice, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def join_inner_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "o_totalprice", "l_extendedprice")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic = 1, false) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def join_left_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03: rows with their group's flag, absent ones defaulted."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def join_semi_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-02."""
    line = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND (quality = 0 OR toxic = 1))")
def join_anti_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-04, JN-14: all but suppressed keys."""
    gone = table(spark, sf_dir, "labels").where("quality = 0 OR toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(gone, "doc_id", "left_anti")


@query("""WITH c AS (SELECT c_custkey, coalesce(SUM(o_totalprice), 0) > 1000000 AS big FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT o_orderkey, c_mktsegment, big FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN c USING (c_custkey)""")
def join_inner_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05, JN-13: inner then left join, as a replay reads its snapshot."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    total = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).select(F.col("o_custkey").alias("k"), (F.col("t") > 1000000).alias("big"))
    both = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return both.join(total, F.col("c_custkey") == F.col("k"), "left").select("o_orderkey", "c_mktsegment", F.coalesce("big", F.lit(False)).alias("big"))


@query("""SELECT p_partkey, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey AND abs(l_extendedprice / l_quantity - p_retailprice) <= 0.02 * p_retailprice""")
def tolerance_join_2pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16: equi join with a two percent residual."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    near = F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")) <= 0.02 * F.col("p_retailprice")
    return line.join(part, (F.col("l_partkey") == F.col("p_partkey")) & near).select("p_partkey", "l_orderkey", "l_linenumber")


@query(f"""WITH fx(ccy, rate) AS (VALUES {", ".join(f"('{c}', {r})" for c, r in RATES)}), o AS (SELECT o_orderkey, o_totalprice, CASE o_custkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'PLN' WHEN 2 THEN 'CHF' WHEN 3 THEN 'CZK' ELSE 'USD' END AS ccy FROM orders)
SELECT o_orderkey, o.ccy, CAST(round_even(CAST(o_totalprice AS BIGINT) * rate, 0) AS BIGINT) AS price, CASE WHEN rate IS NULL THEN 'currency_error' ELSE '' END AS reason FROM o LEFT JOIN fx USING (ccy)""")
def dim_broadcast_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12, MTH-05: a fixed dimension; a missing rate is a reason, not an error."""
    ccy = F.element_at(F.array(*[F.lit(c) for c in ("EUR", "PLN", "CHF", "CZK", "USD")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.bround("o_totalprice").cast("long").alias("amount"), ccy.alias("ccy"))
    fx = spark.createDataFrame(RATES, "ccy string, rate double")
    return o.join(F.broadcast(fx), "ccy", "left").select("o_orderkey", "ccy", numeric.convert(F.col("amount"), F.col("rate")).alias("price"), F.when(F.col("rate").isNull(), "currency_error").otherwise("").alias("reason"))


ALIASES = [("economy brand#3", "Economy 3"), ("economy", "Economy"), ("promo", "Promo"), ("brand#13", "Brand 13"), ("large brand#13", "Large 13"), ("standard", "Standard")]


@query(f"""WITH d(alias, canonical) AS (VALUES {", ".join(f"('{a}', '{c}')" for a, c in ALIASES)}),
m AS (SELECT p_partkey, alias, canonical, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, alias) AS rn FROM part JOIN d ON contains(' ' || lower(p_type || ' ' || p_brand) || ' ', ' ' || alias || ' '))
SELECT p_partkey, alias, canonical FROM m WHERE rn = 1""")
def catalog_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT-01, ENT-03, JN-12: the longest dictionary alias at word boundaries."""
    dim = spark.createDataFrame(ALIASES, "alias string, canonical string")
    return matching.longest_alias(table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("t")), "p_partkey", "t", dim)


@query("""WITH c AS (SELECT COUNT(*) AS n FROM documents), b AS (SELECT CASE WHEN n <= 10 THEN n WHEN n <= 30 THEN 10 WHEN n <= 70 THEN 15 ELSE least(20, greatest(15, CAST(ceil(n * 0.2) AS INTEGER))) END AS budget FROM c)
SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents), b WHERE rn <= budget""")
def topk_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-01, TK-02, TK-08: top rows by a budget that follows the number of candidates (never above 20)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    budget = d.agg(numeric.lookup_budget(F.count("*")).alias("budget"))
    top = d.orderBy(F.desc("n_chars"), "doc_id").limit(20)
    rank = F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id"))  # over at most 20 rows
    return top.withColumn("_rn", rank).crossJoin(F.broadcast(budget)).where("_rn <= budget").select("doc_id", "n_chars")


QUOTA_SQL = """
WITH d AS (SELECT doc_id, source, n_chars, CASE WHEN n_chars > 6000 THEN 'HOT' WHEN n_chars > 3000 THEN 'INTERESTING' WHEN lang <> 'en' THEN 'MANUAL_REVIEW' ELSE 'LOW' END AS status FROM documents),
r AS (SELECT *, CASE status WHEN 'HOT' THEN 0 WHEN 'INTERESTING' THEN 1 WHEN 'MANUAL_REVIEW' THEN 2 END AS sr FROM d WHERE status <> 'LOW'),
m AS (SELECT *, row_number() OVER (PARTITION BY status = 'MANUAL_REVIEW' ORDER BY sr, n_chars DESC, doc_id) AS rn FROM r),
c AS (SELECT COUNT(*) FILTER (WHERE status = 'MANUAL_REVIEW') AS nm FROM r),
f AS (SELECT m.*, CASE WHEN status = 'MANUAL_REVIEW' THEN rn <= 2 ELSE rn <= 12 - least(2, nm) END AS pick FROM m, c),
k AS (SELECT 12 - COUNT(*) FILTER (WHERE pick) AS room FROM f),
g AS (SELECT f.*, row_number() OVER (PARTITION BY pick ORDER BY sr, n_chars DESC, doc_id) AS rest FROM f),
z AS (SELECT g.* FROM g, k WHERE pick OR rest <= room)
SELECT doc_id, source, status, CAST(row_number() OVER (PARTITION BY source ORDER BY sr, n_chars DESC, doc_id) - 1 AS INTEGER) AS source_rank FROM z
"""


@query(QUOTA_SQL)
def quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-03, TK-04: twelve slots, two of them reserved for review, backfill by rank."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.when(F.col("n_chars") > 6000, "HOT").when(F.col("n_chars") > 3000, "INTERESTING").when(F.col("lang") != "en", "MANUAL_REVIEW").otherwise("LOW").alias("status"))
    picked = selection.quota_select(d.where("status <> 'LOW'"), "status", [F.desc("n_chars"), F.asc("doc_id")], most=12, reserved=2)
    return selection.source_ranks(picked, "source", "status", [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source", "status", "source_rank")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS turn FROM documents) SELECT doc_id, source, CAST(turn AS INTEGER) AS turn FROM r WHERE turn < 3""")
def round_robin_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-02: turn of a row within its source."""
    turn = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", turn.alias("_t")).where("_t <= 3").select("doc_id", "source", (F.col("_t") - 1).cast("int").alias("turn"))


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS best, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey DESC) AS worst FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN best <= 3 THEN 'head' ELSE 'tail' END AS part FROM r WHERE best <= 3 OR worst <= 2""")
def head_tail_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-11: half best, half worst of each status."""
    return selection.head_tail(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice", "o_orderkey", 5).select("o_orderkey", "o_orderstatus", "part")


@query("""SELECT doc_id AS id, 'documents' AS origin, length(text) AS size FROM documents UNION ALL SELECT item_id, 'benchmark', length(text) FROM benchmark UNION ALL SELECT conv_id * 1000 + turn, 'conversations', length(text) FROM conversations""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-01."""
    size = F.char_length("text").cast("long").alias("size")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), size)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"), size)
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("conversations").alias("origin"), size)
    return d.unionByName(b).unionByName(c)


@query("""WITH u AS (SELECT s_nationkey AS k, s_name AS name, 0 AS ord FROM supplier UNION ALL SELECT c_nationkey, c_name, 1 FROM customer)
SELECT k, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord, name) AS rn FROM u) WHERE rn = 1""")
def union_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-02: union, first of each key."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.lit(0).alias("ord"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.lit(1).alias("ord"))
    return s.unionByName(c).groupBy("k").agg(F.min_by("name", F.struct("ord", "name")).alias("name"))


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS t FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, CAST(len(list_intersect(a.t, b.t)) AS INTEGER) AS common, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS overlap, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-03: intersection, overlap coefficient, Jaccard."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("t"))
    a, b = w.alias("a"), w.alias("b")
    x, y = F.col("a.t"), F.col("b.t")
    return a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 1).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.size(F.array_intersect(x, y)).alias("common"), F.round(text.overlap_coefficient(x, y), 6).alias("overlap"), F.round(text.jaccard(x, y), 6).alias("jaccard"))


@query("""WITH f AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderstatus)) AS s FROM orders GROUP BY 1)
SELECT k, len(list_filter(s, lambda x: NOT list_contains(['F','O'], x))) = 0 AS subset, array_to_string(list_filter(s, lambda x: NOT list_contains(['F','O'], x)), ',') AS unknown, array_to_string(list_filter(s, lambda x: list_contains(['F','P'], x)), ',') AS flags FROM f""")
def set_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-04, ST-05, ST-06: subset, difference, intersection."""
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    known, flags = F.array(F.lit("F"), F.lit("O")), F.array(F.lit("F"), F.lit("P"))
    return f.select("k", (F.size(F.array_except("s", known)) == 0).alias("subset"), F.array_join(F.array_except("s", known), ",").alias("unknown"), F.array_join(F.array_intersect("s", flags), ",").alias("flags"))


@query("""WITH o AS (SELECT l_orderkey || ':' || l_linenumber AS key, l_partkey, l_suppkey, l_extendedprice AS price, CAST(100 - l_discount * 100 AS INTEGER) AS score, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CAST(100 - l_discount * 100 AS INTEGER) DESC, l_extendedprice, l_orderkey, l_linenumber) AS r1 FROM lineitem)
SELECT l_partkey, l_suppkey, key, score FROM o WHERE r1 = 1""")
def best_offer_per_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-05, WN-07: best offer of a store by score, price, key."""
    line = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"), "l_partkey", "l_suppkey", "l_extendedprice", (100 - F.col("l_discount") * 100).cast("int").alias("_cut"), "l_discount", "l_orderkey", "l_linenumber")
    line = line.withColumn("score", F.bround(100 - F.col("l_discount") * 100).cast("int"))
    return selection.first_per_key(line, ["l_partkey", "l_suppkey"], [F.desc("score"), F.asc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_partkey", "l_suppkey", "key", "score")


@query("""SELECT concat_ws(':', source, doc_id) AS key, CASE WHEN lang = 'en' THEN n_chars WHEN upper(lang) = 'DE' THEN n_chars * 2 END AS price, array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') AS head FROM documents""")
def key_price_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, PRJ-02, PRJ-04, TK-07: composite key, first known price, bounded slice."""
    d = table(spark, sf_dir, "documents")
    price = F.coalesce(F.when(F.col("lang") == "en", F.col("n_chars")), F.when(F.upper("lang") == "DE", F.col("n_chars") * 2))
    return d.select(F.concat_ws(":", "source", "doc_id").alias("key"), price.alias("price"), F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("head"))


@query("""WITH m AS (SELECT MAX(ts) AS now FROM events) SELECT event_id, user_id, ts FROM events, m WHERE ts >= now - INTERVAL 7 DAY AND event_type IN ('purchase', 'signup') ORDER BY ts, event_id LIMIT 100""")
def recency_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-08, FIL-09, FIL-10, TK-05: recent rows of enabled kinds, first in first out."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    now = e.agg(F.max("ts").alias("now"))
    recent = e.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS")).where(F.col("event_type").isin("purchase", "signup"))
    return recent.orderBy("ts", "event_id").limit(100).select("event_id", "user_id", "ts")


@query("""WITH c AS (SELECT p_brand, s_nationkey, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
r AS (SELECT *, SUM(n) OVER (PARTITION BY p_brand ORDER BY n DESC, s_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT p_brand, s_nationkey, n FROM r WHERE coalesce(before, 0) < 50""")
def route_until_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-09: markets in order until enough comparables are in hand, as a cumulative mask."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    c = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("p_brand").orderBy(F.desc("n"), "s_nationkey").rowsBetween(W.unboundedPreceding, -1))
    return c.withColumn("_b", F.coalesce(before, F.lit(0))).where("_b < 50").select("p_brand", "s_nationkey", "n")
