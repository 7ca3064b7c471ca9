"""Text, HTML, URL and JSON queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.plans.registry import query, spread, table


def normal(x: str) -> str:
    """SQL twin of text.normalize_text."""
    t = f"replace(translate(lower({x}), '{text.ACCENTS}', '{text.PLAIN}'), 'ß', 'ss')"
    t = f"replace({t}, '’', '''')"
    t = f"regexp_replace({t}, '[-–]', ' ', 'g')"
    t = f"regexp_replace({t}, '([0-9]),([0-9])', '\\1.\\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '[^a-z0-9+./\"'']+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, md5({normal('text')}) AS digest, length({normal('text')}) AS size FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-02."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", text.normalize_text(F.col("text")).alias("n"))
    n = F.col("n")
    return d.select("doc_id", F.md5(n).alias("digest"), F.char_length(n).cast("long").alias("size"))


@query(f"SELECT doc_id, CASE WHEN {normal('text')} = '' AND coalesce(source, '') = '' THEN '' ELSE sha256({normal('text')} || chr(31) || coalesce(source, '')) END AS fingerprint FROM documents")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    n = d.select("doc_id", "source", text.normalize_text(F.col("text")).alias("n"))  # a column of its own: worked out once, though used twice
    return n.select("doc_id", text.fingerprint(F.col("n"), F.col("source")).alias("fingerprint"))


PHONE_SQL = text.PHONE


@query(f"""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '{text.EMAIL}', '[email]', 'g'), '{text.PHONE}', '[phone]', 'g'), '[ \t\r\n]+', ' ', 'g')), 1, 4000) AS scrubbed FROM documents""")
def pii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", text.scrub(F.col("text")).alias("scrubbed"))


@query(f"""WITH c AS (SELECT doc_id, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '{text.EMAIL}'), lambda x: lower(x)),
 list_filter(list_transform(regexp_extract_all(text, '{text.PHONE}'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 9 AND 15)))) AS c FROM documents)
SELECT doc_id, array_to_string(c, ',') AS contacts, CASE WHEN len(c) = 0 THEN '' ELSE sha256(array_to_string(c, '|')) END AS contact_hash FROM c WHERE len(c) > 0""")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05."""
    c = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", text.contacts(F.col("text")).alias("c")).where(F.size("c") > 0)
    return c.select("doc_id", F.array_join("c", ",").alias("contacts"), F.sha2(F.array_join("c", "|"), 256).alias("contact_hash"))


@query("""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table|section|article)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \\t\\r]+', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(t, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS body FROM t""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, SUP-03."""
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("page_id", text.html_text(F.col("html")).alias("body"))


@query("""SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<meta[^>]*charset="([^"]*)"', 1) AS charset FROM pages""")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, SRC-13: attributes and title from the head."""
    h = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", h('<html[^>]*lang="([^"]*)"').alias("lang"), h("(?s)<title>(.*?)</title>").alias("title"), h('(?i)<meta[^>]*charset="([^"]*)"').alias("charset"))


@query("""SELECT lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, COUNT(*) AS pages, COUNT(DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)) AS paths FROM pages GROUP BY 1""")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(text.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.count_distinct(path).alias("paths"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS INTEGER), -1) AS missing FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant JSON read (1.3): unknown keys dropped, missing ones defaulted."""
    p = F.from_json("props", "k INT, missing INT")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit(-1)).alias("missing"))


@query("""WITH n AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM documents WHERE lang = 'en')
SELECT doc_id, contains(replace(replace(t, ' is not that ', ' '), ' not that ', ' '), ' that ') AS has_term FROM n""")
def negation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08, STR-09: a term unless negated right before it."""
    n = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    return d.select("doc_id", text.any_term_unless_negated(n, ["that"]).alias("has_term"))


@query("""SELECT o_orderkey, replace(format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)), ',', chr(8239)) || ' Kc' AS price, replace(replace('<b>' || o_orderpriority || '&', '&', '&amp;'), '<', '&lt;') AS escaped FROM orders""")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12, SNK-10, SUP-20: rendered cells."""
    esc = F.replace(F.replace(F.concat(F.lit("<b>"), "o_orderpriority", F.lit("&")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.money(F.bround("o_totalprice").cast("long"), "Kc").alias("price"), esc.alias("escaped"))


@query("""SELECT event_id, CAST(date_trunc('day', ts) AS DATE) AS day, strftime(ts, '%Y%m%d') AS day_key, CAST(floor(epoch(TIMESTAMP '2024-02-01' - ts) / 3600) AS BIGINT) AS age_hours, CASE WHEN epoch(TIMESTAMP '2024-02-01' - ts) < 86400 * 2 THEN 'new' ELSE 'old' END AS age FROM events""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date functions with an explicit now (2.9)."""
    age = F.lit("2024-02-01").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), F.date_format("ts", "yyyyMMdd").alias("day_key"), F.floor(age / 3600).cast("long").alias("age_hours"), F.when(age < 86400 * 2, "new").otherwise("old").alias("age"))
