"""Readers of feeds, pages and files (SRC-01..29, SUP-01..03) as DataFrames.

Files come in as (path, content) rows of ``binaryFile`` or as XML/CSV/JSON
sources; parsing is column expressions, with one table function for HTML cards.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from quern.functions import text
from quern.operators import matching

RSS_SCHEMA = "title STRING, link STRING, guid STRING, description STRING, pubDate STRING, content STRUCT<_url: STRING>, enclosure STRUCT<_url: STRING>"


def feed_time(x: Column) -> Column:
    """RFC 822 without its weekday, else ISO 8601; NULL if neither (SRC-03)."""
    bare = F.regexp_replace(F.trim(x), "^[A-Za-z]{3}, *", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), x.try_cast("timestamp"))


def feed_price(body: Column, title: Column) -> Column:
    """Amount before a currency mark, else a number that ends the title (SRC-04); blanks only inside a line."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "").try_cast("int")
    return F.coalesce(digits(F.regexp_extract(body, "([0-9][0-9 \\u00a0.]*)[ \\u00a0]*K[čc]", 1)), digits(F.regexp_extract(title, ":[ \\t]*([0-9][0-9 \\u00a0]*)$", 1)))


def feed_location(body: Column) -> Column:
    """First line with a 3+2 digit postcode, behind the line before it unless that is a price or long (SRC-05)."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    at = F.array_position(F.transform(lines, lambda s: s.rlike("(?<![0-9])[0-9]{3} ?[0-9]{2}(?![0-9])") & ~s.rlike("K[čc]")), True).cast("int")
    line, before = F.try_element_at(lines, F.nullif(at, F.lit(0))), F.try_element_at(lines, F.nullif(at - 1, F.lit(0)))
    usable = before.isNotNull() & ~before.rlike("K[čc]|[0-9]{4,}") & (F.length(before) <= 80)
    return F.coalesce(F.when(usable, F.concat_ws(", ", before, line)).otherwise(line), F.lit(""))


def read_rss(spark: SparkSession, path: str, profile: str, source: str = "feed") -> DataFrame:
    """Listings of RSS items (SRC-01): id from the address, else a long number of the guid, else a hash."""
    raw = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(RSS_SCHEMA).load(path)
    body = text.html_text(F.coalesce("description", F.lit("")))
    key = F.coalesce(F.nullif(F.regexp_extract("link", "/(?:inzerat|ad|item)/([0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract("guid", "([0-9]{6,})", 1), F.lit("")), F.substring(F.sha2(F.concat_ws("|", "link", "title"), 256), 1, 20))
    image = F.coalesce(F.nullif(F.regexp_extract("description", "<img[^>]*src=[\"']([^\"']+)", 1), F.lit("")), F.col("content._url"), F.col("enclosure._url"), F.lit(""))
    rows = raw.where((F.coalesce(F.trim("title"), F.lit("")) != "") & (F.coalesce(F.trim("link"), F.lit("")) != ""))
    return rows.select(F.lit(source).alias("source"), key.alias("external_id"), F.trim("title").alias("title"), body.alias("description"), F.trim("link").alias("url"), F.lit(profile).alias("profile"), feed_price(body, F.trim("title")).alias("price_czk"), feed_location(body).alias("location"), feed_time(F.col("pubDate")).alias("published_at"), absolute(image, F.col("link")).alias("image_url"))


def absolute(x: Column, base: Column) -> Column:
    """Address resolved against the base's scheme and host (SRC-06)."""
    root = F.regexp_extract(base, "^([a-zA-Z]+://[^/]+)", 1)
    return F.when(x.startswith("//"), F.concat(F.lit("https:"), x)).when(x.startswith("/"), F.concat(root, x)).otherwise(x)


def profile_filter(df: DataFrame, required: list[str], excluded: list[str], low: int | None, high: int | None) -> DataFrame:
    """FIL-01: any required word in title or text, no excluded word in the title, bounds only for known prices."""
    whole, title = text.normalize_text(F.concat_ws(" ", "title", "description")), text.normalize_text(F.col("title"))
    out = df
    if required:
        out = out.where(text.any_word(whole, required))
    if excluded:
        out = out.where(~text.any_word(title, excluded))
    return out.where(matching.within_when_known(F.col("price_czk"), F.lit(low if low is not None else -(2**31)), F.lit(high if high is not None else 2**31 - 1)))


class _Cards(HTMLParser):
    """Text of cards by ad id, routed by tag and class hints."""

    def __init__(self, pattern: str):
        super().__init__(convert_charrefs=True)
        self.link, self.cards, self.current, self.route = re.compile(pattern), [], None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and (m := self.link.search(a.get("href") or "")):
            self.current = {"id": m.group(1), "url": a["href"], "title": "", "time": "", "price": "", "location": "", "text": "", "image": ""}
            self.cards.append(self.current)
        if self.current is None:
            return
        if tag == "img":
            self.current["image"] = self.current["image"] or a.get("src") or a.get("data-src") or ""
            return
        hint = f"{tag} {a.get('class') or ''} {a.get('id') or ''} {a.get('itemprop') or ''}".lower()
        kind = "title" if re.search(r"\bh[1-4]\b|title|nadpis", hint) else "time" if re.search(r"\btime\b|date|cas", hint) else "price" if re.search(r"price|cena|\bstrong\b", hint) else "location" if re.search(r"loca|misto|place", hint) else "text"
        if tag not in ("br", "meta", "link", "input", "hr"):
            self.route.append((tag, kind))

    def handle_endtag(self, tag):
        while self.route and self.route.pop()[0] != tag:
            pass
        if tag == "a":
            self.current, self.route = None, []

    def handle_data(self, data):
        if self.current is not None and data.strip():
            kind = self.route[-1][1] if self.route else "text"
            self.current[kind] = f"{self.current[kind]} {' '.join(data.split())}".strip()


@udtf(returnType="id: string, url: string, title: string, time: string, price: string, location: string, text: string, image: string")
class HtmlCards:
    """Rows of the cards of a listing page (SRC-07); a page that asks for a captcha raises."""

    def eval(self, page: str, pattern: str):
        if page is None:
            return
        if re.search(r"captcha|are you a robot", page, re.IGNORECASE):
            raise ValueError("the page asks for a captcha")
        parser = _Cards(pattern)
        parser.feed(page)
        for c in parser.cards:
            yield tuple(c[k] for k in ("id", "url", "title", "time", "price", "location", "text", "image"))


def cards(pages: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row an ad id (SRC-08): of double cards the one with most text, its image from any of them."""
    rows = pages.select(F.col(column).alias("page")).lateralJoin(HtmlCards(F.col("page").outer(), F.lit(pattern))).drop("page")
    size = F.length(F.concat("title", "text", "price", "location", "time"))
    best = F.max_by(F.struct("url", "title", "time", "price", "location", "text"), F.struct(size, F.col("url"))).alias("b")
    out = rows.groupBy("id").agg(best, F.max(F.nullif("image", F.lit(""))).alias("image")).select("id", "b.*", F.coalesce("image", F.lit("")).alias("image"))
    slug = F.initcap(F.replace(F.url_decode(F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1)), F.lit("-"), F.lit(" ")))
    return out.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.nullif("text", F.lit("")), slug))


def relative_time(x: Column, now: Column) -> Column:
    """'před 5 minutami', 'včera', 'dnes' to a time (SRC-12); NULL if unknown."""
    t = text.strip_accents(x)
    n = F.coalesce(F.nullif(F.regexp_extract(t, "([0-9]+)", 1), F.lit("")).cast("int"), F.lit(1))
    return (F.when(t.rlike("pred.*minut|minutes? ago"), now - F.make_dt_interval(mins=n)).when(t.rlike("pred.*hodin|hours? ago"), now - F.make_dt_interval(hours=n))
            .when(t.rlike("pred.*d(en|ny)|days? ago"), now - F.make_dt_interval(days=n)).when(t.rlike("vcera|yesterday"), now - F.make_dt_interval(days=F.lit(1))).when(t.rlike("dnes|today"), now))


def json_ld_price(page: Column) -> tuple[Column, Column]:
    """(price, currency) of the first offer in the page's JSON-LD, at any depth (SRC-10).

    A price is the value of the first key ``price`` (or ``lowPrice`` without one), whatever
    objects and lists hold it; the currency is the one in the same object, else the first.
    """
    body = F.array_join(F.regexp_extract_all(page, F.lit('(?s)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>'), 1), "\n")
    number = r'"?\s*([0-9][0-9 .,]*)'
    value = lambda key: F.nullif(F.regexp_extract(body, rf'"{key}"\s*:\s*{number}', 1), F.lit(""))
    price = F.coalesce(value("price"), value("lowPrice"))
    near = F.coalesce(*[F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in (r'"(?:price|lowPrice)"\s*:[^{}]*"priceCurrency"\s*:\s*"([A-Za-z]{3})"', r'"priceCurrency"\s*:\s*"([A-Za-z]{3})"')])
    return F.regexp_replace(F.replace(price, F.lit(" "), F.lit("")), ",", ".").try_cast("double"), near


LISTING_JSON = "id STRING, title STRING, url STRING, price STRUCT<amount: STRING, formatted_amount: STRING, currency: STRING>, location STRUCT<display_name: STRING, city: STRING, state: STRING>, primary_photo STRUCT<uri: STRING>, is_sold BOOLEAN, is_hidden BOOLEAN, creation_time BIGINT"


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """Single listings as JSON objects, one a file (SRC-36): (title, description, price_czk, location); missing keys are NULL."""
    return spark.read.option("multiLine", "true").schema("title STRING, description STRING, price_czk INT, location STRING").json(path)


def read_marketplace(spark: SparkSession, path: str, default_currency: str = "CZK") -> DataFrame:
    """Listings of JSON responses (SRC-15, SRC-17, SRC-18): sold, hidden and malformed rows go."""
    raw = spark.read.option("multiLine", "true").schema(f"listings ARRAY<STRUCT<{_struct(LISTING_JSON)}>>, cursor STRING, has_next_page BOOLEAN").json(path)
    x = raw.select(F.explode("listings").alias("l")).select("l.*").where("id IS NOT NULL AND title IS NOT NULL AND NOT coalesce(is_sold, false) AND NOT coalesce(is_hidden, false)")
    amount = F.regexp_replace(F.coalesce(F.col("price.amount"), F.col("price.formatted_amount")), "[^0-9.]", "").try_cast("double")
    ccy = F.coalesce(F.col("price.currency"), matching.currency(F.coalesce(F.col("price.formatted_amount"), F.lit("")), default_currency))
    status = F.when(amount.isNull(), "missing").when(amount <= 0, "free").otherwise("numeric")
    return x.select("id", "title", "url", F.bround(amount).cast("int").alias("price_amount"), ccy.alias("currency"), status.alias("price_status"), F.when((ccy == "CZK") & (amount > 0), F.bround(amount)).cast("int").alias("price_czk"),
                    F.coalesce(F.col("location.display_name"), F.concat_ws(", ", "location.city", "location.state")).alias("location"), F.col("primary_photo.uri").alias("image_url"), F.timestamp_seconds("creation_time").alias("published_at"))


def _struct(ddl: str) -> str:
    return re.sub(r"(\w+) ((?:STRUCT<[^>]*>)|\w+)", r"\1: \2", ddl)


def merge_detail(listings: DataFrame, details: DataFrame, most_photos: int = 5) -> DataFrame:
    """SRC-19: a field of the detail (id, description, photos, attributes) counts only if present."""
    d = details.select("id", F.nullif("description", F.lit("")).alias("_d"), "photos", "attributes")
    both = listings.join(d, "id", "left")
    extra = F.array_join(F.transform(F.coalesce("attributes", F.array().cast("array<struct<name:string,label:string>>")), lambda a: F.concat_ws(": ", a["name"], a["label"])), "\n")
    text_ = F.concat_ws("\n", F.coalesce("_d", "description"), F.nullif(extra, F.lit("")))
    return both.select(*(c for c in listings.columns if c != "description"), text_.alias("description"), F.slice(F.array_distinct(F.coalesce("photos", F.array().cast("array<string>"))), 1, most_photos).alias("image_urls"))


def embedded_offers(pages: DataFrame, column: str) -> DataFrame:
    """Offers of the JSON state of a shop page (SRC-25): cents to whole units, one a (seller, url)."""
    body = F.regexp_extract(column, '(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    offer = "ARRAY<STRUCT<type: STRING, name: STRING, url: STRING, price: BIGINT, availability: STRING, shop: STRUCT<name: STRING>>>"
    schema = f"props STRUCT<pageProps: STRUCT<data: STRUCT<results: STRUCT<results: {offer}>, offers: STRUCT<items: {offer}>>>>"
    data = F.from_json(body, schema)["props"]["pageProps"]["data"]
    empty = F.array().cast(re.sub("STRUCT", "struct", re.sub("ARRAY", "array", offer)))
    items = F.concat(F.coalesce(data["results"]["results"], empty), F.coalesce(data["offers"]["items"], empty))
    rows = pages.select(F.posexplode(items).alias("at", "o")).where("o.price IS NOT NULL AND o.shop.name IS NOT NULL")
    rows = rows.select("at", F.col("o.shop.name").alias("seller"), F.col("o.name").alias("product_name"), F.bround(F.col("o.price") / 100).cast("int").alias("price_czk"), F.col("o.url").alias("url"), F.col("o.availability").alias("availability"))
    return rows.groupBy("seller", "url").agg(F.min_by(F.struct("product_name", "price_czk", "availability"), "at").alias("r")).select("seller", "url", "r.*")


def local_number(x: Column) -> Column:
    """'1.299,50 €' and '1 299' to a number (SRC-24)."""
    t = F.regexp_replace(x, "[^0-9.,]", "")
    decimal = t.rlike(",[0-9]{1,2}$")
    return F.when(decimal, F.replace(F.regexp_replace(t, "[.]", ""), F.lit(","), F.lit("."))).otherwise(F.regexp_replace(t, "[.,]", "")).try_cast("double")


def image_fingerprint(x: Column) -> Column:
    """SHA-256 of an image address without size parameters, '' for none (SRC-24)."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), "[?&](w|h|width|height|size|rule|quality)=[^&]*", "")
    return F.when(bare == "", "").otherwise(F.sha2(bare, 256))


def mentions(title: Column, brand: Column, model: Column) -> Column:
    """Title holds the brand and every word of the model (SRC-26)."""
    t = text.normalize_text(title)
    words = F.filter(F.split(text.normalize_text(model), " "), lambda w: w != "")
    return t.contains(text.normalize_text(brand)) & F.forall(words, lambda w: F.array_contains(F.split(t, " "), w))


def read_fx(spark: SparkSession, path: str) -> DataFrame:
    """(currency, rate, valid_date) of a bank's text file (SRC-27): rates by amount, the home currency at 1."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("l"))
    day = F.try_to_timestamp(F.regexp_extract(F.col("l")[0], "^([0-9]{1,2} [A-Za-z]{3} [0-9]{4})", 1), F.lit("d MMM yyyy")).cast("date")
    rows = lines.select(day.alias("valid_date"), F.explode(F.slice("l", 3, 10_000)).alias("x")).select("valid_date", F.split("x", "[|]").alias("c")).where("size(c) = 5")
    rate = F.try_divide(F.replace(F.col("c")[4], F.lit(","), F.lit(".")).try_cast("double"), F.col("c")[2].try_cast("double"))
    out = rows.select(F.trim(F.col("c")[3]).alias("currency"), rate.alias("rate"), "valid_date").where("rate > 0")
    return out.unionByName(lines.select(F.lit("CZK").alias("currency"), F.lit(1.0).alias("rate"), day.alias("valid_date")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(brand, canonical, alias) of a catalog {brands: [{name, models: [{name, aliases}]}]} (SRC-29); a missing file gives none."""
    schema = "brands ARRAY<STRUCT<name: STRING, models: ARRAY<STRUCT<name: STRING, aliases: ARRAY<STRING>>>>>"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "brand string, canonical string, alias string")
    b = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.explode("brands").alias("b"))
    m = b.select(F.col("b.name").alias("brand"), F.explode("b.models").alias("m"))
    names = F.concat(F.array("m.name"), F.coalesce(F.col("m.aliases"), F.array().cast("array<string>")))
    return m.select("brand", F.col("m.name").alias("canonical"), F.explode(F.array_distinct(names)).alias("a")).select("brand", "canonical", text.normalize_text(F.col("a")).alias("alias"))


def decode_feedback(payloads: DataFrame, column: str) -> DataFrame:
    """(source, external_id, label) of 'fb:source:id:label' and 'source:id:label' payloads (SRC-34), with whole keys."""
    p = F.split(column, ":")
    four = F.size(p) == 4
    rows = payloads.where(F.size(p).isin(3, 4))
    at = lambda i: F.when(four, p[i + 1]).otherwise(p[i])
    return rows.select(*payloads.columns, at(0).alias("source"), at(1).alias("external_id"), F.when(four, F.get(p, F.lit(3))).otherwise(p[2]).alias("label"))


def unescape(x: str | None) -> str | None:
    return None if x is None else html.unescape(x)


@F.udf(T.StringType(), useArrow=True)
def html_unescape(x):
    """Entities resolved exactly (SRC-11)."""
    return unescape(x)
