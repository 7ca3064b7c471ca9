"""Used-market pages of three countries as comparables (SRC-21..24): blocks by pattern, fields by expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.sources.feeds import absolute, html_unescape, image_fingerprint

COLUMNS = ["source", "source_listing_id", "url", "country", "title", "description", "price_original", "currency", "seller", "location", "image_url", "image_fingerprint"]


def plain(x: Column) -> Column:
    """Text of a fragment with single blanks."""
    return F.trim(F.regexp_replace(html_unescape(F.regexp_replace(x, "(?s)<[^>]*(?:>|$)", " ")), r"[\s ]+", " "))


def amount(x: Column) -> Column:
    """The first number of a price text: a comma is the decimal sign, then dots group; NULL unless positive (SRC-24)."""
    raw = F.regexp_replace(F.regexp_extract(F.replace(x, F.lit(" "), F.lit(" ")), r"\d[\d .,']*", 0), "[ ']", "")
    bare = F.when(raw.contains(","), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit("."), F.lit("")))
    value = bare.try_cast("double")
    return F.when(value > 0, value)


def _field(pattern: str) -> Column:
    return F.regexp_extract("_b", "(?s)" + pattern, 1)


def _blocks(pages: DataFrame, column: str, pattern: str) -> DataFrame:
    """(page number, block number, block): as they stand on the pages."""
    return pages.select(F.xxhash64(column).alias("_page"), F.posexplode(F.regexp_extract_all(column, F.lit("(?s)" + pattern), 0)).alias("_at", "_b"))


def _first(rows: DataFrame, source: str, country: str, most: int) -> DataFrame:
    """Rows with a title and a price: the first of each id, and of a page the first ``most``."""
    good = rows.where((F.coalesce("title", F.lit("")) != "") & F.col("price_original").isNotNull() & (F.col("source_listing_id") != ""))
    fields = [c for c in COLUMNS if c in good.columns and c != "source_listing_id"]
    one = good.groupBy("_page", "source_listing_id").agg(F.min_by(F.struct("_at", *fields), "_at").alias("r")).select("_page", "source_listing_id", "r.*")
    per_page = F.array_sort(F.collect_list(F.struct("_at", "source_listing_id", *fields)))
    out = one.groupBy("_page").agg(F.slice(per_page, 1, most).alias("l")).select(F.explode("l").alias("r")).select("r.*").drop("_at")
    fixed = {"source": source, "country": country, "currency": "EUR", "seller": "", "location": "", "description": "", "image_url": ""}
    for c, value in fixed.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(value))
    return out.withColumn("image_fingerprint", image_fingerprint(F.lower("image_url"))).select(*COLUMNS)


def german(pages: DataFrame, column: str, most: int = 25) -> DataFrame:
    """SRC-21: articles with an id and an address; title and text from their JSON-LD, else from the mark-up."""
    b = _blocks(pages, column, r'<article class="aditem".*?</article>')
    ld = F.from_json(_field(r'application/ld\+json"[^<>]*>(.+?)</script'), "title STRING, description STRING, contentUrl STRING")
    said = lambda name, pattern: F.coalesce(F.nullif(ld[name], F.lit("")), plain(_field(pattern)))
    rows = b.select(
        "_page", "_at", F.regexp_extract("_b", r'data-adid="(\d+)"', 1).alias("source_listing_id"), html_unescape(F.regexp_extract("_b", 'data-href="([^"]+)"', 1)).alias("_href"),
        said("title", r'<a class="ellipsis".*?>(.*?)</a>').alias("title"), said("description", r"aditem-main--middle--description[^<>]*>(.+?)</p>").alias("description"),
        amount(plain(_field(r"aditem-main--middle--price-shipping--price[^<>]*>(.+?)</p>"))).alias("price_original"), F.coalesce(ld["contentUrl"], F.lit("")).alias("image_url"),
        plain(_field(r"aditem-main--top--left[^<>]*>(.+?)</div>")).alias("location"),
    )
    rows = rows.where(F.col("_href") != "").withColumn("url", absolute(F.col("_href"), F.lit("https://www.kleinanzeigen.de/")))
    return _first(rows, "kleinanzeigen_de", "DE", most)


def dutch(pages: DataFrame, column: str, most: int = 25) -> DataFrame:
    """SRC-22: list items; the same ad is there once for each screen size."""
    b = _blocks(pages, column, r'<li class="hz-Listing\b.*?(?=<li class="hz-Listing\b|\z)')
    href = F.regexp_extract("_b", r'href="(/v/[^"?]+/m\d+-[^"]+)"', 1)
    rows = b.select(
        "_page", "_at", F.regexp_extract(href, r"/m(\d+)-[^/]*$", 1).alias("source_listing_id"), absolute(html_unescape(href), F.lit("https://www.marktplaats.nl/")).alias("url"),
        plain(_field(r"ListingTitle_[^<>]*>(.+?)</span>")).alias("title"), plain(_field(r"ListingDescription_[^<>]*>(.+?)</span>")).alias("description"),
        amount(plain(_field(r"ListingPrice_[^<>]*>(.+?)</h5>"))).alias("price_original"), plain(_field(r"hz-Listing-seller-name-new[^<>]*>(.+?)</span>")).alias("seller"),
        plain(_field(r'data-testid="location-label"[^<>]*>(.+?)</span>')).alias("location"), html_unescape(F.regexp_extract("_b", r'<img[^>]+(?:data-src|src)="([^"]+)"', 1)).alias("image_url"),
    )
    return _first(rows, "marktplaats_nl", "NL", most)


def european(pages: DataFrame, column: str, brand: str | None = None, most: int = 25) -> DataFrame:
    """SRC-23: items by their data attributes; ``brand`` goes before titles that lack it."""
    name = r'data-cnstrc-item-id="[^"]+"\s+data-cnstrc-item-name="[^"]+"\s+data-cnstrc-item-price="[^"]+"'
    b = _blocks(pages, column, rf"{name}.*?(?={name}|\z)")
    of = lambda a: F.regexp_extract("_b", f'^.*?data-cnstrc-item-{a}="([^"]+)"', 1)
    body = F.regexp_replace("_b", rf"^(?s:{name})[^>]*>", "")
    rows = b.select(
        "_page", "_at", of("id").alias("source_listing_id"), html_unescape(F.regexp_extract("_b", r'<a[^>]+href="([^"]+/product/[^"]+)"', 1)).alias("_href"), html_unescape(of("name")).alias("title"),
        F.substring(plain(body), 1, 500).alias("description"), amount(of("price")).alias("price_original"), html_unescape(F.regexp_extract("_b", r'<img[^>]+src="(https://d1mgeijqpfaspl[^"]*)"', 1)).alias("image_url"),
    )
    rows = rows.where(F.col("_href") != "").withColumn("url", absolute(F.col("_href"), F.lit("https://buycycle.com/")))
    if brand and brand.strip():
        has = F.array_contains(F.split(text.normalize_text(F.col("title")), " "), F.element_at(F.split(text.normalize_text(F.lit(brand)), " "), 1)) & F.contains(F.concat(F.lit(" "), text.normalize_text(F.col("title")), F.lit(" ")), F.concat(F.lit(" "), text.normalize_text(F.lit(brand)), F.lit(" ")))
        rows = rows.withColumn("title", F.when(has, F.col("title")).otherwise(F.concat_ws(" ", F.lit(brand.strip()), "title")))
    return _first(rows, "buycycle_eu", "EU", most)
