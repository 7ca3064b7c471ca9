"""Text normalisation, fingerprints, contacts, similarity (STR-01..12).

Everything on the hot path is built-in expressions; the two Arrow kernels are
the exact normaliser (NFKD and case folding) and the sequence-matcher ratio.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCENTS = "áàâäãåāăąçćčĉďđéèêëēėęěğĝíìîïīįıĺľłñńňóòôöõøōőŕřśšşŝţťúùûüūůűųýÿźžż"
PLAIN = "aaaaaaaaacccc" + "dd" + "eeeeeeee" + "gg" + "iiiiiii" + "lll" + "nnn" + "oooooooo" + "rr" + "ssss" + "tt" + "uuuuuuuu" + "yy" + "zzz"
assert len(ACCENTS) == len(PLAIN)

BOILERPLATE = ("see description", "more in description", "price by agreement", "contact me", "no exchange")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
PHONE = r"[+]?[0-9][0-9 ()-]{7,}[0-9]"


def strip_accents(x: Column) -> Column:
    """Lower case without diacritics, for Latin scripts (STR-02)."""
    return F.replace(F.translate(F.lower(x), ACCENTS, PLAIN), F.lit("ß"), F.lit("ss"))


def normalize_text(x: Column) -> Column:
    """Fast normaliser (STR-01): folds, decimal comma to dot, runs of all but [a-z0-9+./"'] to one blank, dashes among them."""
    t = F.replace(strip_accents(x), F.lit("’"), F.lit("'"))
    t = F.regexp_replace(t, "([0-9]),([0-9])", "$1.$2")
    return F.trim(F.regexp_replace(t, "[^a-z0-9+./\"']+", " "))


def _exact(s: str | None) -> str | None:
    if s is None:
        return None
    t = unicodedata.normalize("NFKD", s.casefold())
    t = "".join(c for c in t if not unicodedata.combining(c)).replace("’", "'")
    t = re.sub(r"[-‐–]", " ", t)
    t = re.sub(r"(?<=\d),(?=\d)", ".", t)
    return " ".join(re.sub(r"[^a-z0-9+./\"']+", " ", t).split())


@F.pandas_udf(T.StringType())
def normalize_text_exact(x: pd.Series) -> pd.Series:
    """Exact normaliser (STR-01) with full case folding and compatibility decomposition."""
    return x.map(_exact)


def duplicate_text(x: Column) -> Column:
    """Normaliser of the duplicate test (STR-03): an ellipsis is a blank, boilerplate phrases go."""
    t = F.regexp_replace(normalize_text(x), "[.]{3}", " ")
    t = reduce(lambda c, phrase: F.replace(c, F.lit(phrase), F.lit(" ")), BOILERPLATE, t)
    return F.trim(F.regexp_replace(t, " +", " "))


def fingerprint(*parts: Column, separator: str = "\x1f") -> Column:
    """SHA-256 of the joined parts; '' where all of them are empty (STR-04)."""
    joined = F.concat_ws(separator, *(F.coalesce(p, F.lit("")) for p in parts))
    return F.when(F.length(F.replace(joined, F.lit(separator), F.lit(""))) == 0, F.lit("")).otherwise(F.sha2(joined, 256))


def contacts(x: Column) -> Column:
    """Sorted distinct e-mail addresses and numbers of 9 to 15 digits (STR-05)."""
    emails = F.transform(F.regexp_extract_all(x, F.lit(f"({EMAIL})"), 1), lambda e: F.lower(e))
    phones = F.transform(F.regexp_extract_all(x, F.lit(f"({PHONE})"), 1), lambda p: F.regexp_replace(p, "[^0-9]", ""))
    phones = F.filter(phones, lambda p: F.length(p).between(9, 15))
    return F.array_sort(F.array_distinct(F.concat(emails, phones)))


def scrub(x: Column, most: int = 4000) -> Column:
    """Tags to blanks, addresses and numbers masked, squeezed, cut (STR-06)."""
    t = F.regexp_replace(x, "<[^>]*>", " ")
    t = F.regexp_replace(t, EMAIL, "[email]")
    t = F.regexp_replace(t, PHONE, "[phone]")
    return F.substring(F.trim(F.regexp_replace(t, "[ \\t\\r\\n]+", " ")), 1, most)


def tokens(x: Column) -> Column:
    """Distinct words of the normalised text."""
    return F.array_distinct(F.filter(F.split(normalize_text(x), " "), lambda w: w != ""))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common tokens over the smaller set; 0 where one is empty (ST-03)."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


@lru_cache(maxsize=2048)
def _places(b: str) -> dict[str, list[int]]:
    """Places of each letter of b that difflib lets begin a match: of long texts those under one in a hundred."""
    out: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        out.setdefault(c, []).append(j)
    most = len(b) // 100 + 1
    return {c: js for c, js in out.items() if len(b) < 200 or len(js) <= most}


def matching_ratio(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``, which passes over the places of ``a`` where no match can begin."""
    places = _places(b)
    at = [i for i, c in enumerate(a) if c in places]
    hits = [places[a[i]] for i in at]
    total, ranges = 0, [(0, len(a), 0, len(b))]
    while ranges:
        alo, ahi, blo, bhi = ranges.pop()
        i0, j0, size, before, lengths = alo, blo, 0, -2, {}
        for n in range(bisect_left(at, alo), bisect_left(at, ahi)):
            i, now = at[n], {}
            if i != before + 1:
                lengths = {}
            before, js = i, hits[n]
            for j in js if len(js) < 8 else js[bisect_left(js, blo) :]:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = now[j] = lengths.get(j - 1, 0) + 1
                if k > size:
                    i0, j0, size = i - k + 1, j - k + 1, k
            lengths = now
        while i0 > alo and j0 > blo and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < ahi and j0 + size < bhi and a[i0 + size] == b[j0 + size]:
            size += 1
        if size:
            total += size
            if alo < i0 and blo < j0:
                ranges.append((alo, i0, blo, j0))
            if i0 + size < ahi and j0 + size < bhi:
                ranges.append((i0 + size, ahi, j0 + size, bhi))
    return 2.0 * total / (len(a) + len(b)) if a or b else 1.0


def _ratio(a: str | None, b: str | None, short_overlap: bool) -> float:
    a, b = a or "", b or ""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    score = matching_ratio(a, b)
    ta, tb = set(a.split()), set(b.split())
    least = min(len(ta), len(tb))
    if least and (short_overlap or (min(len(a), len(b)) >= 80 and least >= 12)):
        score = max(score, len(ta & tb) / least)
    return round(score, 4)


def _ratios(a: pd.Series, b: pd.Series, short_overlap: bool) -> pd.Series:
    """``_ratio`` of the rows, once for each pair of texts in them."""
    known: dict[tuple, float] = {}
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = _ratio(*pair, short_overlap)
    return pd.Series([known[pair] for pair in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def similarity_long(a: pd.Series, b: pd.Series) -> pd.Series:
    """Greater of matching-blocks ratio and token overlap, the latter for long texts only (STR-07); of texts that ``duplicate_text`` normalised."""
    return _ratios(a, b, False)


@F.pandas_udf(T.DoubleType())
def similarity_short(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same with the overlap allowed for short texts."""
    return _ratios(a, b, True)


def text_similarity(a: Column, b: Column, short_overlap: bool = False) -> Column:
    """STR-07 of two raw texts, normalised by STR-03 first."""
    return (similarity_short if short_overlap else similarity_long)(duplicate_text(F.coalesce(a, F.lit(""))), duplicate_text(F.coalesce(b, F.lit(""))))


def any_word(x: Column, terms: list[str]) -> Column:
    """Whether a whole word of the normalised text is one of the terms (STR-08)."""
    padded = F.concat(F.lit(" "), x, F.lit(" "))
    return reduce(lambda p, q: p | q, (F.contains(padded, F.lit(f" {t} ")) for t in terms))


def any_term_unless_negated(x: Column, terms: list[str]) -> Column:
    """Whether a term occurs with no negation right before it (STR-09), on normalised text."""
    either = "|".join(re.escape(t) for t in terms)
    return F.regexp_like(x, F.lit(rf"(?<!(?:^|\s)(?:ne|neni(?: (?:v|ve))?|not|is not) )(?<![a-z0-9])(?:{either})(?![a-z0-9])"))


def url_host(x: Column) -> Column:
    """Lower-case host of an address, '' where there is none (STR-11)."""
    return F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def money(x: Column, unit: str) -> Column:
    """Whole amount with thin grouping and unit (STR-12)."""
    return F.concat(F.replace(F.format_number(x, 0), F.lit(","), F.lit(" ")), F.lit(f" {unit}"))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def html_text(x: Column) -> Column:
    """Snippet to text: scripts out, block tags to lines, other tags out, white space squeezed line by line (SRC-02)."""
    t = F.regexp_replace(x, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, "(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table|section|article)[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", "")
    t = F.regexp_replace(t, "[ \\t\\r]+", " ")
    return F.trim(F.regexp_replace(t, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def html_meta(x: Column, name: str) -> Column:
    """Content of a meta tag in either attribute order, entities of mark-up resolved (SRC-11)."""
    after = F.regexp_extract(x, rf'(?i)<meta[^>]*(?:name|property)="{name}"[^>]*content="([^"]*)"', 1)
    before = F.regexp_extract(x, rf'(?i)<meta[^>]*content="([^"]*)"[^>]*(?:name|property)="{name}"', 1)
    t = F.when(after != "", after).otherwise(before)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t
