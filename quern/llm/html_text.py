"""HTML extraction by the maximum-scoring subsequence (operator 4).

A page is a sequence of words and tags.  Words score positive, tags negative;
the contiguous run of greatest sum is the content.  Scores are log odds of lying
inside the content, counted on labelled pages (those whose main text is known),
held to the sign of their kind: what hardly says anything gets the least score
of its sign.  The words' score is then scaled to the best overlap of run and
content on the same pages.  One pass of running sums finds the run.

Scale.  Extraction is one narrow scan.  The scores are a small table (a number
for words and one a tag name), fitted on at most ``max_labelled_pages`` pages;
those are picked by their ids alone, and only their mark-up is gathered.

Defined cases: NULL, empty and wordless pages give NULL text, 0 words; of equal
runs the first and shortest counts; broken markup is read as far as it goes; the
inside of scripts, styles and comments is never text; rows that repeat each get
their answer; without labelled pages the default scores apply; an empty table
gives no row; other columns are left out.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import col, small_batches
from quern.session import cut

MAX_LABELLED_PAGES = 1000
LEAST = 0.05
MOST = 8.0
WORD_SCALES = (1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05, 0.025)
DEFAULT_SCORES = {"": 1.0}
DEFAULT_TAG = -3.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>?|<[!?][^>]*>?|[^<\s]+|<", re.DOTALL | re.IGNORECASE)
_BREAKS = frozenset("p br div li ul ol h1 h2 h3 h4 h5 h6 tr table section article blockquote pre td th dd dt hr".split())


def tokens(page: str) -> list[tuple[str, str]]:
    """(tag name or '' for a word, word); comments, scripts and styles count as one tag '!'."""
    out = []
    for m in _TOKEN.finditer(page):
        name = m.group(2)
        if name:
            out.append((name.lower(), ""))
        else:
            t = m.group()
            out.append(("", t) if t[0] != "<" or len(t) == 1 else ("!", ""))
    return out


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """Half-open run of greatest sum; (0, 0) where no score is positive."""
    if not len(scores) or scores.max() <= 0:
        return 0, 0
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    low = np.minimum.accumulate(sums[:-1])
    end = int(np.argmax(sums[1:] - low)) + 1
    start = int(end - 1 - np.argmin(sums[:end][::-1]))
    return start, end


def render(parts: list[tuple[str, str]]) -> str:
    """Words with single blanks, lines at block tags, entities resolved."""
    lines: list[list[str]] = [[]]
    for name, word in parts:
        if not name:
            lines[-1].append(word)
        elif name.lstrip("/") in _BREAKS and lines[-1]:
            lines.append([])
    return entities.unescape("\n".join(" ".join(line) for line in lines if line))


def content_run(found: list[tuple[str, str]], text: str) -> tuple[int, int]:
    """Token run that spells the known main text: the start from which most words agree; (0, 0) if under half do."""
    want = text.split()
    at = [i for i, (name, _) in enumerate(found) if not name]
    have = [entities.unescape(found[i][1]) for i in at]
    best = (0, 0, 0)
    for s in (i for i, w in enumerate(have) if want and w == want[0]):
        n = 0
        while n < len(want) and s + n < len(have) and have[s + n] == want[n]:
            n += 1
        if n > best[0]:
            best = (n, s, s + n - 1)
    if not want or best[0] < 0.5 * len(want):
        return 0, 0
    return at[best[1]], at[best[2]] + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside: dict[str, int] = {}
    total: dict[str, int] = {}
    for batch in batches:
        for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = tokens(page or "")
            a, b = content_run(found, text or "")
            if a == b:
                continue
            for i, (name, _) in enumerate(found):
                total[name] = total.get(name, 0) + 1
                if a <= i < b:
                    inside[name] = inside.get(name, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([inside.get(k, 0) for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["token", "inside", "total"])


def _overlaps(scores: dict[str, float], scales: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros(len(scales))
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = tokens(page or "")
                a, b = content_run(found, text or "")
                if a == b:
                    continue
                word = np.array([not name for name, _ in found])
                values = np.array([scores.get(name, DEFAULT_TAG) for name, _ in found])
                count = np.concatenate(([0], np.cumsum(word)))
                for k, scale in enumerate(scales):
                    s, e = best_run(np.where(word, values * scale, values))
                    both = max(0, count[max(min(e, b), max(s, a))] - count[max(s, a)])
                    sums[k] += 2 * both / max(1, count[e] - count[s] + count[b] - count[a])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(scales), dtype=np.int32)), pa.array(sums)], ["k", "f1"])

    return run


def fit(labelled: DataFrame, html: str = "html", text: str = "text") -> dict[str, float]:
    """Scores by token ('' is a word) from the pages with known text (``labelled_pages`` bounds their number)."""
    few = cut(labelled.where(col(html).isNotNull() & col(text).isNotNull()).select(col(html), col(text)))
    rows = few.mapInArrow(_count, "token string, inside long, total long").groupBy("token").agg(F.sum("inside").alias("i"), F.sum("total").alias("n")).collect()
    out: dict[str, float] = {}
    for r in rows:
        odds = math.log((r["i"] + 0.5) / (r["n"] - r["i"] + 0.5))
        out[r["token"]] = min(max(odds, LEAST), MOST) if r["token"] == "" else -min(max(-odds, LEAST), MOST)
    if "" not in out:
        return dict(DEFAULT_SCORES)
    rank = few.mapInArrow(_overlaps(out, WORD_SCALES), "k int, f1 double").groupBy("k").agg(F.sum("f1").alias("f1")).collect()
    out[""] *= WORD_SCALES[max(rank, key=lambda r: (r["f1"], -r["k"]))["k"]]
    return out


def extract(pages: DataFrame, scores: dict[str, float], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, score, words, tokens) of every page."""
    own = small_batches(pages).select(col(page_id).alias("page_id"), col(url).alias("url"), col(html).cast("string").alias("html"))
    kind = own.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sums, words, sizes = [], [], [], []
            for page in batch.column(2).to_pylist():
                found = tokens(page or "")
                values = np.array([scores.get(name, DEFAULT_TAG) for name, _ in found])
                a, b = best_run(values)
                n = sum(1 for name, _ in found[a:b] if not name)
                texts.append(render(found[a:b]) if n else None)
                sums.append(round(float(values[a:b].sum()), 4))
                words.append(n)
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sums, pa.float64()), pa.array(words, pa.int32()), pa.array(sizes, pa.int32())], ["page_id", "url", "text", "score", "words", "tokens"])

    return own.mapInArrow(run, f"page_id {kind}, url string, text string, score double, words int, tokens int")


def labelled_pages(pages: DataFrame, docs: DataFrame, max_labelled_pages: int = MAX_LABELLED_PAGES) -> DataFrame:
    """At most that many pages (least hash of the id first) whose address ends in a document's number, with its text as their known content.

    The order is taken over ids alone; repeated rows of an id count once.
    """
    numbered = pages.select("page_id", F.expr("try_cast(regexp_extract(url, '/([0-9]+)(?:[./?#]|$)', 1) AS BIGINT)").alias("_doc")).where("_doc IS NOT NULL")
    few = cut(numbered.orderBy(F.xxhash64("page_id"), "page_id", "_doc").limit(max_labelled_pages).dropDuplicates(["page_id"]))
    texts = docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(few), "_doc")  # bounded by the sample
    marked = pages.select("page_id", "html").join(F.broadcast(few.select("page_id")), "page_id", "left_semi").dropDuplicates(["page_id"])
    return marked.join(texts.dropDuplicates(["page_id"]), "page_id").select("page_id", "html", "text")
