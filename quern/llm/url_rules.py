"""URL filters by a sort-merge range join (operator 3).

A URL's canonical key is its host with labels reversed, a dot after each, then
path and query: ``https://blog.example.com/en/7`` is ``com.example.blog./en/7``.
A rule is a prefix of keys: a host rule ``example.com`` covers the host and its
subdomains (``com.example.``), a rule with a path covers that host's paths that
begin so.  Prefixes are nested or disjoint intervals of the key order, so one
sweep over rules and URLs in key order keeps the active rules on a stack; its
top is the most specific rule.

Scale.  Range bounds come from a sample of rows (``SAMPLE_A_RANGE`` for each range),
so ranges have about equal numbers of rows; they decide where a row is judged,
not how.  A key with more rows than a range's share gets several ranges, over
which its rows are spread.  A rule goes to every range it meets, a URL to one.  Each range is a
partition of its own, sorted and swept in constant memory but for the stack.
Only narrow columns move.

Defined cases: NULL and unreadable URLs have key '' and meet no rule; URLs that
meet no rule are allowed; of rules with equal keys the least id counts; repeated
URLs get equal answers; NULL patterns are ignored; an empty rule table allows
everything; an empty page table gives no row; other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import col

SAMPLE_A_RANGE = 64
SEED = 3
_LAST = "\U0010ffff"

#: id, pattern, action of the filter list that the query applies.
RULES = [
    (1, "example.org", "block"),
    (2, "ththth.example.org", "allow"),
    (3, "blog.ththth.example.org", "block"),
    (4, "blog.ththth.example.org/fr/", "allow"),
    (5, "casino-win.example.net", "block"),
    (6, "tionsh.example.net/fr/", "block"),
    (7, "tionsh.example.net/fr/2", "allow"),
    (8, "https://WWW.tionsh.example.net:443/en/1", "block"),
    (9, "tionsh.example.net/en/1", "allow"),
    (10, "example.com", "allow"),
    (11, "m.tiontion.example.com", "block"),
    (12, "blog.tionble.example.com/en", "block"),
    (13, "blog.tionble.example.com/en/12", "allow"),
    (14, "nowhere.invalid", "block"),
]


def canonical_key(url: Column) -> Column:
    """Reversed-host key of a URL or rule pattern; scheme, user, port, 'www.' and fragment are dropped."""
    bare = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":[0-9]*$", "")
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), "[.]+$", "")
    rest = F.regexp_extract(bare, "^[^/?#]*([^#]*)", 1)
    labels = F.array_join(F.reverse(F.split(host, "[.]")), ".")
    return F.when(F.coalesce(host, F.lit("")) == "", F.lit("")).otherwise(F.concat(labels, F.lit("."), rest))


def _ranges(bounds: list[str], rules: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if not rules:
                at = []
                for k, h in zip(keys, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    low, high = bisect_left(bounds, k), bisect_right(bounds, k)
                    at.append(high if high - low < 2 else low + 1 + h % (high - low))  # between equal bounds lies that key alone
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns[:-1]], ["range", *batch.schema.names[:-1]])
                continue
            rows, at = [], []
            for i, k in enumerate(keys):
                low = bisect_left(bounds, k)
                for r in range(low + (bounds[low : low + 1] == [k]), bisect_left(bounds, k + _LAST) + 1):
                    rows.append(i)
                    at.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1])], ["range", *batch.schema.names[:-1]])

    return run


def sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(page row, top rule, depth) for each page among (key, is page, payload) in key order, rules first."""
    stack: list[tuple[str, object]] = []
    for key, is_page, payload in rows:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if is_page:
            yield payload, stack[-1][1] if stack else None, len(stack)
        elif not stack or stack[-1][0] != key:  # of equal rules the first has the least id
            stack.append((key, payload))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, int, str]] = []
    area = None
    for batch in batches:
        ranges, keys, pages = (batch.column(i).to_pylist() for i in (0, 1, 2))
        ids, rules, actions = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()
        out: list[tuple] = []
        for i, key in enumerate(keys):
            if ranges[i] != area:
                stack, area = [], ranges[i]
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if pages[i]:
                out.append((ids[i], key, *(stack[-1][1:] if stack else (None, "allow")), len(stack)))
            elif not stack or stack[-1][0] != key:
                stack.append((key, rules[i], actions[i]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(3).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int32())], ["page_id", "url_key", "rule_id", "action", "n_rules"])


def range_bounds(counts: list[tuple[str, int]], parts: int) -> list[str]:
    """Bounds of ``parts`` ranges of equal numbers of rows, from keys in order with their numbers; a key may be several bounds."""
    total = sum(n for _, n in counts)
    out, done = [], 0
    for key, n in counts:
        done += n
        out += [key] * (done * parts // total - len(out)) if total else []
    return out[: parts - 1]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_id long, pattern string, action string")


def apply_rules(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", partitions: int | None = None) -> DataFrame:
    """(page_id, url_key, rule_id, action, n_rules) of every page: the most specific rule and how many are nested there."""
    spark = pages.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pages.select(F.coalesce(canonical_key(col(url).cast("string")), F.lit("")).alias("key"), F.lit(True).alias("page"), col(page_id).alias("page_id"), F.lit(None).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("action"), F.pmod(F.xxhash64(col(page_id)), F.lit(1 << 31)).alias("spread"))
    kind = keyed.schema["page_id"].dataType.simpleString()
    wanted = rules.select(canonical_key(F.col("pattern")).alias("key"), F.lit(False).alias("page"), F.lit(None).cast(kind).alias("page_id"), F.col("rule_id").cast("long").alias("rule_id"), F.col("action").cast("string").alias("action"), F.lit(0).cast("long").alias("spread")).where("key IS NOT NULL AND key <> ''")
    share = min(1.0, SAMPLE_A_RANGE * parts / max(1, pages.count()))
    few = keyed.select("key").where(F.rand(SEED) < share) if share < 1 else keyed.select("key")
    counts = sorted((r["key"], r["n"]) for r in few.groupBy("key").agg(F.count("*").alias("n")).collect())  # about SAMPLE_A_RANGE rows a range
    bounds = range_bounds(counts, parts)
    schema = f"range int, key string, page boolean, page_id {kind}, rule_id long, action string"
    both = keyed.mapInArrow(_ranges(bounds, False), schema).unionByName(wanted.mapInArrow(_ranges(bounds, True), schema))
    ready = both.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "key", "page", "rule_id")
    return ready.mapInArrow(_sweep, f"page_id {kind}, url_key string, rule_id long, action string, n_rules int")


def _sql_key(x: str) -> str:
    bare = f"regexp_replace(trim({x}), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"lower(regexp_extract({bare}, '^([^/?#]*)', 1))"
    for pattern in ("^[^@]*@", ":[0-9]*$", "^www[.]", "[.]+$"):
        host = f"regexp_replace({host}, '{pattern}', '')"
    rest = f"regexp_extract({bare}, '^[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN coalesce({host}, '') = '' THEN '' ELSE array_to_string(list_reverse(string_split({host}, '.')), '.') || '.' || {rest} END"


ORACLE = f"""
WITH rules(rule_id, pattern, action) AS (VALUES {", ".join(f"({i}, '{p}', '{a}')" for i, p, a in RULES)}),
r AS (SELECT CAST(MIN(rule_id) AS BIGINT) AS rule_id, key, arg_min(action, rule_id) AS action FROM (SELECT *, {_sql_key("pattern")} AS key FROM rules) GROUP BY key),
p AS (SELECT page_id, coalesce({_sql_key("url")}, '') AS url_key FROM pages)
SELECT page_id, url_key, arg_max(r.rule_id, length(r.key)) AS rule_id, coalesce(arg_max(r.action, length(r.key)), 'allow') AS action, CAST(COUNT(r.rule_id) AS INTEGER) AS n_rules
FROM p LEFT JOIN r ON starts_with(p.url_key, r.key) GROUP BY page_id, url_key
"""
