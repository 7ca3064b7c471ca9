"""Mixing sources to target weights by Poisson replication (operator 10).

A source's rate is its target share of the corpus over its present share.  Each
document draws its number of copies by inverting the Poisson distribution with
that mean at a uniform number hashed from seed and id, is exploded by the
count, and all copies are spread over the cluster in the order of another hash.
The draw depends on nothing but seed, id and rate, so a retried task repeats it.

Scale.  One partial aggregation over two narrow columns gives the sizes; the
inverse tables are a few numbers a source and are broadcast only up to
``max_broadcast_sources`` sources, beyond which they are joined by shuffle.
The text moves once, in the global shuffle.

Defined cases: a NULL source is a source of its own; a NULL size counts 0, and a
source of total size 0 keeps rate 1; a NULL id draws by the text's hash; rows
that repeat an id draw the same number; sources without a given weight get none
(rate 0); an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import col, free_name

SEED = "mix-1"
TEMPERATURE = 0.5
MAX_BROADCAST_SOURCES = 50_000


def target_rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", size: str = "n_chars", temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): target share over present share; ``weights`` is (source, weight), else size ** temperature."""
    sizes = docs.groupBy(col(source).cast("string").alias("source")).agg(F.sum(F.coalesce(col(size), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        aimed = sizes.withColumn("weight", F.pow("size", F.lit(float(temperature))))
    else:
        w = weights.select(F.col("source").alias("_w"), F.col("weight").cast("double").alias("weight"))
        aimed = sizes.join(w, sizes["source"].eqNullSafe(w["_w"]), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = aimed.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    share = F.try_divide(F.col("weight") * F.col("all_size"), F.col("all_weight") * F.col("size"))
    return aimed.crossJoin(F.broadcast(total)).select("source", F.when(F.col("size") > 0, F.coalesce(share, F.lit(0.0))).otherwise(1.0).alias("rate"))


def inverse_tables(rates: DataFrame) -> DataFrame:
    """(source, rate, steps): cumulative Poisson probabilities for 0, 1, 2, ... up to 12 deviations above the mean.

    Terms are taken from logarithms, so a large rate doesn't underflow.
    """
    most = (F.ceil(F.col("rate") + 12 * F.sqrt("rate")) + 20).cast("int")
    rows = rates.withColumn("k", F.explode(F.sequence(F.lit(0), most)))
    w = W.partitionBy("source").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    log_fact = F.sum(F.when(F.col("k") > 0, F.ln(F.col("k").cast("double"))).otherwise(0.0)).over(w)
    log_p = F.when(F.col("rate") > 0, F.col("k") * F.ln("rate") - F.col("rate") - F.col("log_fact"))
    rows = rows.withColumn("log_fact", log_fact).withColumn("p", F.when(F.col("rate") > 0, F.exp(log_p)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0)))
    rows = rows.withColumn("cdf", F.sum("p").over(w))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda s: s["cdf"])
    return rows.groupBy("source").agg(F.first("rate").alias("rate"), steps.alias("steps"))


def _uniform(text):
    """Uniform number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text", size: str = "n_chars", seed: str = SEED, temperature: float = TEMPERATURE, max_broadcast_sources: int = MAX_BROADCAST_SOURCES, detail: bool = False) -> DataFrame:
    """Every document as often as its draw says, in hashed order; ``detail`` adds copy number and shuffle key."""
    tables = inverse_tables(target_rates(docs, weights, source, size, temperature)).select(F.col("source").alias("_src"), F.col("steps").alias("_steps"))
    few = docs.select(col(source)).distinct().limit(max_broadcast_sources + 1).count() <= max_broadcast_sources
    steps, key, copy, order = (free_name(docs, n) for n in ("_steps_of", "_draw_key", "replica", "shuffle_key"))
    tables = tables.select(F.col("_src").alias(steps + "_s"), F.col("_steps").alias(steps))
    joined = docs.join(F.broadcast(tables) if few else tables, col(source).cast("string").eqNullSafe(F.col(steps + "_s")), "left")
    drawn = joined.withColumn(key, F.concat_ws(":", F.lit(seed), F.coalesce(col(doc_id).cast("string"), F.md5(col(text).cast("binary")), F.lit(""))))
    u = _uniform(F.col(key))
    n = F.size(F.filter(F.col(steps), lambda c: c <= u))
    out = drawn.withColumn(copy, F.explode(F.when(n > 0, F.sequence(F.lit(1), n))))
    out = out.withColumn(order, F.md5(F.concat_ws(":", F.col(key), F.col(copy).cast("string")).cast("binary")))
    out = out.repartition(F.col(order)).sortWithinPartitions(F.col(order))
    return out.select(*(col(c) for c in docs.columns), *((F.col(copy), F.col(order)) if detail else ()))


ORACLE = """
WITH sizes AS (SELECT source, CAST(SUM(COALESCE(n_chars, 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
aimed AS (SELECT source, size, POWER(size, 0.5) AS weight FROM sizes),
total AS (SELECT SUM(size) AS all_size, SUM(CASE WHEN size > 0 THEN weight END) AS all_weight FROM aimed),
rates AS (SELECT source, CASE WHEN size > 0 THEN weight * all_size / (all_weight * size) ELSE 1.0 END AS rate FROM aimed, total),
terms AS (SELECT source, rate, k FROM rates, LATERAL (SELECT UNNEST(range(0, CAST(CEIL(rate + 12 * SQRT(rate)) AS BIGINT) + 21)) AS k)),
facts AS (SELECT *, SUM(CASE WHEN k > 0 THEN LN(CAST(k AS DOUBLE)) ELSE 0.0 END) OVER (PARTITION BY source ORDER BY k) AS log_fact FROM terms),
cdfs AS (SELECT source, k, SUM(EXP(k * LN(rate) - rate - log_fact)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM facts),
draws AS (SELECT d.*, CAST('0x' || SUBSTR(MD5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT doc_id, text, lang, d.source, n_chars, (SELECT COUNT(*) FROM cdfs c WHERE c.source = d.source AND c.cdf <= d.u) AS n FROM draws d)
SELECT doc_id, text, lang, source, n_chars, CAST(replica AS INTEGER) AS replica, MD5('mix-1:' || CAST(doc_id AS VARCHAR) || ':' || CAST(replica AS VARCHAR)) AS shuffle_key
FROM counted, LATERAL (SELECT UNNEST(range(1, CAST(n AS BIGINT) + 1)) AS replica)
"""
