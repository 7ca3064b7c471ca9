"""Writes, caches and streams, as two-batch runs over the events of two periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import state
from quern.plans.registry import query, table
from quern.streaming import events as streams

SPLIT = "2024-01-15"
TWO = f"a AS (SELECT user_id, event_type, COUNT(*) AS hits, MIN(ts) AS first_seen, MAX(ts) AS last_seen FROM events WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY ALL), b AS (SELECT user_id, event_type, COUNT(*) AS hits, MIN(ts) AS first_seen, MAX(ts) AS last_seen FROM events WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY ALL)"
KEYS = ["user_id", "event_type"]


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    cut = F.lit(SPLIT).cast("timestamp")
    group = lambda d: d.groupBy(*KEYS).agg(F.count("*").alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return group(e.where(F.col("ts") < cut)), group(e.where(F.col("ts") >= cut))


@query(f"WITH {TWO} SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(b.hits, a.hits) AS hits, coalesce(a.first_seen, b.first_seen) AS first_seen, coalesce(b.last_seen, a.last_seen) AS last_seen FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def upsert_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01."""
    a, b = _two(spark, sf_dir)
    return state.upsert(a, b, KEYS, ["hits", "last_seen"])


@query(f"WITH {TWO} SELECT * FROM a UNION ALL SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type)")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: the second batch is appended twice and changes nothing the second time."""
    a, b = _two(spark, sf_dir)
    once = a.unionByName(state.append_new(a, b, KEYS))
    return once.unionByName(state.append_new(once, b, KEYS))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, MAX(ts) AS seen FROM events GROUP BY 1),
x AS (SELECT *, seen + INTERVAL 1 HOUR * CASE status WHEN 'purchase' THEN 336 WHEN 'error' THEN 1 ELSE 48 END AS expires_at FROM l)
SELECT user_id, status, expires_at FROM x WHERE expires_at > TIMESTAMP '2024-01-30'""")
def ttl_cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, FIL-13: latest entry of a key, lifetime by status, live ones only."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"), F.col("ts").alias("at"))
    last = e.groupBy("user_id").agg(F.max_by(F.struct("status", "at"), F.struct("at", "event_id")).alias("r")).select("user_id", "r.*")
    cached = last.withColumn("expires_at", state.expires_at(F.col("at"), F.col("status"), {"purchase": 336, "error": 1}, 48))
    return state.unexpired(cached, F.lit("2024-01-30").cast("timestamp")).select("user_id", "status", "expires_at")


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), f AS (SELECT l_orderkey, l_linenumber + 100 AS l_linenumber, l_quantity * 2 AS l_quantity FROM lineitem WHERE l_orderkey % 10 = 0)
SELECT * FROM c WHERE l_orderkey NOT IN (SELECT l_orderkey FROM f) UNION ALL SELECT * FROM f""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    f = c.where("l_orderkey % 10 = 0").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"), (F.col("l_quantity") * 2).alias("l_quantity"))
    return state.replace_children(c, f, ["l_orderkey"])


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id // 3 END AS callback FROM events)
SELECT MIN(event_id) AS event_id, callback FROM e WHERE callback IS NOT NULL GROUP BY callback UNION ALL SELECT event_id, callback FROM e WHERE callback IS NULL""")
def exactly_once_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: unique callbacks, with NULL ones left alone."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.floor(F.col("event_id") / 3).cast("long")).alias("callback"))
    known = e.where("callback IS NOT NULL").groupBy("callback").agg(F.min("event_id").alias("event_id")).select("event_id", "callback")
    return state.dedup_nullable(known.unionByName(e.where("callback IS NULL")), "callback")


@query("""SELECT user_id, event_type, COUNT(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream deduplication, run over what is there."""
    out = streams.run_available(streams.first_seen(streams.read_events(spark, sf_dir), KEYS).select(*KEYS))
    return out.groupBy(*KEYS).agg(F.count("*").alias("n"))


@query("""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS spent FROM events GROUP BY ALL""")
def stream_daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream of daily windows in complete mode, which keeps the days inside the watermark too."""
    out = streams.run_available(streams.daily(streams.read_events(spark, sf_dir)), "complete")
    return out


@query()
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuit breaker with keyed state over the stream."""
    e = streams.read_events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")
    return streams.run_available(streams.breaker(e))


@query("""SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 06:00:00' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '2024-01-20 06:00:00' OR ts = TIMESTAMP '2024-01-20 00:00:00'""")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-09, late data: events of the last six hours give a notice, each once."""
    return streams.run_available(streams.alerts(streams.read_events(spark, sf_dir).select("event_id", "ts"), "2024-01-20 06:00:00"))
