"""Structured calls to an outside model as recorded rows (SRC-31..33, SUP-14..19, MTH-07).

A call must not be repeated by a retried task, so it runs at the edge: requests
are rows, answers are a table keyed by fingerprint, and plans only join the two.
``run_calls`` is the edge: it asks once for each fingerprint without an answer
and appends what came back before anything reads it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import numeric
from quern.functions.text import scrub
from quern.operators import state

ANSWER = "fingerprint string, requested_model string, answered_model string, body string, input_tokens int, cached_tokens int, output_tokens int, status string, at timestamp"


@lru_cache(maxsize=64)
def load_prompt(folder: str, name: str, version: str) -> tuple[str, str]:
    """(system text, JSON schema) of a versioned prompt folder, read once a process."""
    base = Path(folder) / name / version
    return (base / "system.md").read_text(encoding="utf-8"), (base / "schema.json").read_text(encoding="utf-8")


def clear_caches() -> None:
    """Forgets the prompts read so far (SUP-29)."""
    load_prompt.cache_clear()


def prompt_label(name: str, version: str) -> str:
    """Name of a prompt for logs and keys (SUP-19)."""
    return f"{name}-{version}"


def user_message(task: str, payload: dict) -> str:
    """Task text and the payload behind it, its keys in order (SUP-19)."""
    return task + json.dumps(payload, ensure_ascii=False, sort_keys=True)


def requests(listings: DataFrame, model: str, version: str) -> DataFrame:
    """(fingerprint, requested_model, payload): scrubbed payloads, one for equal content (AG-26, PRJ-05, STR-06)."""
    payload = F.to_json(F.struct(scrub(F.col("title"), 300).alias("title"), scrub(F.col("description"), 4000).alias("description"), F.col("price_czk")))
    return listings.select(F.sha2(F.concat_ws("\x1e", payload, F.lit(model), F.lit(version)), 256).alias("fingerprint"), F.lit(model).alias("requested_model"), payload.alias("payload")).dropDuplicates(["fingerprint"])


def run_calls(wanted: DataFrame, answers: state.Snapshots, ask: Callable[[str], dict], most: int) -> int:
    """Asks for at most ``most`` fingerprints without an answer and stores what comes; errors are answers too.

    The cap is the cycle's budget (TK-08); what it leaves is asked next time.
    """
    spark = wanted.sparkSession
    known = answers.read()
    open_ = wanted if known is None else wanted.join(known.where("status = 'AI_OK'").select("fingerprint"), "fingerprint", "left_anti")
    rows = []
    for r in open_.orderBy("fingerprint").limit(most).collect():
        try:
            a = ask(r["payload"])
            rows.append((r["fingerprint"], r["requested_model"], a.get("model"), json.dumps(a.get("body")), a.get("input_tokens", 0), a.get("cached_tokens", 0), a.get("output_tokens", 0), a.get("status", "AI_OK")))
        except Exception as e:  # the row carries the failure, the batch goes on
            rows.append((r["fingerprint"], r["requested_model"], None, json.dumps({"error": str(e)[:300]}), 0, 0, 0, "AI_FAILED"))
    if rows:
        fresh = spark.createDataFrame(rows, ANSWER.rsplit(",", 1)[0]).withColumn("at", F.current_timestamp())
        answers.write(fresh if known is None else state.latest(known.unionByName(fresh), ["fingerprint"], "at"))
    return len(rows)


def _enum(x: Column, allowed: list[str]) -> Column:
    return F.when(F.lower(x).isin(allowed), F.lower(x)).otherwise("unknown")


def _confidence(x: Column) -> Column:
    return F.coalesce(numeric.clamp(x, 0.0, 1.0), F.lit(0.0))


PAYLOAD = """classification STRUCT<is_bicycle: BOOLEAN, listing_type: STRING, confidence: DOUBLE>, identity STRUCT<brand: STRING, model: STRING, confidence: DOUBLE>,
condition STRUCT<claimed_condition: STRING, facts: ARRAY<STRING>>, risk STRUCT<flags: ARRAY<STRING>, severity: STRING>, evidence ARRAY<STRUCT<field: STRING, excerpt: STRING>>"""
FIELDS = ["classification", "identity", "condition", "risk"]


def validated(answers: DataFrame) -> DataFrame:
    """Coerced answers (SCR-27, SUP-17): unknown keys dropped, enums and confidences held, a missing block makes an error row."""
    p = F.from_json("body", PAYLOAD)
    x = answers.withColumn("p", p)
    missing = F.filter(F.array(*[F.when(F.col(f"p.{f}").isNull(), F.lit(f)) for f in FIELDS]), lambda f: f.isNotNull())
    evidence = F.slice(F.filter(F.coalesce("p.evidence", F.array().cast("array<struct<field:string,excerpt:string>>")), lambda e: (F.coalesce(e["excerpt"], F.lit("")) != "") & e["field"].isin(FIELDS)), 1, 12)
    status = F.when(F.col("status") != "AI_OK", F.col("status")).when(F.size(missing) > 0, "AI_FAILED").otherwise("AI_OK")
    sure = _confidence(F.col("p.identity.confidence"))
    return x.select(
        "fingerprint", status.alias("status"), F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).otherwise("").alias("error"),
        F.col("p.classification.is_bicycle").alias("is_bicycle"), _enum(F.col("p.classification.listing_type"), ["bicycle", "frame", "part", "accessory", "clothing", "other"]).alias("listing_type"), _confidence(F.col("p.classification.confidence")).alias("confidence"),
        F.when(sure >= 0.5, F.col("p.identity.brand")).alias("brand"), F.when(sure >= 0.5, F.col("p.identity.model")).alias("model"),
        F.array_distinct(F.coalesce("p.risk.flags", F.array().cast("array<string>"))).alias("risk_flags"), _enum(F.col("p.risk.severity"), ["none", "info", "low", "medium", "high", "blocking"]).alias("severity"), evidence.alias("evidence"),
    )


def call_costs(answers: DataFrame, rates: tuple[float, float, float]) -> DataFrame:
    """(day, calls, spent): cost of the calls by UTC day (AG-14)."""
    cost = numeric.token_cost(F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens"), rates)
    return answers.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("calls"), F.sum(cost).alias("spent"))


def non_bicycle(x: DataFrame, live: bool = True) -> Column:
    """FIL-11: sure enough that it is none, of a type that can be told, with the layer live."""
    return F.lit(live) & (x["status"] == "AI_OK") & ~F.coalesce(x["is_bicycle"], F.lit(True)) & x["listing_type"].isin("frame", "part", "accessory", "clothing") & (x["confidence"] >= 0.75)
