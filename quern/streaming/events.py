"""Structured Streaming counterparts of the polling loop.

Sinks are ``foreachBatch`` writes to a folder named by the batch, so a batch that
is run again replaces its own output: exactly once for readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ensure_checkpoint_dir


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def run_every(stream: DataFrame, folder: str, seconds: int, mode: str = "append"):
    """The running query of a stream that is looked at every ``seconds``; stop it with ``stop()``.  Output and state lie in ``folder``."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(processingTime=f"{seconds} seconds").start()


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote; state and output lie in the shared folder."""
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out/batch=*")


def first_seen(events: DataFrame, keys: list[str], lateness: str = "40 days") -> DataFrame:
    """First arrival of each key within the watermark (dedup state)."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def daily(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Tumbling UTC days: calls and spend."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("spent")).select(F.to_date("window.start").alias("day"), "event_type", "n", "spent")


def sliding_calls(events: DataFrame, size: str = "24 hours", step: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Sliding windows that approximate a rolling limit."""
    w = events.withWatermark("ts", lateness).groupBy("user_id", F.window("ts", size, step))
    return w.agg(F.count("*").alias("calls")).select("user_id", F.col("window.end").alias("until"), "calls")


def alerts(events: DataFrame, now: str, most_hours: float = 6.0) -> DataFrame:
    """Events young enough for a notice: what comes later than the watermark or is older by ``now`` gives none."""
    age = (F.lit(now).cast("timestamp").cast("double") - F.col("ts").cast("double")) / 3600
    return events.withWatermark("ts", f"{int(most_hours * 3600)} seconds").dropDuplicatesWithinWatermark(["event_id"]).where(age.between(0, most_hours))


def run_isolated(streams: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(results, errors) by source: every source is a query of its own, so one that fails stops nothing but itself."""
    done, errors = {}, {}
    for name, stream in streams.items():
        try:
            done[name] = run_available(stream)
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
    if errors and not done:
        raise RuntimeError("every source failed: " + "; ".join(f"{k}: {v}" for k, v in errors.items()))
    return done, errors


def breaker(events: DataFrame, limit: int = 3, open_minutes: int = 30, forget_minutes: int = 60 * 24 * 40, lateness: str = "40 days") -> DataFrame:
    """Consecutive errors by key with a breaker that opens for a time (keyed state).

    State is (errors in a row, open until); rows of a batch are taken in event time.
    The state of a key that stays silent for ``forget_minutes`` of event time is dropped.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        count, until = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for ts, event_id, kind in zip(rows["ts"], rows["event_id"], rows["event_type"], strict=True):
            now = int(ts.timestamp())
            refused = now < until
            if not refused:
                count = count + 1 if kind == "error" else 0
                if count >= limit:
                    until = now + 60 * open_minutes
            out.append((int(key[0]), int(event_id), int(count), bool(refused)))
        state.update((int(count), int(until)))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 60_000 * forget_minutes)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "errors_in_a_row", "refused"])

    own = events.withWatermark("ts", lateness).groupBy("user_id")
    return own.applyInPandasWithState(step, "user_id long, event_id long, errors_in_a_row long, refused boolean", "errors long, until long", "append", GroupStateTimeout.EventTimeTimeout)
