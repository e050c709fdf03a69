"""Jobs as streams: states, usage windows, distinct annotations and charges against balances."""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions import text as X

JOB = "job_id long, user_id long, text string, strategy string, ts timestamp"


def segmented(jobs: DataFrame, strategies: tuple[str, ...] = ("sentence", "paragraph", "auto")) -> DataFrame:
    """job_id, user_id, segment_index, text, start, end, ts of each segment."""
    found = X.segment_offsets("text", "full_text")
    for s in strategies:
        found = F.when(F.col("strategy") == s, X.segment_offsets("text", s)).otherwise(found)
    rows = jobs.select("job_id", "user_id", "ts", F.posexplode(found).alias("segment_index", "s"))
    return rows.select("job_id", "user_id", "ts", "segment_index", F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def run_jobs(jobs: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Segment and score each micro-batch of free jobs and append segments and job states below out (settling.run charges first).

    Each job's states also go out as events, one JSON object a line. A batch is written under its number, so a batch that is
    repeated after a failure replaces itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # it is written three times
        try:
            score(segmented(rows)).write.mode("overwrite").parquet(f"{out}/segments/batch={number}")
            states = rows.select("job_id", "user_id", "ts", F.when(F.length(X.clean("text")) > 0, "completed").otherwise("failed").alias("status"))
            states.write.mode("overwrite").parquet(f"{out}/states/batch={number}")
            progress_events(states).write.mode("overwrite").text(f"{out}/events/batch={number}")
        finally:
            rows.unpersist()

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(spark: SparkSession, out: str) -> DataFrame:
    states = spark.read.parquet(f"{out}/states")
    return states.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def progress_events(states: DataFrame) -> DataFrame:
    """value: a JSON object for each step of a job (job_id, status): queued, processing, and how it ended."""
    steps = F.array(F.lit("queued"), F.lit("processing"), F.col("status"))
    rows = states.select("job_id", F.posexplode(steps).alias("step", "status"))
    done = F.when(F.col("status") == "queued", 0).when(F.col("status") == "processing", 50).otherwise(100)
    return rows.select(F.to_json(F.struct("job_id", "step", "status", done.alias("progress"))).alias("value"))


def usage_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total for each window; batch or stream. With slide a window begins that often, else when the last one ends."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def usage_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n of each session: events of a user that follow one another within the gap; batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_annotations(annotations: DataFrame, late: str = "1 day") -> DataFrame:
    """One annotation for each segment and user."""
    if annotations.isStreaming:
        return annotations.withWatermark("ts", late).dropDuplicatesWithinWatermark(["segment_id", "user_id"])
    return annotations.dropDuplicates(["segment_id", "user_id"])


def charged(jobs: DataFrame, start: str = "1000") -> DataFrame:
    """user_id, job_id, accepted, balance: jobs (user_id, job_id, cost, ts) against each user's balance, kept as state.

    Within a micro-batch a user's jobs go in order of time; a job that costs more than the balance is free and rejected. A
    balance depends on all jobs before, so one user's jobs of a micro-batch are one task's work and cannot be salted.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left = decimal.Decimal(state.get[0]) if state.exists else decimal.Decimal(start)
        rows = pd.concat(list(frames)).sort_values(["ts", "job_id"])  # one user's jobs of one micro-batch
        accepted, after = [], []
        for cost in rows["cost"]:
            accepted.append(cost <= left)
            left -= cost if accepted[-1] else 0
            after.append(str(left))
        state.update((str(left),))
        yield pd.DataFrame({"user_id": key[0], "job_id": rows["job_id"], "accepted": accepted, "balance": after})

    return jobs.groupBy("user_id").applyInPandasWithState(step, "user_id long, job_id long, accepted boolean, balance string", "balance string", "append", GroupStateTimeout.NoTimeout)
