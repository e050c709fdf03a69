"""Jobs that are charged before their segments go out, as a stream with state and as a batch.

A job is segmented and its words counted, then charged against its user's balance; only then are its segments published. A job without a
text fails and is free, as does one that costs more than is left. A job that comes again, in whatever batch, was settled before and is ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions import text as X
from corpusloom.operators import curate, metering
from corpusloom.streaming import jobs

#: Money is held as whole numbers of this part of a unit.
UNIT = 10_000
#: Strategies with a rule of their own; any other takes the text as one segment.
STRATEGIES = ("sentence", "paragraph", "auto")
#: How long a settled job is known, so that its repetition is ignored.
KEEP_MS = 30 * 24 * 3600 * 1000
STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def words_in(strategy: str) -> Column:
    """Words of the segments of a text."""
    return F.aggregate(X.segments("text", strategy), F.lit(0).cast("long"), lambda n, s: n + X.word_count(s))


def priced(work: DataFrame, rates: DataFrame, default: str = "0.001") -> DataFrame:
    """Jobs (job_id, user_id, text, strategy, model_name, ts) with tokens and cost, 0 for jobs without a text."""
    tokens = words_in("")
    for s in STRATEGIES:
        tokens = F.when(F.col("strategy") == s, words_in(s)).otherwise(tokens)
    counted = work.withColumn("tokens", F.coalesce(tokens, F.lit(0).cast("long")))
    return metering.charged(counted, rates, "model_name", "tokens", default).withColumnRenamed("charge", "cost").drop("rate")


def verdict(accepted: Column) -> dict[str, Column]:
    empty = F.col("tokens") == 0
    return {
        "status": F.when(empty | ~accepted, "failed").otherwise("completed"),
        "reason": F.when(empty, "no text").when(~accepted, "insufficient credits"),
        "cost": F.when(empty | ~accepted, F.lit(0).cast(metering.MONEY)).otherwise(F.col("cost")),
    }


SETTLED = ["user_id", "job_id", "ts", "status", "reason", "tokens", "cost", "balance", "text", "strategy"]


def settled(work: DataFrame, rates: DataFrame, balances: DataFrame, default: str = "0.001") -> DataFrame:
    """SETTLED for each job of a batch, in order of time; a repeated job counts once, at its first time."""
    first = curate.keep_first(work, ["user_id", "job_id"], ["ts", "text"])
    rows = priced(first, rates, default)
    done = metering.sequential_charge(rows.select("user_id", "job_id", F.col("ts").alias("ord"), "cost"), balances)
    rows = rows.join(done.select("user_id", "job_id", "accepted", "balance"), ["user_id", "job_id"])
    return rows.withColumns(verdict(F.col("accepted"))).select(SETTLED)


def segments_of(done: DataFrame) -> DataFrame:
    """Segments of the completed jobs only."""
    return jobs.segmented(done.where("status = 'completed'"), STRATEGIES)


class Settlement(StatefulProcessor):
    """A user's balance, and the jobs that are settled with the time until which they are known.

    With timers jobs are forgotten when that time has come, without them when their user's next jobs come after it.
    """

    def __init__(self, start: int, keep: int, timers: bool):
        self.start, self.keep, self.timers = start, keep, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "units long")
        self.known = handle.getMapState("known", "job_id long", "until long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.left.update((int(initialState["units"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left = self.left.get()[0] if self.left.exists() else self.start
        work = pd.concat(list(rows)).sort_values(["ts", "job_id"]).drop_duplicates("job_id")  # one user's jobs of one micro-batch
        now = timerValues.getCurrentProcessingTimeInMs() if self.timers else int(time.time() * 1000)
        if not self.timers:
            self.forget(now)
        until = now + self.keep
        kept, accepted, after = [], [], []
        for at, (job, cost) in enumerate(zip(work["job_id"].tolist(), work["units"].tolist(), strict=True)):
            if self.known.containsKey((job,)):
                continue
            self.known.updateValue((job,), (until,))
            kept.append(at)
            accepted.append(cost <= left)
            left -= cost if accepted[-1] else 0
            after.append(left)
        self.left.update((left,))
        if kept:
            if self.timers:
                self.handle.registerTimer(until)
            yield work.iloc[kept].assign(user_id=key[0], accepted=accepted, left=after)[COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget(expiredTimerInfo.getExpiryTimeInMs())
        return iter([])

    def forget(self, now: int) -> None:
        for job, until in [(k[0], v[0]) for k, v in self.known.iterator()]:
            if until <= now:
                self.known.removeKey((job,))

    def close(self) -> None:
        pass


COLUMNS = ["user_id", "job_id", "ts", "tokens", "units", "text", "strategy", "accepted", "left"]


def units(money: Column) -> Column:
    return (money.cast(metering.MONEY) * UNIT).cast("long")


def money(whole: Column) -> Column:
    return (whole.cast("decimal(20,0)") / UNIT).cast(metering.MONEY)


def settled_stream(work: DataFrame, rates: DataFrame, balances: DataFrame | None = None, start: str = "1000", default: str = "0.001", keep: int = KEEP_MS, timers: bool = False) -> DataFrame:
    """SETTLED as a stream: each job once, whenever it comes. Users without a balance (user_id, balance) have start.

    A balance depends on all jobs before, so a user's jobs of a micro-batch are one task's work and cannot be salted. With timers
    there is always another batch to come, so a stream that is to end with its input goes without them.
    """
    work.sparkSession.conf.set(STATE, ROCKSDB)  # the state of this operator needs it
    rows = priced(work, rates, default).withColumn("units", units(F.col("cost"))).drop("cost")
    first = None if balances is None else balances.select("user_id", units(F.col("balance")).alias("units")).groupBy("user_id")
    schema = "user_id long, job_id long, ts timestamp, tokens long, units long, text string, strategy string, accepted boolean, left long"
    start_units = int(round(float(start) * UNIT))
    done = rows.groupBy("user_id").transformWithStateInPandas(Settlement(start_units, keep, timers), schema, "append", "ProcessingTime" if timers else "None", first)
    return done.withColumns({"cost": money(F.col("units")), "balance": money(F.col("left"))}).withColumns(verdict(F.col("accepted"))).select(SETTLED)


def run(work: DataFrame, rates: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, balances: DataFrame | None = None, every: str | None = None, **options):
    """Settle a stream of jobs and append verdicts, events and the scored segments of completed jobs below out, until its input ends;
    with every (as "10 seconds") for good, with timers.

    A batch is written under its number, so one that is repeated after a failure replaces itself; its state is that of the batch before.
    """

    def batch(done: DataFrame, number: int) -> None:
        done = done.persist()  # it is written three times
        try:
            score(segments_of(done)).write.mode("overwrite").parquet(f"{out}/segments/batch={number}")
            done.drop("text", "strategy").write.mode("overwrite").parquet(f"{out}/states/batch={number}")
            jobs.progress_events(done).write.mode("overwrite").text(f"{out}/events/batch={number}")
        finally:
            done.unpersist()

    stream = settled_stream(work, rates, balances, timers=every is not None, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def balances_of(spark: SparkSession, out: str) -> DataFrame:
    """user_id, balance after the last settled job."""
    rows = spark.read.parquet(f"{out}/states")
    return rows.groupBy("user_id").agg(F.min("balance").alias("balance"))  # it only falls
