"""Charged jobs: a stream that stops, restarts and repeats gives what a batch gives."""

import json
import os
import time

from corpusloom.streaming import settling
from pyspark.sql import functions as F

SCHEMA = "job_id long, user_id long, text string, strategy string, model_name string, ts timestamp"


def work(spark):
    rows = [(k, k % 3, " ".join(["w"] * (k % 7)) + ("." if k % 2 else "") + " b. c", ["sentence", "auto", "paragraph", "x"][k % 4], "m" if k % 2 else "other", 1000 + k) for k in range(60)]
    rows += [(70, 1, None, "auto", "m", 2000), (71, 2, " \n", "sentence", "m", 2001), (72, 9, "a b c", "auto", None, 2002)]
    df = spark.createDataFrame(rows, "job_id long, user_id long, text string, strategy string, model_name string, s long")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_settled_jobs_are_forgotten_by_timers(spark, tmp_path):
    rates, source = spark.createDataFrame([], "model_name string, rate string"), str(tmp_path / "in")
    job = spark.createDataFrame([(1, 1, "a b", "x", "m")], "job_id long, user_id long, text string, strategy string, model_name string").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    job.coalesce(1).write.mode("append").parquet(source)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    states = lambda: spark.read.parquet(f"{out}/states").count() if os.path.exists(f"{out}/states") else 0
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    held = settling.run(stream, rates, lambda d: d, out, check, every="1 second", default="1", keep=1000)
    try:
        until = time.time() + 90
        while time.time() < until and (states() < 1 or held.lastProgress["batchId"] < 3):
            time.sleep(1)
        assert states() == 1
        job.coalesce(1).write.mode("append").parquet(source)
        while time.time() < until and states() < 2:
            time.sleep(1)
    finally:
        held.stop()
    assert states() == 2  # it was forgotten, so it is a new one


def test_stream_equals_batch(spark, tmp_path):
    rows = work(spark)
    rates = spark.createDataFrame([("m", "0.5")], "model_name string, rate string")
    balances = spark.createDataFrame([(0, "20"), (1, "12.5"), (2, "7")], "user_id long, balance string")
    want = settling.settled(rows, rates, balances.unionByName(spark.createDataFrame([(9, "3")], "user_id long, balance string")), default="0.25").collect()
    assert {r.status for r in want} == {"completed", "failed"} and {r.reason for r in want} == {None, "no text", "insufficient credits"}
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    score = lambda d: d.withColumn("predicted_language", F.lit("x"))

    def feed(frame):
        frame.coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        held = settling.run(stream, rates, score, out, check, balances, start="3", default="0.25")
        held.awaitTermination(240)
        assert held.exception() is None

    def found():
        states = spark.read.parquet(f"{out}/states").drop("batch").collect()
        return sorted(tuple(map(str, (r.user_id, r.job_id, r.status, r.reason, r.tokens, r.cost, r.balance))) for r in states)

    feed(rows.where("job_id < 30"))
    go()
    feed(rows.where("job_id < 45 and job_id >= 20"))  # some come again
    feed(rows.where("job_id >= 45"))
    go()
    expected = sorted(tuple(map(str, (r.user_id, r.job_id, r.status, r.reason, r.tokens, r.cost, r.balance))) for r in want)
    assert found() == expected
    segments = spark.read.parquet(f"{out}/segments").groupBy("job_id").count().collect()
    assert {r.job_id for r in segments} == {r.job_id for r in want if r.status == "completed"}
    # the last batch fails after its writes and is repeated
    last = max(int(x) for x in os.listdir(f"{check}/commits") if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{check}/commits/{name}"):
            os.remove(f"{check}/commits/{name}")
    go()
    assert found() == expected
    events = [json.loads(r.value) for r in spark.read.text(f"{out}/events").collect()]
    assert len(events) == 3 * len(want)
    assert {r.user_id: float(r.balance) for r in settling.balances_of(spark, out).collect()} == {u: min(float(r.balance) for r in want if r.user_id == u) for u in (0, 1, 2, 9)}
