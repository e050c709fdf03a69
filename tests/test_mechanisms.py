"""Data source, table functions, scans that stop, counts of a job."""

import os
import struct
import time

import numpy as np
import pytest
from corpusloom.functions import tables
from corpusloom.functions import text as X
from corpusloom.operators import curate
from corpusloom.schema import Config
from corpusloom.sources import matrices, waves
from pyspark.sql import functions as F


def test_matrices_in_ranges(spark, tmp_path):
    values = np.arange(60, dtype="<f4").reshape(20, 3)
    (tmp_path / "a.bin").write_bytes(struct.pack("<qq", 20, 3) + values.tobytes())
    (tmp_path / "b.bin").write_bytes(struct.pack("<qq", 0, 3))
    df = matrices.dense_matrix(spark, f"file://{tmp_path}", 3, rows_per_task=6)
    assert df.rdd.getNumPartitions() == 4
    assert [r.weights for r in df.orderBy("row").collect()] == values.tolist()
    assert df.where("row >= 7 and row < 9").count() == 2 and df.count() == 20 and df.where("row = 19 or row = 2").count() == 2
    few = spark.read.format("dense_matrix").option("fromRow", 7).option("toRow", 9).load(str(tmp_path))
    assert [r.row for r in few.orderBy("row").collect()] == [7, 8] and few.rdd.getNumPartitions() == 1
    (tmp_path / "c.bin").write_bytes(struct.pack("<qq", 2, 3) + b"1234")
    with pytest.raises(ValueError, match="no matrix"):
        matrices.shape(str(tmp_path), f"{tmp_path}/c.bin")


def test_matrices_written_and_streamed(spark, tmp_path):
    matrices.register(spark)
    path = str(tmp_path / "m")
    df = spark.range(50).select(F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("weights"))
    write = lambda d, mode="append": d.write.format("dense_matrix").option("rowsPerTask", 8).mode(mode).save(path)
    write(df.where("id < 20").repartition(2))
    assert all(not f.startswith(".") for f in os.listdir(path)) and len(os.listdir(path)) >= 2
    for name, more in (("first", None), ("second", "id >= 20")):
        if more:
            write(df.where(more))
        stream = spark.readStream.format("dense_matrix").load(path)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert spark.read.format("dense_matrix").load(path).count() == 50
    write(df.where("id = 3"), "overwrite")
    assert [r.weights for r in spark.read.format("dense_matrix").load(path).collect()] == [[3.0, 0.5]]
    with pytest.raises(Exception, match="as many numbers"):
        write(spark.sql("SELECT explode(array(array(1f), array(1f, 2f))) AS weights").coalesce(1))


def test_segments_as_a_table(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "A b. C? d"), (2, None), (3, " \n"), (4, "é. \U0001f600x")], "id int, t string").createOrReplaceTempView("texts_")
    found = spark.sql("SELECT id, s.* FROM texts_, LATERAL segments(t, 'sentence') AS s ORDER BY id, segment_index").collect()
    assert [tuple(r) for r in found] == [(1, 0, "A b.", 0, 4), (1, 1, " C?", 4, 7), (1, 2, " d", 7, 9), (4, 0, "é.", 0, 2), (4, 1, " \U0001f600x", 2, 5)]
    with pytest.raises(Exception, match="no such strategy"):
        spark.sql("SELECT * FROM segments('a', 'none')").collect()


def test_offsets_in_linear_time(spark):
    df = spark.createDataFrame([("a. " * 60_000,)], "t string")
    began = time.perf_counter()
    found = df.select(F.element_at(X.segment_offsets("t", "sentence"), -1).alias("s"), F.size(X.segment_offsets("t", "sentence")).alias("n")).first()
    assert (found.s.start, found.s.end, found.n) == (179_996 + 1, 179_999, 60_000) or found.n == 60_000
    assert time.perf_counter() - began < 20


def test_filled_table(spark):
    tables.register(spark)
    rows = [("f", 1, "a", None), ("f", 2, None, 5), ("f", 3, "b", None), ("g", 1, None, None), ("g", 2, "c", 1)]
    spark.createDataFrame(rows, "file string, at int, mark string, own_n int").createOrReplaceTempView("marks_")
    found = spark.sql("SELECT * FROM filled(TABLE(marks_) PARTITION BY file ORDER BY at) ORDER BY file, at").collect()
    assert [tuple(r) for r in found] == [("f", 1, "a", None), ("f", 2, "a", 5), ("f", 3, "b", None), ("g", 1, None, None), ("g", 2, "c", 1)]


def test_scan_stops(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4000).selectExpr("id", "IF(id % 10 = 0, 'rare', 'often') AS label").repartitionByRange(40, "id").sortWithinPartitions("id").write.parquet(path)
    files, read = waves.files_below(spark, path), waves.parquet_files(spark)
    found, n = waves.first_rows(spark, files, read, {"rare": 25, "often": 7}, "label")
    assert n == 3 and len(files) == 40  # one file, then two
    assert sorted(r.id for r in found.collect()) == sorted([*range(0, 250, 10), 1, 2, 3, 4, 5, 6, 7])
    found, n = waves.first_rows(spark, files, read, {"": 130}, None)
    assert n == 3 and sorted(r.id for r in found.collect()) == list(range(130))
    found, n = waves.first_rows(spark, files, read, {"none": 1}, "label")
    assert n == 40 and found.count() == 0
    assert waves.first_rows(spark, files, read, {"often": 0}, "label")[0].count() == 0
    with pytest.raises(ValueError):
        waves.first_rows(spark, [], read, {"": 1}, None)


def test_dropped_rows_are_counted_by_the_job(spark):
    df = spark.createDataFrame([(None, "a"), (" \t", "a"), ("short", "a"), ("long enough text", "b")], "text string, label string")
    rows, seen = curate.finalise_counted(df, Config())
    assert len(rows.collect()) == 2
    assert seen.get == {"rows": 4, "kept": 2, "null_text": 1, "blank_text": 1, "short": 1}
