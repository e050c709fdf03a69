"""Inputs on which queries once differed from their SQL or did work that grew too fast."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from corpusloom.catalogue import ORACLE_SQL, QUERIES
from corpusloom.functions import ngrams
from corpusloom.functions import text as X
from corpusloom.operators import folds, metrics, ml, projection
from corpusloom.sources import readers
from pyspark.sql import functions as F
from tests.oracle import mismatch


def test_tiers_whose_first_customer_has_number_zero(spark, tmp_path):
    rows = [(0, "BUILDING"), (5, "BUILDING"), (3, "MACHINERY"), (4, None), (7, "FREE")]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "customer.parquet")
    for name in ("documents", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    assert mismatch(spark, QUERIES["tiers_without"], ORACLE_SQL["tiers_without"], tmp_path) is None


def test_folds_of_texts_equal_folds_of_their_ngrams(spark, monkeypatch):
    """No table of each document's n-grams is made, and models come in passes of a few folds."""
    rng = random.Random(5)
    rows = [(k, f"s{k % 5}", y, "".join(rng.choice({"a": "abcDe ", "b": "bcdef\n", "c": "xyz\U0001f600ab "}[y]) for _ in range(rng.randint(0, 25)))) for k in range(150) for y in [rng.choice("abc")]]
    rows += [(500, None, "a", "abc"), (501, "s1", "only", "qqq"), (502, "s2", "a", None)]
    df = spark.createDataFrame(rows, "id long, source string, label string, text string")
    want = folds.leave_one_source_out(df.drop("text"), folds.document_ngrams(df, 1, 2).cache(), 60).collect()
    monkeypatch.setattr(folds, "FOLDS", 2)
    monkeypatch.setattr(folds, "CHARACTERS", 40)
    assert sorted(map(tuple, folds.leave_one_source_out(df, k=60, low=1, high=2).collect())) == sorted(map(tuple, want)) and len(want) == 5


@pytest.mark.parametrize("chars", ["ab \0\U0001f600", "".join(map(chr, range(0x4E00, 0x9FA0)))])
def test_ngrams_by_sorting(chars):
    rng = random.Random(7)
    texts = ["".join(rng.choice(chars) for _ in range(rng.choice([0, 1, 2, 9, 40000]))) for _ in range(8)] + ["", "a"]
    grams, doc, gram, n = ngrams.counted(texts, 2, 4)
    want = {(k, g): c for k, t in enumerate(texts) for g, c in Counter(t[i : i + m] for m in (2, 3, 4) for i in range(len(t) - m + 1)).items()}
    assert len(set(grams)) == len(grams) and {(int(d), grams[g]): int(c) for d, g, c in zip(doc, gram, n, strict=True)} == want
    assert [len(x) for x in ngrams.counted(["", "a"], 2, 3)] == [0, 0, 0, 0]


def test_rows_of_texts_equal_rows_of_their_ngrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, ""), (-2, None)], "id long, text string"))
    want, names = projection.tfidf_rows(folds.document_ngrams(docs, 1, 3), docs.count(), 500)
    found, ours = projection.text_rows(docs, 1, 3, 500)
    held = {r.id: r for r in found.collect()}
    assert ours == names and len(held) == want.count() and not held.keys() & {-1, -2}
    for r in want.collect():
        assert r.features == held[r.id].features and r.weights == pytest.approx(held[r.id].weights)


def test_counts_equal_the_array_of_ngrams(spark):
    df = spark.createDataFrame([(1, "a B\n\n bA"), (2, ""), (3, "xyx b")], "id long, text string")
    features = ml.char_features(df, 1, 2, 6)
    whole = features.transform(df.withColumn("grams", ml.X.char_ngrams("text", 1, 2)))
    ours = ml.char_counts(df, features, 1, 2)
    assert [r.counts for r in ours.orderBy("id").collect()] == [r.counts for r in whole.orderBy("id").collect()]
    assert "grams" not in ours.columns


@pytest.mark.parametrize("size", ["30", "128m"])
@pytest.mark.parametrize("start", ["", "loose\tx\n", "\n", "# id\n"])
def test_annotated_blocks_without_windows(spark, tmp_path, size, start):
    (tmp_path / "a.txt").write_text(start + "# id = one \r\na\tx\r\n\n \nb\n# id =# id = two\n#\tx\n\tempty\nc # id = no\n# id =\nlost\n# id = three\n# id = four\nd")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    found = readers.block_annotated(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("# id = two", "#  c # id = no"), ("four", "d"), ("one", "a b")]
    assert "Window" not in found._jdf.queryExecution().toString()
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("strategy", ["sentence", "auto", "paragraph", "whole"])
def test_segments_are_listed_in_slices(spark, strategy, monkeypatch):
    texts = ["a. b!\n\nc, (d)", None, "", " \n", "\U0001f600. e", *[f"x{k}. y;" for k in range(250)]]
    want = [[{"text": s, "start": a, "end": b} for s, a, b in X.spans(t, strategy)] for t in texts]
    assert X.TEXTS < len(texts) and X.listed(pa.array(texts), strategy).to_pylist() == want
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").coalesce(1)
    found = df.select("k", X.segment_offsets("t", strategy).alias("s")).orderBy("k").collect()
    assert [[x.asDict() for x in r.s] for r in found] == want


def test_word_vectors_are_learnt_in_parts(spark):
    df = spark.createDataFrame([(k, "a b c" if k % 2 else "x y z") for k in range(40)], "id long, text string")
    assert ml.word_vectors(df, size=4).getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ml.word_vectors(df, size=4, parts=1).getNumPartitions() == 1
