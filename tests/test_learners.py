"""Projection and heads against numpy."""

import hashlib

import numpy as np
import pytest
from corpusloom.operators import curate, folds, heads, metrics, projection
from pyspark.sql import functions as F


def test_singular_values_equal_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    grams = folds.document_ngrams(docs, 1, 3).cache()
    rows, names = projection.tfidf_rows(grams, docs.count(), 2000)
    values, right = projection.singular_vectors(rows, names)
    held = rows.orderBy("id").collect()
    dense = np.zeros((len(held), len(names)))
    for k, r in enumerate(held):
        dense[k, r.features] = r.weights
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)
    want = np.linalg.svd(dense, compute_uv=False)[:2]
    assert np.abs(values / want - 1).max() < 1e-3
    found = projection.projected(rows, right).orderBy("id").collect()
    assert np.allclose([r.point for r in found], dense @ right)


def test_projection_of_nothing(spark):
    none = spark.createDataFrame([], "id long, gram string, n long")
    rows, names = projection.tfidf_rows(none, 0, 10)
    assert names == [] and projection.singular_vectors(rows, names)[0].size == 0 and rows.count() == 0


def clusters(n, spread=0.6):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    labels = rng.choice(4, n, p=[0.5, 0.3, 0.15, 0.05])
    return [(int(k), (centres[y] + rng.normal(size=6) * spread).tolist(), f"l{y}") for k, y in enumerate(labels)]


def sequential(rows, epochs=3):
    names = sorted({r[2] for r in rows})
    weight = {y: len(rows) / (len(names) * sum(r[2] == y for r in rows)) for y in names}
    w, step = np.zeros((len(names), 6)), 0
    for epoch in range(epochs):
        for k, v, y in sorted(rows, key=lambda r: (hashlib.md5(f"42|{epoch}|{r[0]}".encode()).hexdigest(), r[0])):
            rate = 0.05 + (0.005 - 0.05) * step / (epochs * len(rows))
            v = np.array(v)
            p = np.exp(w @ v - (w @ v).max())
            p /= p.sum()
            p[names.index(y)] -= 1
            w -= rate * weight[y] * np.outer(p, v)
            step += 1
    return w


def test_one_range_is_sequential(spark):
    rows = clusters(300)
    df = spark.createDataFrame([*rows, (900, None, "l1"), (901, [0.0] * 6, None)], "id long, v array<double>, label string").repartition(3)
    head = heads.fit_sgd(df, "v", "label", "id", epochs=3, parts=1).orderBy("id").collect()
    assert np.abs(np.array([r.weights for r in head]) - sequential(rows)).max() < 1e-6


def test_ranges_lose_little(spark):
    df = spark.createDataFrame(clusters(2000), "id long, v array<double>, label string")
    score = {}
    for parts in (1, 8):
        found = heads.head_predictions(df, heads.fit_sgd(df, "v", "label", "id", parts=parts), "v")
        score[parts] = metrics.accuracy(found, true="label").first().accuracy
    assert score[1] > 0.8 and score[8] >= score[1] - 0.01
    assert heads.fit_sgd(df.limit(0), "v", "label", "id").count() == 0


def test_split_keeps_all_labels(spark):
    df = spark.createDataFrame(clusters(200), "id long, v array<double>, label string")
    assert curate.stratified_split(df, 0.9, 42).count() == 200


@pytest.mark.parametrize("names", [[], ["a"], ["a", "b"]])
def test_directions_depend_on_names_only(names):
    first = projection.random_directions(names, 3, 1)
    assert np.array_equal(first, projection.random_directions([*names, "z"], 3, 1)[: len(names)])
