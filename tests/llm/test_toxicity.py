"""Toxicity: the index against all cosines, and accuracy on labels that were held out."""

import math

import numpy as np
import pytest
from corpusloom.llm import toxicity
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

VECTOR = st.tuples(st.dictionaries(st.integers(0, 5), st.integers(1, 6), max_size=4), st.integers(1, 40))


def cosine(a, b, idf):
    dense = lambda v: np.array([*(v[0].get(t, 0) * idf[t] for t in range(6)), v[1] * toxicity.REST])
    x, y = dense(a), dense(b)
    return float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y))


@settings(max_examples=150, deadline=None)
@given(st.lists(VECTOR, min_size=1, max_size=300), VECTOR)
def test_nearest_are_exact(entries, query):
    idf = np.array([1.5, 2, 2.5, 3, 3.5, 4])
    flat = lambda v: (sorted(v[0]), [v[0][t] for t in sorted(v[0])], v[1])
    index = toxicity.Index([flat(e) for e in entries], idf)
    found, cosines = index.nearest(*flat(query))
    all_of = sorted((cosine(query, e, idf) for e in entries), reverse=True)[: toxicity.NEIGHBOURS]
    assert np.allclose(cosines, all_of) and len(set(found.tolist())) == len(all_of)
    assert np.allclose([cosine(query, entries[index.order[k]], idf) for k in found], cosines)


def test_blocks_are_left_out():
    rng = np.random.default_rng(2)
    entries = [([int(t)], [int(c)], int(r)) for t, c, r in zip(rng.integers(0, 40, 20_000), rng.integers(1, 30, 20_000), rng.integers(1, 400, 20_000), strict=True)]
    index = toxicity.Index(entries, np.full(40, 4.0))
    read, scored = [], index.scored
    index.scored = lambda query, several: (read.extend(several.tolist()), scored(query, several))[1]
    index.nearest([3], [5], 50)
    assert 0 < len(read) == len(set(read)) < index.blocks / 10


def rows(n):
    """Every fifth text holds one of three insults, with endings of their own."""
    rng = np.random.default_rng(7)
    made = []
    for k in range(n):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["lor", "ip", "sum", "dol", "sit"], 60), rng.choice(["am", "et", "con", "sec", "ad", "el"], 60), strict=True)]
        if k % 5 == 0:
            for place in rng.integers(0, 60, 4):
                words[place] = rng.choice(["grubbler", "Dolt", "snivel"]) + rng.choice(["s", "ing", "!"])
        made.append((k, " ".join(words)))
    return made


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([*rows(600), (600, None), (601, ""), (None, "Dolts snivels"), (602, "12 !"), (5, "loram"), (5, "loram")], "doc_id long, text string").withColumns({"score": F.lit("x"), "terms": F.lit(1)})
    labels = spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(400) if k != 7] + [(7, None, 1), (None, 1, 1), (8, 0, 1), (8, 0, 1)], "doc_id long, toxic int, lang int")
    return {(r.doc_id, n): r for n, r in enumerate(sorted(toxicity.scored(docs, labels, F.col("doc_id") % 4 != 1).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score)))}


def test_unseen_documents(found):
    seen = [(r.doc_id, r.score) for r in found.values() if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert len(seen) == 200 and all((s >= 0.7) == (k % 5 == 0) for k, s in seen)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_odd_documents(found):
    low = [r.score for r in found.values() if r.doc_id in (600, 601, 602)]
    assert len(low) == 3 and len(set(low)) == 1 and low[0] < 0.1
    assert [r.score >= 0.7 for r in found.values() if r.doc_id is None] == [True]
    assert len([r for r in found.values() if r.doc_id == 5]) == 3


def test_evidence(found):
    for r in found.values():
        assert len(r.neighbours) <= toxicity.NEIGHBOURS and all(-1e-9 <= n.share <= 1 and 0 < n.cosine <= 1 for n in r.neighbours)
        if r.score >= 0.7:
            assert r.terms and np.mean([n.share for n in r.neighbours[:5]]) > 0.5


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert toxicity.scored(docs, labels, F.lit(True)).count() == 0
    assert [r.score for r in toxicity.scored(some, labels, F.lit(True)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scored(some, one, F.lit(True)).collect()] == [0.0, 0.0]
