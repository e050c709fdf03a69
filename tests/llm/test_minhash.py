import random
from collections import Counter

import numpy as np
import pytest
from corpusloom.llm import graph, minhash
from corpusloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def bag(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs):
    """Least doc_id of each document's class, from all pairs; docs: (doc_id, text)."""
    bags = {}
    for i, t in docs:
        bags.setdefault(t or "", [bag(t or ""), i])
        bags[t or ""][1] = min(bags[t or ""][1], i)
    texts = list(bags)
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            x, y = bags[a][0], bags[b][0]
            whole = sum((x | y).values())
            if whole and sum((x & y).values()) / whole >= 0.8:
                root[top(a)] = top(b)
    least = {}
    for t in texts:
        least[top(t)] = min(least.get(top(t), bags[t][1]), bags[t][1])
    return {i: least[top(t or "")] for i, t in docs}


def test_registers_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    for size, most in ((3, 1), (60, 1), (400, 6), (40, 900)):
        hashes = minhash.mixed(np.arange(1, 2 * size + 1, dtype=np.uint64))
        got, want = [], []
        for _ in range(40):
            hashes = minhash.mixed(hashes)
            a, b = (rng.integers(0, most + 1, 2 * size) for _ in range(2))
            b = np.where(rng.random(2 * size) < 0.6, a, b)
            bags = [(hashes[w > 0], w[w > 0]) for w in (a, b)]
            if not all(len(x[0]) for x in bags):
                continue
            s = minhash.signatures(bags)
            got.append((s[0] == s[1]).mean())
            want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
            order = np.argsort(bags[0][0])
            assert minhash.similarity(*[(h[o], w[o]) for (h, w) in bags for o in [np.argsort(h)]]) == pytest.approx(want[-1])
            # a document's registers do not depend on its neighbours in a batch
            assert (minhash.signatures([bags[0]])[0] == s[0]).all() and len(order)
        assert abs(np.mean(got) - np.mean(want)) < 4 * np.std(np.subtract(got, want)) / np.sqrt(len(got)) + 0.004


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 3), (200, 201), (201, 202), (7, 7)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in [*range(41), 100]} | {200: 200, 201: 200, 202: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def variants(rng, words, base, n):
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = rng.choice(words)
        yield " ".join(text)


@pytest.mark.parametrize(("held", "split"), [(1000, 20_000), (3, 20_000), (1000, 4), (3, 5)])
def test_groups_equal_brute_force(spark, monkeypatch, held, split):
    monkeypatch.setattr(minhash, "HEAD", held)
    monkeypatch.setattr(minhash, "SPLIT", split)
    monkeypatch.setattr(minhash, "TOGETHER", 50)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = [t for n in (3, 20, 80, 200) for _ in range(3) for t in variants(rng, words, [rng.choice(words) for _ in range(n)], 12)]
    docs = list(enumerate(rng.sample(texts, len(texts))))
    found = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == brute(docs)


def test_recall_of_pairs_just_above_the_limit(spark):
    """Pairs of similarity 0.8 to 0.83, each a class of its own: at least 0.95 of them are found (in fact nearly all)."""
    rng, docs, pairs = random.Random(12), [], 0
    while pairs < 300:
        base = [f"p{pairs}w{i}" for i in range(rng.randint(120, 300))]
        text = list(base)
        for _ in range(rng.randint(2, 8)):
            text[rng.randrange(len(text))] = f"x{rng.random()}"
        a, b = bag(" ".join(base)), bag(" ".join(text))
        if 0.8 <= sum((a & b).values()) / sum((a | b).values()) <= 0.83:
            docs += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(text))]
            pairs += 1
    found = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    recall = sum(found[2 * k + 1] == 2 * k for k in range(pairs)) / pairs
    assert recall >= 0.95 and all(c // 2 == i // 2 for i, c in found.items())


def test_cases(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "a b", 7), (4, "A B", 7), (5, "word " * 9000, 7), (6, "word " * 8999, 7), (7, " ", 7), (3, "a b", 7), (9, "other text of some six words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    assert sorted((r.doc_id, r.class_id) for r in minhash.classes(docs).collect()) == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (9, 9)]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 9]
    assert minhash.classes(docs.limit(0)).count() == minhash.keep_one(docs.limit(0)).count() == 0


def test_classes_with_null_and_equal_ids_stay_apart(spark):
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2] + " more"), (8, texts[3]), (8, texts[4]), (8, texts[5]), (9, texts[5]), (None, texts[0])]
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 6 and {(t or "").removesuffix(" more") for _, t in kept} == set(texts)


def test_table_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in QUERIES["op2_bag_minhash"](spark, SMALL).collect()} == brute(docs)
