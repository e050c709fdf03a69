"""Periodic runs against a brute force that compares all words of all periods."""

import hashlib
import zlib

import numpy as np
import pytest
from corpusloom.llm import periodic, queries
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q) if q % p == 0):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def ids(words):
    return periodic.numbered([str(w).encode() for w in words])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_equals_brute_force(parts):
    words = [w for part, times in parts for w in part * times]
    assert periodic.runs_of(ids(words)) == brute(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60))
def test_two_words(words):
    assert periodic.runs_of(ids(words)) == brute(words)


@pytest.mark.parametrize("period", [1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 33, 64, 100])
def test_every_place(period):
    unit = [f"u{k}" for k in range(period)]
    for lead in (0, 1, period // 2, period, 37):
        for more in (0, 1, period - 1, 3 * period):
            words = [f"x{k}" for k in range(lead)] + (unit * 12)[: max(6, 4 * period) + more] + ["y"]
            assert (lead, max(6, 4 * period) + more, period) in periodic.runs_of(ids(words))


def test_long_text():
    words = ["a"] * 50_000 + ["b", "c"] * 20_000
    assert periodic.runs_of(ids(words)) == [(0, 50_000, 1), (50_000, 40_000, 2)]
    unit = [str(k) for k in np.random.default_rng(1).integers(0, 50, 9_000)]
    assert periodic.runs_of(ids(unit * 5))[-1:] == [(0, 45_000, 9_000)]


def contract(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query(spark, tmp_path):
    texts = [None, "", " \t\n", "a " * 40, "one two three " * 9 + "end", "x " * 7 + "y " * 9, "é b é b " * 5, "ab\x0bab\x0cab ab\rab ab ab"]
    rows = [(k, texts[k % len(texts)] if k % 3 else " ".join(f"w{(k * j) % 11}" for j in range(k % 90))) for k in range(300)] + [(None, "a a a a a a a"), (7, "a"), (7, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS runs", "1 AS best").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted((tuple(r) for r in found), key=key) == sorted(((k, *contract(k, t)) for k, t in rows), key=key)


def test_empty_table(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
