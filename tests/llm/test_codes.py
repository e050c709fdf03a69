"""Vector codes against the contract in plain Python and in SQL."""

import hashlib
import math

import numpy as np
import pytest
from corpusloom.llm import codes, queries
from tests.oracle import mismatch

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows):
    kept = [(i, y, [math.floor(4096 * x) for x in v]) for i, y, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    parts = [(i, y, [v[k * len(v) // 8 : (k + 1) * len(v) // 8] for k in range(8)]) for i, y, v in kept]
    books = [[p[k] for _, _, p in parts[:16]] for k in range(8)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(6):
        for k in range(8):
            of = [near(p[k], books[k])[1] for _, _, p in parts]
            for e in range(len(books[k])):
                mine = [p[k] for (_, _, p), n in zip(parts, of, strict=True) if n == e]
                if mine:
                    books[k][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out, errors = [], {}
    for i, y, p in parts:
        found = [near(p[k], books[k]) for k in range(8)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), y))
        errors[y] = errors.get(y, 0) + out[-1][2]
    told = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, code, error, errors[y], told) for i, code, error, y in out)


def made(n, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width))
    rows = [(k * 7 % n, int(k % 5) if k % 9 else None, (centres[k % 20] + rng.normal(size=width) * 0.2).astype(np.float32).tolist()) for k in range(n)]
    return [*rows, (n + 1, 1, None), (n + 2, 1, [float("nan")] * width), (n + 3, 1, [float("inf")] * width), (n + 4, 1, [None] + [0.0] * (width - 1)), (n + 5, 2, [0.0] * width)]


@pytest.mark.parametrize("rows", [made(401), made(9), made(60, 8), [(k, 0, [1.0] * 8) for k in range(40)]], ids=["clusters", "few", "narrow", "equal"])
def test_query_equals_brute_force(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "0 AS sums").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op13_exponion_codes(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_query_equals_sql(spark):
    assert mismatch(spark, queries.op13_exponion_codes, codes.oracle_sql(), "/root/testdata/sf0.001") is None


def test_search_is_exact():
    rng = np.random.default_rng(5)
    book = codes.Codebook(np.vstack([rng.integers(-40, 40, (12, 4)), np.zeros((4, 4), int)]))  # equal entries too
    parts = rng.integers(-50, 50, (2000, 4))
    all_of = ((parts[:, None] - book.entries[None]) ** 2).sum(2)
    code, least = book.search(parts, rng.integers(0, 16, 2000).astype(np.uint8))
    assert (code == all_of.argmin(1)).all() and (least == all_of.min(1)).all()


def test_decoded(spark):
    rows = made(200)
    found, books = codes.compress(spark.createDataFrame(rows, SCHEMA))
    back = {r.vec_id: np.array(r.vector) for r in codes.decoded(found, books).collect()}
    error = {r.vec_id: r.error for r in found.collect()}
    for i, _, v in rows[:200]:
        away = np.floor(np.array(v, float) * 4096) - back[i] * 4096
        assert round((away**2).sum()) == error[i]


def test_odd_tables(spark):
    none, books = codes.compress(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error"] and codes.digest(books) == hashlib.sha256(b"").hexdigest()
    rows = [(1, 0, [1.0] * 8), (1, 0, [1.0] * 8), (None, 0, [2.0] * 8), (2, 0, [1.0] * 16), (3, 0, [])]
    found, _ = codes.compress(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.vec_id or 0, r.error) for r in found.collect()) == [(0, 0), (1, 0), (1, 0)]
    with pytest.raises(ValueError, match="cut into 8"):
        codes.compress(spark.createDataFrame([(1, 0, [1.0] * 9)], SCHEMA))
    with pytest.raises(ValueError, match="below"):
        codes.compress(spark.createDataFrame([(1, 0, [1e30] * 8)], SCHEMA))
