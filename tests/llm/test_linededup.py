import random
import re

import pytest
from corpusloom.llm import linededup
from corpusloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(docs):
    """Texts by (doc_id, text) after removal; docs: (doc_id, text, tag), in any order."""
    order = sorted({(-(2**63) if i is None else i, tag, t) for i, t, tag in docs if t is not None}, key=lambda x: x[:2])
    seen, sets, out = {}, [], {}
    for i, tag, text in order:
        kept = []
        for line in text.split("\n"):
            words = frozenset(w for w in re.split(r"[\t-\r\x1c- ]", line.lower()) if w)
            if not words:
                kept.append(line)
                continue
            if words in seen:
                continue
            seen[words] = gone = any(min(len(o), len(words)) * 5 >= 4 * max(len(o), len(words)) and 5 * len(o & words) >= 4 * len(o | words) for o in sets)
            sets.append(words)
            if not gone:
                kept.append(line)
        out[i, text] = "\n".join(kept)
    return out


def tagged(spark, df):
    return [(r.doc_id, r.text, r.tag) for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS tag").collect()]


def compare(spark, docs):
    want = brute(tagged(spark, docs))
    joined = linededup.remove_repeated_lines(docs.selectExpr("*", "text AS old"))
    rows = joined.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.old is None:
            assert r.text is None
        else:
            assert r.text == want[-(2**63) if r.doc_id is None else r.doc_id, r.old], (r.doc_id, r.old[:200], r.text[:200])


@pytest.mark.parametrize(("first", "held", "split"), [(2, 1000, 100_000), (1, 7, 100_000), (1, 1000, 15), (2, 7, 10)])
def test_random_lines_equal_brute_force(spark, monkeypatch, first, held, split):
    monkeypatch.setattr(linededup, "SPLIT", split)
    monkeypatch.setattr(linededup, "HEAD", held)
    monkeypatch.setattr(linededup, "TOGETHER", 50)
    monkeypatch.setattr(linededup, "FIRST_ROUND", first)
    monkeypatch.setattr(linededup, "GROWTH", 2)
    rng = random.Random(first)
    words = [f"w{i}" for i in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(15)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice([" ", "\t"]).join(line))
        rows.append((i * 7 % 60, "\n".join(lines)))
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


@pytest.mark.parametrize("ids", [[None], [None, 1, 2]])
def test_null_and_repeated_ids_equal_brute_force(spark, monkeypatch, ids):
    monkeypatch.setattr(linededup, "HEAD", 7)
    monkeypatch.setattr(linededup, "TOGETHER", 50)
    monkeypatch.setattr(linededup, "FIRST_ROUND", 1)
    monkeypatch.setattr(linededup, "GROWTH", 2)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.randint(8, 25))] for _ in range(6)]
    rows = []
    for _ in range(25):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line))
        rows.append((rng.choice(ids), "\n".join(lines)))
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_long_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FIRST_ROUND", 1)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for n in (60, 80, 170, 190, 390, 420, 950, 2000):
        base = rng.sample(words, n)
        for k in range(8):
            line = list(base)
            for _ in range(rng.randint(0, n // 7)):
                line[rng.randrange(n)] = rng.choice(words)
            rows.append((len(rows), " ".join(line[: n - rng.randint(0, n // 12)])))
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_cases(spark):
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, "One two\n\none TWO\nx", "a"), (None, "x\ny", "a"), (5, long + "\n" + long + " more\nz", "b"), (5, long + "\n" + long + " more\nz", "b"), (6, long, None), (7, "\n" * 70_000 + "x\nq r s", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    compare(spark, docs)
    found = linededup.remove_repeated_lines(docs, "removed")
    assert found.columns == ["doc_id", "text", "line", "removed"]
    by = {r.doc_id: r for r in found.collect()}
    assert by[3].text == "One two\n" and by[3].removed == 2 and by[6].text == "" and by[None].text == "x\ny"
    assert by[7].text == "\n" * 70_000 + "q r s"
    assert linededup.remove_repeated_lines(docs.limit(0)).count() == 0


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    compare(spark, docs)
    assert {r.doc_id for r in QUERIES["op7_line_join"](spark, SMALL).collect()} == {r.doc_id for r in docs.collect()}
