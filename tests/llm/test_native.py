import hashlib
import re
import struct

import pytest
import xxhash
from corpusloom.llm import fingerprints, quality
from corpusloom.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F
from tests.oracle import mismatch

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, "one", "a"),
    (4, "a b c a b c a b c", "a"),
    (5, "x\n\nx\n \nx\ny y y y y", "b"),
    (6, "é#$ ñ&| z\x0b q\tq q q", None),
    (7, "w " * 4000 + "end", "b"),
    (8, " ".join(f"t{i}" for i in range(90)), "b"),
    (8, " ".join(f"t{i}" for i in range(90)), "b"),
]


def odd(spark):
    return spark.createDataFrame([(*r, 1, "z") for r in ODD], "doc_id long, text string, source string, _words int, kept string")


def rules(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 500 else set(range(len(words) - 1))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_rules_equal_brute_force(spark):
    for r in quality.quality(odd(spark)).collect():
        text = next(t for i, t, _ in ODD if i == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rules(text), r
    assert quality.quality(odd(spark).limit(0)).count() == 0


def test_keep_good_keeps_rows_and_columns(spark):
    kept = quality.keep_good(odd(spark))
    assert kept.columns == odd(spark).columns
    assert [r.doc_id for r in kept.collect()] == [] or all(r.doc_id == 8 for r in kept.collect())


def test_bad_host_goes(spark):
    good = " ".join(f"t{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", "fine") for i in range(100)] + [(200 + i, "short" if i else good, "bad") for i in range(60)]
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r.kept for r in found) == 90
    assert not next(r.kept for r in found if r.doc_id == 200)


def test_quality_equals_sql(spark):
    assert mismatch(spark, QUERIES["op5_quality_hosts"], ORACLE_SQL["op5_quality_hosts"], SMALL) is None


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_fingerprints(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        texts = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
        found = {r.doc_id: r for r in fingerprints.compare_edits(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == len(texts)
    for k, (i, text) in enumerate(texts):
        follower = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, follower)):
            a, b = shingles(text), shingles(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 0.16
    same = {}
    for i, text in texts:
        assert same.setdefault(text, found[i].fingerprint) == found[i].fingerprint


def reference_bits(text):
    """The fingerprint, step by step."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of_longs = lambda xs, seed=42: xs and of_longs(xs[1:], xxhash.xxh64_intdigest(struct.pack("<q", signed(xs[0])), seed)) or seed
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text)]
    if not words:
        return ""
    least = {}
    for i in range(max(1, len(words) - 4)):
        h = signed(of_longs(words[i : i + 5]))
        bin_ = h >> 56
        least[bin_] = min(least.get(bin_, h), h)
    bins = []
    for j in range(256):
        h = least.get(j - 128)
        for t in range(fingerprints.PROBES):
            if h is None:
                seed = xxhash.xxh64_intdigest(struct.pack("<i", j), 42)
                probe = signed(xxhash.xxh64_intdigest(struct.pack("<i", t), seed)) % 256
                h = least.get(probe - 128)
        if h is None:
            seed = xxhash.xxh64_intdigest(struct.pack("<i", j), 42)
            h = least[min(least, key=lambda b: signed(xxhash.xxh64_intdigest(struct.pack("<q", b), seed)))]
        bins.append(h & 15)
    return "".join(f"{x:x}" for x in bins)


def test_fingerprints_equal_reference(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    for r in fingerprints.fingerprints(docs).select("text", fingerprints.shown("bins").alias("bits"), "next_text").collect():
        assert r.bits == reference_bits(r.text), r.text[:100]


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_repeated_and_missing_ids_have_one_order(spark, partitions):
    rows = [(7, f"a{i % 9}") for i in range(40)] + [(None, f"b{i % 5}") for i in range(30)] + [(i, f"c{i}") for i in (1, 9, 12)]
    order = sorted(((i is not None, i or 0, hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows), reverse=True)
    want = sorted((x[3], order[(k + 1) % len(order)][3]) for k, x in enumerate(order))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.text, r.next_text) for r in found) == want


def test_prior_takes_chance_out(spark):
    verdicts = lambda hosts: spark.createDataFrame([(h, i < k) for h, n, k in hosts for i in range(n)], "source string, base_failed boolean")
    rate = lambda hosts: {r._host: r.failing_rate for r in quality.rejected_hosts(verdicts(hosts)).collect()}
    # one-document hosts tell nothing: a single failure among many hosts of one document is no reason to reject
    assert rate([(f"h{i}", 1, i % 4 == 0) for i in range(80)]) == {}
    # hosts that clearly differ keep about their own rates
    assert 0.78 < rate([("bad", 100, 80), ("good", 100, 25), ("fine", 100, 30)])["bad"] < 0.8
    assert rate([("only", 10, 10)]) == {"only": 1.0} and rate([("only", 10, 4)]) == {}


def test_fingerprint_cases(spark):
    found = {r.doc_id: r for r in fingerprints.compare_edits(odd(spark).dropDuplicates(["doc_id"])).collect()}
    assert found[1].fingerprint == found[2].fingerprint == "" and found[2].near_next == 1.0
    assert len(found[3].fingerprint) == fingerprints.BINS and found[3].near_next == 0.0
    assert fingerprints.compare_edits(odd(spark).limit(0)).count() == 0
    nameless = odd(spark).withColumn("doc_id", F.lit(None).cast("long"))
    assert fingerprints.compare_edits(nameless).count() == nameless.count() and quality.quality(nameless).count() == nameless.count()
    alone = fingerprints.compare_edits(odd(spark).where("doc_id = 4")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
