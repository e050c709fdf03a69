"""Archives, token files and packing: exact round trips and brute force."""

import gzip
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from corpusloom.llm import packing, repair, warc
from corpusloom.llm.common import scratch_path
from corpusloom.llm.encoding import Encoder
from corpusloom.llm.files import read_blocks, write_blocks
from corpusloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import mismatch

SMALL = "/root/testdata/sf0.001"
TEXTS = [None, "", "a", "word " * 9000, "é ñ <|endoftext|> x", "same text here", "same text here", "line\n\n  two  blanks\n"]


def docs_of(spark):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 5, "x")], "doc_id long, text string, piece int, ids string")


def test_archives_equal_sql(spark):
    assert mismatch(spark, QUERIES["op1_warc_segments"], ORACLE_SQL["op1_warc_segments"], SMALL) is None


def test_archives_across_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 3)
    same = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 10
    pages = [(1, "u", None), (2, None, ""), (3, "u\r\nv", same), (4, "u", same), (5, "u", "ß" * 60_000), (6, "u", "tiny"), (7, "u", "tiny"), (3, "u", same)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string").coalesce(1)
    path = scratch_path(spark, "warc")
    warc.write_archives(df, path)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(pages) and all(r.verified for r in rows)
    by = {int(r.page_id): r for r in rows}
    assert by[4].record_type == "revisit" and by[4].refers_to == "3" and by[4].payload_bytes == len(same.encode())
    assert bytes(by[5].payload).decode() == "ß" * 60_000 and by[7].record_type == "response"
    assert sum(r.record_type == "revisit" for r in rows) == 1
    path = scratch_path(spark, "warc")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_records_have_the_fields_of_the_standard(spark):
    same = "x" * 200
    df = spark.createDataFrame([(1, "http://a/1", same), (2, "http://a/2", same), (3, "http://a/3", "y" * 20_000)], "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write_archives(df, path, "2024-01-02T03:04:05Z")
    found = [x for r in read_blocks(spark, path).collect() for x in warc.parse(gzip.decompress(r.content))]
    assert all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= f.keys() for f, _ in found)
    assert len({f["WARC-Record-ID"] for f, _ in found}) == len(found) == 5
    by = {f.get("X-Page-Id"): f for f, _ in found if f["WARC-Type"] != "continuation"}
    assert by["2"]["WARC-Refers-To"] == by["1"]["WARC-Record-ID"] and by["2"]["WARC-Refers-To-Target-URI"] == "http://a/1"
    assert by["2"]["WARC-Refers-To-Date"] == by["1"]["WARC-Date"] and by["2"]["WARC-Profile"].endswith("identical-payload-digest")
    assert max(len(block) for _, block in found) <= warc.SEGMENT


def test_revisits_are_verified_in_their_records(spark):
    columns = "origin string, page_id string, url string, record_type string, refers_to_record string, payload_bytes long, payload_digest string, verified boolean, payload binary"
    rows = [("a", "1", None, "response", None, 5, "d", True, None), ("b", "2", None, "response", None, None, None, False, None)]
    rows += [(f"r{k}", f"1{k}", None, "revisit", to, None, digest, False, None) for k, (to, digest) in enumerate([("a", "d"), ("a", "e"), ("b", "d"), ("missing", "d"), (None, "d")])]
    found = {r.page_id: r for r in warc.looked_up(spark.createDataFrame(rows, columns)).collect()}
    assert len(found) == 7 and [found[f"1{k}"].verified for k in range(5)] == [True, False, False, False, False]
    assert (found["10"].refers_to, found["10"].payload_bytes) == ("1", 5) and found["13"].refers_to is None


def test_files_carry_all_bytes(spark):
    rows = [(bytes(range(256)) * 3,), (bytes(reversed(range(256))),), (b"\xff\xfe\x80\x00\n\r",)]
    path = scratch_path(spark, "bytes")
    write_blocks(spark.createDataFrame(rows, "value binary").coalesce(1), "value", path, "|")
    assert b"".join(bytes(r.content) for r in read_blocks(spark, path).collect()) == b"|".join(r[0] for r in rows) + b"|"


def test_broken_records_are_marked():
    block = warc.HTTP + warc.chunked(b"x" * 10_000)
    good = [(1, None, {"WARC-Payload-Digest": "sha256:?"}, block[:8192]), (2, len(block), {}, block[8192:])]
    assert warc.finish("o", good)["payload"] == b"x" * 10_000 and warc.finish("o", good[::-1])["payload_bytes"] == 10_000
    assert warc.finish("o", good[1:])["payload"] is None
    assert warc.finish("o", [good[0], (2, 5, {}, good[1][3])])["payload"] is None
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for alphabet, n in ((3, 5000), (200, 20_000), (40_000, 3000), (1, 4000)):
        sizes = rng.integers(1, 60, n // 30)
        ids = [rng.integers(0, alphabet, s).astype("<u2").tobytes() for s in sizes]
        keys = [None, *range(1, len(ids))]
        (shard,) = repair.shards(repair.pack(3, 9, keys, ids) + b"\n")
        assert shard.doc_ids == keys and shard.before == 9
        for k, x in enumerate(ids):
            assert shard.decode(k).tobytes() == x and shard.length(k) == len(x) // 2
            for start, n in ((0, 1), (len(x) // 6, 3), (len(x) // 2 - 1, 1)):
                assert shard.ids_at(k, start, n).tobytes() == x[2 * start : 2 * (start + n)]
        if alphabet < 100:
            assert len(shard.seq) < sizes.sum() / 2


def test_grammar_is_complete_and_counts_hold():
    """No pair that pays is left, and each rule stands for as many places as its pair had, without overlaps."""
    rng = np.random.default_rng(4)
    words = [rng.integers(10, 60, rng.integers(2, 7)) for _ in range(60)]
    for ids in (np.concatenate([words[k] for k in rng.zipf(1.4, 8000) % 60]), np.full(5000, 7), np.tile([5, 5, 6], 900)):
        last = np.zeros(len(ids), bool)
        last[-1] = True
        rules, seq, last = repair.compress(ids, last)
        use = repair.places_of_pairs(seq, last)
        pairs = Counter(zip(seq[:-1][use].tolist(), seq[1:][use].tolist(), strict=True))
        assert not pairs or max(pairs.values()) < repair.LEAST
        assert b"".join(repair.expansions(rules)[s] for s in seq.tolist()) == ids.astype("<u2").tobytes() and last[-1]
    assert len(repair.compress(np.full(4096, 7), np.arange(4096) == 4095)[0]) >= 9


@pytest.mark.parametrize("size", [500_000, 40])
def test_token_files(spark, monkeypatch, size):
    monkeypatch.setattr(repair, "SHARD", size)
    library = Encoder("word")
    path = scratch_path(spark, "shards")
    repair.write_shards(docs_of(spark), path)
    rows = sorted(repair.read_shards(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        want = np.frombuffer(library.whole(TEXTS[r.doc_id] or ""), "<u2").astype("<u4").tolist() + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.start == at
        at += len(want)
    assert [r.doc_id for r in rows] == sorted([*range(len(TEXTS)), 3])
    path = scratch_path(spark, "shards")
    repair.write_shards(docs_of(spark).limit(0), path)
    assert repair.read_shards(spark, path).count() == 0


def check_packing(rows, texts, capacity):
    library, by_sequence, by_doc = Encoder("byte"), {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts.items():
        ids = np.append(np.frombuffer(library.whole(text or ""), "<u2"), 2).astype("<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
    return len(by_sequence)


def test_packing_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = QUERIES["op9_genetic_packing"](spark, SMALL).collect()
    used = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 1024)
    assert used <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_copies_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    docs = spark.createDataFrame([(None, None)] * 400, "doc_id long, text string").repartition(3)
    rows = packing.cut_and_pack(docs).collect()
    blocks = Counter(r.sequence_id >> 24 for r in rows)
    assert len(rows) == 400 and len(blocks) == 8 and max(blocks.values()) < 100


def test_packing_cases(spark):
    docs = docs_of(spark)
    check_packing(packing.cut_and_pack(docs.dropDuplicates(["doc_id"])).collect(), dict(enumerate(TEXTS)), 1024)
    assert packing.cut_and_pack(docs).where("doc_id = 3").count() == 2 * packing.cut_and_pack(docs.limit(4)).where("doc_id = 3").count()
    assert packing.cut_and_pack(docs.limit(0)).count() == 0


def lengths_of(seed):
    """Lengths that leave room for better packings: many pieces of more than half a sequence, and others to go with them."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.integers(520, 1000, 800), rng.integers(100, 500, 1200)])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_evolution_beats_the_packings_that_it_begins_with(monkeypatch, seed):
    sizes = lengths_of(seed)
    begun = packing.evolve(sizes, [], [seed], generations=0, noise=0.3)
    found = packing.evolve(sizes, [], [seed], generations=30, noise=0.3)
    monkeypatch.setattr(packing, "cross", lambda sizes, lengths, one, two, capacity, rng: one.copy())
    without = packing.evolve(sizes, [], [seed], generations=30, noise=0.3)
    count = lambda home: -packing.fitness(sizes, home, 1024)[0]
    assert count(found) < count(begun) == count(without)
    assert packing.fills(sizes, found).max() <= 1024
    assert count(found) <= 1.02 * sizes.sum() / 1024


def test_child_has_sequences_of_both_parents():
    sizes, rng = lengths_of(7), np.random.default_rng(7)
    one, two = (packing.evolve(sizes, [], [k], generations=0, noise=0.2) for k in (1, 2))
    child = packing.cross(sizes, sizes.tolist(), one, two, 1024, rng)
    held = lambda home: {tuple(np.flatnonzero(home == k)) for k in np.unique(home)}
    assert len(held(child) & (held(one) - held(two))) > 50 and len(held(child) & (held(two) - held(one))) > 50
    assert sorted(i for s in held(child) for i in s) == list(range(len(sizes))) and packing.fills(sizes, child).max() <= 1024


@pytest.mark.parametrize("sizes", [[600] * 50, [512] * 31, [1], [1023, 1]])
def test_evolution_cases(sizes):
    home = packing.evolve(np.array(sizes), [], [1])
    assert packing.fills(np.array(sizes), home).max() <= 1024 and -packing.fitness(np.array(sizes), home, 1024)[0] == {50: 50, 31: 16, 1: 1, 2: 1}[len(sizes)]
