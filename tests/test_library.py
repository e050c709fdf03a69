"""Operators that SQL can't check: hand-written rows, round trips and brute force."""

import json
import os
import random
import re
import shutil
import struct
import subprocess
import sys
from pathlib import Path

import pytest
from corpusloom.functions import text as X
from corpusloom.functions import vectors
from corpusloom.operators import audit, auditing, curate, filters, metering, metrics, ml
from corpusloom.schema import Config
from corpusloom.sources import readers, writers
from corpusloom.streaming import jobs
from pyspark.sql import functions as F

SINHALA = "කිරි"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (X.clean, "  a b\tc\n", "a b c"),
        (X.clean, None, ""),
        (X.clean, " a　b\u0085", "a b"),
        (X.strip_join_marker, "ab<psiX>c<PSI>d", "abcd"),
        (X.normalise_words, SINHALA + " Ab, 12\nc", "කර ab c"),
        (X.strip_wiki, "{{x}}a [[b|c]] <ref>d</ref>[http://e.org f] <b>g</b>", "a c g"),
        (lambda t: X.strip_wiki(t, keep=True), "{{x}}a [[b|c]] <ref>d</ref>[http://e.org f] <b>g</b>", "a c f g"),
        (X.strip_wiki, "{{a|{{b|{{c}} x}} y}}one {{d}}[[two]] <!-- {{ -->'''three''' <ref name=x/>[https://e.org]\n== Four ==\nfive {not six}", "one two three five {not six}"),
        (X.snippet, "x" * 41, "x" * 40 + "..."),
        (X.split_eos, "a<eos>b. c? d", ["a", "b.", "c?", "d"]),
        (X.split_eos, "a b॥ c d। e\u00a0f.\u2003g", ["a b॥", "c d।", "e\u00a0f.", "g"]),
        (X.split_eos, "\u3000a.\u00a0b<eos> c ", ["a.\u00a0b", "c"]),
        (X.split_danda, "a। b॥", ["a", "b"]),
        (X.word_count, "  ", 0),
    ],
)
def test_text_functions(spark, f, given, want):
    assert one(spark, f("t"), given) == want


def test_padding_and_ratios(spark):
    assert one(spark, X.padded("t", 3), "1234") == "1234" and one(spark, X.padded("t", 3), "7") == "007"
    mixed = "Hello " + SINHALA
    chars = Config().script
    assert one(spark, X.script_ratio_beyond_ascii("t", chars), mixed) == 1.0 and one(spark, X.script_ratio_letters("t", chars), mixed) < 0.5
    assert one(spark, X.script_ratio_letters("t", chars), "125") == 0.0
    assert one(spark, X.detect_script("t", chars, Config().other_script), SINHALA) == "Sinh"
    assert one(spark, F.array(X.char_ngrams("t", 1, 2)), "Ab  c") == [["a", "b", " ", "c", "ab", "b ", " c"]]


PATTERNS = {"sentence": r"[^.!?।\n]+(?:[.!?।\n]+|$)", "paragraph": r"(?:[^\n][\n]?)+", "auto": r"[^.!?।\n,;:()\[\]]+(?:[.!?।\n,;:()\[\]]+|$)"}


@pytest.mark.parametrize("strategy", [*PATTERNS, "full_text"])
def test_segments_equal_python(spark, strategy):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n.!?,;(]।\U0001f600" + SINHALA) for _ in range(rng.randint(0, 25))) for _ in range(150)] + ["...Hi there. How?! ok\nlast, a;b\n", "line\n" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = dict(df.select("id", X.segment_offsets("t", strategy) if strategy != "paragraph" else X.segment_offsets(F.substring("t", 1, 4000), strategy)).collect())
    for i, t in enumerate(texts):
        t = t[:4000] if strategy == "paragraph" else t
        spans = [(m[0], m.start(), m.end()) for m in re.finditer(PATTERNS[strategy], t)] if strategy in PATTERNS else [(t, 0, len(t))]
        assert [tuple(x) for x in found[i]] == [s for s in spans if s[0].strip()], repr(t[:80])


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(vectors.softmax("v")).first()[0] == pytest.approx([0.26894142, 0.73105858])
    assert df.select(vectors.argmax("v")).first()[0] == 1 and df.select(vectors.dot("v", "v")).first()[0] == 5.0
    scores = df.select(F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(0.5)).alias("m")).select(vectors.best_entry("m").alias("b")).first().b
    assert (scores.key, scores.value) == ("a", 0.5)
    assert df.select(vectors.mean_vector(F.array("v", F.array(F.lit(3.0), F.lit(0.0))), 2)).first()[0] == [2.0, 1.0]


@pytest.mark.parametrize(("groups", "want"), [(1, {"train": 1}), (2, {"train": 2}), (3, {"train": 1, "val": 1, "test": 1}), (5, {"train": 3, "val": 1, "test": 1}), (10, {"train": 8, "val": 1, "test": 1})])
def test_split_sizes(spark, groups, want):
    df = spark.createDataFrame([(f"g{i}", "x") for i in range(groups)], "group_id string, label string")
    assert {r.split: r["count"] for r in curate.grouped_split(df).groupBy("split").count().collect()} == want


@pytest.mark.parametrize(("n", "want"), [(1, (0, 0, 1)), (3, (2, 0, 1)), (5, (4, 0, 1)), (6, (4, 1, 1)), (7, (5, 1, 1)), (10, (8, 1, 1)), (25, (20, 2, 3))])
def test_two_stage_split_sizes(spark, n, want):
    """Of groups, and of rows where a class has one group."""
    groups = [(i, "x", f"g{i}") for i in range(n)] if n >= 3 else []
    df = spark.createDataFrame([*groups, *((100 + i, "y", "g") for i in range(n))], "id long, label string, group_id string")
    found = {(r.label, r.split): r["count"] for r in curate.two_stage_split(df, ["label"]).groupBy("label", "split").count().collect()}
    for label in {r[1] for r in groups} | {"y"}:
        assert tuple(found.get((label, s), 0) for s in ("train", "val", "test")) == want


def test_keep_first_of_many(spark):
    df = spark.createDataFrame([(k, "a" if k % 2 else None, k % 3) for k in range(30)], "id int, text string, more int")
    assert sorted(tuple(r) for r in curate.keep_first(df, ["text"], ["more", "id"]).collect()) == [(0, None, 0), (3, "a", 0)]
    assert curate.keep_first(df.select("text"), ["text"], ["text"]).count() == 2


def test_downsample_overshoots_by_one_group(spark):
    df = spark.createDataFrame([("x", f"g{i // 4}", i) for i in range(12)], "label string, group_id string, id int")
    assert curate.downsample_groups(df, {"x": 5}).count() == 8 and curate.downsample_groups(df, {}).count() == 12


def test_contradictions(spark):
    rows = [("a", "pali"), ("a", "sinhala"), ("b", "pali"), ("b", "mixed"), ("c", "mixed"), ("d", "pali"), ("e", "mixed"), ("e", "other"), ("f", "pali"), ("f", "other")]
    rows += [("g", "pali"), ("g", "mixed"), ("g", "other"), ("h", "pali"), ("h", None), (None, "pali"), (None, "sinhala"), ("i", "other"), ("i", "more")]
    df = spark.createDataFrame(rows, "text string, label string")
    kept = [("b", "pali"), ("c", "mixed"), ("d", "pali"), ("g", "other"), ("g", "pali"), ("h", None), ("h", "pali"), (None, "pali"), (None, "sinhala")]
    core, text = ["pali", "sinhala", "sanskrit"], lambda r: tuple(map(str, r))
    assert sorted(map(text, curate.resolve_contradictions(df, core, "mixed").collect())) == sorted(map(text, kept))
    masked = curate.drop_mask(df, core, "mixed", "a-z", 1).where("not drop").select("text", "label")
    assert sorted(map(text, masked.collect())) == sorted(text(r) for r in kept if r[0])
    assert curate.finalise(spark.createDataFrame([(None, "pali"), (" ", "pali"), ("ab", "pali")], "text string, label string"), Config()).count() == 1


def test_sequential_charge(spark):
    work = spark.createDataFrame([(1, 1, 1, 6.0), (1, 2, 2, 6.0), (1, 3, 3, 3.0), (2, 4, 1, 1.0)], "user_id int, job_id int, ord int, cost double")
    found = metering.sequential_charge(work, spark.createDataFrame([(1, 10.0), (2, 10.0)], "user_id int, balance double")).orderBy("job_id").collect()
    assert [(r.accepted, float(r.balance)) for r in found] == [(True, 4.0), (False, 4.0), (True, 1.0), (True, 9.0)]
    with pytest.raises(ValueError):
        metering.page(work, 0, 101)


def test_metrics_with_absent_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "true_label string, predicted_label string")
    found = {r.label: r for r in metrics.class_scores(df, ["a", "b", "z"]).collect()}
    assert found["z"].f1 == 0.0 and found["a"].recall == 0.5 and found["b"].fp == 1
    assert metrics.f1_where_supported(metrics.class_scores(df, ["z"])).first().f1 is None
    assert metrics.fit_verdict(0.9, 0.8) == "overfit"


def test_jsonl_errors(spark):
    rows = [(1, "{bad"), (2, '{"text": "a"}'), (3, '{"text": "a", "label": ""}'), (4, '{"text": " ", "label": "x"}'), (5, '{"text": "a", "label": "x"}')]
    found = [(r.number, r.error) for r in audit.jsonl_errors(spark.createDataFrame(rows, "number long, value string")).orderBy("number").collect()]
    assert found == [(1, "invalid JSON"), (2, "missing keys"), (3, "empty label"), (4, "empty text")]


def test_readers(spark, tmp_path):
    def put(name, content):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(at)

    usfx = put("x.xml", '<usfx><book id="MAT"><id>skip</id><c id="1"/><p><v id="1" bcv="MAT.1.1"/>one<ve/></p><p><v id="2"/>two <q>more</q></p><p>rest</p><c id="2"/><v id="1"/>three</book></usfx>')
    assert sorted(tuple(r) for r in readers.usfx(spark, usfx).collect()) == [("MAT", "1", "1", "one"), ("MAT", "1", "2", "two more rest"), ("MAT", "2", "1", "three")]
    put("books/My Book/My Book.txt", "a<psi>b<eos>c. d")
    put("books/My Book/metadata.json", json.dumps({"title": "T", "ocr_confidence": 0.5}))
    books = readers.book_dirs(spark, str(tmp_path / "books"))
    assert books.first().title == "T" and [tuple(r)[:2] for r in readers.book_sentences(books).collect()] == [("My_Book_00000", "ab"), ("My_Book_00001", "c."), ("My_Book_00002", "d")]
    put("books/Other/Other.txt", "one.\ntwo\nthree<eos>four\nfive")
    put("books/Other/metadata.json", json.dumps({"title": "O", "author": "X"}, indent=2))
    other = readers.book_dirs(spark, str(tmp_path / "books")).where("book = 'Other'").collect()
    assert [(r.title, r.author, r.text) for r in other] == [("O", "X", "one.\ntwo\nthree<eos>four\nfive")]
    blocks = put("b.txt", "# id = a.b.1\nx\t1\ny\t2\n\n# id = a.b.2\nz\t3\n")
    assert sorted(tuple(r) for r in readers.block_annotated(spark, blocks).collect()) == [("a.b.1", "x y"), ("a.b.2", "z")]
    matrix = put("m.bin", struct.pack("<qq6f", 2, 3, *range(6)))
    assert [tuple(r) for r in readers.dense_matrix(spark, matrix, 3).orderBy("row").collect()] == [("m.bin", 0, [0, 1, 2]), ("m.bin", 1, [3, 4, 5])]
    with pytest.raises(ValueError):
        readers.dense_matrix(spark, matrix, 2)
    pair = readers.paired_lines(spark, put("x.txt", "a\tb\nc\n"), put("y.txt", "l\nm\n"))
    assert [(r.text, r.label) for r in pair.orderBy("number").collect()] == [("a\tb", "l"), ("c", "m")]
    with pytest.raises(ValueError):
        readers.paired_lines(spark, put("x2.txt", "a\nb\nc\n"), str(tmp_path / "y.txt"))
    csv = put("c.csv", '﻿id,text,label\n1,"a\nb",NA\n')
    assert tuple(readers.csv(spark, csv, None, na_tokens=("NA",)).first())[1:] == ("a\nb", None)
    wiki = put("w.xml", "<mediawiki><page><title>T</title><revision><text>a [[b]]</text></revision></page></mediawiki>")
    assert tuple(readers.mediawiki(spark, wiki).first()) == ("T", "a b")
    assert readers.json_map(spark, put("mn1_x.json", '{"s1": "t1", "s2": "t2"}')).count() == 2
    assert sorted(tuple(r) for r in readers.json_map(spark, put("mn2_y.json", '{\n  "s1": "t1",\n  "s2": "t\\n2"\n}\n')).collect()) == [("mn2", "s1", "t1"), ("mn2", "s2", "t\n2")]
    assert readers.existing(spark, [csv, "/nowhere"], lambda p: readers.text_lines(spark, p)).count() == 3
    with pytest.raises(ValueError):
        readers.existing(spark, ["/nowhere"], None)


def test_line_numbers_of_files_in_blocks(spark, tmp_path):
    held = {"a.txt": [f"line {i} " + "x" * (i % 50) for i in range(4000)], "b.txt": ["only"], "c.txt": ["x", "", "y"]}
    for name, lines in held.items():
        (tmp_path / name).write_bytes("\r\n".join(lines).encode() + (b"\n" if name != "c.txt" else b""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = readers.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 4004
    for name, lines in held.items():
        assert sorted((r.number, r.value) for r in rows if r.file == name) == list(enumerate(lines, 1))


def test_heads_rates_and_scores(spark):
    head = spark.createDataFrame([("a", 0, [1.0, 2.0])], "label string, id int, weights array<double>")
    new = spark.createDataFrame([("c", 2), ("b", 1), ("a", 0)], "label string, position int")
    assert sorted((r.id, r.label, r.weights) for r in ml.extended_head(head, new).collect()) == [(0, "a", [1.0, 2.0]), (1, "b", [0.0, 0.0]), (2, "c", [0.0, 0.0])]
    rates = spark.createDataFrame([("t", "m1", 1.0, True), ("t", "m2", 2.0, True)], "model_type string, model_name string, rate double, is_active boolean")
    changes = spark.createDataFrame([("t", "m2", None, False), ("t", "m3", 3.0, None)], "model_type string, model_name string, rate double, is_active boolean")
    assert sorted(tuple(r) for r in metering.set_rates(rates, changes).collect()) == [("t", "m1", 1.0, True), ("t", "m2", 2.0, False), ("t", "m3", 3.0, True)]
    assert sorted(r.model_name for r in metering.active_rates(metering.set_rates(rates, changes), "t").collect()) == ["m1", "m3"]
    scores = spark.sql("SELECT map('a', 0.2D, 'c', 0.4D, 'b', 0.4D) AS m").select(ml.ranked_scores("m").alias("r")).first().r
    assert [(x.key, x.value) for x in scores] == [("b", 0.4), ("c", 0.4), ("a", 0.2)]


def test_issues_of_a_bad_corpus(spark):
    rows = [(1, "a", "l1", "s", "g", "train", True), (1, "a", "l2", "s", "g", "test", True), (2, " ", "l1", "s", "h", "train", False), (3, "ß long enough text", "l1", "s", None, "val", True), (4, "ß long enough text", "l1", "s", "i", None, True)]
    df = spark.createDataFrame(rows, "id long, text string, label string, source string, group_id string, split string, is_core boolean")
    held = auditing.summary(df, "ß-ß")
    found = auditing.issues(held).first()
    assert found.issues == ["CRITICAL: 1 groups in several splits", "WARNING: 2 rows with the same text and label", "INFO: 1 texts under several labels", "WARNING: 3 rows without the script", "WARNING: 1 repeated ids", "INFO: 3 short texts"]
    assert (found.groups, found.groups_in_train_test, found.groups_in_train_val, found.blank, found.core_rows) == (3, 1, 0, 1, 4)
    report = json.loads(auditing.report(held).first().report)
    assert report["core_balance"] == {"l1": 3, "l2": 1} and report["imbalance_ratio"] == 3.0 and report["leakage_check"] == "FAIL" and report["sources"] == {"s": 5}
    assert {(r.label, r.id) for r in auditing.examples(held).collect()} <= {("l1", "1"), ("l1", "3"), ("l1", "4"), ("l2", "1")}
    values = {(r.step, r.name, r.key): r.value for r in auditing.steps(held).collect()}
    assert values[12, "median", "l1"] == 9.5 and values[15, "median", ""] == 1.0 and values[5, "share", "l2"] == 25.0 and values[2, "nulls", "split"] == 1
    empty = auditing.summary(df.limit(0), "ß-ß")
    assert auditing.issues(empty).first().issues == [] and json.loads(auditing.report(empty).first().report)["total_rows"] == 0
    assert auditing.steps(empty).where("step = 11").count() == 2


def test_audit_reads_its_input_once(spark, tmp_path):
    """One scan of the table, whatever the number of steps."""
    spark.range(10).selectExpr("id", "'a' AS text").write.parquet(str(tmp_path / "t"))
    listed = spark._jsparkSession.sharedState().statusStore()
    before = listed.executionsCount()
    auditing.steps(auditing.summary(spark.read.parquet(str(tmp_path / "t")), "a-z")).collect()
    plans = [listed.executionsList().apply(k).physicalPlanDescription() for k in range(before, listed.executionsCount())]
    assert sum(p.count(f"Location: InMemoryFileIndex [file:{tmp_path}/t]") for p in plans) in (1, 2)  # adaptive plans show their first form too


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", "x"), ("c", "y")], "text string, label string")
    writers.training_lines(df, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["__label__x a b", "__label__y c"]
    writers.jsonl(df, str(tmp_path / "j"))
    assert readers.jsonl(spark, str(tmp_path / "j"), ["x"]).count() == 1
    at = str(tmp_path / "p")
    writers.parquet(df, at)
    writers.swap(spark, spark.read.parquet(at).where("label = 'x'"), at)
    assert spark.read.parquet(at).count() == 1 and sorted(os.listdir(tmp_path)) == ["j", "p", "t"]


def test_excluded_names_by_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).selectExpr("concat('r', id * 7, '_') AS part").union(spark.createDataFrame([("",), (None,)], "part string"))
    names = spark.range(2000).selectExpr("concat('x r', id, '_ y') AS name")
    want = {f"x r{k}_ y" for k in range(2000) if k % 7}
    for most in (filters.MOST_CHARS, 300_000):  # one automaton, and several
        assert {r.name for r in filters.excluded_names(names, "name", rules, most).collect()} == want


def test_excluded_names_by_many_rules(spark):
    rules = spark.range(1200).selectExpr("concat('part', id, '.') AS part").union(spark.createDataFrame([(None,), ("cafe\u0301",)], "part string"))
    names = spark.range(1200).selectExpr("concat('a part', id, '. b') AS name").union(spark.createDataFrame([(None,), ("a caf\u00e9",), ("part1",), ("part1",)], "name string"))
    assert sorted(r.name or "" for r in filters.excluded_names(names, "name", rules).collect()) == ["", "part1", "part1"]


def test_filters(spark):
    df = spark.createDataFrame([("123 4.5",), ("café rights",), ("plain",)], "name string")
    lines = spark.createDataFrame([("123 4.5",), ("(1, 2)",), ("෧෨\u00a0-:",), ("1 a",), ("",)], "name string")
    assert [r.name for r in lines.where(filters.numeric_line("name")).collect()] == ["123 4.5", "෧෨\u00a0-:"]
    assert lines.where(filters.numeric_line("name", ".,:;()")).count() == 2
    rules = spark.createDataFrame([("café",)], "part string")
    assert filters.excluded_names(df, "name", rules).count() == 2


class Toy:
    labels = ["a", "b"]

    def predict(self, texts):
        return [("a" if "a" in t else "b", 1.0) for t in texts]


def test_models(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["aba", "abb"] if i % 2 else ["xyx", "yyx"]) for _ in range(6)), "l1" if i % 2 else "l2") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = ml.fit_labels(df, ml.char_features(df, 1, 2, 50), 1, 2, steps=10)
    found = ml.predictions(model, df, 1, 2)
    assert metrics.accuracy(found, true="label").first().accuracy == 1.0
    assert ml.predictions(model, df.limit(1).withColumn("text", F.lit(" ")), 1, 2).first().predicted_label == "unknown"
    assert [tuple(r)[-2:] for r in ml.scored(df.select("text").limit(2), Toy).collect()] in ([("a", 1.0), ("b", 1.0)], [("b", 1.0), ("a", 1.0)])
    assert ml.robustness(df, lambda d: ml.predictions(model, d, 1, 2)).groupBy("k").count().count() == 3


def test_streams(spark, tmp_path):
    work = spark.createDataFrame([(1, 1, "A b. C d.", "sentence", "2024-01-01 00:00:00"), (2, 1, " ", "auto", "2024-01-01 00:01:00")], "job_id long, user_id long, text string, strategy string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    work.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(work.schema).parquet(str(tmp_path / "in"))
    query = jobs.run_jobs(stream, lambda d: d.withColumn("predicted_language", F.lit("x")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert {r.job_id: r.status for r in jobs.latest_states(spark, str(tmp_path / "out")).collect()} == {1: "completed", 2: "failed"}
    assert spark.read.parquet(str(tmp_path / "out/segments")).count() == 2
    events = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/events")).collect()]
    assert sorted((e["job_id"], e["step"], e["status"]) for e in events) == [(1, 0, "queued"), (1, 1, "processing"), (1, 2, "completed"), (2, 0, "queued"), (2, 1, "processing"), (2, 2, "failed")]
    at = str(tmp_path / "ev")
    spark.createDataFrame([(1, 1.0, "2024-01-01 00:00:00"), (1, 2.0, "2024-01-01 00:20:00"), (1, 4.0, "2024-01-01 09:00:00")], "user_id long, value double, ts string").selectExpr("user_id", "'x' AS event_type", "value", "CAST(ts AS timestamp) AS ts").coalesce(1).write.parquet(at)
    stream = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)
    for name, frame in (("sliding", jobs.usage_windows(stream, slide="30 minutes")), ("sessions", jobs.usage_sessions(stream))):
        query = frame.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert sorted(r.n for r in spark.sql("SELECT n FROM sessions").collect()) == [1, 2]
    assert spark.sql("SELECT sum(n) AS n FROM sliding").first().n == 6
    costs = work.select("user_id", "job_id", F.lit("600").cast("decimal(18,4)").alias("cost"), "ts")
    costs.write.parquet(str(tmp_path / "costs"))
    charged = jobs.charged(spark.readStream.schema(costs.schema).parquet(str(tmp_path / "costs")))
    query = charged.writeStream.format("memory").queryName("charged").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.accepted for r in spark.sql("SELECT accepted FROM charged ORDER BY job_id").collect()] == [True, False]


def test_entry_without_the_optional_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"]
    here = os.environ | {"PYTHONPATH": str(tmp_path)}
    found = subprocess.run(ask, cwd=tmp_path, env=here, capture_output=True, text=True)
    from corpusloom import catalogue

    assert found.stdout.split() == [str(len(catalogue.QUERIES)), "False", str(len(catalogue.ORACLE_SQL))], found.stderr
    # a part that is there but lacks a module of its own is an error
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    broken = subprocess.run(ask, cwd=tmp_path, env=here, capture_output=True, text=True)
    assert broken.returncode and "no_such_module" in broken.stderr
