import importlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from corpusloom.llm import common, minhash, pii, quality
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_linededup import tagged
from tests.llm.test_minhash import brute as brute_classes
from tests.llm.test_stores import check_packing

SMALL = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = common.read(spark, SMALL, "documents")
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        outs.append(common.write_table(stage(spark, docs if not outs else outs[-1], SMALL), name))
    for out in outs[:-1]:
        assert out.columns == columns
    good, lines, single, safe, packed = outs
    verdict = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == verdict and verdict
    want = brute_lines(tagged(spark, good))
    before = {r.doc_id: r.text for r in good.collect()}
    assert all(r.text == want[r.doc_id, before[r.doc_id]] and r.n_chars == len(r.text) for r in lines.collect())
    classes = brute_classes([(r.doc_id, r.text) for r in lines.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    old = {r.doc_id: r.text for r in single.collect()}
    assert len(old) == safe.count()
    for r in safe.collect():
        found = pii.find(old[r.doc_id])
        assert (r.text == old[r.doc_id]) == (not found)
        assert not any(old[r.doc_id][a:b] in r.text for a, b, _, _ in found)
    check_packing(packed.collect(), {r.doc_id: r.text for r in safe.collect()}, 1024)


def test_odd_documents(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "x " * 60, None, None, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for odd in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            odd_out = stage(spark, odd, SMALL)
            odd_out.collect()
    assert minhash.keep_one(docs).count() == 2


def test_entry_without_this_part(tmp_path):
    repo = Path(__file__).resolve().parent.parent.parent
    (tmp_path / "corpusloom").mkdir()
    for p in [*repo.glob("corpusloom/*"), repo / "__spark_entry__.py"]:
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / p.relative_to(repo)).symlink_to(p)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.strip() == "False"
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run
