"""The dump reader strips each page once, whatever the compression of the dump."""

import bz2
import gzip

import pytest
from corpusloom.catalogue import ORACLE_SQL, QUERIES
from corpusloom.functions import text as X
from corpusloom.sources import readers
from tests.oracle import mismatch


def test_pages_are_stripped_once(spark, tmp_path):
    (tmp_path / "w.xml").write_text("<mediawiki><page><title>T</title><revision><text>a [[b]]</text></revision></page></mediawiki>")
    plan = readers.mediawiki(spark, str(tmp_path / "w.xml"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(X.WIKI_TEMPLATE) == 1
    assert plan.count(X.WIKI_PAGES[0][0]) == 1


@pytest.mark.parametrize("kind", [bz2, gzip])
def test_compressed_dumps(spark, tmp_path, kind):
    """Pages without a text, or with nothing but markup, go."""
    texts = ["{{only}}", "", " \n", *(f"[[P|{k}]] {'x' * (k * 7919 % 3000)}" for k in range(1500))]
    pages = "".join(f"<page>\n<title>{k}</title><revision><text>{t}</text></revision></page>\n" for k, t in enumerate(texts)) + "<page><title>none</title></page>"
    path = tmp_path / ("w.xml.bz2" if kind is bz2 else "w.xml.gz")
    path.write_bytes(kind.compress(f"<mediawiki>\n{pages}</mediawiki>".encode()))
    found = sorted((int(r.title), r.text) for r in readers.mediawiki(spark, str(path)).collect())
    assert found == [(k + 3, f"{k} {'x' * (k * 7919 % 3000)}".strip()) for k in range(1500)]


def test_wiki_dump_scan(spark):
    assert mismatch(spark, QUERIES["wiki_dump_scan"], ORACLE_SQL["wiki_dump_scan"], "/root/testdata/sf0.001") is None
