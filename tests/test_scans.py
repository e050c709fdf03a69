"""Scans of files in blocks: equal to a plain reader of the whole file, however small the blocks are."""

import random
import re
import xml.etree.ElementTree as ET

import pytest
from corpusloom.sources import readers, scans


@pytest.fixture(params=["1000", "128m"])
def blocks(spark, request):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in held.items():
        spark.conf.set(k, v)


def verses(xml):
    """By the whole tree."""
    book = chapter = verse = None
    out, parts, skip = [], [], set()
    root = ET.fromstring(xml)
    for e in root.iter():
        if e in skip:
            parts += [e.tail or ""] if False else []
            continue
        if e.tag in ("book", "c", "v", "ve"):
            if verse is not None:
                out.append((book or "", chapter or "", verse, " ".join(" ".join(parts).split())))
            verse, parts = None, []
        if e.tag == "book":
            book, chapter = e.get("id"), None
        elif e.tag == "c":
            chapter = e.get("id")
        elif e.tag == "v":
            verse = e.get("id")
            if e.get("bcv", "").count(".") == 2:
                book, chapter, verse = e.get("bcv").split(".")
            parts.append(e.tail or "")
        elif e.tag in ("id", "h", "toc"):
            skip |= set(e.iter()) - {e}
            parts.append(e.tail or "")
        elif e.tag != "ve":
            parts += [e.text or "", e.tail or ""]
    if verse is not None:
        out.append((book or "", chapter or "", verse, " ".join(" ".join(parts).split())))
    return [v for v in out if v[3]]


def milestone_file(rng, n):
    out = ["<?xml version='1.0'?>\n<usfx>"]
    for k in range(n):
        kind = rng.random()
        if kind < 0.1:
            out.append(f'<book id="B{k}"/><id>Title <b>of</b> it</id>')
        elif kind < 0.25:
            out.append(f'<c id="{k}"/>')
        elif kind < 0.35:
            out.append("<ve/>between <p>more</p>")
        else:
            own = f" bcv='X{k}.{k % 7}.{k % 5}'" if kind < 0.5 else ""
            out.append(f"<v id=\"{k}\"{own} title='a > b'/>word{k} " + rng.choice(["<p>a &lt;b&gt; &amp;lt;</p>", "<toc>t</toc> rest", "<!-- note -->c", "<![CDATA[d > e]]>f", "", "é ක\n", "x" * 700]))
    return "".join([*out, "</usfx>"])


def test_milestones_in_blocks(spark, blocks, tmp_path):
    rng, want = random.Random(3), []
    for k in range(3):
        xml = milestone_file(rng, 150)
        (tmp_path / f"{k}.xml").write_text(xml)
        # the tree drops comments and joins what stands beside them
        want += verses(re.sub("<!-- note -->", " ", xml).replace("<![CDATA[d > e]]>f", "d &gt; ef"))
    found = [tuple(r) for r in scans.usfx(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(want)


def test_annotated_blocks(spark, blocks, tmp_path):
    rng, want = random.Random(4), []
    for k in range(2):
        text = "loose\tx\n"
        for i in range(120):
            words = [rng.choice(["a", "bb", "#c", "é"]) * rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
            text += f"# id = {k}.{i}\r\n" + "".join(f"{w}\t{j}\n" + rng.choice(["", "\n", " \n"]) for j, w in enumerate(words))
            want += [(f"{k}.{i}", " ".join(words))] if words else []
        (tmp_path / f"{k}.txt").write_bytes(text.encode())
    assert sorted(tuple(r) for r in readers.block_annotated(spark, str(tmp_path)).collect()) == sorted(want)


def test_books(spark, blocks, tmp_path):
    rng, want = random.Random(5), []
    for name in ("One", "My Book"):
        (tmp_path / name).mkdir()
        said = [rng.choice(["a. b", "c<psiX>d", " ", "é! ", "w" * 400, "\n"]) for _ in range(60)]
        text = "<eos>".join(said) + "<eos>last one? yes॥ no। end"
        (tmp_path / name / f"{name}.txt").write_text(text)
        parts = [" ".join(s.replace("<psiX>", "").split()) for s in said]
        parts = [p for p in parts if p] + ["last one?", "yes॥", "no।", "end"]
        want += [(f"{name.replace(' ', '_')}_{n:05d}", p) for n, p in enumerate(parts)]
    assert sorted(tuple(r) for r in scans.book_sentences(spark, str(tmp_path)).collect()) == sorted(want)


def test_lines(spark, blocks, tmp_path):
    held = [f"line {i} " + "x" * (i % 50) for i in range(300)]
    (tmp_path / "a.txt").write_text("\n".join(held))
    assert sorted((r.number, r.value) for r in scans.lines(spark, str(tmp_path)).collect()) == list(enumerate(held, 1))
