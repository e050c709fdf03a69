"""Texts that are encoded together: as by the library, and each distinct chunk is looked up once."""

from collections import Counter
from unittest.mock import MagicMock

import pyarrow as pa
import pytest
from corpusloom.llm import encoding, repair
from corpusloom.llm.encoding import Encoder

BLANKS = [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x85", "\xa0"]
WORDS = ["", "a", "Foo", "it's", "'s", "x,", "(y)", ",.", "é", "Ɓ", "日本", "é", "12", "<|endoftext|>"]
TEXTS = ["", *BLANKS, *(f"{w}{a}{b}{v}" for a in BLANKS for b in ["", *BLANKS] for w in WORDS for v in ("b", "'s", "", ".")), "One two, three\nTwo two, one.\n\nThree (two)\n one", "\none\n", "two\n"]


@pytest.mark.parametrize("kind", ["word", "byte"])
@pytest.mark.parametrize("together", [1, 40, 1 << 24])
def test_texts_together_are_encoded_as_by_the_library(monkeypatch, kind, together):
    monkeypatch.setattr(encoding, "TOGETHER", together)
    own = Encoder(kind)
    assert [k for k, _ in own.encode_all(enumerate(TEXTS))] == list(range(len(TEXTS)))
    for text, (_, ids) in zip(TEXTS, own.encode_all(enumerate(TEXTS)), strict=True):
        assert ids == own.whole(text) == own.encode(text), ascii(text)
    assert list(own.encode_all([])) == []


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_chunks_are_looked_up_once(kind):
    own, asked = Encoder(kind), Counter()

    class Counted(type(own.chunks)):
        def __getitem__(self, chunk):
            asked[chunk] += 1
            return super().__getitem__(chunk)

    own.chunks = Counted(own._chunk)
    texts = ["alpha beta\ngamma beta alpha", "beta alpha\ngamma", None] * 50
    for k, ids in own.encode_all((k, t or "") for k, t in enumerate(texts)):
        assert ids == own.whole(texts[k] or "")
    assert max(asked.values()) == 1 and not any("\n" in c for c in asked)


def test_words_that_a_line_end_parts_are_not_remembered_as_one():
    own = Encoder("byte")
    own.encode("alpha beta\ngamma delta\nalpha")
    assert not any("\n" in c for c in own.chunks)


def test_shards_are_made_of_texts_encoded_together(monkeypatch):
    """All batches of a task reach the encoder as one stream; the shards hold what the library says."""
    own, taken = Encoder("word"), []

    class Together:
        def encode_all(self, rows):
            taken.append(list(rows))
            return own.encode_all(taken[-1])

    docs = MagicMock()
    docs.sparkSession.conf.get.return_value = "1"
    rows = docs.select.return_value.repartitionByRange.return_value.sortWithinPartitions.return_value
    monkeypatch.setattr(repair, "encoder", lambda kind, path: Together())
    monkeypatch.setattr(repair, "write_blocks", lambda *a, **b: None)
    monkeypatch.setattr(repair, "TaskContext", MagicMock(get=lambda: MagicMock(partitionId=lambda: 3)))
    monkeypatch.setattr(repair, "SHARD", 12)
    repair.write_shards(docs, "nowhere")
    texts = ["one two three", None, "two 日本 one", "one, two\nthree four five", "", "six"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([k, k + 1]), "text": pa.array(texts[k : k + 2])}) for k in range(0, 6, 2)]
    made = [s for b in rows.mapInArrow.call_args.args[0](iter(batches)) for s in repair.shards(b.column(0)[0].as_py())]
    assert taken == [[(k, t or "") for k, t in enumerate(texts)]] and len(made) > 1
    found = [s.decode(k).tobytes() for s in made for k in range(len(s.doc_ids))]
    assert found == [own.whole(t or "") + b"\x02\0" for t in texts]
