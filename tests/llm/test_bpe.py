import random

import numpy as np
import pytest
from corpusloom.llm import bpe
from corpusloom.llm.encoding import Encoder

ALPHABET = "ab cDé1²'s\n\n\t .,!?  \xa0ß'tÀİ ll're\x85 \r\nªªµ¼ 12ǅ日本Σς"


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(7)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    return [*made, "", " ", "a<|endoftext|> b", "<|startoftext|>x<|", "ΟΔΟΣ", "éa", "x" * 3000, "the cat " * 4000]


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_encoder_equals_library(samples, kind):
    own = Encoder(kind)
    for text in samples:
        assert own.encode(text) == own.whole(text), text[:80]


def test_segment_tree_equals_library(samples):
    own, library = bpe.SegmentTreeBpe(), Encoder("word")
    for text in samples:
        ids = own.encode(text)
        assert ids.tobytes() == library.whole(text), text[:80]
        assert own.decode(ids) == library.library.decode(ids.tolist(), skip_special_tokens=False)


def test_long_pieces_equal_library():
    rng, own, library = random.Random(8), bpe.SegmentTreeBpe(), Encoder("word")
    for piece in ("a" * 100_000, "".join(rng.choice("aeionrst") for _ in range(100_000))):
        ids = own.encode(piece)
        assert ids.tobytes() == library.whole(piece)
        assert own.decode(ids) == library.library.decode(ids.tolist(), skip_special_tokens=False)


def test_query_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (4, "Hello world", "y"), (None, "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = {r.doc_id: r for r in bpe.encode_and_decode(docs).collect()}
    assert len(found) == 5 and bytes(found[1].ids) == b"" and found[2].decoded == ""
    assert found[3].ids == found[4].ids and found[3].decoded == "hello</w> world</w>"
    assert np.frombuffer(found[3].ids, "<u4").size == 2
    assert bpe.encode_and_decode(docs.limit(0)).count() == 0
