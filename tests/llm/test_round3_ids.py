"""Ids of every low character, new words told without splitting them, and grammars whatever the number of slots."""

from collections import Counter

import numpy as np
import pytest
from corpusloom.llm import bpe, repair
from corpusloom.llm.encoding import Encoder

CHARACTERS = [*range(1, 0x260), 0x1E9E, 0x2126, 0x212A, 0x212B]


def test_every_low_character_is_encoded_as_by_the_library():
    """Some capitals have small letters beyond U+024F, where words were cut."""
    word, byte, tree = Encoder("word"), Encoder("byte"), bpe.SegmentTreeBpe()
    for text in (t for c in map(chr, CHARACTERS) for t in (f"a{c}b", f"A{c}1 x", f"{c}'s{c}")):
        want = word.whole(text)
        assert word.encode(text) == want and tree.encode(text).tobytes() == want, ascii(text)
        assert byte.encode(text) == byte.whole(text), ascii(text)


def test_words_of_letters_are_not_split():
    own = Encoder("word")

    class Counted:
        asked: list = []

        def findall(self, text, split=own.pieces.findall):
            self.asked.append(text)
            return split(text)

    own.pieces = Counted()
    assert own.encode("Uxora éblouitàß zq, x1") == own.whole("Uxora éblouitàß zq, x1")
    assert Counted.asked == [",", "x1", "1"]


@pytest.mark.parametrize("bits", [2, 18])
def test_slots_only_leave_out_rare_pairs(monkeypatch, bits):
    assert 8 << repair.SLOT_BITS <= 1 << 21  # counts that stay near the core
    monkeypatch.setattr(repair, "SLOT_BITS", bits)
    rng = np.random.default_rng(6)
    words = [rng.integers(10, 60, rng.integers(2, 7)) for _ in range(60)]
    ids = np.concatenate([words[k] for k in rng.zipf(1.4, 4000) % 60])
    rules, seq, last = repair.compress(ids, np.arange(len(ids)) % 50 == 49)
    use = repair.places_of_pairs(seq, last)
    assert max(Counter(zip(seq[:-1][use].tolist(), seq[1:][use].tolist(), strict=True)).values()) < repair.LEAST
    assert b"".join(repair.expansions(rules)[s] for s in seq.tolist()) == ids.astype("<u2").tobytes()
