"""BPE encoding and decoding with a segment tree over adjacent pair ranks (operator 3).

Each piece of a text becomes a row of symbols; a segment tree over the ranks of adjacent pairs holds minima,
so the root names the lowest rank and a descent that prefers the left child finds its leftmost place. A merge
updates three leaves and their paths, until the root is infinite. Pieces recur, so workers remember them in a
memo of bounded size.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows give equal results;
a very long piece costs n log n; an empty table gives an empty table; only the key and text columns are read.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.encoding import PIECES, PLAIN, Remembered, byte_letters, texts

NEVER = 1 << 60
#: White space of Unicode (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
ANY_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
END = "</w>"


def merge_all(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the lowest-ranked pair, leftmost first, until none is left. pairs: to (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 1).bit_length()
    tree = [NEVER] * (2 * width)
    for i in range(n - 1):
        if (found := pairs.get((symbols[i], symbols[i + 1]))) is not None:
            tree[width + i] = found[0]
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    if tree[1] == NEVER:
        return symbols
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, rank: int) -> None:
        i = width + leaf
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while (rank := tree[1]) != NEVER:
        i = 1
        while i < width:
            i *= 2
            if tree[i] != rank:
                i += 1
        at = i - width
        gone = after[at]
        symbols[at] = pairs[symbols[at], symbols[gone]][1]
        symbols[gone] = -1
        nxt = after[at] = after[gone]
        put(gone, NEVER)
        if nxt < n:
            before[nxt] = at
            found = pairs.get((symbols[at], symbols[nxt]))
            put(at, found[0] if found else NEVER)
        else:
            put(at, NEVER)
        if (left := before[at]) >= 0:
            found = pairs.get((symbols[left], symbols[at]))
            put(left, found[0] if found else NEVER)
    return [s for s in symbols if s >= 0]


class SegmentTreeBpe:
    """Encoder and decoder for a vocabulary file of lower-cased word BPE with word ends."""

    def __init__(self, path: str | None = None):
        with open(path or public_tokenizers.path("word_bpe_49k.json")) as file:
            held = json.load(file)
        vocabulary = held["model"]["vocab"]
        self.first, self.last = ([vocabulary.get(x + end, -1) for x in byte_letters()] for end in ("", END))
        self.pairs = {}
        for rank, (a, b) in enumerate(held["model"]["merges"]):
            self.pairs[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.shown = {i: token for token, i in vocabulary.items()} | {i: token for token, i in self.special.items()}
        self.chunks = Remembered(self._chunk)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        symbols = [self.first[b] for b in raw[:-1]]
        symbols.append(self.last[raw[-1]])
        return array("H", merge_all([s for s in symbols if s >= 0], self.pairs)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        pieces = PIECES["word"].findall(chunk)
        if pieces == [chunk]:
            return self._piece(chunk)
        return b"".join(map(self.chunks.__getitem__, pieces))

    def _ordinary(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        if PLAIN.fullmatch(shown := text.lower()):  # small letters of some capitals lie beyond U+024F
            return b"".join(map(self.chunks.__getitem__, shown.split()))
        lower = "".join(c.lower() for c in text)
        return b"".join(map(self._piece, ANY_PIECES.findall(lower)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text; the special tokens' strings become their ids."""
        parts = self.split.split(text) if "<|" in text else [text]
        found = [array("H", [self.special[p]]).tobytes() if k % 2 else self._ordinary(p) for k, p in enumerate(parts)]
        return np.frombuffer(b"".join(found), "<u2")

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by blanks: the vocabulary names no decoder."""
        return " ".join(map(self.shown.__getitem__, ids.tolist()))


@cache
def model(path: str | None) -> SegmentTreeBpe:
    return SegmentTreeBpe(path)


def encode_and_decode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, ids (binary: little-endian unsigned 32-bit integers), decoded (string from those ids)."""

    def run(batches):
        bpe = model(path)
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                found = [bpe.encode(t) for t in texts(part, text)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()), pa.array(map(bpe.decode, found), pa.string())],
                    names=[key, "ids", "decoded"],
                )

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary, decoded string")
