"""Fast exact encoding with the tokenizers library: chunks between blanks are encoded once and remembered.

A chunk is what stands between two blanks. Neither tokenizer lets a token span a blank, so a text's ids
are its chunks' ids in a row. Texts where that needs care (special tokens, runs of blanks, letters beyond
U+024F) go to the library whole, so results equal those of the library in every case.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Letters and numbers below U+0250, as \p{L} and \p{N} have them (fixed values).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
PLAIN = re.compile("[^\x1c-\x1fɐ-\U0010ffff]*")
#: The two public pre-tokenizers, over characters below U+0250 (fixed values).
PIECES = {
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"),
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"),
}
#: Two characters of white space in a row; elsewhere a line end is a piece of its own.
DOUBLE_SPACE = re.compile(r"\s\s")
#: Stand before the first chunk of a text and that of a later line (not in plain texts).
TEXT_START, LINE_START = "\x1c", "\x1d"
#: Characters of the texts whose chunks are looked up together.
TOGETHER = 1 << 24
#: The two bytes of each id.
TWO_BYTES = [i.to_bytes(2, "little") for i in range(1 << 16)]
LONGEST = 48
FULL = 500_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


class Remembered(dict):
    """A memo of two generations: when the newer is full it becomes the older one."""

    def __init__(self, make, most: int = 500_000):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of whole texts as little-endian unsigned 16-bit integers (both vocabularies have under 65,536)."""

    def __init__(self, kind: str, path: str | None = None):
        self.kind = kind
        self.path = path or public_tokenizers.path({"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}[kind])
        self.library = Tokenizer.from_file(self.path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.table = {b: letter for b, letter in enumerate(byte_letters())}
        self.words = Remembered(self._word, FULL)
        self.chunks = Remembered(self._chunk, FULL)
        self.pieces = PIECES[kind]

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            shown = word.replace(" ", "\u0120")
        else:
            shown = word.encode().decode("latin-1").translate(self.table)
        tokens = self.model.tokenize(shown)
        return TWO_BYTES[tokens[0].id] if len(tokens) == 1 else b"".join([TWO_BYTES[t.id] for t in tokens])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b"" if self.kind == "word" else self.words[" "]
        if self.kind == "word":
            if chunk.isalpha():  # one piece: below U+0250 these are LETTERS
                return self._word(chunk)
            if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
                return self.chunks[chunk[:-1]] + self.chunks[chunk[-1]]
            pieces = self.pieces.findall(chunk)
        else:
            if chunk.isalpha():
                return self._word(" " + chunk)
            if chunk[:-1].isalpha() and chunk[-1] in ",.;:!?":
                return self.chunks[chunk[:-1]] + self.words[chunk[-1]]
            if chunk[0] in (TEXT_START, LINE_START):  # no blank before it
                line_end = self.words["\n"] if chunk[0] == LINE_START else b""
                return line_end + b"".join(map(self.words.__getitem__, self.pieces.findall(chunk[1:])))
            first, *rest = self.pieces.findall(" " + chunk)
            if not rest:
                return self._word(first)
            head = self.chunks[first[1:]] if first[0] == " " and len(first) > 1 else self.words[first]
            return head + b"".join(map(self.words.__getitem__, rest))
        if pieces == [chunk]:
            return self._word(chunk)
        return b"".join(map(self.chunks.__getitem__, pieces))

    def whole(self, text: str) -> bytes:
        """By the library alone."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def chunked(self, text: str) -> str | None:
        """The text as chunks between blanks, or None where only the library will do."""
        shown = text.lower() if self.kind == "word" else text  # small letters of some capitals lie beyond U+024F
        if not PLAIN.fullmatch(shown) or any(s in text for s in self.special):
            return None
        if self.kind == "word":
            return shown.replace("\n", " ") if unicodedata.is_normalized("NFC", text) else None
        if "  " in text:
            return None
        if "\n" in text and not DOUBLE_SPACE.search(text):  # else words that a line end parts would be remembered as one
            text = text.replace("\n", " " + LINE_START)
        return TEXT_START + text

    def encode(self, text: str) -> bytes:
        chunks = self.chunked(text)
        return self.whole(text) if chunks is None else b"".join(map(self.chunks.__getitem__, chunks.split(" ")))

    def encode_all(self, rows: Iterable[tuple[Any, str]]) -> Iterator[tuple[Any, bytes]]:
        """As encode, for many texts with keys: each distinct chunk of those taken together is looked up once."""
        held, chars = [], 0
        for row in rows:
            held.append(row)
            chars += len(row[1])
            if chars >= TOGETHER:
                yield from self._together(held)
                held, chars = [], 0
        if held:
            yield from self._together(held)

    def _together(self, rows: list[tuple[Any, str]]) -> Iterator[tuple[Any, bytes]]:
        chunked = [None if len(t) > TOGETHER else self.chunked(t) for _, t in rows]
        split = pc.split_pattern(pa.array([c for c in chunked if c is not None], pa.string()), " ")
        found = split.flatten().dictionary_encode()
        ids = pa.array(map(self.chunks.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)), pa.binary()).take(found.indices)
        _, ends, data = ids.buffers()
        edges = np.frombuffer(ends, "<i4")[split.offsets.to_numpy()].tolist() if len(ids) else [0]
        data, k = memoryview(data or b""), 0
        for (key, text), chunks in zip(rows, chunked, strict=True):
            if chunks is None:
                yield key, self.encode(text)
            else:
                yield key, bytes(data[edges[k] : edges[k + 1]])
                k += 1


@cache
def encoder(kind: str, path: str | None = None) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(kind, path)


def keyed_texts(batches) -> Iterator[tuple[Any, str]]:
    """doc_id and text of every row."""
    for batch in batches:
        yield from zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)


def texts(batch, column: str = "text") -> Iterable[str]:
    """A batch's texts; null counts as empty."""
    return ("" if t is None else t for t in batch.column(column).to_pylist())
