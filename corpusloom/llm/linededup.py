"""Removal of repeated and nearly repeated lines by an exact set-similarity join (operator 7).

A line is the set of its lower-cased words, parted by ASCII white space. Lines with equal sets form a class; a class goes if a class that
occurs earlier (by document, then line) has a Jaccard similarity of 0.8 or more, and of every class only its first
line stays. Words are ordered by rarity, so the prefix of a line holds its rarest words: two similar lines share
one of them. The length and positional filters thin out the candidates and the word sets decide.

Rarity comes from a sketch of fixed size (a count for each of 2**24 slots of word hashes, 16 MB), which only
orders words and skips those that stand in one line; it loses no pair. Of lines that share a prefix word, each is
first held against the earliest few, and only lines that stay unmatched go on to the next ones, so a word with
many nearly equal lines costs a few comparisons a line. The lines of a very frequent
word are dealt into parts: a line first meets those of its own part, and only if it stays unmatched it visits the
other parts, so no task holds all lines of a word. Prefix words are dealt out in blocks whose number grows with the
words, many to a row; later rounds work on plain rows of the words that are still open, which the first round leaves.

Words are told by 64-bit hashes, equal word sets by 128 bits over those. The 40 bits of a word that name its group of
candidates can only add candidates; the word sets decide.

Defined cases: null texts stay null; lines without words stay; a text may become empty; null doc_ids come first;
rows with the same doc_id and text count as one document and are treated alike; an empty table gives an empty
table; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bits import bit_filter, wanted
from corpusloom.llm.common import write_table

#: Similarity of 4/5 in integers: with sizes a and b, the overlap is at least 4 (a + b) / 9.
SLOTS, SLOT_BLOCK = 1 << 24, 1 << 16
#: Lines of a frequent word in a part, by the counts of the sketch.
SPLIT = 100_000
#: A line of more than so many words has 2, 4, 8, ... words of 64 odd bits.
WIDER = (72, 176, 400, 900, 1900, 4000)
MASK40 = (1 << 40) - 1
#: Alike partners of a line and word that are verified first, and by how many times more in each later round.
FIRST_ROUND, GROWTH, MOST_AT_ONCE = 2, 128, 1000
#: Lines of a word that are held in memory at a time.
HEAD = 200_000
#: Rows of the index in a row that is shuffled, and in memory before they are; words of lines in a block.
PACKED, FLUSH, BLOCK_WORDS = 500, 400_000, 1_000_000
BITS = 1 << 26
CLASSES = 200_000
TOGETHER = 40_000
#: Rows of whole blocks that are sorted and compared at a time.
SORTED = 150_000
#: Documents whose numbers are broadcast.
FEW_DOCS = 100_000
LINE = "doc long, tag long, line int"
U = np.uint64
#: White space that parts words, besides line ends.
PARTS = np.zeros(256, bool)
PARTS[[*range(9, 14), *range(28, 33)]] = True
BASE = 0x9E3779B97F4A7C15
#: Texts of up to so many bytes share a table of powers; longer ones up to REACH have one made for them.
USUAL, REACH = 1 << 20, 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (finalizer of a public generator; fixed values)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        found = np.full(n, base, U)
        found[0] = 1
        made.append(np.cumprod(found, dtype=U))
    return made[0], made[1]


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line number of each word of a text in UTF-8: polynomials over the bytes, for all words at once."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) >= REACH:  # one very long line: word by word
        found = [(k, w) for k, line in enumerate(raw.split(b"\n")) for w in line.translate(SPACED).split()]
        sums = np.array([sum(c * pow(BASE, i, 1 << 64) for i, c in enumerate(w)) % (1 << 64) for _, w in found], U)
        return mixed(sums + np.array([len(w) for _, w in found], U)), np.array([k for k, _ in found], np.int64)
    up, down = powers(USUAL if len(data) < USUAL else REACH)
    blank = np.frombuffer(b"\1" + raw.translate(BLANK) + b"\1", bool)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(data * up[: len(data)], out=sums[1:], dtype=U)
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    # words before each line end
    before = np.concatenate([[0], np.searchsorted(starts, np.flatnonzero(data == 10)), [len(starts)]])
    return hashes, np.repeat(np.arange(len(before) - 1), np.diff(before))


BLANK = PARTS.tobytes()
SPACED = bytes(32 if PARTS[c] else c for c in range(256))


class Lines:
    """The word sets of the lines of some documents, each in the order of rarity; lines without words are left out."""

    def __init__(self, parts: list[tuple[int, int, int, list[str]]], rarity: np.ndarray | None):
        counts = [len(p[3]) for p in parts]
        hashes, owner = hashed_words("\n".join([x for p in parts for x in p[3]]).lower().encode())
        key = (owner.astype(U) << U(48)) | (hashes & U(MASK40))
        if rarity is not None:
            key |= rarity[hashes & U(SLOTS - 1)].astype(U) << U(40)
        order = np.argsort(key)
        key, hashes = key[order], hashes[order]
        again = key[1:] == key[:-1]
        if (again & (hashes[1:] != hashes[:-1])).any():  # different words with 40 bits in common
            order = np.lexsort((hashes, key))
            key, hashes = key[order], hashes[order]
            again = (key[1:] == key[:-1]) & (hashes[1:] == hashes[:-1])
        if again.any():
            fresh = np.concatenate([[True], ~again])
            key, hashes = key[fresh], hashes[fresh]
        line = (key >> U(48)).astype(np.int64)
        self.start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        self.size, full = np.diff(np.append(self.start, len(line))), line[self.start]
        self.owner = np.repeat(np.arange(len(full)), self.size)
        self.rank = (key >> U(40)) & U(255)
        self.word = (key & U(MASK40)).astype(np.int64)
        of = np.repeat(np.arange(len(parts)), counts)[full] if len(full) else np.zeros(0, np.int64)
        before = np.cumsum(counts) - counts
        self.doc, self.tag, begin = (np.array([p[k] for p in parts], np.int64)[of] for k in (0, 1, 2))
        self.line = (begin + full - before[of]).astype(np.int32)
        self.each = mixed(hashes + U(1))
        if len(full):
            #: equal sets have equal sums
            self.name = mixed(np.add.reduceat(self.each, self.start) + self.size.astype(U)).astype(np.int64)
        else:
            self.name = np.zeros(0, np.int64)

    @property
    def check(self) -> np.ndarray:
        """Another sum, for equal sets."""
        return np.add.reduceat(mixed(self.each ^ U(BASE)), self.start).astype(np.int64) if len(self.size) else np.zeros(0, np.int64)

    def odd_bits(self) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
        """Bit k of a line tells whether an odd number of its words falls on it; a differing bit tells of a differing word.

        Two words of 64 bits for each line (the second is 0 for short ones); long lines also have all their bits.
        """
        one, high = U(1) << (self.each >> U(58)), (self.each >> U(57)) & U(1)
        second = (high > 0) & (self.size > WIDER[0])[self.owner]
        odd, more = (np.bitwise_xor.reduceat(np.where(x, one, U(0)), self.start) if len(self.size) else np.zeros(0, U) for x in (~second, second))
        wide: list[bytes | None] = [None] * len(self.size)
        for k in np.flatnonzero(self.size > WIDER[1]).tolist():
            part = slice(int(self.start[k]), int(self.start[k] + self.size[k]))
            bits = np.zeros(width(int(self.size[k])), U)
            # the last bit of the number of a word is that of the two words
            np.bitwise_xor.at(bits, (high[part] | ((self.each[part] >> U(32)) & U(len(bits) // 2 - 1)) << U(1)).astype(np.int64), one[part])
            wide[k] = bits.tobytes()
        return odd.astype(np.int64), more.astype(np.int64), wide


def width(size: int) -> int:
    """Words of 64 odd bits of a line."""
    return 1 << sum(size > x for x in WIDER)


def far(a: bytes, b: bytes, most: int) -> bool:
    """Whether the odd bits of two long lines differ in more than so many places."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    if len(x) != len(y):  # the longer one is folded
        n = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum()) > most


def in_parts(batches, most: int = 60_000) -> Iterator[list[tuple[int, int, int, list[str]]]]:
    """(doc, tag, number of the first line, lines) of some documents at a time, with at most so many lines."""
    for batch in batches:
        part, room, chars = [], most, 0
        for doc, tag, text in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").to_pylist(), strict=True):
            lines, at = [] if text is None else text.split("\n"), 0
            while at < len(lines):
                part.append((doc, tag, at, lines[at : at + room]))
                taken = len(part[-1][3])
                at, room = at + taken, room - taken
                chars += len(text)
                if not room or chars > 600_000:
                    yield part
                    part, room, chars = [], most, 0
        if part:
            yield part


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tag (of the text) and text of every row."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("tag"), "text")


COUNTED = f"block int, at binary, n binary, class long, check long, {LINE}"


def counted(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: each line with words (class, check, doc, tag, line), and the slots that a task has counted (block)."""
    names = ["block", "at", "n", "class", "check", "doc", "tag", "line"]

    def run(batches):
        found = np.zeros(SLOTS, np.uint16)
        pending: list[np.ndarray] = []

        def settle() -> None:
            slots, n = np.unique(np.concatenate(pending), return_counts=True)
            found[slots] = np.minimum(found[slots] + n, 65_535).astype(np.uint16)
            pending.clear()

        for part in in_parts(batches):
            lines = Lines(part, None)
            pending.append((lines.word & (SLOTS - 1)).astype(np.uint32))
            if sum(map(len, pending)) > 2_000_000:
                settle()
            n = len(lines.name)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *map(pa.array, (lines.name, lines.check, lines.doc, lines.tag, lines.line))], names=names)
        if pending:
            settle()
        for block in range(0, SLOTS, SLOT_BLOCK):
            at = np.flatnonzero(found[block : block + SLOT_BLOCK]).astype("<u2")
            if len(at):
                values = [pa.array([block // SLOT_BLOCK], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([found[block : block + SLOT_BLOCK][at].astype("<u2").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*values, *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.int32())], names=names)

    return docs.mapInArrow(run, COUNTED)


def rarity(rows: DataFrame) -> tuple[np.ndarray, int]:
    """For each slot 0 (its word stands in one line) or 1 + 8 log2 of its lines, from rows of counted(); and the sum over all slots."""

    def summed(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                total = blocks.setdefault(r["block"], np.zeros(SLOT_BLOCK, np.int64))
                total[np.frombuffer(r["at"], "<u2")] += np.frombuffer(r["n"], "<u2")
        for block, total in blocks.items():
            level = np.where(total > 1, np.minimum(255, 1 + 8 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=["block", "level", "n"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = rows.where("block is not null").select("block", "at", "n").repartition(parts, "block").mapInArrow(summed, "block int, level binary, n long")
    out, n = np.zeros(SLOTS, np.uint8), 0
    for r in made.collect():  # at most 256 blocks of 64 KB
        out[r.block * SLOT_BLOCK : (r.block + 1) * SLOT_BLOCK] = np.frombuffer(r.level, np.uint8)
        n += r.n
    return out, n


NUMBERS = ("key", "part", "class", "doc", "tag", "line", "size", "odd", "odd2")
INDEX = f"{', '.join(f'{c} long' for c in NUMBERS)}, wide binary"
FOUND = f"later long, word long, earlier array<long>, more boolean, beyond boolean, {INDEX}"
#: The key holds the word above and, in this many bits, its rank in the line.
RANK_BITS = 23


def repeated_ids(lines: DataFrame):
    """A filter that the docs with several tags pass: only among their lines the tag decides the order."""
    return bit_filter(lines.groupBy("doc").agg(F.min("tag").alias("x"), F.max("tag").alias("y")).where("x != y"), "doc")


def part_of(level: np.ndarray, name: np.ndarray, most: int) -> np.ndarray:
    """The part of a word's lines that a class belongs to: parts << 32 | part, or 0 for a word in one part."""
    parts = np.ceil(2.0 ** ((level.astype(np.float64) - 1) / 8) / most).astype(np.int64)
    return np.where(parts > 1, (parts << 32) | (mixed(name.view(U) ^ U(BASE)) % np.maximum(parts, 1).astype(U)).astype(np.int64), 0)


def wide_bytes(size: np.ndarray) -> np.ndarray:
    """Bytes of all odd bits of lines; short ones have none."""
    return np.where(size > WIDER[1], 8 << sum((size > x).astype(np.int64) for x in WIDER), 0)


def prefix_words(batches, known, repeated, words, most: int) -> Iterator[tuple[np.ndarray, dict[int, bytes]]]:
    """Rows of INDEX, a column of the array for each, and wide bits by row: the prefix words of the least line of a class in a task.

    words: a filter that they have to pass. The tag is 0 where the doc alone tells the document (not in the filter
    repeated), so that it packs well.
    """
    least: dict[int, tuple] = {}
    for part in in_parts(batches):
        lines = Lines(part, known.value)
        n = len(lines.name)
        if not n:
            continue
        fresh = np.zeros(n, bool)
        for k, (name, place) in enumerate(zip(lines.name.tolist(), zip(lines.doc.tolist(), lines.tag.tolist(), lines.line.tolist(), strict=True), strict=True)):
            if name not in least or place < least[name]:
                if len(least) >= CLASSES:
                    least.clear()
                least[name] = place
                fresh[k] = True
        prefix = np.where(fresh, lines.size - (4 * lines.size + 4) // 5 + 1, 0)
        at = np.arange(int(prefix.sum())) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        use = np.repeat(lines.start, prefix) + at
        kept = lines.rank[use] > 0
        if words is not None:
            kept &= wanted(words.value, lines.word[use])
        use, at = use[kept], at[kept]
        own = lines.owner[use]
        tag = np.where(wanted(repeated.value, lines.doc), lines.tag, 0)
        odd, odd2, wide = lines.odd_bits()
        made = [(lines.word[use] << RANK_BITS) | at, part_of(lines.rank[use], lines.name[own], most), lines.name[own], lines.doc[own], tag[own], lines.line[own], lines.size[own], odd[own], odd2[own]]
        yield np.stack([c.astype(np.int64) for c in made]), {int(k): wide[own[k]] for k in np.flatnonzero(lines.size[own] > WIDER[1])}


def emitted(docs: DataFrame, known, repeated, blocks: int, words=None) -> DataFrame:
    """The rows of prefix_words() by block, some hundred in a row: all of a word's part fall in one block.

    So Spark deals out and sorts few rows; the tasks that get a block sort it (indexed()).
    """

    most = SPLIT

    def run(batches):
        held, wides, n = [], {}, 0

        def flush():
            columns = np.concatenate(held, axis=1)
            block = (mixed((columns[0] >> RANK_BITS).astype(U) ^ mixed(columns[1].astype(U))) % U(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            columns, block = columns[:, order], block[order]
            long = np.flatnonzero(columns[NUMBERS.index("size")] > WIDER[1])
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])).tolist()
            pieces = [(i, min(i + PACKED, end)) for begin, end in zip(edges, edges[1:], strict=False) for i in range(begin, end, PACKED)]
            # wide bits stand behind the numbers; sizes tell their lengths
            tails = [b"".join(wides[k] for k in order[long[slice(*np.searchsorted(long, (i, j)))]].tolist()) for i, j in pieces] if len(long) else [b""] * len(pieces)
            data = [columns[:, i:j].tobytes() + tail for (i, j), tail in zip(pieces, tails, strict=True)]
            at = pa.array(block[[i for i, _ in pieces]], pa.int32())
            made = pa.RecordBatch.from_arrays([at, pa.array([j - i for i, j in pieces], pa.int32()), pa.array(data, pa.binary())], names=["block", "n", "data"])
            held.clear()
            wides.clear()
            yield from (made.slice(i, 500) for i in range(0, len(pieces), 500))

        for columns, wide in prefix_words(batches, known, repeated, words, most):
            if not columns.shape[1]:
                continue
            held.append(columns)
            wides |= {n + k: bits for k, bits in wide.items()}
            n += columns.shape[1]
            if n >= FLUSH:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    return docs.mapInArrow(run, "block int, n int, data binary")


def indexed(batches) -> Iterator[dict[str, np.ndarray]]:
    """Columns of INDEX from rows of emitted() in the order of blocks: whole blocks, in the order of word, part and place."""
    held, n, last = [], 0, None
    for batch in batches:
        for block, count, data in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "data")), strict=True):
            if block != last and n >= SORTED:
                yield in_order(held)
                held, n = [], 0
            held.append((count, data))
            n, last = n + count, block
    if n:
        yield in_order(held)


def in_order(held: list[tuple[int, bytes]]) -> dict[str, np.ndarray]:
    """The rows of some blocks, in the order of word, part and place."""
    numbers = np.concatenate([np.frombuffer(data, np.int64, len(NUMBERS) * n).reshape(len(NUMBERS), n) for n, data in held], axis=1)
    new = dict(zip(NUMBERS, numbers, strict=True))
    wide = np.full(numbers.shape[1], None, object)
    row = 0
    for n, data in held:
        at = 8 * len(NUMBERS) * n
        if len(data) > at:
            lengths = wide_bytes(new["size"][row : row + n])
            for k in np.flatnonzero(lengths).tolist():
                wide[row + k] = data[at : at + int(lengths[k])]
                at += int(lengths[k])
        row += n
    word, low, high = new["key"] >> RANK_BITS, int(new["doc"].min()), int(new["doc"].max())
    if not new["tag"].any() and high - low < 1 << 39 and int(new["line"].max()) < 1 << 24:
        # one number for a place; its rank and the word make another one
        place = np.argsort(((new["doc"] - low) << 24) | new["line"])
    else:
        place = np.lexsort((new["line"], new["tag"], new["doc"]))
    if new["part"].any() or len(word) >= 1 << 23:
        order = place[np.lexsort((new["part"][place], word[place]))]
    else:
        order = place[np.argsort((word[place] << 23) | np.arange(len(word)))]
    return {c: v[order] for c, v in new.items()} | {"wide": wide[order]}


def together(batches, columns: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of many rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            yield {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in columns}
            held, n = [], 0
    if n:
        yield {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in columns}


def candidates(index: DataFrame, low: int, high: int, segment: int = 0) -> DataFrame:
    """From rows of emitted() or, with a column open, of INDEX: FOUND, in rows of two kinds.

    later, word, earlier (array), more, beyond: of the classes before it that share a prefix word and pass the filters, a
    class meets those numbered low to high - 1 in its part. more tells that others pass too; beyond, that lines of the
    word lie behind the segment of HEAD lines that is held. Rows without any of it are left out. With a column open, only
    its lines look for earlier ones, and they visit the other parts of their words as guests; without it, lines of words
    in several parts count as having more. Guests have met nobody before the second round.

    Lines of a word stand in the order of their places, the same in every round: numbers and segments hold on, and a line
    that is gone has no later one left to look at.

    Rows of the other kind (class, not later) are those of INDEX, without open, for each word with a line that has more.

    Filters by length, by the place of the shared word, and by the words on odd bits: the latter differ in no more
    bits than the sets differ in words.
    """

    floor, some = segment * HEAD, "open" in index.columns
    guest_low = 0 if low == FIRST_ROUND else low
    names = ("key", "part", "class", "size", "odd", "odd2", "wide", *(("open", "guest") if some else ()))
    most = 4 * TOGETHER
    fields = FOUND.replace("array<long>", "array").replace(",", "").split()[::2]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), *[pa.int64()] * len(NUMBERS), pa.binary()]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in zip(fields, kinds, strict=True)], names=fields)

    def run(batches):
        if some:
            yield from met_by(together(batches, names), None)
            return
        for rows in indexed(batches):
            n, asked = len(rows["key"]), []
            yield from met_by(({c: rows[c][i : i + most] for c in names} for i in range(0, n, most)), asked)
            # all lines of words that some line has more of
            word = rows["key"] >> RANK_BITS
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            stay = np.flatnonzero(np.repeat(np.logical_or.reduceat(np.concatenate(asked), begin), np.diff(np.append(begin, n))))
            for i in range(0, len(stay), TOGETHER):
                at = stay[i : i + TOGETHER]
                yield batch_of(len(at), **{c: v[at] for c, v in rows.items()})

    def met_by(chunks, asked: list[np.ndarray] | None):
        head, seen, held = None, 0, None
        for new in chunks:
            word, part = new["key"] >> RANK_BITS, new["part"]
            on = held is not None and (word[0], part[0]) == held  # the chunk goes on with a word
            begin = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (part[1:] != part[:-1])]))
            lengths = np.diff(np.append(begin, len(word)))
            # guests look for partners but are none, and don't count
            host = new["guest"] == 0 if some else np.ones(len(word), bool)
            before = np.cumsum(host) - host
            rank = before - np.repeat(before[begin], lengths)
            if on:
                rank[: lengths[0]] += seen
            h = len(head["key"]) if on else 0
            hosts = {c: new[c][host] for c in names} if some else new
            pool = {c: np.concatenate([head[c], hosts[c]]) for c in names} if h else hosts
            # where the segment of a row's word begins in the pool
            start = h + before[begin] + floor
            if on:
                start[0] = 0 if h else floor - seen
            start = np.repeat(start, lengths)
            partners = np.minimum(rank - floor, HEAD)
            ours, theirs = ([c["size"], c["size"] - (c["key"] & ((1 << RANK_BITS) - 1)) - 1, c["odd"], c["odd2"], c["class"], c["wide"]] for c in (new, pool))
            (size, rest, odd, odd2, name, wide), (size_, rest_, odd_, odd2_, name_, wide_) = ours, theirs
            passed, k = np.zeros(len(word), np.int64), 0
            first = np.where(new["guest"] > 0, guest_low, low) if some else np.full(len(word), low)
            more = np.zeros(len(word), bool) if some else part != 0
            met: list[tuple[np.ndarray, np.ndarray]] = []
            x = np.flatnonzero((partners > 0) & (new["open"] > 0)) if some else np.flatnonzero(partners > 0)
            while len(x := x[partners[x] > k]):
                y = start[x] + k
                whole = size[x] + size_[y]
                shared = (4 * whole + 8) // 9
                near = np.flatnonzero((1 + np.minimum(rest[x], rest_[y]) >= shared) & (5 * np.minimum(size[x], size_[y]) >= 4 * np.maximum(size[x], size_[y])))
                y, z, differ = y[near], x[near], (whole - 2 * shared)[near]
                a, b = (odd[z] ^ odd_[y]).view(U), (odd2[z] ^ odd2_[y]).view(U)
                least = np.minimum(size[z], size_[y])
                bits = np.where(least > WIDER[0], np.bitwise_count(a).astype(np.int64) + np.bitwise_count(b), np.bitwise_count(a ^ b))
                good = np.flatnonzero((bits <= differ) & (name[z] != name_[y]))
                if len(good) and (long := good[least[good] > WIDER[1]]).size:
                    unlike = [i for i in long.tolist() if far(wide[z[i]], wide_[y[i]], int(differ[i]))]
                    good = np.setdiff1d(good, unlike, assume_unique=True)
                if len(good):
                    hit, with_ = z[good], y[good]
                    use, end = (passed[hit] >= first[hit]) & (passed[hit] < high), passed[hit] >= high
                    met.append((hit[use], name_[with_[use]]))
                    more[hit[end]] = True
                    passed[hit] += 1
                    x = x[passed[x] <= high]
                k += 1
            beyond = rank >= floor + HEAD
            whose = np.concatenate([m[0] for m in met]) if met else np.zeros(0, np.int64)
            partner = np.concatenate([m[1] for m in met]) if met else np.zeros(0, np.int64)
            many = np.bincount(whose, minlength=len(word))
            out = np.flatnonzero((many > 0) | more | beyond)
            if len(out):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[out])]).astype(np.int32)), pa.array(partner[np.argsort(whose, kind="stable")]))
                yield batch_of(len(out), later=name[out], word=word[out], earlier=lists, more=more[out], beyond=beyond[out])
            if asked is not None:
                asked.append(more)
            at = begin[-1]
            mine = slice(int(before[at]) + max(0, floor - int(rank[at])), None)
            stays = on and len(begin) == 1
            tail = {c: hosts[c][mine] for c in names}
            head = {c: (np.concatenate([head[c], tail[c]]) if stays else tail[c])[:HEAD].copy() for c in names}
            seen, held = int(rank[-1]) + int(host[-1]), (word[-1], part[-1])

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not some:
        return index.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, FOUND)
    word = F.shiftright("key", RANK_BITS)
    # an open line also visits the other parts of its word
    everywhere = F.sequence(F.shiftleft(F.shiftright("part", 32), 32), F.shiftleft(F.shiftright("part", 32), 32) + F.shiftright("part", 32) - 1)
    visits = F.when((F.col("part") != 0) & (F.col("open") > 0), everywhere).otherwise(F.array("part"))
    index = index.withColumn("own", F.col("part")).withColumn("part", F.explode(visits)).withColumn("guest", (F.col("part") != F.col("own")).cast("int")).drop("own")
    rows = index.repartition(parts, word, "part").sortWithinPartitions(word, "part", "doc", "tag", "line", "class")
    return rows.mapInArrow(run, FOUND)


def bit_of(doc, tag, line) -> np.ndarray:
    """A bit of the filter for each line."""
    mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (tag.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (line.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 26)


def word_sets(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines (class, doc, tag, line) with words (array of 64-bit hashes).

    A filter of fixed size (8 MB of bits) tells the tasks which lines may be wanted; a join takes the rest out. Of few
    documents, only those reach the tasks.
    """
    wanted_docs = lines.select("doc").distinct()
    if wanted_docs.limit(FEW_DOCS + 1).count() <= FEW_DOCS:
        docs = docs.join(F.broadcast(wanted_docs), "doc", "left_semi")

    def bits(batches):
        for batch in batches:
            at = bit_of(*(batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "tag", "line")))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["bit"])

    made = lines.mapInArrow(bits, "bit long").select(F.floor(F.col("bit") / 32768).cast("int").alias("block"), (F.col("bit") % 32768).alias("place"))
    held = np.zeros(BITS // 8, np.uint8)
    for r in made.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits")).collect():  # at most 2048 blocks of 4 KB
        held[r.block * 4096 : r.block * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for part in in_parts(batches):
            split = [x for p in part for x in p[3]]
            counts = [len(p[3]) for p in part]
            of = np.repeat(np.arange(len(part)), counts)
            doc, tag, begin = (np.array([p[k] for p in part], np.int64)[of] for k in (0, 1, 2))
            line = begin + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = bit_of(doc, tag, line)
            chosen = np.flatnonzero((known.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            words = [[x - (1 << 64) if x >> 63 else x for x in map(xxhash.xxh64_intdigest, {*split[i].lower().encode().translate(SPACED).split()})] for i in chosen.tolist()]
            for i in range(0, len(chosen), 5000):
                c = chosen[i : i + 5000]
                yield pa.RecordBatch.from_arrays([pa.array(doc[c]), pa.array(tag[c]), pa.array(line[c].astype(np.int32)), pa.array(words[i : i + 5000], pa.list_(pa.int64()))], names=["doc", "tag", "line", "words"])

    found = docs.mapInArrow(run, f"{LINE}, words array<long>")
    return lines.join(found, ["doc", "tag", "line"]).dropDuplicates(["doc", "tag", "line"])


def matched(docs: DataFrame, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """class and place (doc, tag, line) of the later one of each pair whose similarity is 0.8 or more."""
    needed = pairs.select(F.col("later").alias("class")).union(pairs.select("earlier")).distinct().join(firsts, "class")
    needed = write_table(needed.select("class", "doc", "tag", "line"), "needed")
    sets = write_table(word_sets(docs, needed), "word_sets")
    place = F.struct("doc", "tag", "line")
    named = lambda new: sets.select(F.col("class").alias(new), F.col("words").alias(f"{new}_words"), place.alias(f"{new}_place"))
    both = pairs.join(named("later"), "later").join(named("earlier"), "earlier")
    shared = F.size(F.array_intersect("later_words", "earlier_words"))
    alike = both.where((shared * 9 >= (F.size("later_words") + F.size("earlier_words")) * 4) & (F.col("later_place") != F.col("earlier_place")))
    after = F.col("later_place") > F.col("earlier_place")
    found = alike.select(F.when(after, F.col("later")).otherwise(F.col("earlier")).alias("class"), F.when(after, F.col("later_place")).otherwise(F.col("earlier_place")).alias("x"))
    return found.select("class", "x.*").distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc, tag, line of every line that goes, from rows of keyed(); more than once for rows that are equal."""
    spark = docs.sparkSession
    rows = write_table(counted(docs), "lines")
    level, n_words = rarity(rows)
    known = spark.sparkContext.broadcast(level)
    blocks = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // BLOCK_WORDS)
    lines = rows.where("block is null").select("class", "check", "doc", "tag", "line")
    place = F.struct("doc", "tag", "line")
    firsts = write_table(lines.groupBy("class", "check").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n")).select("class", "check", "p.*", "n"), "firsts")
    repeated = repeated_ids(lines)
    gone, segment, index = None, 0, emitted(docs, known, repeated, blocks)
    while True:
        low, high, rows, small, beyond = 0, FIRST_ROUND, index, None, None
        while True:
            found = write_table(candidates(rows, low, high, segment), "candidates")
            # each pair once, however many words it shares
            partners = found.where("size(earlier) > 0").groupBy("later").agg(F.array_distinct(F.flatten(F.collect_list("earlier"))).alias("earlier"))
            pairs = write_table(partners.select("later", F.explode("earlier").alias("earlier")), "pairs")
            if not pairs.isEmpty():
                now = write_table(matched(docs, pairs, firsts), "matched")
                gone = now if gone is None else gone.unionByName(now)
            if low <= FIRST_ROUND:  # lines that go on by themselves, then guests
                now = found.where("beyond").select(F.col("later").alias("class"), "word")
                beyond = now if beyond is None else beyond.union(now)
            more = found.where("more").select(F.col("later").alias("class"), "word")
            open_ = write_table(more if gone is None else more.join(gone, "class", "left_anti"), "open")
            if open_.isEmpty():
                break
            # next, only words of lines that are still open; as partners all lines of those words stay
            if small is None:
                small = found.where("class is not null").select(*NUMBERS, "wide")
            flags = open_.select("class").distinct().withColumn("open", F.lit(1))
            words = open_.select("word").distinct()
            rows = small.join(words, F.shiftright(small["key"], RANK_BITS) == words["word"], "left_semi")
            rows = rows.join(flags, "class", "left").withColumn("open", F.coalesce("open", F.lit(0)))
            low, high = high, min(high * GROWTH, high + MOST_AT_ONCE)
        beyond = write_table(beyond if gone is None else beyond.join(gone, "class", "left_anti"), "beyond")
        if beyond.isEmpty():
            break
        index = emitted(docs, known, repeated, blocks, bit_filter(beyond, "word"))
        segment += 1
    if gone is None:
        gone = firsts.where("false").select("class", "doc", "tag", "line")
    gone = gone.distinct().withColumn("gone", F.lit(True))
    doubtful = firsts.join(gone, ["class", "doc", "tag", "line"], "left").where("gone or n > 1").select("class", "check", F.struct("doc", "tag", "line").alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"))
    return lines.join(doubtful, ["class", "check"]).where(F.col("gone") | (place > F.col("first"))).select("doc", "tag", "line")


def remove_repeated_lines(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """The rows with their repeated lines taken out of text; removed: a further column that tells how many went."""
    gone = write_table(repeated_lines(keyed(docs)), "gone").groupBy("doc", "tag").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("tag"))
    joined = rows.join(gone, ["doc", "tag"], "left")
    # only texts that lose lines are split, once each
    kept = F.expr(r"get(transform(array(split(row.text, '\n')), lines -> array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> get(lines, i)), '\n')), 0)")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    columns = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    number = [] if removed is None else [F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(removed)]
    return joined.select(*columns, *number)
