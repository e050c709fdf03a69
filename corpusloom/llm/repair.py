"""Token ids in files compressed by Re-Pair grammars (operator 8).

Documents are dealt by ranges of doc_id and sorted, and each run of about half a million ids is a shard. Within a
shard the frequent pairs of adjacent ids (never across documents) are replaced by nonterminals, until no pair pays for
its rule or the 16-bit symbols run out. Pairs are counted anew in each round, without the overlaps inside runs of one id; a
round goes from the most frequent pair down to a tenth of its count and leaves out pairs whose places could overlap those
of a pair before them, so every count holds when its pair is replaced. Against one pair at a time this only changes
the order of pairs whose counts lie within a factor of ten.

A shard stores its rules, their expansion lengths, the reduced sequence and where each document starts in it. A
document, or a range of its ids, is decoded on its own: lengths lead to the symbols, and only their rules are expanded.

Defined cases: a null or empty text has only the end id; null ids sort first; repeated rows are all stored; a
document longer than a shard is a shard of its own; an empty table gives no shard and an empty table; further
columns of the input are passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.encoding import encoder, keyed_texts
from corpusloom.llm.files import read_blocks, write_blocks

MAGIC = b"RPT1"
SHARD, FILE_SHARDS = 500_000, 32
SYMBOLS, FIRST_RULE = 65_536, 49_408
#: Occurrences that pay for a rule; least share of a round's most frequent pair.
LEAST, SHARE = 6, 0.1
#: Slots of pairs in a round; their counts (2 MB) stay in a core's cache.
SLOT_BITS = 18
#: magic, bytes after the header, partition, ids of the partition before it, ids, documents, rules, symbols
HEADER = struct.Struct("<4sQIQQIII")
#: The two bytes of each id.
PLAIN_IDS = [i.to_bytes(2, "little") for i in range(FIRST_RULE)]
END_ID = 2


def places_of_pairs(seq: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which places begin a pair: not at a document's end, and only every other one in a run of one symbol."""
    use = ~last[:-1]
    same = np.flatnonzero((seq[:-1] == seq[1:]) & use)
    starts = np.flatnonzero(np.diff(same, prepend=-2) != 1)
    odd = (np.arange(len(same)) - np.repeat(starts, np.diff(np.append(starts, len(same))))) % 2 == 1
    use[same[odd]] = False
    return use


def apart(pairs: np.ndarray) -> list[int]:
    """Of pairs in this order, those that no place can share with an earlier one: no symbol begins one and ends another."""
    begins, ends, taken = set(), set(), []
    for k, (a, b) in enumerate(zip((pairs >> np.uint32(16)).tolist(), (pairs & np.uint32(65535)).tolist(), strict=True)):
        if a in ends or b in begins or (a == b and a in begins):
            continue
        begins.add(a)
        ends.add(b)
        taken.append(k)
    return taken


def compress(ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (n, 2), the reduced sequence, and its marks of documents' last symbols."""
    seq, rules, made = ids.astype(np.uint16), [np.zeros(0, np.uint32)], 0
    # a pair that has become too rare stays so: only pairs with a new symbol are counted where one was given up
    live = np.ones(len(seq), bool)
    while len(seq) > 1 and made < SYMBOLS - FIRST_RULE:
        at = np.flatnonzero(places_of_pairs(seq, last) & live[:-1])
        pair = (seq[at].astype(np.uint32) << np.uint32(16)) | seq[at + 1]
        # counts of slots are at least those of their pairs, so only pairs of busy slots are counted one by one
        slot = ((pair * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)).astype(np.intp)
        rough = np.bincount(slot, minlength=1 << SLOT_BITS)
        most, rough = rough.max(), rough[slot]
        live[at[rough < LEAST]] = False
        while True:
            busy = np.flatnonzero(rough >= max(LEAST, SHARE * most))
            found, back, counts = np.unique(pair[busy], return_inverse=True, return_counts=True)
            if not len(busy) or counts.max() >= SHARE * most:
                break
            most = counts.max()  # busy slots of rare pairs
        if not len(busy) or counts.max() < LEAST:
            break
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] >= max(LEAST, SHARE * counts[order[0]])]
        order = order[apart(found[order])][: SYMBOLS - FIRST_RULE - made]
        number = np.full(len(found), -1, np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        which = number[back]
        at, which = at[busy[which >= 0]], which[which >= 0]
        rules.append(found[order])
        seq[at] = FIRST_RULE + made + which
        made += len(order)
        last[at] = last[at + 1]
        live[at] = live[np.maximum(at - 1, 0)] = True
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last, live = seq[stay], last[stay], live[stay]
    pairs = np.concatenate(rules)
    return np.stack([pairs >> np.uint32(16), pairs & np.uint32(65535)], 1).astype(np.uint16), seq, last


def expansions(rules: np.ndarray) -> list[bytes]:
    """The ids (16-bit) of each symbol: plain ids, then nonterminals."""
    made = PLAIN_IDS.copy()
    for a, b in rules.tolist():
        made.append(made[a] + made[b])
    return made


def pack(partition: int, before: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    sizes = np.array([len(x) // 2 for x in ids])
    last = np.zeros(sizes.sum(), bool)
    last[np.cumsum(sizes) - 1] = True
    rules, seq, last = compress(np.frombuffer(b"".join(ids), "<u2"), last)
    ends = (np.flatnonzero(last) + 1).astype("<u4")
    lengths = np.array([len(x) // 2 for x in expansions(rules)[FIRST_RULE:]], "<u4")
    null = np.array([d is None for d in doc_ids], np.uint8)
    body = b"".join((np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), ends.tobytes(), rules.astype("<u2").tobytes(), lengths.tobytes(), seq.astype("<u2").tobytes()))
    return HEADER.pack(MAGIC, len(body), partition, before, int(sizes.sum()), len(doc_ids), len(rules), len(seq)) + body


class Shard:
    """One stored shard; decode(k) gives the ids of its k-th document alone."""

    def __init__(self, header: tuple, body: memoryview):
        _, _, self.partition, self.before, self.total, docs, rules, symbols = header
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(body, kind, n, at)
            at += found.nbytes
            return found

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, null, strict=True)]
        self.ends, self.rules, self.lengths, self.seq = take("<u4", docs), take("<u2", 2 * rules).reshape(-1, 2), take("<u4", rules), take("<u2", symbols)

    @cached_property
    def made(self) -> dict[int, bytes]:
        """Expansions of the symbols that were needed so far."""
        return {}

    def expand(self, symbol: int) -> bytes:
        """The ids (16-bit) of a symbol; its rule and those below it are expanded once."""
        if symbol < FIRST_RULE:
            return PLAIN_IDS[symbol]
        if (found := self.made.get(symbol)) is None:
            below, waiting = self.made, [symbol]
            while waiting:
                a, b = map(int, self.rules[waiting[-1] - FIRST_RULE])
                open_ = [x for x in (a, b) if x >= FIRST_RULE and x not in below]
                if open_:
                    waiting += open_
                else:
                    below[waiting.pop()] = (PLAIN_IDS[a] if a < FIRST_RULE else below[a]) + (PLAIN_IDS[b] if b < FIRST_RULE else below[b])
            found = below[symbol]
        return found

    def length(self, k: int) -> int:
        """Ids of a document, from the stored lengths."""
        return int(self._lengths(self._symbols(k)).sum())

    def _lengths(self, part: np.ndarray) -> np.ndarray:
        out = np.ones(len(part), np.int64)
        high = part >= FIRST_RULE
        out[high] = self.lengths[part[high] - FIRST_RULE]
        return out

    def _symbols(self, k: int) -> np.ndarray:
        return self.seq[self.ends[k - 1] if k else 0 : self.ends[k]]

    def decode(self, k: int, made: list[bytes] | None = None) -> np.ndarray:
        """The ids of a document; who reads all documents hands over the expansions of all symbols."""
        return np.frombuffer(b"".join(map(made.__getitem__ if made else self.expand, self._symbols(k).tolist())), "<u2")

    def ids_at(self, k: int, start: int, n: int) -> np.ndarray:
        """n ids of a document from a place on: the lengths lead there."""
        part = self._symbols(k)
        after = np.cumsum(self._lengths(part))
        first, end = np.searchsorted(after, [start, start + n - 1], "right")
        skipped = start - (after[first - 1] if first else 0)
        found = np.frombuffer(b"".join(map(self.expand, part[first : end + 1].tolist())), "<u2")
        return found[skipped : skipped + n]


def shards(content: bytes) -> Iterator[Shard]:
    at = 0
    while at < len(content):
        header = HEADER.unpack_from(content, at)
        if header[0] != MAGIC:
            raise ValueError("not a shard")
        begin = at + HEADER.size
        yield Shard(header, memoryview(content)[begin : begin + header[1]])
        at = begin + header[1] + 1


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode all documents and write their shards in ascending doc_id order."""

    def run(batches):
        encode, partition, total = encoder("word", tokenizer).encode_all, TaskContext.get().partitionId(), 0
        keys, ids, size, end = [], [], 0, END_ID.to_bytes(2, "little")

        def out():
            return pa.RecordBatch.from_arrays([pa.array([pack(partition, total, keys, ids)], pa.binary())], names=["shard"])

        for key, found in encode(keyed_texts(batches)):
            found += end
            if keys and size + len(found) // 2 > SHARD:
                yield out()
                total, keys, ids, size = total + size, [], [], 0
            keys.append(key)
            ids.append(found)
            size += len(found) // 2
        if keys:
            yield out()

    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = docs.select("doc_id", "text").repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id")
    write_blocks(rows.mapInArrow(run, "shard binary"), "shard", path, "\n", most=FILE_SHARDS)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), start (ids of all documents before it)."""
    files = read_blocks(spark, path)

    def sizes(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for s in shards(batch.column("content")[k].as_py()):
                    yield pa.RecordBatch.from_pydict({"partition": pa.array([s.partition], pa.int32()), "n": pa.array([s.before + s.total], pa.int64())})

    def decoded(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for s in shards(batch.column("content")[k].as_py()):
                    at, made = s.before, expansions(s.rules)
                    for i in range(0, len(s.doc_ids), 100):
                        ids = [s.decode(j, made) for j in range(i, min(i + 100, len(s.doc_ids)))]
                        before = at + np.cumsum([0, *map(len, ids)])
                        at = int(before[-1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(s.doc_ids[i : i + 100], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(before[:-1], pa.int64()), pa.array([s.partition] * len(ids), pa.int32())],
                            names=["doc_id", "ids", "inside", "partition"],
                        )

    # a row for each written partition, however large the corpus
    totals = files.mapInArrow(sizes, "partition int, n long").groupBy("partition").agg(F.max("n").alias("n"))
    earlier = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("partition", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = files.mapInArrow(decoded, "doc_id long, ids binary, inside long, partition int")
    return rows.join(F.broadcast(base), "partition").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "ids")
