"""Packing of token pieces into sequences with a grouping genetic algorithm (operator 9).

Documents longer than a sequence are cut, the remainder first. Full pieces fill sequences of their own. The rest
is dealt by number into blocks of some thousand pieces, and each block is evolved on several islands from noisy
best-fit packings: a child keeps most of the well-filled sequences of one parent and takes over whole well-filled ones of
the other, the sequences that share pieces with them are dissolved like all emptier ones, and the displaced pieces go
where they fit best. After each epoch an island's best packing migrates to the next island of its block; the best
packing of all islands stands.

Defined cases: a null or empty text is the end id alone; null doc_ids are carried; repeated rows are all packed;
equal lengths are dealt in a fixed order; an empty table gives an empty table; further columns are passed over.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import write_table
from corpusloom.llm.encoding import encoder, keyed_texts

CAPACITY, BLOCK = 1024, 4000
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 12, 5
#: Noise of the lengths by which the packings of the beginning are sorted, more for each one.
NOISE = 0.1
#: Most of a parent's well-filled sequences that are dissolved all the same, and the share of the other one's that displace such.
FORGET, DISPLACE = 0.6, 0.2
END_ID = 2
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def run(batches):
        end, rows = END_ID.to_bytes(2, "little"), encoder("byte", tokenizer).encode_all(keyed_texts(batches))
        while some := list(islice(rows, 1000)):
            keys, number, starts, lengths, crcs = [], [], [], [], []
            for key, found in some:
                ids = np.frombuffer(found + end, "<u2").astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    keys.append(key)
                    number.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class Space:
    """Free places of open sequences: the tightest that still holds a piece is found in one step."""

    def __init__(self, capacity: int):
        self.capacity, self.at, self.open = capacity, [[] for _ in range(capacity + 1)], 0

    def add(self, sequence: int, free: int) -> None:
        self.at[free].append(sequence)
        self.open |= 1 << free

    def take(self, length: int) -> tuple[int, int]:
        """(sequence, free places) of the best fit, or (-1, capacity)."""
        fitting = self.open >> length
        if not fitting:
            return -1, self.capacity
        free = length + (fitting & -fitting).bit_length() - 1
        found = self.at[free].pop()
        if not self.at[free]:
            self.open ^= 1 << free
        return found, free


def best_fit(lengths: list[int], items: list[int], home: np.ndarray, free: list[int], capacity: int) -> None:
    """Put items, in this order, where they fit best; home and free are extended in place."""
    space = Space(capacity)
    for sequence, left in enumerate(free):
        if 0 < left < capacity:
            space.add(sequence, left)
    for item in items:
        length = lengths[item]
        sequence, left = space.take(length)
        if sequence < 0:
            sequence = len(free)
            free.append(capacity)
        home[item] = sequence
        free[sequence] = left - length
        if left > length:
            space.add(sequence, left - length)


def fills(sizes: np.ndarray, home: np.ndarray) -> np.ndarray:
    return np.bincount(home, sizes)


def fitness(sizes: np.ndarray, home: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones."""
    full = fills(sizes, home)
    used = full > 0
    return -int(used.sum()), float(np.square(full[used] / capacity).mean())


def well_filled(full: np.ndarray) -> np.ndarray:
    """The sequences as full as the middle one: the full ones, where half of them are."""
    return full >= np.median(full[full > 0])


def cross(sizes: np.ndarray, lengths: list[int], one: np.ndarray, two: np.ndarray, capacity: int, rng) -> np.ndarray:
    """A child of one with whole well-filled sequences of two.

    Well-filled sequences of two that share no piece with those that one keeps come all, of the others some. Pieces that would be
    held twice leave the sequences of one, which are dissolved, and what is displaced goes where it fits best.
    """
    good, full = well_filled(fills(sizes, one)), well_filled(fills(sizes, two))
    kept = good & (rng.random(len(good)) >= rng.uniform(0, FORGET))
    shared = np.bincount(two[kept[one]], minlength=len(full)) > 0
    injected = (full & (~shared | (rng.random(len(full)) < DISPLACE)))[two]
    kept[one[injected]] = False
    stays = kept[one]
    child = np.full(len(sizes), -1)
    mine, child[stays] = np.unique(one[stays], return_inverse=True)
    taken, child[injected] = np.unique(two[injected], return_inverse=True)
    child[injected] += len(mine)
    displaced = np.flatnonzero(child < 0)
    displaced = displaced[np.argsort(-sizes[displaced] * np.exp(rng.normal(0, rng.choice([0, 0.02]), len(displaced))), kind="stable")]
    free = capacity - np.bincount(child[child >= 0], sizes[child >= 0], len(mine) + len(taken)).astype(int)
    best_fit(lengths, displaced.tolist(), child, free.tolist(), capacity)
    return child


def evolve(sizes: np.ndarray, elites: list[np.ndarray], seed: list[int], capacity: int = CAPACITY, generations: int = GENERATIONS, noise: float = NOISE) -> np.ndarray:
    """The best packing an island finds: for each piece its sequence. The noise of its first packing is that given."""
    rng = np.random.default_rng(seed)
    lengths, people = sizes.tolist(), list(elites)
    while len(people) < POPULATION:
        home, free = np.full(len(sizes), -1), []
        noisy = -sizes * np.exp(rng.normal(0, noise + NOISE * len(people), len(sizes)))
        best_fit(lengths, np.argsort(noisy, kind="stable").tolist(), home, free, capacity)
        people.append(home)
    people = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
    least = -(-int(sizes.sum()) // capacity)
    for k in range(generations):
        if -people[0][0][0] == least:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        child = cross(sizes, lengths, people[a][2], people[b][2], capacity, rng)
        people = sorted([*people, (fitness(sizes, child, capacity), 1000 + k, child)], key=lambda x: x[:2], reverse=True)[:POPULATION]
    return people[0][2]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of numbered pieces. The numbers deal them, so that copies of a
    piece spread over all blocks."""
    columns = [c for c in pieces.columns if c != "number"]
    short = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // BLOCK))
    block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("long")
    dealt = short.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("items"))
    dealt = write_table(dealt, "blocks")  # rows of bounded size, a few thousand pieces each
    islands = dealt.select("block", F.col("items.length").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = islands.withColumn("elite", F.expr("cast(array() as array<int>)"))

    def epoch(number: int):
        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    sizes, elite = np.array(r["sizes"]), np.array(r["elite"], int)
                    home = evolve(sizes, [elite] if len(elite) else [], [r["block"], r["island"], number], capacity, noise=NOISE * r["island"])
                    count, mean = fitness(sizes, home, capacity)
                    yield pa.RecordBatch.from_pylist(
                        [{"block": r["block"], "island": r["island"], "rank": [float(count), mean], "home": home.tolist()}],
                        pa.schema([("block", pa.int64()), ("island", pa.int32()), ("rank", pa.list_(pa.float64())), ("home", pa.list_(pa.int32()))]),
                    )

        return run

    spread = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for number in range(EPOCHS):
        found = state.repartition(spread, "block", "island").mapInArrow(epoch(number), "block long, island int, rank array<double>, home array<int>")
        found = write_table(found, f"epoch{number}")
        migrants = found.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("home").alias("elite"))
        state = islands.join(migrants, ["block", "island"])
    best = found.groupBy("block").agg(F.max_by("home", F.struct("rank", "island")).alias("home"))
    rows = dealt.join(best, "block").select("block", F.explode(F.arrays_zip("items", "home")).alias("x")).select("block", "x.items.*", F.col("x.home").cast("long").alias("home"))
    before = Window.partitionBy("block", "home").orderBy("doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    packed = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    packed = packed.select(*columns, (F.col("block") * (1 << 24) + F.col("home")).alias("sequence_id"), "offset")
    alone = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def cut_and_pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """All pieces of all documents with their places."""
    return pack(write_table(cut(docs, capacity, tokenizer).withColumn("number", F.monotonically_increasing_id()), "pieces"), capacity)
