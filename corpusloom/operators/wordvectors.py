"""Skip-gram vectors of words, learnt side by side in parts of the texts, with no vocabulary in one place.

Each part numbers its own words. Counts and vectors travel in packed rows: a part's words are told apart by 64-bit hashes and dealt
into buckets, so a task sees one part's words or one bucket's. A part learns by negative sampling from its texts' words that are
frequent enough among all texts; a word begins with the same vector everywhere, and what the parts made of it is averaged by how often
they met it. Vectors travel and are kept in half precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.sources.scratch import written

#: Words of a part at most, unless one text has more; characters of texts that are split at once.
WORDS, CHARACTERS = 4_000_000, 4_000_000
#: Words that learn at once, neighbours among them that share noise words, noise words that they share, and noise words for each pair.
STEP, NEAR, NOISE, NEGATIVE = 512, 16, 8, 5
#: A word that stands more often among the words that learn at once moves no further than one that stands so often, and never further than FAR.
MOST, FAR = 8, 0.5
RATE = 0.05


def hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words.to_pylist(), object), categorize=False)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The packed numbers of all rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def sizes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """How many packed numbers of so many bytes each row has."""
    return pc.binary_length(column).to_numpy() // width


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that none has many characters."""
    ends, at = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + CHARACTERS, "right")))
        yield batch.slice(at, to - at)
        at = to


def encoded(df: DataFrame, text: str, tasks: int) -> DataFrame:
    """A row for each part: part, rows (the other columns of its texts), sizes (words of each text), tokens, words, counts; written."""
    kept = [c for c in df.columns if c != text]

    def row(held, number):
        flat = pa.concat_arrays([w for _, _, w in held]).dictionary_encode()
        tokens = flat.indices.to_numpy()
        table = pa.Table.from_batches([b for b, _, _ in held])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        counts = np.bincount(tokens, minlength=len(flat.dictionary)).astype(np.int32)
        values = [number, sink.getvalue().to_pybytes(), packed(np.concatenate([n for _, n, _ in held]).astype(np.int32)), packed(tokens.astype(np.int32)), flat.dictionary, packed(counts)]
        words = pa.ListArray.from_arrays(pa.array([0, len(flat.dictionary)], pa.int32()), flat.dictionary)
        return pa.RecordBatch.from_arrays([words if k == 4 else pa.array([v]) for k, v in enumerate(values)], names=["part", "rows", "sizes", "tokens", "words", "counts"])

    def run(batches):
        number, held, many = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in pieces(batch, text):
                lists = pc.split_pattern(part.column(text), " ")
                flat, of = lists.flatten(), np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                real = pc.not_equal(flat, "")
                counts = np.bincount(of[real.to_numpy(zero_copy_only=False)], minlength=part.num_rows)
                held.append((part.select(kept), counts, flat.filter(real).cast(pa.string())))
                many += int(counts.sum())
                if many >= WORDS:
                    yield row(held, number)
                    number, held, many = number + 1, [], 0
        if held:
            yield row(held, number)

    rows = df.select(*kept, X.clean(text).alias(text)).repartition(tasks)
    return written(rows.mapInArrow(run, "part long, rows binary, sizes binary, tokens binary, words array<string>, counts binary"), "encoded-texts")


def dealt(parts: DataFrame, buckets: int) -> DataFrame:
    """bucket, part, at, hashes, counts: of each part its words in a bucket, with their numbers in the part."""

    def run(batches):
        for batch in batches:
            for part, words, counts in zip(batch.column("part").to_pylist(), batch.column("words"), batch.column("counts").to_pylist(), strict=True):
                made = [(b, part, packed(at.astype(np.int32)), packed(h), packed(np.frombuffer(counts, np.int32)[at])) for b, at, h in in_buckets(hashes(words.values), buckets)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["bucket", "part", "at", "hashes", "counts"])

    return parts.select("part", "words", "counts").mapInArrow(run, "bucket long, part long, at binary, hashes binary, counts binary")


def in_buckets(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bucket, places and hashes of the words in it."""
    of = h % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        at = order[ends[b] : ends[b + 1]]
        yield b, at, h[at]


def frequent(rows: DataFrame, least: int) -> DataFrame:
    """part, at, totals: of each part the words that all texts have so often, with how often."""

    def run(table):
        different, of = np.unique(joined(table["hashes"], np.uint64), return_inverse=True)
        totals = np.bincount(of, joined(table["counts"], np.int32), len(different))[of].astype(np.int64)
        at, ends = joined(table["at"], np.int32), np.cumsum(sizes(table["at"], 4))[:-1]
        made = [(part, packed(a[t >= least]), packed(t[t >= least])) for part, a, t in zip(table["part"].to_pylist(), np.split(at, ends), np.split(totals, ends), strict=True)]
        return pa.Table.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["part", "at", "totals"])

    return rows.groupBy("bucket").applyInArrow(run, "part long, at binary, totals binary")


def first_vectors(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Small random vectors that depend on the words' hashes only."""
    made, at = np.empty((len(h), size), np.float32), np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(h), 4096):
        x = (h[k : k + 4096, None] ^ np.uint64(seed)) + at
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        made[k : k + 4096] = ((x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(size)
    return made


def add(m: np.ndarray, ids: np.ndarray, d: np.ndarray, most: int, far: float) -> None:
    """Adds rows d to the rows ids of m; the sum of more than most of them counts as their mean so many times, and is no longer than far. Rows d are used up."""
    order = np.argsort(ids)
    s = ids.take(order)
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    many = np.diff(np.append(starts, len(s)))
    twice = np.repeat(many, many) > 1
    at, rank = order[twice], (np.arange(len(s)) - np.repeat(starts, many))[twice]
    while len(at):  # neighbours of the same id are added up, then what is left of them
        odd = np.flatnonzero(rank & 1)
        into = at[odd - 1]
        d[into] = d.take(into, 0) + d.take(at[odd], 0)
        even = (rank & 1) == 0
        at, rank = at[even], rank[even] >> 1
        more = (rank > 0) | np.append(rank[1:] > 0, False)
        at, rank = at[more], rank[more]
    sums, big = d.take(order[starts], 0), np.flatnonzero(many > most)
    sums[big] *= (most / many[big]).astype(np.float32)[:, None]
    length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
    long = np.flatnonzero(length > far)
    sums[long] *= (far / length[long])[:, None]
    sums += m.take(s[starts], 0)
    m[s[starts]] = sums


def learn(w: np.ndarray, tokens: np.ndarray, text: np.ndarray, totals: np.ndarray, window: int, seed: int) -> None:
    """One pass over the tokens, with a falling rate; a pair's words stand in one text. w: a vector for each word, which learns."""
    size, groups, wide = w.shape[1], STEP // NEAR, NEAR + 2 * window
    other, rng = np.zeros_like(w), np.random.default_rng(seed)
    rising = np.cumsum(totals**0.75)
    noise = np.searchsorted(rising, (np.arange(max(1 << 20, 4 * len(w))) + 0.5) / max(1 << 20, 4 * len(w)) * rising[-1])
    n, span = len(tokens), STEP + NEAR  # the last group's neighbours are in the rows of one more
    tokens, text = (np.concatenate([np.full(window, v), x, np.full(STEP + NEAR, v)]) for x, v in ((tokens, 0), (text, -1)))
    apart = np.abs(np.arange(wide)[None] - window - np.arange(NEAR)[:, None])
    apart[apart == 0] = window + 1
    strided, moved = np.lib.stride_tricks.as_strided, np.empty((groups + 1, NEAR, size), np.float32)
    with np.errstate(over="ignore"):
        for at in range(0, n, STEP):
            rate = np.float32(RATE * max(1e-4, 1 - at / n))
            near, near_text = tokens[at : at + span], text[at : at + span]
            centre, own = near[window : window + STEP], near_text[window : window + STEP].reshape(groups, NEAR, 1)
            x, c = w.take(centre, 0).reshape(groups, NEAR, size), other.take(near, 0)
            c = strided(c, (groups, wide, size), (NEAR * c.strides[0], *c.strides), writeable=False)
            theirs = strided(near_text, (groups, 1, wide), (NEAR * near_text.strides[0], 0, near_text.strides[0]), writeable=False)
            pairs = ((apart <= rng.integers(1, window + 1, (groups, NEAR, 1))) & (theirs == own) & (own >= 0)).astype(np.float32)
            drawn = noise[rng.integers(0, len(noise), groups * NOISE)]
            z = other.take(drawn, 0).reshape(groups, NOISE, size)
            pull = pairs * rate / (1 + np.exp(x @ c.transpose(0, 2, 1)))
            push = pairs.sum(axis=2, keepdims=True) * np.float32(-NEGATIVE / NOISE) * rate / (1 + np.exp(-(x @ z.transpose(0, 2, 1))))
            of_near, of_noise = pull.transpose(0, 2, 1) @ x, push.transpose(0, 2, 1) @ x
            moved[:groups], moved[groups] = of_near[:, :NEAR], 0
            moved[1:, : 2 * window] += of_near[:, NEAR:]
            add(w, centre, (pull @ c + push @ z).reshape(-1, size), MOST, FAR)
            add(other, np.concatenate([near, drawn]), np.concatenate([moved.reshape(-1, size), of_noise.reshape(-1, size)]), MOST, FAR)


def learnt(parts: DataFrame, kept: DataFrame, tasks: int, buckets: int, size: int, window: int, seed: int) -> DataFrame:
    """bucket, words, hashes, counts, vectors: what each part makes of its words, packed by bucket."""

    def run(mine, found):
        names = ["bucket", "words", "hashes", "counts", "vectors"]
        if not mine.num_rows or not found.num_rows or not len(at := joined(found["at"], np.int32)):
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())], names)
        words = mine["words"].combine_chunks().values
        number = np.full(len(words), -1, np.int64)
        number[at] = np.arange(len(at))
        tokens, counts = number[joined(mine["tokens"], np.int32)], joined(mine["counts"], np.int32)[at]
        lengths = joined(mine["sizes"], np.int32)
        text = np.repeat(np.arange(len(lengths)), lengths)[tokens >= 0]
        words = words.take(pa.array(at))
        h = hashes(words)
        w = first_vectors(h, size, seed)
        learn(w, tokens[tokens >= 0], text, joined(found["totals"], np.int64), window, seed)
        made = [(b, words.take(pa.array(p)).to_pylist(), packed(x), packed(counts[p]), packed(w[p].astype(np.float16))) for b, p, x in in_buckets(h, buckets)]
        return pa.table([pa.array(x, pa.list_(pa.string())) if k == 1 else pa.array(x) for k, x in enumerate(zip(*made, strict=True))], names)

    both = [x.repartition(4 * tasks, "part").groupBy("part") for x in (parts.select("part", "sizes", "tokens", "words", "counts"), kept)]
    return both[0].cogroup(both[1]).applyInArrow(run, "bucket long, words array<string>, hashes binary, counts binary, vectors binary")


def averaged(rows: DataFrame, size: int) -> DataFrame:
    """bucket, words, hashes, vectors: the parts' vectors averaged by how often they met the word; a row for each bucket."""

    def run(table):
        h, counts = joined(table["hashes"], np.uint64), joined(table["counts"], np.int32).astype(np.float32)
        different, first, of = np.unique(h, return_index=True, return_inverse=True)
        total, at = np.zeros((len(different), size), np.float32), 0
        for many, vectors in zip(sizes(table["hashes"], 8).tolist(), table["vectors"].to_pylist(), strict=True):  # a part has a word once
            total[of[at : at + many]] += np.frombuffer(vectors, np.float16).reshape(-1, size) * counts[at : at + many, None]
            at += many
        total /= np.bincount(of, counts, len(different)).astype(np.float32)[:, None]
        words = pc.list_flatten(table["words"]).combine_chunks().take(pa.array(first))
        lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return pa.table([table["bucket"].slice(0, 1).combine_chunks(), lists, pa.array([packed(different)]), pa.array([packed(total.astype(np.float16))])], ["bucket", "words", "hashes", "vectors"])

    return rows.groupBy("bucket").applyInArrow(run, "bucket long, words array<string>, hashes binary, vectors binary")


class WordVectors:
    """Vectors of words: a table with a row for each bucket of words (bucket, words, hashes, vectors)."""

    def __init__(self, table: DataFrame, size: int, buckets: int, parts: int):
        self.table, self.size, self.buckets, self.parts = table, size, buckets, parts

    def getNumPartitions(self) -> int:  # noqa: N802, as Spark's model has it
        return self.parts

    def getVectors(self) -> DataFrame:  # noqa: N802
        """word, vector (numbers)."""
        size = self.size

        def run(batches):
            for batch in batches:
                for words, vectors in zip(batch.column("words"), batch.column("vectors").to_pylist(), strict=True):
                    numbers = pa.array(np.frombuffer(vectors, np.float16).astype(np.float32))
                    lists = pa.FixedSizeListArray.from_arrays(numbers, size).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([words.values, lists], names=["word", "vector"])

        return self.table.select("words", "vectors").mapInArrow(run, "word string, vector array<float>")

    def transform(self, df: DataFrame, text: str = "text", vector: str = "features") -> DataFrame:
        """The other columns, and the mean of the text's words' vectors; zeros if it has none."""
        tasks, size = tasks_for(df, text, None), self.size
        parts = encoded(df, text, tasks)
        kept = [c for c in df.columns if c != text]
        schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(vector, T.ArrayType(T.DoubleType()))])

        def answers(asked, known):
            names = ["part", "at", "vectors"]
            if not asked.num_rows or not known.num_rows:
                return pa.table([pa.array([], k) for k in (pa.int64(), pa.binary(), pa.binary())], names)
            have = joined(known["hashes"], np.uint64)
            vectors = joined(known["vectors"], np.float16).reshape(-1, size)
            made = []
            for part, at, h in zip(asked["part"].to_pylist(), asked["at"].to_pylist(), asked["hashes"].to_pylist(), strict=True):
                h = np.frombuffer(h, np.uint64)
                place = np.minimum(np.searchsorted(have, h), len(have) - 1)
                real = have[place] == h
                made.append((part, packed(np.frombuffer(at, np.int32)[real]), packed(vectors[place[real]])))
            return pa.table([pa.array(x) for x in zip(*made, strict=True)], names)

        def means(mine, found):
            rows = [pa.ipc.open_stream(x).read_all() for x in mine["rows"].to_pylist()]
            lengths, tokens = joined(mine["sizes"], np.int32), joined(mine["tokens"], np.int32)
            at = joined(found["at"], np.int32)
            number = np.full(len(mine["words"].combine_chunks().values), -1, np.int64)
            number[at] = np.arange(len(at))
            vectors = joined(found["vectors"], np.float16).reshape(-1, size).astype(np.float32)
            out, ends = np.zeros((len(lengths), size)), np.cumsum(lengths)
            for k, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
                own = number[tokens[a:b]]
                if len(own := own[own >= 0]):
                    out[k] = vectors.take(own, 0).mean(axis=0)
            made = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), size).cast(pa.list_(pa.float64()))
            return pa.concat_tables(rows).append_column(vector, made) if kept else pa.table([made], [vector])

        asked = dealt(parts, self.buckets).drop("counts")
        found = asked.groupBy("bucket").cogroup(self.table.select("bucket", "hashes", "vectors").groupBy("bucket")).applyInArrow(answers, "part long, at binary, vectors binary")
        both = [x.repartition(4 * tasks, "part").groupBy("part") for x in (parts.drop("counts"), found)]
        return both[0].cogroup(both[1]).applyInArrow(means, schema).withColumn(vector, array_to_vector(vector))


def tasks_for(df: DataFrame, text: str, parts: int | None) -> int:
    """As many as given or as shuffles have; more if a task would have more words than a part may."""
    characters = df.agg(F.sum(F.length(X.col(text)))).first()[0] or 0
    return max(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-characters // (5 * WORDS)))


def fit(train: DataFrame, size: int, window: int, least: int, text: str, seed: int, parts: int | None) -> WordVectors:
    tasks = tasks_for(train, text, parts)
    buckets = max(tasks, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = encoded(train.select(text), text, tasks)
    found = learnt(rows, frequent(dealt(rows, buckets), least), tasks, buckets, size, window, seed)
    return WordVectors(written(averaged(found, size), "word-vectors"), size, buckets, tasks)
