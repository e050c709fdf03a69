"""Near-duplicate classes by BagMinHash over word shingles (operator 2).

A document is the multiset of its five-word shingles. Every shingle carries Poisson processes over the dyadic
intervals of its weight, [0,1), [1,2), [2,4), ...; a point falls on a register and on a level of its interval and
counts if the level is below the shingle's weight. A register keeps its earliest point, so two documents agree in
a register with the probability of their weighted Jaccard similarity. Only points before a bound are drawn; the
bound grows until all registers are filled, so the minima are exact.

Twenty bands of five registers name candidates (a pair of similarity 0.8 is missed once in 2,800). Documents of a
band's bucket are first held against its least one; then, over the components found so far, each meets ever more of
those in other components, until none are left. Such pairs are ruled out by their sizes and by 1024 bits that tell of
odd numbers of copies: two multisets differ in no fewer copies than bits. The others are verified by the overlap of
their multisets. A large bucket is dealt into parts, and the nodes outside its largest component visit all parts, so no
task holds a bucket and what is shipped grows with the nodes that are still apart.

Equal texts are one node. Classes are the components of the verified pairs.

Defined cases: null texts count as empty; texts without words are alike only if equal; a text of one to four
words is one shingle; an empty table gives an empty table; other columns stay out of the result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bits import bit_filter, wanted
from corpusloom.llm.common import text_or_empty, write_table
from corpusloom.llm.encoding import Remembered
from corpusloom.llm.graph import components, merged

SHINGLE, BANDS, ROWS = 5, 20, 5
REGISTERS = BANDS * ROWS
#: Words of 64 bits that tell of each copy of a shingle, to rule out pairs; rows that are compared at a time.
ODD_WORDS, TOGETHER = 16, 20_000
#: Possible partners of a node in a bucket that are verified first, and by how many times more in each later round.
FIRST_ROUND, GROWTH = 1, 16
#: Nodes of a bucket that are held in memory at a time, and nodes of a part of a bucket.
HEAD, SPLIT = 50_000, 20_000
SEEN = 100_000
U = np.uint64

_words = Remembered(xxhash.xxh64_intdigest, 50_000)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (finalizer of a public generator; fixed values)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and their counts."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    hashes = np.fromiter(map(_words.__getitem__, words), U, n)
    size = min(n, SHINGLE)
    sums = np.zeros(n - size + 1, U)
    for k in range(size):
        sums = sums * U(0x9E3779B97F4A7C15) + mixed(hashes[k : n - size + 1 + k] + U(size))
    return np.unique(mixed(sums), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers (documents x REGISTERS) of documents that have shingles: the bits of their earliest points."""
    n = len(bags)
    hashes = np.concatenate([b[0] for b in bags])
    weights = np.concatenate([b[1] for b in bags]).astype(np.float64)
    owner = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    total = np.bincount(owner, weights, n)
    # the dyadic intervals that a weight reaches into
    low, parts = 0, []
    while True:
        at = np.flatnonzero(weights > low)
        if not len(at):
            break
        parts.append((at, np.full(len(at), low, np.float64)))
        low = 1 if not low else 2 * low
    at = np.concatenate([p[0] for p in parts])
    low = np.concatenate([p[1] for p in parts])
    seed = mixed(hashes[at] + low.astype(U) * U(0xD6E8FEB86659FD93))
    length, weight, owner = np.maximum(low, 1), weights[at], owner[at]
    earliest = np.full((n, REGISTERS), np.inf)
    flat = earliest.reshape(-1)
    time = np.zeros(len(at))
    bound = REGISTERS * (np.log(REGISTERS) + 5) / total
    step, active = np.zeros(len(at), U), np.arange(len(at))
    while len(active):
        while len(active):
            s = mixed(seed[active] + (step[active] + U(1)) * U(0x9E3779B97F4A7C15))
            after = time[active] - np.log(((s >> U(11)).astype(np.float64) + 0.5) / 2.0**53) / length[active]
            inside = after <= bound[owner[active]]
            # a point beyond the bound is drawn again, the same, when the bound has grown
            active, s, after = active[inside], s[inside], after[inside]
            time[active] = after
            step[active] += U(1)
            t = mixed(s + U(0x2545F4914F6CDD1D))
            level = low[active] + length[active] * ((t >> U(40)).astype(np.float64) / 2.0**24)
            good = level < weight[active]
            register = ((t & U(0xFFFFFF)) % U(REGISTERS)).astype(np.int64)
            np.minimum.at(flat, owner[active][good] * REGISTERS + register[good], after[good])
        empty = np.isinf(earliest).any(axis=1)
        bound[empty] *= 2
        active = np.flatnonzero(empty[owner])
    return earliest.view(U)


def odd_bits(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Documents x ODD_WORDS: bit k tells whether an odd number of copies of shingles falls on it."""
    counts = np.concatenate([b[1] for b in bags])
    level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    bit = mixed(np.repeat(np.concatenate([b[0] for b in bags]), counts) + level.astype(U) * U(0xD6E8FEB86659FD93)) >> U(54)
    owner = np.repeat(np.arange(len(bags)), [int(b[1].sum()) for b in bags])
    out = np.zeros(len(bags) * ODD_WORDS, U)
    np.bitwise_xor.at(out, owner * ODD_WORDS + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out.reshape(-1, ODD_WORDS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A hash for each band of each document."""
    parts = registers.reshape(len(registers), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=U), (len(registers), BANDS)).copy()
    for k in range(ROWS):
        keys = mixed(keys * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole else 0.0


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text) and text of every row."""
    return docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))


def nodes_of(rows: DataFrame) -> DataFrame:
    """A row for each distinct text: digest, node (a number), doc_id (the least), bands (array; empty without words),
    size (shingles with copies), odd (bits)."""

    def run(batches):
        seen: set[str] = set()

        def out(part):
            bags = [shingles(t) for _, _, t in part]
            full = [k for k, b in enumerate(bags) if len(b[0])]
            bands, odd = [[] for _ in part], [b""] * len(part)
            if full:
                own = [bags[k] for k in full]
                for k, keys, bits in zip(full, band_keys(signatures(own)).tolist(), odd_bits(own), strict=True):
                    bands[k], odd[k] = keys, bits.tobytes()
            sizes = [int(b[1].sum()) for b in bags]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(odd, pa.binary())], names=["digest", "bands", "size", "odd"])

        for batch in batches:
            part, chars = [], 0
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if digest in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                part.append((digest, None, text))
                chars += len(text)
                if chars > 3_000_000:
                    yield out(part)
                    part, chars = [], 0
            if part:
                yield out(part)

    ids = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    bands = rows.select("digest", "text").mapInArrow(run, "digest string, bands array<long>, size long, odd binary").dropDuplicates(["digest"])
    return write_table(ids.join(bands, "digest").withColumn("node", F.monotonically_increasing_id()), "nodes")


@lru_cache(64)
def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    return shingles(text)


def verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs (a, b: nodes) whose multisets are alike enough."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "digest", "doc_id"), "node")
    hashed = F.xxhash64("digest", F.col("doc_id"))
    need = write_table(need.withColumn("hash", hashed), "need")
    held = bit_filter(need, "hash")

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted(held.value, batch.column("hash").to_numpy()))).drop_columns(["hash"])

    texts = rows.select("doc_id", "digest", "text", hashed.alias("hash")).mapInArrow(pick, "doc_id long, digest string, text string")
    texts = write_table(need.join(texts.drop("doc_id"), "digest").dropDuplicates(["digest", "node"]).select("node", "text"), "texts")

    def check(batches):
        for batch in batches:
            a, b = batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()
            good = pa.array([similarity(bag_of(x), bag_of(y)) >= least for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    both = pairs.join(texts.toDF("a", "a_text"), "a").join(texts.toDF("b", "b_text"), "b")
    return write_table(both.select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long"), "links")


def together(batches):
    """Columns of many bucket rows at a time."""
    held, n = [], 0

    def out():
        columns = {c: np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "part", "guest", "node", "root", "size")}
        return columns | {"odd": np.frombuffer(b"".join(x for b in held for x in b.column("odd").to_pylist()), U).reshape(-1, ODD_WORDS)}

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def cross_pairs(buckets: DataFrame, nodes: DataFrame, most: int, least: float, segment: int = 0) -> DataFrame:
    """a, b of a bucket's part (key, part, node, root, guest): each node with the first nodes before it that have another root and
    may be alike, at most so many. Guests from other parts come last and are nobody's partners. Where there are more, a row
    with a null tells so (more true); where nodes of the part lie beyond the segment of HEAD nodes that is held, one with
    more false.
    """
    limit, floor, names = (1 - least) / (1 + least) + 1e-9, segment * HEAD, ("key", "part", "guest", "node", "root", "size", "odd")

    def row(a, b, key, more):
        n = len(b)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if a is None else pa.array(a), pa.array(b), pa.array(key), pa.nulls(n, pa.bool_()) if more is None else pa.array(np.full(n, more))], names=["a", "b", "key", "more"])

    def run(batches):
        head, seen, held = None, 0, None
        for new in together(batches):
            key, part, host = new["key"], new["part"], new["guest"] == 0
            on = held is not None and (key[0], part[0]) == held  # the chunk goes on with a part
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            lengths = np.diff(np.append(begin, len(key)))
            before = np.cumsum(host) - host
            rank = before - np.repeat(before[begin], lengths)
            if on:
                rank[: lengths[0]] += seen
            h = len(head["key"]) if on else 0
            hosts = new if host.all() else {c: new[c][host] for c in names}
            pool = {c: np.concatenate([head[c], hosts[c]]) for c in names} if h else hosts
            # where the segment of a row's part begins in the pool
            start = h + before[begin] + floor
            if on:
                start[0] = 0 if h else floor - seen
            start = np.repeat(start, lengths)
            partners = np.minimum(rank - floor, HEAD)
            (node, root, size, odd), (node_, root_, size_, odd_) = ([c[x] for x in names[3:]] for c in (new, pool))
            passed, k = np.zeros(len(key), np.int64), 0
            x = np.flatnonzero(partners > 0)
            while len(x := x[partners[x] > k]):
                z = x[root[x] != root_[start[x] + k]]
                y = start[z] + k
                good = np.bitwise_count(odd[z] ^ odd_[y]).sum(axis=1, dtype=np.int64) <= limit * (size[z] + size_[y])
                if good.any():
                    z, y = z[good], y[good]
                    use, end = passed[z] < most, passed[z] >= most
                    if use.any():
                        one, two = node_[y[use]], node[z[use]]
                        yield row(np.minimum(one, two), np.maximum(one, two), key[z[use]], None)
                    if end.any():
                        yield row(None, node[z[end]], key[z[end]], True)
                    passed[z] += 1
                    x = x[passed[x] <= most]
                k += 1
            beyond = np.flatnonzero(rank >= floor + HEAD)
            if len(beyond):
                yield row(None, node[beyond], key[beyond], False)
            at = begin[-1]
            mine = slice(int(before[at]) + max(0, floor - int(rank[at])), None)
            stays = on and len(begin) == 1
            tail = {c: hosts[c][mine] for c in names}
            head = {c: (np.concatenate([head[c], tail[c]]) if stays else tail[c])[:HEAD].copy() for c in names}
            seen, held = int(rank[-1]) + int(host[-1]), (key[-1], part[-1])

    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = buckets.select("key", "part", "guest", "node", "root").join(nodes.select("node", "size", "odd"), "node")
    return rows.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "guest", "node").mapInArrow(run, "a long, b long, key long, more boolean")


def mixed_keys(buckets: DataFrame, roots: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Rows (key, part, guest, node, root) of the buckets that hold nodes of several components; among: the keys looked at.

    A node has a row in its own part of the bucket, and one as a guest in each other part if it is outside the bucket's
    largest component.
    """
    if "guest" in buckets.columns:
        buckets = buckets.where("guest = 0")
    rows = buckets.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    counts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.ceil(F.sum("n") / SPLIT).cast("int").alias("parts"), F.max_by("root", F.struct("n", "root")).alias("main"))
    several = several.where("roots > 1").select("key", "parts", "main")
    if among is not None:
        several = several.join(among, "key")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    visits = F.when(F.col("root") != F.col("main"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    dealt = rows.join(several, "key").withColumn("own", own).select("key", "node", "root", "own", F.explode(visits).alias("part"))
    return write_table(dealt.select("key", "part", (F.col("part") != F.col("own")).cast("int").alias("guest"), "node", "root"), "buckets")


def links(rows: DataFrame, nodes: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) and the components of nodes (node, root) that they make."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = write_table(keys.join(shared, "key"), "keys")
    star = buckets.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    tested = write_table(star, "pairs")
    found = verified(rows, nodes, tested, least)
    roots = components(found)
    segment = 0
    while True:
        most, own, beyond, open_ = FIRST_ROUND, buckets, None, None
        while True:
            own = mixed_keys(own, roots, open_)
            if own.isEmpty():
                break
            made = write_table(cross_pairs(own, nodes, most, least, segment), "cross")
            pairs = write_table(made.where("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
            if not pairs.isEmpty():
                tested = tested.union(pairs)
                new = verified(rows, nodes, pairs, least)
                found = found.union(new)
                roots = merged(roots, new)
            if beyond is None:
                beyond = write_table(made.where("not more").select("key").distinct(), "beyond")
            # only buckets where nodes have more partners go on
            open_ = write_table(made.where("more").select("key").distinct(), "open")
            if open_.isEmpty():
                break
            most *= GROWTH
        if beyond is None or beyond.isEmpty():
            return found, roots
        buckets = buckets.join(beyond, "key", "left_semi")
        segment += 1


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, digest, class_id (the least doc_id of its class) and root (its component, also where doc_ids are null or
    repeated) for every row."""
    rows = keyed(docs)
    nodes = nodes_of(rows)
    _, roots = links(rows, nodes, least)
    rooted = nodes.join(roots, "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = write_table(rooted.join(ids, "root").select("digest", "class_id", "root"), "classes")
    return rows.select("doc_id", "digest").join(named, "digest")


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows whose doc_id is the least of their class, one row for each class, with the columns of the input."""
    found = write_table(classes(docs, least), "rows")
    of_class = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "digest")).alias("x"))
    keepers = of_class.select("x.doc_id", "x.digest")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", F.md5(text_or_empty().cast("binary")).alias("digest"))
    same = rows["doc_id"].eqNullSafe(keepers["doc_id"]) & (rows["digest"] == keepers["digest"])
    kept = rows.join(keepers, same, "left_semi")
    twice = found.groupBy("doc_id", "digest").count().where("count > 1")
    if not twice.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select("_row.*")
