"""Document fingerprints by one-permutation MinHash, with DataFrame functions only (operator 10).

Every five-word shingle is hashed once. The top bits name one of 256 bins, and each bin keeps its least hash.
An empty bin copies the first filled bin of a random order of its own (optimal densification). Four low bits of
each bin are packed; a comparison counts equal bins and takes out the share that agrees by chance.

Defined cases: null texts count as empty, and an empty text has an empty fingerprint, wholly like another empty
one and unlike any other; a text of one to four words is one shingle; equal texts have equal fingerprints; rows with
the same doc_id follow one another in the descending order of their texts' MD5, and rows without one come after the
lowest; a single document follows itself; an empty table gives an empty table; other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import text_or_empty, write_table
from corpusloom.llm.quality import with_words

BINS, BITS, SHINGLE, PROBES = 256, 4, 5, 12
CHANCE = 2.0**-BITS


def with_bins(docs: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds the packed bins of a text (16 longs of 16 bins; an empty array for a text without words)."""
    found = with_words(docs, text).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    others = ", ".join(f"get(_hashes, i + {k})" for k in range(1, SHINGLE))
    found = found.withColumn(
        "_sorted",
        F.expr(f"sort_array(transform(slice(_hashes, 1, if(size(_hashes) = 0, 0, greatest(size(_hashes) - {SHINGLE - 1}, 1))), (x, i) -> xxhash64(x, {others})))"),
    )
    # shiftright keeps the sign, so bins run from -128 to 127 in the order of the hashes
    found = found.withColumn("_least", F.expr("filter(_sorted, (x, i) -> i = 0 or shiftright(x, 56) != shiftright(get(_sorted, i - 1), 56))"))
    gaps = "flatten(transform(_least, (x, i) -> concat(array_repeat(cast(null as bigint), cast(shiftright(x, 56) - coalesce(shiftright(get(_least, i - 1), 56), -129L) - 1 as int)), array(x))))"
    found = found.withColumn("_bins", F.expr(gaps))
    probes = ", ".join(f"get(_bins, cast(pmod(xxhash64(j, {t}), {BINS}) as int))" for t in range(PROBES))
    rest = "array_min(transform(_least, x -> struct(xxhash64(j, shiftright(x, 56)) as r, x as x))).x"
    found = found.withColumn("_full", F.expr(f"if(size(_least) = 0, cast(array() as array<bigint>), transform(sequence(0, {BINS - 1}), j -> coalesce(get(_bins, j), {probes}, {rest})))"))
    each = 64 // BITS
    packed = f"transform(sequence(0, {BINS // each - 1}), k -> aggregate(slice(_full, k * {each} + 1, {each}), 0L, (a, x) -> shiftleft(a, {BITS}) | (x & {2**BITS - 1})))"
    found = found.withColumn(out, F.expr(f"if(size(_full) = 0, cast(array() as array<bigint>), {packed})"))
    return found.drop("_words", "_hashes", "_sorted", "_least", "_bins", "_full")


def shown(bins: str) -> Column:
    """The fingerprint as hexadecimal digits, one for each bin."""
    return F.lower(F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Share of equal bins without the share that agrees by chance, from 0 to 1."""
    unlike = f"aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0, (n, z) -> n + bit_count((z | shiftright(z, 1) | shiftright(z, 2) | shiftright(z, 3)) & 1229782938247303441L))"
    share = f"greatest(0D, ({BINS} - {unlike}) / {BINS}D - {CHANCE}D) / {1 - CHANCE}D"
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1D when size({a}) = 0 or size({b}) = 0 then 0D else {share} end")


def with_next(rows: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """Adds next_<column> from the row with the next lower key (after the lowest: the highest); rows is a written table.

    Rows without a key come after the lowest; equal keys go by tie, downwards too. Rows are dealt by ranges of this order,
    whose bounds Spark's range partitioning of the keys finds, so a key of many rows spreads over many ranges. The
    highest row of each range is also lent to the range above, so that no range needs another's rows; there are as many of
    those as ranges.
    """
    place = F.struct(F.col(key).isNotNull().alias("a"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("b"), F.col(tie).alias("c"), F.col("_number").alias("d"))
    rows = rows.withColumn("_number", F.monotonically_increasing_id()).withColumn("_place", place)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("_place").repartitionByRange(n, "_place").withColumn("_span", F.spark_partition_id())
    ranges = sorted(tuple(r) for r in dealt.groupBy("_span").agg(F.min("_place"), F.max("_place")).select("min(_place)", "max(_place)").collect())  # a row for each range
    if not ranges:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("_number", "_place")
    bounds = F.array(*[F.struct(*[F.lit(x) for x in low]) for low, _ in ranges]).cast("array<struct<a: boolean, b: bigint, c: string, d: bigint>>")
    steps = [1 << k for k in reversed(range(len(ranges).bit_length()))]
    span = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when(F.get(bounds, p + s) <= F.col("_place"), p + s).otherwise(p))
    own = rows.withColumn("_span", span).withColumn("_lent", F.lit(0))
    lent = rows.where(F.col("_number").isin([high.d for _, high in ranges])).withColumn("_span", F.pmod(span + 1, F.lit(len(ranges)))).withColumn("_lent", F.lit(1))
    order = Window.partitionBy("_span").orderBy("_lent", F.col("_place").desc())
    found = own.unionByName(lent).withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return found.where("_lent = 0").drop("_span", "_lent", "_number", "_place")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, bins of every row, and next_text and next_bins of the document that follows it downwards."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = write_table(with_bins(rows, F.col("text"), "bins").withColumn("digest", F.md5("text")), "bins")
    return with_next(rows, "doc_id", "digest", ["text", "bins"]).drop("digest")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and what they are alike."""
    half = F.expr("cast(floor(length(text) / 2) as int)")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    found = fingerprints(docs).withColumn("edited", edited)
    found = with_bins(found, F.col("edited"), "edited_bins")
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown("bins").alias("fingerprint"),
        shown("edited_bins").alias("edited_fingerprint"),
        likeness("bins", "edited_bins").alias("near_edited"),
        likeness("bins", "next_bins").alias("near_next"),
    )
