"""Registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import bound
from corpusloom.llm import bpe, codes, common, fingerprints, licenses, linededup, minhash, packing, periodic, pii, quality, repair, toxicity, warc


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.classes(common.read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    found = bpe.encode_and_decode(common.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of all documents."""
    found = licenses.scan_licenses(common.read(spark, sf_dir, "documents"))
    starts = F.col("places.start")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    # the coverage of the fullest span; a phrase without one counts as half a licence
    base_score = F.when(F.size("places") > 0, 0.5).otherwise(0.0)
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat(F.col("places.label"), F.col("spans.label"))).alias("labels"),
        F.greatest(base_score, F.coalesce(F.array_max(F.col("spans.coverage")), F.lit(0.0))).alias("score"),
        "spans",
    )


def op5_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host verdicts for all documents."""
    found = quality.quality(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.compare_edits(common.read(spark, sf_dir, "documents"))


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    path = common.scratch_path(spark, "warc")
    warc.write_archives(common.read(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path, payloads=False)
    return found.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "verified"
    )


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data and secrets."""
    found = pii.with_surrogates(common.read(spark, sf_dir, "documents").select("doc_id", "text"), kinds="found")
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("kinds"))


def op7_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines."""
    return linededup.remove_repeated_lines(common.read(spark, sf_dir, "documents").select("doc_id", "text"), "n_removed")


def op8_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids through Re-Pair files and back."""
    path = common.scratch_path(spark, "shards")
    repair.write_shards(common.read(spark, sf_dir, "documents"), path)
    found = repair.read_shards(spark, path)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    found = packing.cut_and_pack(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op11_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from two thirds of the labels."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = toxicity.scored(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "terms", F.slice("neighbours", 1, 3).alias("evidence"))


def repeated_words(text: F.Column, number: F.Column) -> F.Column:
    """From a word chosen by a number on, the next words again and again; at least three and a bit times."""

    def changed(words: F.Column) -> F.Column:
        n = F.size(words)
        first = number % F.greatest(n, F.lit(1))
        period = 1 + F.floor((n - first) / (3 + number % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < first, w).otherwise(F.get(words, (first + (i - first) % period).cast("int")))), " ")

    return bound(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), changed)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which are made to hold some."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", common.text_or_empty().alias("text"))
    chosen = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("text", F.when(chosen % 10 == 0, repeated_words(F.col("text"), F.floor(chosen / 10))).otherwise(F.col("text")))
    found = periodic.find_runs(docs)
    more = lambda a, b: b["length"] * a["period"] - a["length"] * b["period"]  # noqa: E731  exponents as fractions
    order = F.array_sort("runs", lambda a, b: F.signum(F.when(more(a, b) != 0, more(a, b)).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])).cast("int"))
    told = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("best", F.get(order, F.lit(0))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all sound vectors."""
    found, codebooks = codes.compress(common.read(spark, sf_dir, "embeddings"))
    return codes.with_label_error(found).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(codebooks)).alias("codebooks_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_segments": op1_warc_segments,
    "op2_bag_minhash": op2_bag_minhash,
    "op3_bpe_segment_tree": op3_bpe_segment_tree,
    "op4_license_automaton": op4_license_automaton,
    "op5_quality_hosts": op5_quality_hosts,
    "op6_surrogates": op6_surrogates,
    "op7_line_join": op7_line_join,
    "op8_repair_shards": op8_repair_shards,
    "op9_genetic_packing": op9_genetic_packing,
    "op10_one_permutation": op10_one_permutation,
    "op11_nearest_toxic": op11_nearest_toxic,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exponion_codes": op13_exponion_codes,
}

ORACLE_SQL: dict[str, str] = {"op1_warc_segments": warc.ORACLE_SQL, "op5_quality_hosts": quality.ORACLE_SQL, "op13_exponion_codes": codes.oracle_sql()}
