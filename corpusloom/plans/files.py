"""Queries of sources and sinks: driver tables written in a layout and read back from it."""

from __future__ import annotations

from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import audit
from corpusloom.plans.auditing import WIKI_PARTS, wiki_sql
from corpusloom.plans.base import corpus, predicted, query, scratch
from corpusloom.plans.curation import CLEAN
from corpusloom.schema import CORPUS
from corpusloom.sources import readers, writers

ONE_LINE = r"regexp_replace(text, '[\r\n]+', ' ', 'g')"


def full_rows(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumns({"id": F.col("id").cast("string"), "subcorpus": F.lit(None).cast("string"), "split": F.when(F.col("is_core"), 'a "quoted", value')})
    return rows.select(*CORPUS.names)


CORPUS_ROWS_SQL = "SELECT id::VARCHAR AS id, text, label, source, NULL::VARCHAR AS subcorpus, group_id, is_core, CASE WHEN is_core THEN 'a \"quoted\", value' END AS split FROM c"


@query(CORPUS_ROWS_SQL)
def csv_round_trip(spark, sf_dir):
    """The common schema as CSV; texts span lines."""
    path = scratch(spark, "csv")
    writers.csv(full_rows(spark, sf_dir), path)
    return readers.csv(spark, path)


@query(f"SELECT id::VARCHAR AS id, {CLEAN} AS text FROM c")
def tsv_round_trip(spark, sf_dir):
    path = scratch(spark, "tsv")
    rows = full_rows(spark, sf_dir).select("id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    writers.csv(rows, path, ["id", "text"], sep="\t")
    return readers.tsv(spark, path, "id string, text string")


@query("SELECT id::VARCHAR AS id, text, label, source FROM c WHERE label IN ('de', 'fr')")
def jsonl_round_trip(spark, sf_dir):
    """JSON Lines, read for two labels."""
    path = scratch(spark, "jsonl")
    writers.jsonl(full_rows(spark, sf_dir), path)
    return readers.jsonl(spark, path, ["de", "fr"]).select("id", "text", "label", "source")


@query(r"SELECT text, count(*) AS n FROM (SELECT trim(regexp_replace(l, '\s+', ' ', 'g')) AS text FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM c)) GROUP BY text")
def text_lines_scan(spark, sf_dir):
    """All lines of all documents as lines of text files."""
    path = scratch(spark, "lines")
    corpus(spark, sf_dir).select("text").write.text(path)
    return readers.text_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id::VARCHAR AS id, text FROM c")
def json_map_scan(spark, sf_dir):
    """Files with an object from ids to texts, of at most a thousand documents."""
    path = scratch(spark, "maps")
    maps = corpus(spark, sf_dir).groupBy(F.floor(F.col("id") / 1000).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "text"))).alias("m"))
    maps.select(F.to_json("m").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.json_map(spark, path).select("id", "text")


def rooted(batches):
    """Lines of a file between the tags of its root."""
    line = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])
    yield line("<mediawiki>")
    yield from batches
    yield line("</mediawiki>")


@query(f"SELECT id::VARCHAR AS title, trim({wiki_sql(' ')}) AS text FROM c")
def wiki_dump_scan(spark, sf_dir):
    """Each document as a page of a compressed dump."""
    path = scratch(spark, "dump")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    markup = F.concat(*[safe(F.col(p)) if k % 2 else F.lit(escape(p)) for k, p in enumerate(WIKI_PARTS)])
    page = F.concat(F.lit("<page>\n<title>"), F.col("id").cast("string"), F.lit('</title><revision><text xml:space="preserve">'), markup, F.lit("</text></revision></page>"))
    corpus(spark, sf_dir).select(page.alias("value")).mapInArrow(rooted, "value string").write.option("compression", "gzip").text(path)  # a file for each task; bzip2 takes three times as long
    return readers.mediawiki(spark, path)


@query("SELECT count(*) AS texts, sum(strlen(text) + 1)::BIGINT AS bytes FROM c")
def objects_scan(spark, sf_dir):
    """Whole objects with their lengths."""
    path = scratch(spark, "objects")
    corpus(spark, sf_dir).select("text").write.option("maxRecordsPerFile", 50).text(path)
    found = readers.objects(spark, path, "part-*")
    lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1
    texts = corpus(spark, sf_dir).agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.count(F.lit(1)).alias("n"))  # one row
    whole = found.agg(F.sum("length").alias("bytes"), F.sum(lines).alias("lines"))
    return whole.join(texts, "lines").select(F.col("n").alias("texts"), "bytes")


@query("SELECT id AS number, CASE id % 3 WHEN 0 THEN 'invalid JSON' ELSE 'missing keys' END AS error, CASE id % 3 WHEN 0 THEN '{' || label ELSE '{\"text\":\"' || label || '\"}' END AS line FROM c WHERE id % 3 < 2")
def error_rows(spark, sf_dir):
    """Bad lines with their numbers and errors, as a CSV file."""
    k = F.col("id") % 3
    good = F.to_json(F.struct("text", "label"))
    line = F.when(k == 0, F.concat(F.lit("{"), "label")).when(k == 1, F.to_json(F.struct(F.col("label").alias("text")))).otherwise(good)
    path = scratch(spark, "errors")
    writers.csv(audit.jsonl_errors(corpus(spark, sf_dir).select(F.col("id").alias("number"), line.alias("value"))), path, ["number", "error", "line"])
    return readers.csv(spark, path, "number long, error string, line string")


@query("SELECT source AS dataset, true_label, id, predicted_label FROM p WHERE true_label <> predicted_label")
def mismatch_files(spark, sf_dir):
    """Wrong predictions in a folder for each dataset and label."""
    path = scratch(spark, "mismatches")
    rows = predicted(spark, sf_dir).select(F.col("source").alias("dataset"), "true_label", "id", "predicted_label")
    writers.mismatches(rows, path)
    return spark.read.schema("id long, predicted_label string, dataset string, true_label string").option("header", True).csv(path)


@query("SELECT 'rule' AS model, source AS dataset, id, predicted_label FROM p")
def prediction_files(spark, sf_dir):
    path = scratch(spark, "predictions")
    writers.predictions(predicted(spark, sf_dir).select(F.lit("rule").alias("model"), F.col("source").alias("dataset"), "id", "predicted_label"), path)
    return spark.read.schema("id long, predicted_label string, model string, dataset string").option("header", True).csv(path)


@query(f"SELECT '__label__' || label || ' ' || {ONE_LINE} AS value, count(*) AS n FROM c GROUP BY ALL")
def training_lines(spark, sf_dir):
    path = scratch(spark, "training")
    writers.training_lines(corpus(spark, sf_dir), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 0 AS part, '__label__' || label || ' ' || label AS value, 1 AS n FROM (SELECT DISTINCT label FROM c) UNION ALL SELECT 1, '__label__' || label || ' ' || {ONE_LINE}, count(*) FROM c GROUP BY ALL")
def declared_lines(spark, sf_dir):
    """Training lines after a line for each label."""
    path = scratch(spark, "declared")
    rows = corpus(spark, sf_dir)
    writers.declared_lines(rows, rows.select("label").distinct(), path)
    return spark.read.text(path).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, 'old' AS route, {CLEAN} AS text FROM c WHERE label IN ('en', 'fr')")
def routed_files(spark, sf_dir):
    """Rows of one route, tab separated."""
    path = scratch(spark, "routed")
    route = F.when(F.col("label").isin("en", "fr"), "old").otherwise("new")
    writers.routed(corpus(spark, sf_dir).select("id", route.alias("route"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")), path, "old")
    return spark.read.schema("id long, route string, text string").option("sep", "\t").csv(path)


@query("SELECT id, text FROM c WHERE label = 'de'")
def swapped_table(spark, sf_dir):
    """A table that is replaced by a part of itself."""
    path = scratch(spark, "swapped")
    writers.parquet(corpus(spark, sf_dir).select("id", "text", "label"), path)
    writers.swap(spark, spark.read.parquet(path).where("label = 'de'").select("id", "text"), path)
    return spark.read.parquet(path)
