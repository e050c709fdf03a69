"""The registry of queries and the corpus view of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schema import Config
from corpusloom.sources.scratch import scratch, written

__all__ = ["CONFIG", "LABELS", "ORACLE_SQL", "QUERIES", "corpus", "language_rule", "predicted", "query", "scratch", "table", "written"]

#: The driver tables hold other languages: accented Latin letters stand in for the target script.
CONFIG = Config(core=("en", "de", "fr"), mixed="es", script="À-ſ", other_script="ß-ß")
LABELS = ["de", "en", "es", "fr"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CORPUS_SQL = """c AS (
  SELECT doc_id AS id, text, lang AS label, source, source || '_' || (doc_id % 7) AS group_id,
         lang IN ('en', 'de', 'fr') AS is_core, 'L' || (CAST(substr(source, 4) AS INT) % 4) AS label2
  FROM documents)"""
#: A simple rule as a classifier.
PREDICTED_SQL = """p AS (
  SELECT c.*, label AS true_label,
         CASE WHEN regexp_matches(text, '[ßäöü]') THEN 'de' WHEN regexp_matches(text, '[ñóí]') THEN 'es'
              WHEN regexp_matches(text, '[À-ſ]') THEN 'fr' ELSE 'en' END AS predicted_label FROM c)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query; sql is what DuckDB runs for the same rows. WITH c, p are put before it."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            uses_p = " p" in sql.replace("\n", " ")
            lead = f"WITH {CORPUS_SQL}" + (f", {PREDICTED_SQL}" if uses_p else "")
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                ORACLE_SQL[key] = f"WITH RECURSIVE {lead[5:]}, {body[15:]}"
            else:
                ORACLE_SQL[key] = f"{lead}, {body[5:]}" if body.upper().startswith("WITH ") else f"{lead} {body}"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus: id, text, label, source, group_id, is_core, label2."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("lang").alias("label"),
        "source",
        F.concat("source", F.lit("_"), (F.col("doc_id") % 7).cast("string")).alias("group_id"),
        F.col("lang").isin(list(CONFIG.core)).alias("is_core"),
        F.concat(F.lit("L"), (F.substring("source", 4, 9).cast("int") % 4).cast("string")).alias("label2"),
    )


def language_rule():
    """A simple rule as a classifier of text."""
    return F.when(F.col("text").rlike("[ßäöü]"), "de").when(F.col("text").rlike("[ñóí]"), "es").when(F.col("text").rlike("[À-ſ]"), "fr").otherwise("en")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return rows.withColumn("true_label", F.col("label")).withColumn("predicted_label", language_rule())
