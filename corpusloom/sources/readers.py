"""Readers of corpora in the layouts they come in. Everything is read through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.schema import BENCHMARK, CORPUS
from corpusloom.sources.matrices import dense_matrix
from corpusloom.sources.scans import block_annotated, lines, usfx

__all__ = ["block_annotated", "book_dirs", "book_sentences", "csv", "dense_matrix", "existing", "jdbc", "json_map", "jsonl", "lines", "mediawiki", "objects", "paired_lines", "text_lines", "tsv", "usfx"]


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = CORPUS, sep: str = ",", na_tokens: tuple[str, ...] = (), multi_line: bool = True) -> DataFrame:
    """Rows of a file with a header; with multi_line quoted values may span lines, without it large files are read in blocks. na_tokens are read as null."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("sep", sep).option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if na_tokens:
        df = df.select([F.when(F.col(f.name).isin(list(na_tokens)), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])
    return df


def tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return csv(spark, path, schema, "\t")


def jsonl(spark: SparkSession, path: str, labels: list[str] | None = None, schema: T.StructType = BENCHMARK) -> DataFrame:
    """Lines of JSON, with dataset (the file's name); only some labels, if named."""
    df = spark.read.schema(schema).json(path).withColumn("dataset", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl?$", ""))
    return df.where(F.col("label").isin(labels)) if labels else df


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """text, group_id (the file's name) for each line, however large the files."""
    return spark.read.text(path).select(X.clean("value").alias("text"), F.col("_metadata.file_name").alias("group_id"))


def paired_lines(spark: SparkSession, texts: str, labels: str) -> DataFrame:
    """number, text, label of two files with as many lines."""
    from corpusloom.operators.curate import zip_lines

    a = lines(spark, texts).select("number", F.col("value").alias("text"))
    return zip_lines(a, lines(spark, labels).select("number", F.col("value").alias("label")), "number")


def mediawiki(spark: SparkSession, path: str) -> DataFrame:
    """title, text of every page with a text; compressed dumps too."""
    schema = "title string, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", True).schema(schema).load(path)
    text = F.array(X.strip_wiki("revision.text._VALUE"))
    return pages.select("title", F.explode(F.filter(text, lambda t: F.length(t) > 0)).alias("text"))  # a filter on text would strip it twice


def book_dirs(spark: SparkSession, path: str) -> DataFrame:
    """book, text and metadata of a tree with a directory for each book; bad bytes are replaced."""
    parent = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    texts = texts.select(F.url_decode(parent).alias("book"), F.col("value").alias("text"))
    fields = "title string, title_en string, author string, genre string, issued_date string, written_date string, ocr_confidence double"
    meta = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="metadata.json")
    meta = meta.select(F.url_decode(parent).alias("book"), F.from_json("value", F.lit(fields)).alias("m")).select("book", "m.*")
    return texts.join(meta, "book", "left")


def book_sentences(books: DataFrame) -> DataFrame:
    """id, text of each sentence of each book, in order."""
    rows = books.select("*", F.posexplode(X.split_eos(X.strip_join_marker("text"))).alias("position", "sentence")).drop("text")
    key = F.concat_ws("_", X.stub("book"), X.padded("position", 5))
    return rows.select(key.alias("id"), X.clean("sentence").alias("text"), *[c for c in rows.columns if c not in ("sentence",)])


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """group_id (the file name's first part), id, text of JSON objects from ids to texts."""
    whole = spark.read.text(path, wholetext=True)
    group = F.regexp_extract(F.col("_metadata.file_name"), r"^([^_.]+)", 1)
    return whole.select(group.alias("group_id"), F.explode(F.from_json("value", F.lit("map<string,string>"))).alias("id", "text"))


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of whole objects."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def existing(spark: SparkSession, paths: list[str], read) -> DataFrame:
    """The union of the paths that exist; an error if none does."""
    from corpusloom.operators.curate import union_existing

    def there(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    return union_existing([read(p) for p in paths if there(p)])
