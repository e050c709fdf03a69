"""Writers; all of them write in parallel and none collects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schema import CORPUS


def csv(df: DataFrame, path: str, columns: list[str] | None = None, by: list[str] | None = None, sep: str = ",") -> None:
    """CSV in the order of the schema, replacing what is there; blanks at the ends of values stay."""
    writer = df.select(*(columns or CORPUS.names)).write.mode("overwrite").option("header", True).option("escape", '"').option("sep", sep)
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.partitionBy(*by) if by else writer).csv(path)


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def parquet(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A one-row JSON report."""
    df.coalesce(1).write.mode("overwrite").text(path)


def training_lines(df: DataFrame, path: str, label: str = "label", text: str = "text") -> None:
    """A line "__label__X text" for each row."""
    df.select(F.concat(F.lit("__label__"), F.col(label), F.lit(" "), F.regexp_replace(text, r"[\r\n]+", " ")).alias("value")).write.mode("overwrite").text(path)


def declared_lines(df: DataFrame, labels: DataFrame, path: str, label: str = "label", text: str = "text") -> None:
    """Training lines, with a line for each label in a file that sorts first (labels: a small table)."""
    head = labels.select(F.lit(0).alias("part"), F.concat(F.lit("__label__"), F.col(label), F.lit(" "), F.col(label)).alias("value"))
    body = df.select(F.lit(1).alias("part"), F.concat(F.lit("__label__"), F.col(label), F.lit(" "), F.regexp_replace(text, r"[\r\n]+", " ")).alias("value"))
    head.unionByName(body).write.mode("overwrite").partitionBy("part").text(path)


def vectors(model, path: str) -> None:
    """A line for each word: the word and its numbers."""
    from corpusloom.functions.ml_text import vector_line

    model.getVectors().select(vector_line("word", "vector").alias("value")).write.mode("overwrite").text(path)


def predictions(df: DataFrame, path: str) -> None:
    """Predictions by model and dataset."""
    df.write.mode("overwrite").partitionBy("model", "dataset").option("header", True).csv(path)


def mismatches(df: DataFrame, path: str) -> None:
    """Wrong predictions by dataset and true label."""
    df.where("true_label != predicted_label").write.mode("overwrite").partitionBy("dataset", "true_label").option("header", True).csv(path)


def routed(df: DataFrame, path: str, route: str) -> None:
    """Rows of one route, tab separated."""
    df.where(F.col("route") == route).write.mode("overwrite").option("sep", "\t").csv(path)


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a table by a frame that may read it: write beside it, then move."""
    fresh, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(fresh)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(at(fresh), at(path)):
        raise OSError(f"{fresh} can't be moved")
    fs.delete(at(old), True)


def model(fitted, path: str) -> None:
    fitted.write().overwrite().save(path)
