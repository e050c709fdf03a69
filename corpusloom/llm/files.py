"""Plain binary files through Spark's own writer and reader, on any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import dropped_shuffles


def write_blocks(df: DataFrame, column: str, path: str, separator: str, compression: str = "none", most: int = 0) -> None:
    """Each row's bytes, then the separator, in files of at most so many rows (0: a file for each partition).

    The text writer puts out the bytes of a value as they are, also where they are no UTF-8.
    """
    writer = df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", separator).option("maxRecordsPerFile", most)
    with dropped_shuffles(df.sparkSession):
        writer.text(path, compression=compression)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
