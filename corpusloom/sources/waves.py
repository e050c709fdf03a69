"""Scans that stop: files are read in waves, each twice as many as before, until every quota is full.

Files go by their names and rows by their place in the file, so the rows found are the same whatever the waves. What earlier waves found
is written, and only a count for each label is kept between them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import scratch


def plain(path: str) -> str:
    """One form of a path, whatever the slashes after its scheme."""
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def files_below(spark: SparkSession, path: str) -> list[str]:
    """All data files below a path, by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while listed.hasNext():
        file = listed.next().getPath()
        if not file.getName().startswith(("_", ".")):
            found.append(plain(file.toUri().toString()))
    return sorted(found)


def first_rows(spark: SparkSession, files: list[str], read: Callable[[list[str]], DataFrame], quotas: dict[str, int], label: str | None, first_wave: int = 1) -> tuple[DataFrame, int]:
    """The first rows of each label up to its quota, in the order of the files, and how many files were read.

    read: a frame of some files with the columns file_path and place (rising in a file) beside its own. With label None all rows
    share one quota, named "".
    """
    if not files:
        raise ValueError("no files")
    found, path, done, wave = dict.fromkeys(quotas, 0), scratch(spark, "wave"), 0, first_wave
    while done < len(files) and any(found[x] < n for x, n in quotas.items()):
        part = files[done : done + wave]
        rows = read(part)
        columns = rows.columns
        table = spark.createDataFrame([(x, n - found[x]) for x, n in quotas.items() if found[x] < n], "_label string, _open int")
        order = spark.createDataFrame([(f, done + k) for k, f in enumerate(part)], "_path string, _file int")
        rows = rows.withColumn("_label", F.lit("") if label is None else F.col(label)).join(F.broadcast(table), "_label")
        rows = rows.join(F.broadcast(order), F.regexp_replace("file_path", r"^(\w+):/+", "$1:/") == F.col("_path"))
        rank = F.row_number().over(Window.partitionBy("_label").orderBy("_file", "place"))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= max(n - found[x] for x, n in quotas.items())).where("_rank <= _open")
        rows.select(*columns, "_label").write.mode("append").parquet(path)
        done += len(part)
        wave *= 2
        counts = spark.read.parquet(path).groupBy("_label").count().collect()  # a row for each label
        found |= {r["_label"]: r["count"] for r in counts}
    return spark.read.parquet(path).drop("_label") if done else read(files[:1]).limit(0), done


def parquet_files(spark: SparkSession) -> Callable[[list[str]], DataFrame]:
    def read(files: list[str]) -> DataFrame:
        return spark.read.parquet(*files).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("place"))

    return read
