"""Checks and profiles; each gives rows, never prints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.filters import not_blank


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Counts and percentages."""
    counts = value_counts(df, key)
    whole = counts.agg(F.sum("n").alias("_all"))  # one row
    return counts.join(F.broadcast(whole)).select(key, "n", F.round(F.col("n") * 100.0 / F.col("_all"), 4).alias("share"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str], total: bool = True) -> DataFrame:
    """Counts of rows by two keys, zeros filled in, with a last row TOTAL."""
    counted = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    if not total:
        return counted
    sums = counted.agg(*[F.coalesce(F.sum(F.col(f"`{v}`")), F.lit(0)).cast("long").alias(v) for v in values])
    return counted.unionByName(sums.withColumn(row, F.lit("TOTAL")))


def leakage(df: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups in more than one split: group, splits."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def split_intersections(df: DataFrame, splits: tuple[str, ...], group: str = "group_id") -> DataFrame:
    """For each pair of splits the number of groups in both."""
    held = df.groupBy(group).agg(F.collect_set("split").alias("s"))
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    both = [F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}") for a, b in pairs]
    return held.agg(*both).unpivot([], [f"{a}_{b}" for a, b in pairs], "pair", "groups")


def length_stats(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Least, mean, exact median and most characters and words by key. An exact median holds each key's distinct lengths, which are
    as few as the longest text is long."""
    chars, words = F.length(text), X.word_count(text)
    stats = [
        f(c).cast("double" if name not in ("min", "max") else "long").alias(f"{name}_{unit}")
        for unit, c in (("chars", chars), ("words", words))
        for name, f in (("min", F.min), ("median", F.median), ("mean", F.avg), ("max", F.max), ("std", F.stddev_samp))
    ]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *stats)


def group_stats(df: DataFrame, key: str, group: str, large: int = 100) -> DataFrame:
    sizes = df.groupBy(key, group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(key).agg(
        F.count(F.lit(1)).alias("groups"), F.min("n").alias("least"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.count_if(F.col("n") > large).alias("large")
    )


def null_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """column, nulls, blanks (blanks only for the text)."""
    blanks = F.count_if(~not_blank(text)).alias("_blank")
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], blanks)
    long = counts.unpivot(["_blank"], df.columns, "column", "nulls")
    return long.select("column", "nulls", F.when(F.col("column") == text, F.col("_blank")).otherwise(F.lit(0)).alias("blanks"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Every row whose keys occur more than once."""
    rows = df.withColumn("_digest", F.md5(F.to_json(F.struct(*keys))))  # 128 bits stand for the keys
    many = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(many, "_digest").drop("_digest")


def id_uniqueness(df: DataFrame, key: str = "id") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("ids"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated"))


def imbalance(df: DataFrame, label: str = "label") -> DataFrame:
    counts = value_counts(df, label)
    return counts.agg(
        (F.max("n") / F.min("n")).alias("ratio"),
        F.min_by(label, F.struct("n", label)).alias("smallest"),
        F.min("n").alias("least"),
        (F.min("n") * 100.0 / F.sum("n")).alias("smallest_share"),
    )


def script_share(df: DataFrame, script: str, n: int, seed: int, label: str = "label", key: str = "id") -> DataFrame:
    """Of n random rows of each label the share with the script: a sampling operator."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(X.seeded(seed, key)))
    rows = df.withColumn("_rank", rank).where(F.col("_rank") <= n)
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.avg(X.has_script("text", script).cast("double")).alias("share"))


def vocabulary(df: DataFrame, least: int, text: str = "text") -> DataFrame:
    words = df.select(F.explode(X.words(F.lower(text))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def characters(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(F.split(text, "")).alias("char")).where("char != ''").groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def jsonl_errors(lines: DataFrame, keys: tuple[str, ...] = ("text", "label")) -> DataFrame:
    """number, error, line of bad JSON lines: invalid, then missing keys, empty label, empty text."""
    fields = F.from_json("value", F.lit("map<string,string>"))
    rows = lines.withColumn("_map", fields).withColumn("_bad", F.col("_map").isNull() | F.col("value").rlike(r"^\s*[^{\s]"))
    missing = [k for k in keys]
    error = F.when(F.col("_bad"), "invalid JSON")
    for k in missing:
        error = error.when(~F.map_contains_key("_map", k), "missing keys")
    error = error.when(F.trim(F.coalesce(F.col("_map")["label"], F.lit(""))) == "", "empty label").when(F.trim(F.coalesce(F.col("_map")["text"], F.lit(""))) == "", "empty text")
    return rows.withColumn("error", error).where("error is not null").select("number", "error", F.col("value").alias("line"))
