"""Vector functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import bound


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column | str) -> Column:
    logits = F.col(logits) if isinstance(logits, str) else logits
    powers = bound(logits, lambda v: F.transform(v, lambda x: F.exp(x.cast("double") - F.array_max(v).cast("double"))))
    return bound(powers, lambda v: bound(F.aggregate(v, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(v, lambda x: x / total)))


def argmax(values: Column | str) -> Column:
    """Index from 0 of the largest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def head_scores(vector: Column | str, weights: list[list[float]]) -> Column:
    """Softmax over the products with each row of weights."""
    rows = F.array(*[dot(vector, F.array(*[F.lit(float(x)) for x in row])) for row in weights])
    return softmax(rows)


def best_entry(scores: Column | str) -> Column:
    """struct(key, value) of the largest value of a map; equals by key."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key")))
    top = F.array_min(entries)
    return F.struct(top["key"].alias("key"), (-top["minus"]).alias("value"))


def means_by(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """keys, rows, mean of the vectors of each key, null ones left out; numbers meet as sums of each place, never as vectors."""
    rows = df.where(F.col(vector).isNotNull())
    each = rows.select(*keys, F.posexplode(vector).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    places = F.array_sort(F.collect_list(F.struct("_at", "_mean")))  # as many as a vector has
    return each.groupBy(*keys).agg(F.max("_n").alias("rows"), F.transform(places, lambda p: p["_mean"]).alias("mean"))


def mean_vector(vectors: Column | str, size: int) -> Column:
    """Mean of an array of vectors; zeros if there are none."""
    zero = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    n = F.greatest(F.size(vectors), F.lit(1))
    return F.transform(total, lambda x: x / n)
