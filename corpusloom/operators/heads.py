"""Softmax heads over frozen vectors, trained by stochastic gradient descent with a linearly falling rate, in parallel.

In each epoch a seeded hash orders the rows. A task takes one range of that order and goes through it row by row, from the weights that
the epoch began with; then the tasks' weights are averaged by their rows. With one range this is plain sequential training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.metrics import class_weights


def epoch_of(rows: DataFrame, weights: np.ndarray, epoch: int, epochs: int, rates: tuple[float, float], parts: int, key: str, seed: int) -> np.ndarray:
    """The weights (labels x dimensions) after one pass. rows: key, y, weight, v."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    dealt = rows.withColumn("_order", X.seeded(seed, F.lit(epoch), key))
    dealt = dealt.repartitionByRange(parts, "_order", key) if parts > 1 else dealt.coalesce(1)
    first, last = rates

    def run(batches):
        w, n, done = held.value.copy(), None, 0
        for batch in batches:
            many = batch.column("many").to_pylist()
            n = n or (many[0] if many else None)
            vectors = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            for y, weight, v in zip(batch.column("y").to_pylist(), batch.column("weight").to_pylist(), vectors, strict=True):
                rate = first + (last - first) * (epoch + done / n) / epochs
                scores = w @ v
                powers = np.exp(scores - scores.max())
                wrong = powers / powers.sum()
                wrong[y] -= 1
                w -= rate * weight * wrong[:, None] * v
                done += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([w.ravel().tolist()], pa.list_(pa.float64())), pa.array([done], pa.int64())], names=["w", "rows"])

    # each range's size, so that the rate falls alike in all of them
    ranges = dealt.withColumn("_part", F.spark_partition_id())
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("many"))  # a row for each range
    sized = ranges.join(F.broadcast(sizes), "_part").sortWithinPartitions("_order", key).select("y", "weight", "v", "many")
    done = sized.mapInArrow(run, "w array<double>, rows long").collect()  # a head for each range
    held.destroy()
    total = sum(r["rows"] for r in done)
    return sum(np.array(r.w) * r["rows"] for r in done).reshape(weights.shape) / total if total else weights


def fit_sgd(df: DataFrame, vector: str, label: str, key: str, epochs: int = 5, rates: tuple[float, float] = (0.05, 0.005), parts: int | None = None, seed: int = 42) -> DataFrame:
    """label, id, weights of a head without intercept that starts at zero; classes are balanced. Rows without a vector or a label are left out.

    parts: ranges of an epoch, as many as shuffle partitions if not given.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    classes = {r[label]: (n, r.weight) for n, r in enumerate(class_weights(rows, label).orderBy(label).collect())}  # a row for each label
    kind = df.schema[label].dataType.simpleString()
    schema = f"label {kind}, id int, weights array<double>"
    if not classes:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(y, n, float(w)) for y, (n, w) in classes.items()], f"_label {kind}, y int, weight double")
    rows = rows.join(F.broadcast(table), F.col(label) == F.col("_label")).select(key, "y", "weight", F.transform(vector, lambda x: x.cast("double")).alias("v"))
    size = rows.agg(F.max(F.size("v")).alias("n")).first().n
    weights = np.zeros((len(classes), size))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for epoch in range(epochs):
        weights = epoch_of(rows, weights, epoch, epochs, rates, parts, key, seed)
    return spark.createDataFrame([(y, n, weights[n].tolist()) for y, (n, _) in classes.items()], schema)


def head_predictions(df: DataFrame, head: DataFrame, vector: str) -> DataFrame:
    """Adds predicted_label and confidence by a head (label, id, weights), a row for each label."""
    from corpusloom.functions import vectors

    held = head.orderBy("id").collect()  # a row for each label
    names = F.array(*[F.lit(r.label) for r in held])
    rows = df.withColumn("_scores", vectors.head_scores(vector, [r.weights for r in held]))
    return rows.withColumns({"predicted_label": F.get(names, vectors.argmax("_scores")), "confidence": F.array_max("_scores")}).drop("_scores")
