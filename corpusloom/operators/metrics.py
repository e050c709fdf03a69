"""Scores of classifiers from rows with a true and a predicted label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, *by: str, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    hit = F.coalesce(F.col(true) == F.col(pred), F.lit(False)).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, labels: list[str], true: str = "true_label", pred: str = "predicted_label", other: str = "other") -> DataFrame:
    """Rows by true label, a column for each predicted label and one for all others."""
    seen = F.when(F.col(pred).isin(labels), F.col(pred)).otherwise(F.lit(other))
    return df.withColumn("_pred", seen).groupBy(true).pivot("_pred", [*labels, other]).agg(F.count(F.lit(1))).na.fill(0)


def class_scores(df: DataFrame, labels: list[str], *by: str, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """For each listed label tp, fp, fn, precision, recall, f1 and support; absent labels have zeros.

    Each row counts for its true and for its predicted label, so one aggregation serves all labels.
    """
    hit = F.col(true) == F.col(pred)
    parts = F.array(F.struct(F.col(true).alias("label"), F.lit(True).alias("own")), F.struct(F.col(pred).alias("label"), F.lit(False).alias("own")))
    long = df.select(*by, hit.alias("_hit"), F.explode(parts).alias("_p")).select(*by, "_hit", "_p.label", "_p.own")
    counts = long.groupBy(*by, "label").agg(
        F.count_if(F.col("own") & F.col("_hit")).alias("tp"), F.count_if(~F.col("own") & ~F.coalesce("_hit", F.lit(False))).alias("fp"), F.count_if(F.col("own") & ~F.coalesce("_hit", F.lit(False))).alias("fn"), F.count_if("own").alias("support")
    )
    names = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    wanted = df.select(*by).distinct().crossJoin(F.broadcast(names)) if by else names  # a short list of labels
    rows = wanted.join(counts, [*by, "label"], "left").na.fill(0, ["tp", "fp", "fn", "support"])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.withColumns(
        {
            "precision": share(F.col("tp").cast("double"), F.col("tp") + F.col("fp")),
            "recall": share(F.col("tp").cast("double"), F.col("support")),
            "f1": share(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def macro_f1(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def micro_f1(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg((F.sum("tp") / (F.sum("tp") + 0.5 * (F.sum("fp") + F.sum("fn")))).alias("micro_f1"))


def f1_where_supported(scores: DataFrame) -> DataFrame:
    """f1 is null for labels without rows."""
    return scores.withColumn("f1", F.when(F.col("support") > 0, F.col("f1")))


def routed(ratio: Column, special: str, base: str, threshold: float = 0.5) -> dict[str, Column]:
    """Columns route and predicted_label: the specialist decides from the threshold on."""
    ours = ratio >= threshold
    return {"route": F.when(ours, "specialist").otherwise("base"), "predicted_label": F.when(ours, F.col(special)).otherwise(F.col(base))}


def router_coverage(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("route") == "specialist").cast("double")).alias("coverage"))


def agreement(a: DataFrame, b: DataFrame, key: str, new_labels: list[str]) -> DataFrame:
    """Two models on the same rows: agreement, changes, and changes to new labels."""
    both = a.select(key, F.col("predicted_label").alias("_a")).join(b.select(key, F.col("predicted_label").alias("_b")), key)
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("agreed"), F.count_if(~same).alias("changed"), F.count_if(~same & F.col("_b").isin(new_labels)).alias("to_new"), F.avg(same.cast("double")).alias("preserved")
    )


def fixed_broken(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """For each true label the rows that the second model mends and breaks."""
    both = a.select(key, "true_label", F.col("predicted_label").alias("_a")).join(b.select(key, F.col("predicted_label").alias("_b")), key)
    was, now = F.col("_a") == F.col("true_label"), F.col("_b") == F.col("true_label")
    return both.groupBy("true_label").agg(F.count_if(~was & now).alias("fixed"), F.count_if(was & ~now).alias("broken"), F.count(F.lit(1)).alias("rows"))


def mislabelled(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows whose prediction is not the class of their label (classes: label, class)."""
    return df.join(classes, df["true_label"] == classes["label"]).where(F.col("predicted_label") != F.col("class")).select(*[df[c] for c in df.columns], "class")


def leaderboard(scores: DataFrame) -> DataFrame:
    """The latest scores of each model, best first (model, version, macro_f1)."""
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("version")))
    return scores.withColumn("_rank", rank).where("_rank = 1").drop("_rank").orderBy(F.desc("macro_f1"), "model")


def score_table(scores: DataFrame, labels: list[str]) -> DataFrame:
    """f1 by dataset, a column for each label, rounded."""
    wide = scores.groupBy("dataset").pivot("label", labels).agg(F.first("f1"))
    return wide.select("dataset", *[F.round(F.col(f"`{x}`"), 4).alias(x) for x in labels])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """rows / (labels * rows of the label)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))  # one row
    return counts.join(F.broadcast(whole)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def fit_verdicts(train: Column, val: Column) -> Column:
    """fit_verdict of columns."""
    return F.when(train - val > 0.05, "overfit").when(F.greatest(train, val) < 0.70, "underfit").otherwise("good")


def fit_verdict(train: float, val: float) -> str:
    return "overfit" if train - val > 0.05 else "underfit" if max(train, val) < 0.70 else "good"


def disagreements(df: DataFrame, *models: str) -> DataFrame:
    """For each dataset and label, the rows on which the models' predictions differ."""
    differs = F.size(F.array_distinct(F.array(*models))) > 1
    return df.groupBy("dataset", "true_label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(differs).alias("differing"))
