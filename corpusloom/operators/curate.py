"""From raw rows to a split corpus: common schema, dedup, contradictions, balance and leakage-free splits.

Every "first" names its order and every "random" its seed. Running counts over groups are taken within ranges of a
key first and then over the ranges, so no task sees all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.schema import CORPUS, Config

BUCKETS = 256


def finalise(df: DataFrame, config: Config) -> DataFrame:
    """Clean texts, without empty ones, in the common schema; short texts stay."""
    rows = df.withColumn("text", X.clean("text")).where(F.length("text") > 0)
    rows = rows.withColumn("is_core", F.col("label").isin(list(config.core))).withColumn("split", F.lit(None).cast("string"))
    return rows.select([F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CORPUS])


def finalise_counted(df: DataFrame, config: Config) -> tuple[DataFrame, Observation]:
    """finalise, and an observation that the job which reads the frame fills: rows, kept, null_text and blank_text (dropped), short (kept)."""
    seen = Observation("finalised")
    text = X.clean("text")
    blank = F.length(text) == 0
    rows = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~blank).alias("kept"),
        F.count_if(F.col("text").isNull()).alias("null_text"),
        F.count_if(F.col("text").isNotNull() & blank).alias("blank_text"),
        F.count_if(~blank & (F.length(text) < config.least_chars)).alias("short"),
    )
    return finalise(rows, config), seen


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; null keys are equal.

    Each task sends one candidate a key, so copies are dropped before the shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")) if rest else df.distinct()
    return found.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def contradictions(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Texts under several labels: text, labels (sorted), rows."""
    found = df.groupBy(F.md5(text).alias("_digest")).agg(F.any_value(text).alias(text), F.array_sort(F.collect_set(label)).alias("labels"), F.count(F.lit(1)).alias("rows"))
    return found.where(F.size("labels") > 1).drop("_digest")


def contradicted(df: DataFrame, core: list[str], mixed: str, text: str, label: str) -> DataFrame:
    """Adds _gone: a text under several labels goes, unless they are one core label and the mixed one (and perhaps more): then only
    its mixed rows go. Null labels are no labels, and null texts contradict nothing.

    128 bits of a text stand for it, and only texts under several labels are joined back.
    """
    rows = df.withColumn("_digest", F.md5(text))
    labels = rows.groupBy("_digest").agg(F.collect_set(label).alias("_labels"))
    several = labels.where((F.size("_labels") > 1) & F.col("_digest").isNotNull())
    one_core = F.size(F.filter("_labels", lambda x: x.isin(core))) == 1
    several = several.select("_digest", (one_core & F.array_contains("_labels", mixed)).alias("_only_mixed"))
    gone = F.col("_only_mixed").isNotNull() & (~F.col("_only_mixed") | F.coalesce(F.col(label) == mixed, F.lit(False)))
    return rows.join(several, "_digest", "left").withColumn("_gone", gone).drop("_digest", "_only_mixed")


def resolve_contradictions(df: DataFrame, core: list[str], mixed: str, text: str = "text", label: str = "label") -> DataFrame:
    """Rows whose text is under one label, and those that stay of texts under one core label and the mixed one."""
    return contradicted(df, core, mixed, text, label).where("not _gone").select(*df.columns)


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def running(groups: DataFrame, by: list[str], key: str, value: Column, digits: int = 3) -> DataFrame:
    """Adds before: the sum of value over earlier rows of by, in the order of a hexadecimal key.

    Sums of ranges of the key come first, so each task holds one range: 16 to the power of digits ranges, 4096 as it is,
    which are 2.5 million rows each of a label of 10 billion.
    """
    rows = groups.withColumn("_value", value).withColumn("_range", F.substring(key, 1, digits))
    sums = rows.groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    rows = rows.join(sums, [*by, "_range"])
    return rows.withColumn("before", F.col("_base") + F.col("_inside")).drop("_value", "_range", "_base", "_inside")


def downsample_groups(df: DataFrame, caps: dict[str, int], seed: int = 42, label: str = "label", group: str = "group_id") -> DataFrame:
    """Whole groups in random order until a label's cap is reached; the group that reaches it stays.

    Labels without a cap or below it stay whole.
    """
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]) if caps else F.expr("cast(map() as map<string, int>)")
    groups = group_sizes(df, label, group).withColumn("_key", X.seeded(seed, group))
    groups = running(groups, [label], "_key", F.col("n")).withColumn("_cap", F.try_element_at(cap, F.col(label)))
    kept = groups.where(F.col("_cap").isNull() | (F.col("before") < F.col("_cap"))).select(label, group)
    return df.join(kept, [label, group], "left_semi")


def dominant(df: DataFrame, group: str = "group_id", label: str = "label") -> DataFrame:
    """group, dominant label (ties: the lesser)."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("dominant"))


def grouped_split(df: DataFrame, seed: int = 42, ratios: tuple[float, float] = (0.8, 0.1), group: str = "group_id", label: str = "label") -> DataFrame:
    """group, dominant, split: groups of a dominant label in random order, cut by the ratios.

    With three groups or more, validation and test get at least one each, at the cost of train.
    """
    groups = dominant(df.where(F.col(group).isNotNull() & F.col(label).isNotNull()), group, label).withColumn("_key", X.seeded(seed, group))
    ranked = running(groups, ["dominant"], "_key", F.lit(1))
    totals = groups.groupBy("dominant").agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked.join(totals, "dominant")
    train, val = (F.bround(F.col("_n") * r, 0).cast("int") for r in ratios)
    val = F.when((F.col("_n") >= 3) & (val < 1), 1).otherwise(val)
    rows = rows.withColumn("_val", val).withColumn("_train", train)
    rows = rows.withColumn("_train", F.when(F.col("_n") >= 3, F.least("_train", F.col("_n") - F.col("_val") - 1)).otherwise(F.col("_train")))
    split = F.when(F.col("before") < F.col("_train"), "train").when(F.col("before") < F.col("_train") + F.col("_val"), "val").otherwise("test")
    return rows.select(group, "dominant", split.alias("split"))


def with_split(df: DataFrame, splits: DataFrame, group: str = "group_id") -> DataFrame:
    return df.drop("split").join(splits.select(group, "split"), group, "left")


def two_stage_split(df: DataFrame, by: list[str], seed: int = 42, group: str = "group_id", least: int = 3) -> DataFrame:
    """Adds split: groups of each class 80/10/10; classes with few groups are split by rows (key: id)."""
    groups = df.select(*by, group).distinct().withColumn("_key", X.seeded(seed, *by, group))
    totals = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("_groups"))
    ranked = running(groups, by, "_key", F.lit(1)).join(totals, by)
    of_group = ranked.select(*by, group, cut("before", "_groups").alias("_of_group"), "_groups")
    rows = df.join(of_group, [*by, group]).withColumn("_row_key", X.seeded(seed, "id"))
    few = rows.where(F.col("_groups") < least)
    sizes = few.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    few = running(few, by, "_row_key", F.lit(1)).join(sizes, by).withColumn("split", cut("before", "_n"))
    many = rows.where(F.col("_groups") >= least).withColumn("split", F.col("_of_group"))
    columns = [c for c in df.columns if c != "split"]
    return many.select(*columns, "split").unionByName(few.select(*columns, "split"))


def cut(at: str, n: str) -> Column:
    """80/10/10 by rank: train takes four fifths and validation half of the rest, both rounded down, so from 6 on none is empty."""
    train = F.floor(F.col(n) * 4 / 5)
    val = F.floor((F.col(n) - train) / 2)
    return F.when(F.col(at) < train, "train").when(F.col(at) < train + val, "val").otherwise("test")


def stratified_split(df: DataFrame, share: float, seed: int, label: str = "label", key: str = "id") -> DataFrame:
    """Adds split: of each label the first share of rows in random order trains, the rest tests."""
    rows = running(df.withColumn("_key", X.seeded(seed, key)), [label], "_key", F.lit(1))
    totals = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(totals, label).withColumn("split", F.when(F.col("before") < F.floor(F.col("_n") * share), "train").otherwise("test"))
    return rows.drop("_key", "before", "_n")


def quota(df: DataFrame, n: int, order: list[str], label: str = "label") -> DataFrame:
    """The first n rows of each label."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def balance(df: DataFrame, seed: int, cap: int | None = None, label: str = "label", key: str = "id") -> DataFrame:
    """As many random rows of each label as the smallest one has, at most cap."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.min("n"), F.lit(cap or 2**62)).alias("_least"))
    ranked = running(df.withColumn("_key", X.seeded(seed, key)), [label], "_key", F.lit(1))
    return ranked.join(F.broadcast(least)).where(F.col("before") < F.col("_least")).select(*df.columns)  # least is one row


def sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """Exactly n random rows."""
    return df.withColumn("_key", X.seeded(seed, key)).orderBy("_key").limit(n).drop("_key")


def replace_rows(df: DataFrame, gone: Column, new: DataFrame) -> DataFrame:
    """Without some rows, with others instead."""
    return df.where(~F.coalesce(gone, F.lit(False))).unionByName(new, allowMissingColumns=True)


def drop_mask(df: DataFrame, core: list[str], mixed: str, script: str, least: int, text: str = "text", label: str = "label") -> DataFrame:
    """Adds drop: contradictory (as resolve_contradictions), or without the script, or short, or null."""
    rows = contradicted(df, core, mixed, text, label)
    drop = F.col("_gone") | ~X.has_script(text, script) | (F.length(text) < least)
    return rows.withColumn("drop", F.coalesce(drop, F.lit(True))).select(*df.columns, "drop")


def run_ids(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds run (from 0) and whether a row begins or ends a run of equal values."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    first = F.row_number().over(w) == 1
    begins = first | ~before.eqNullSafe(F.col(value))
    rows = df.withColumns({"begins": begins, "ends": F.lead(F.lit(1)).over(w).isNull() | ~after.eqNullSafe(F.col(value))})
    return rows.withColumn("run", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def row_numbers(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """Numbers from 0 in the order of a column without equal values, by ranges: each task numbers its own range, which it finds by halving."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(x) for x in df.approxQuantile(order, [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    rows = df.withColumn("_span", range_of(F.col(order), bounds))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("_span").count().collect())  # a row for each range
    base, at = {}, 0
    for k, size in sizes:
        base[k] = at
        at += size
    rank = F.row_number().over(Window.partitionBy("_span").orderBy(order)) - 1
    start = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])[F.col("_span")] if base else F.lit(0)
    return rows.withColumn(name, (rank + start).cast("long")).drop("_span")


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the value."""
    if not bounds:
        return F.lit(0)
    held, steps = F.array(*[F.lit(x).cast("long") for x in bounds]), [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= value, at + s).otherwise(at))


def shuffled(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """All rows in a random order, which adds position (from 0)."""
    return running(df.withColumn("_key", X.seeded(seed, key)), [], "_key", F.lit(1)).withColumnRenamed("before", "position").drop("_key").orderBy("position")


def random_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """A random UUID for each row; write the result before it is used twice."""
    return df.withColumn(name, F.uuid() if hasattr(F, "uuid") else F.expr("uuid()"))


def zip_lines(a: DataFrame, b: DataFrame, number: str) -> DataFrame:
    """Rows with the same line number side by side; an error if one side has more lines."""
    counts = a.agg(F.count(F.lit(1)).alias("a")).crossJoin(b.agg(F.count(F.lit(1)).alias("b"))).first()  # one row each
    if counts.a != counts.b:
        raise ValueError(f"{counts.a} and {counts.b} lines")
    return a.join(b, number)


def union_existing(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; missing columns are null."""
    if not frames:
        raise ValueError("no input")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def label_ids(known: DataFrame, labels: DataFrame) -> DataFrame:
    """label, id: known ids stay, new labels (label, position) get the next ids in order. Both are label sets."""
    new = labels.join(known, "label", "left_anti").groupBy("label").agg(F.min("position").alias("position"))
    top = known.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    ranked = new.withColumn("rank", F.row_number().over(Window.orderBy("position")))
    return known.select("label", "id").unionByName(ranked.join(F.broadcast(top)).select("label", (F.col("top") + F.col("rank")).cast("int").alias("id")))


def partial_update(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that the update sets replace the old ones."""
    fresh = new.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return old.join(fresh, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])
