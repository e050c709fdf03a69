"""The audit of a corpus in one pass over its texts, whatever the number of its steps.

Digests, flags and lengths of the texts are written once, as a narrow table. One pass over it counts by keys of few values (labels, sources, splits, subcorpora, lengths), the other by keys of many (groups, texts, ids) with as few
numbers as they need; both use grouping sets, so every row is read once for all sets. The many keys are then counted by what they came
to. What is left is a small table, from which all steps, counters and the report are made.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.filters import not_blank
from corpusloom.sources.scratch import written

SPLITS = ("train", "val", "test")
COLUMNS = ("id", "text", "label", "source", "subcorpus", "group_id", "is_core", "split")
FEW = {
    "total": [], "label": ["label"], "core": ["is_core", "label"], "source": ["source"], "source_label": ["source", "label"], "split": ["split"],
    "label_split": ["label", "split"], "subcorpus": ["subcorpus"], "chars": ["label", "chars"], "words": ["label", "words"],
}
MANY = {"group": ["group_id"], "text": ["digest"], "text_label": ["digest", "label"], "id": ["id"]}
#: A row with one row of each third of the others, for the examples of a label.
THIRDS = 3
#: Groups above this size are large; characters of an example.
LARGE, PREVIEW = 100, 120
#: Severity of each counter that is not zero (fixed values), and what it says.
ISSUES = {
    "leaking": ("CRITICAL", "groups in several splits"),
    "exact_duplicates": ("WARNING", "rows with the same text and label"),
    "contradictory": ("INFO", "texts under several labels"),
    "no_script": ("WARNING", "rows without the script"),
    "repeated_ids": ("WARNING", "repeated ids"),
    "short": ("INFO", "short texts"),
}


def by_sets(rows: DataFrame, sets: dict[str, list[str]], *measures: Column) -> DataFrame:
    """part (a set's name), all keys, measures: grouped by each set of keys."""
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    number = {name: sum(1 << (len(keys) - 1 - n) for n, k in enumerate(keys) if k not in s) for name, s in sets.items()}
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets.values()], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_set"), *measures)
    part = F.create_map(*[F.lit(x) for name, at in number.items() for x in (at, name)])[F.col("_set").cast("int")]
    return grouped.withColumn("part", part).drop("_set")


def summary(df: DataFrame, script: str, least: int = 10, most: int = 2000, splits: tuple[str, ...] = SPLITS, seed: int = 42) -> DataFrame:
    """The small table that everything else is made from. Columns of the common schema that df lacks count as null."""
    rows = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]).withColumn("is_core", F.col("is_core").cast("string"))
    facts = {
        "chars": F.coalesce(F.length("text"), F.lit(0)),
        "words": X.word_count("text"),
        "digest": F.md5("text"),
        "_script": F.coalesce(X.has_script("text", script), F.lit(False)),
        "_blank": ~not_blank(),
        "_key": X.seeded(seed, "id"),
        "text": F.left("text", F.lit(PREVIEW)),
    }
    # written, else each set of keys would work them out anew
    few = written(rows.withColumns(facts), "audit-facts")
    example = F.struct("_key", F.col("id").cast("string").alias("id"), "source", "text")
    third = F.conv(F.substring("_key", -2, 2), 16, 10).cast("int") % THIRDS
    of_rows = by_sets(
        few,
        FEW,
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("chars") < least).alias("short"),
        F.count_if(F.col("chars") > most).alias("long"),
        F.count_if(~F.col("_script")).alias("no_script"),
        F.count_if("_blank").alias("blank"),
        *[f(F.col(c)).cast("double").alias(f"{name}_{c}") for c in ("chars", "words") for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in COLUMNS],
        F.array_compact(F.array(*[F.min(F.when(third == k, example)) for k in range(THIRDS)])).alias("examples"),
    )
    of_rows = of_rows.withColumns({"size": F.coalesce("chars", "words").cast("long")}).drop("chars", "words")

    bit = F.lit(0)
    for k, s in enumerate(splits):
        bit = F.when(F.col("split") == s, 1 << k).otherwise(bit)
    many = few.select("id", "label", "group_id", "digest", F.when(F.col("split").isNotNull() & (bit == 0), 1 << len(splits)).otherwise(bit).alias("_bit"))
    # null groups and ids are no keys; null texts are equal to none
    keys = by_sets(many, MANY, F.count(F.lit(1)).alias("n"), F.bit_or("_bit").alias("bits"), F.min("label").alias("_least"), F.max("label").alias("_most"))
    keys = keys.where((F.col("part") != "group") | F.col("group_id").isNotNull()).where(~F.col("part").startswith("text") | F.col("digest").isNotNull())
    size = F.when(F.col("part") == "group", F.col("n"))
    pairs = [F.count_if((F.col("bits").bitwiseAND(1 << a) > 0) & (F.col("bits").bitwiseAND(1 << b) > 0)).alias(f"in_{splits[a]}_{splits[b]}") for a, b in combinations(range(len(splits)), 2)]
    of_keys = keys.groupBy("part", size.alias("size")).agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("copies"),
        F.count_if(F.bit_count("bits") > 1).alias("straddling"),
        F.count_if(F.col("_least") != F.col("_most")).alias("contradictory"),
        F.count_if(F.col("id").isNull()).alias("null_keys"),
        *pairs,
    )
    return written(of_rows.unionByName(of_keys, allowMissingColumns=True), "audit")


def part_sum(part: str, column: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("part") == part, F.col(column))), F.lit(0)).cast("long")


def counters(found: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """One row: what the summary counts."""
    count = lambda part, what: F.count_if((F.col("part") == part) & what).cast("long")
    ids = part_sum("id", "keys") - F.coalesce(F.sum(F.when(F.col("part") == "id", F.col("null_keys"))), F.lit(0)).cast("long")
    return found.agg(
        part_sum("total", "n").alias("rows"),
        count("label", F.col("label").isNotNull()).alias("labels"),
        count("source", F.col("source").isNotNull()).alias("sources"),
        part_sum("group", "keys").alias("groups"),
        F.coalesce(F.sum(F.when((F.col("part") == "core") & (F.col("is_core") == "true"), F.col("n"))), F.lit(0)).cast("long").alias("core_rows"),
        F.coalesce(F.sum(F.when((F.col("part") == "core") & (F.col("is_core") == "false"), F.col("n"))), F.lit(0)).cast("long").alias("mixed_rows"),
        *[part_sum("total", c).alias(c) for c in ("blank", "short", "long", "no_script")],
        (part_sum("total", "n") - ids).alias("repeated_ids"),
        part_sum("text_label", "copies").alias("exact_duplicates"),
        part_sum("text", "contradictory").alias("contradictory"),
        part_sum("group", "straddling").alias("leaking"),
        *[part_sum("group", f"in_{a}_{b}").alias(f"groups_in_{a}_{b}") for a, b in combinations(splits, 2)],
    )


def issues(found: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """The counters, and issues: the severities of those that are not zero."""
    said = F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{level}: "), F.col(c).cast("string"), F.lit(f" {what}"))) for c, (level, what) in ISSUES.items()])
    return counters(found, splits).withColumn("issues", F.array_compact(said))


def report(found: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """One row, report: the audit as JSON."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(c, F.struct(F.coalesce(F.when(F.col("part") == "core", F.col("label")).otherwise(F.col("source")), F.lit("null")).alias("key"), "n")))))
    core = (F.col("part") == "core") & (F.col("is_core") == "true")
    lists = found.agg(
        entries(core).alias("core_balance"), entries(F.col("part") == "source").alias("sources"), F.round(F.max(F.when(core, F.col("n"))) / F.min(F.when(core, F.col("n"))), 2).alias("imbalance_ratio")
    )
    one = issues(found, splits).drop("sources").crossJoin(lists)  # one row each
    fields = {
        "total_rows": "rows", "core_rows": "core_rows", "mixed_rows": "mixed_rows", "core_balance": "core_balance", "imbalance_ratio": "imbalance_ratio", "sources": "sources",
        "leakage_check": F.when(F.col("leaking") == 0, "PASS").otherwise("FAIL"), "exact_duplicates": "exact_duplicates", "contradictory_texts": "contradictory", "no_script_rows": "no_script",
        "duplicate_ids": "repeated_ids", "issues": "issues",
    }
    return one.select(F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields.items()])).alias("report"))


def medians(found: DataFrame, part: str, *by: str) -> DataFrame:
    """by, median of the sizes that a part counts (its keys' sizes for groups, else its rows')."""
    n = F.col("keys") if part == "group" else F.col("n")
    rows = found.where((F.col("part") == part) & F.col("size").isNotNull()).select(*by, "size", n.alias("n"))
    window = Window.partitionBy(*by)
    rows = rows.withColumns({"upto": F.sum("n").over(window.orderBy("size")), "all": F.sum("n").over(window)})
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("size")))
    return rows.groupBy(*by).agg(((at(F.floor((F.col("all") + 1) / 2)) + at(F.floor(F.col("all") / 2) + 1)) / 2.0).alias("median"))


def steps(found: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """step (1 to 17), name, key, value: every number of the audit. Shares are in per cent."""
    total = found.where("part = 'total'").select(F.col("n").alias("_all"))  # one row
    core = found.where("part = 'core' and is_core = 'true'").agg(F.sum("n").alias("_core"))  # one row
    rows = found.join(F.broadcast(total)).join(F.broadcast(core))
    key = lambda *c: F.concat_ws("|", *[F.coalesce(F.col(x), F.lit("null")) for x in c])

    def cells(part: str, step: int, k: Column, **values: Column) -> list[Column]:
        return [F.when(F.col("part") == part, F.struct(F.lit(step).alias("step"), F.lit(name).alias("name"), k.alias("key"), v.cast("double").alias("value"))) for name, v in values.items()]

    n, share = F.col("n"), F.col("n") * 100.0 / F.col("_all")
    none = F.lit("")
    of_core = F.col("is_core") == "true"
    parts = [
        *cells("total", 1, none, rows=n, columns=F.lit(len(COLUMNS))),
        *[c for x in COLUMNS for c in cells("total", 2, F.lit(x), nulls=F.col(f"null_{x}"))],
        *cells("total", 2, F.lit("text"), blanks=F.col("blank")),
        *cells("label", 3, key("label"), rows=n, share=share),
        *[F.when(of_core, c) for c in cells("core", 5, key("label"), rows=n, share=n * 100.0 / F.col("_core"))],
        *cells("source", 6, key("source"), rows=n, share=share),
        *cells("source_label", 7, key("source", "label"), rows=n),
        *cells("split", 8, key("split"), rows=n, share=share),
        *cells("label_split", 9, key("label", "split"), rows=n),
        *cells("label", 12, key("label"), **{f: F.col(f"{f}_chars") for f in ("min", "mean", "max", "std")}, short=F.col("short"), long=F.col("long")),
        *cells("label", 13, key("label"), **{f: F.col(f"{f}_words") for f in ("min", "mean", "max")}),
        *cells("subcorpus", 14, key("subcorpus"), rows=n, share=share),
        *cells("label", 16, key("label"), without_script=F.col("no_script"), script_share=100.0 - F.col("no_script") * 100.0 / n),
        *cells("source", 16, key("source"), source_without_script=F.col("no_script")),
    ]
    long = rows.select(F.explode(F.array_compact(F.array(*parts))).alias("c")).select("c.*")
    counted = counters(found, splits)
    place = {"core_rows": 4, "mixed_rows": 4, "groups": 10, "leaking": 10, **{f"groups_in_{a}_{b}": 10 for a, b in combinations(splits, 2)}, "exact_duplicates": 11, "contradictory": 11, "repeated_ids": 17}
    single = F.array(*[F.struct(F.lit(step).alias("step"), F.lit(name).alias("name"), F.lit("").alias("key"), F.col(name).cast("double").alias("value")) for name, step in place.items()])
    single = counted.select(F.explode(single).alias("c")).select("c.*")
    sizes = found.where("part = 'group'").agg(F.min("size").alias("min"), F.max("size").alias("max"), (F.sum("n") / F.sum("keys")).alias("mean"), F.coalesce(F.sum(F.when(F.col("size") > LARGE, F.col("keys"))), F.lit(0)).alias("large"))
    sizes = sizes.select(F.explode(F.array(*[F.struct(F.lit(15).alias("step"), F.lit(c).alias("name"), F.lit("").alias("key"), F.col(c).cast("double").alias("value")) for c in ("min", "max", "mean", "large")])).alias("c")).select("c.*")
    middle = [medians(found, p, "label").select(F.lit(s).alias("step"), F.lit("median").alias("name"), key("label").alias("key"), F.col("median").alias("value")) for p, s in (("chars", 12), ("words", 13))]
    middle.append(medians(found, "group").select(F.lit(15).alias("step"), F.lit("median").alias("name"), F.lit("").alias("key"), F.col("median").alias("value")))
    imbalance = found.where("part = 'core' and is_core = 'true'").agg((F.max("n") / F.min("n")).alias("value")).select(F.lit(5).alias("step"), F.lit("imbalance").alias("name"), F.lit("").alias("key"), "value")
    out = long
    for more in (single, sizes, *middle, imbalance):
        out = out.unionByName(more)
    return out


def examples(found: DataFrame) -> DataFrame:
    """label, id, source, text: step 18, up to three random rows of each core label, one of each third of its rows."""
    rows = found.where("part = 'core' and is_core = 'true'").select("label", F.explode("examples").alias("e"))
    return rows.select("label", "e.id", "e.source", "e.text")
