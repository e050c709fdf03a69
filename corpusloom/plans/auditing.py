"""Queries of auditing and profiling."""

from __future__ import annotations

from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.functions import text as X
from corpusloom.operators import audit, auditing, curate, metrics
from corpusloom.plans.base import CONFIG, LABELS, corpus, query, scratch, table
from corpusloom.plans.curation import CLEAN, split_sql, splits
from corpusloom.sources import matrices, readers, scans

SPLITS = ("train", "val", "test")
WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def split_corpus(spark, sf_dir):
    return curate.with_split(corpus(spark, sf_dir), splits(spark, sf_dir))


@query("SELECT label, count(*) AS n FROM c GROUP BY label")
def label_counts(spark, sf_dir):
    return audit.value_counts(corpus(spark, sf_dir), "label")


@query("SELECT source, label, count(*) AS n FROM c GROUP BY ALL")
def source_label_counts(spark, sf_dir):
    return audit.value_counts(corpus(spark, sf_dir), "source", "label")


@query("SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM c GROUP BY label")
def label_share(spark, sf_dir):
    return audit.shares(corpus(spark, sf_dir), "label").withColumn("share", F.col("share").cast("double"))


@query("SELECT source, count(*) FILTER (label = 'de') AS de, count(*) FILTER (label = 'en') AS en, count(*) FILTER (label = 'es') AS es, count(*) FILTER (label = 'fr') AS fr FROM c GROUP BY source")
def source_label_crosstab(spark, sf_dir):
    return audit.crosstab(corpus(spark, sf_dir), "source", "label", LABELS, total=False)


@query(
    f"""WITH {split_sql("c")}, w AS (SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM c JOIN gs USING (group_id) GROUP BY label)
SELECT * FROM w UNION ALL SELECT 'TOTAL', sum(train)::BIGINT, sum(val)::BIGINT, sum(test)::BIGINT FROM w"""
)
def label_split_crosstab(spark, sf_dir):
    return audit.crosstab(split_corpus(spark, sf_dir), "label", "split", list(SPLITS))


@query("SELECT quality::BIGINT AS quality, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM labels GROUP BY quality")
def quality_toxic_crosstab(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("long").alias("quality"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("kind"))
    return audit.crosstab(rows, "quality", "kind", ["clean", "toxic"], total=False)


@query(
    "SELECT 'text' AS \"column\", count(*) FILTER (text IS NULL) AS nulls, count(*) FILTER (trim(coalesce(text, '')) = '') AS blanks FROM c UNION ALL SELECT 'label', count(*) FILTER (label IS NULL), 0 FROM c UNION ALL SELECT 'source', count(*) FILTER (source IS NULL), 0 FROM c"
)
def null_profile(spark, sf_dir):
    return audit.null_profile(corpus(spark, sf_dir).select("text", "label", "source")).withColumn("blanks", F.col("blanks").cast("long"))


LENGTHS = ", ".join(
    f"{f}({x}){cast} AS {name}_{unit}"
    for unit, x in (("chars", "length(text)"), ("words", WORDS))
    for name, f, cast in (("min", "min", "::BIGINT"), ("median", "median", "::DOUBLE"), ("mean", "avg", ""), ("max", "max", "::BIGINT"), ("std", "stddev_samp", ""))
)


@query(f"SELECT label, n, min_chars, round(median_chars, 6) AS median_chars, round(mean_chars, 6) AS mean_chars, max_chars, round(std_chars, 6) AS std_chars, min_words, round(median_words, 6) AS median_words, round(mean_words, 6) AS mean_words, max_words, round(std_words, 6) AS std_words FROM (SELECT label, count(*) AS n, {LENGTHS} FROM c GROUP BY label)")
def length_stats(spark, sf_dir):
    return rounded(audit.length_stats(corpus(spark, sf_dir), "label"), *[f"{k}_{u}" for k in ("median", "mean", "std") for u in ("chars", "words")])


@query(f"SELECT source, sum({WORDS})::BIGINT AS words FROM c GROUP BY source")
def word_stats(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("source").agg(F.sum(X.word_count("text")).alias("words"))


@query("SELECT label, count(*) AS groups, min(n) AS least, median(n)::DOUBLE AS median, round(avg(n), 6) AS mean, max(n) AS most, count(*) FILTER (n > 100) AS large FROM (SELECT label, group_id, count(*) AS n FROM c GROUP BY ALL) GROUP BY label")
def group_size_stats(spark, sf_dir):
    return rounded(audit.group_stats(corpus(spark, sf_dir), "label", "group_id"), "mean")


@query("SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) - count(DISTINCT id) AS repeated FROM c")
def id_uniqueness(spark, sf_dir):
    return audit.id_uniqueness(corpus(spark, sf_dir))


@query("SELECT id, copies FROM (SELECT id, count(*) OVER (PARTITION BY text, label) AS copies FROM c) WHERE copies > 1")
def duplicate_rows(spark, sf_dir):
    return audit.duplicates(corpus(spark, sf_dir), "text", "label").select("id", "copies")


COUNTS = "k AS (SELECT label, count(*) AS n FROM c GROUP BY label)"


@query(f"WITH {COUNTS} SELECT round(max(n) / min(n), 6) AS ratio, (SELECT label FROM k ORDER BY n, label LIMIT 1) AS smallest, min(n) AS least FROM k")
def imbalance(spark, sf_dir):
    return rounded(audit.imbalance(corpus(spark, sf_dir)), "ratio").drop("smallest_share")


@query(f"WITH {COUNTS} SELECT label, n, round(n * 100.0 / (SELECT sum(n) FROM k), 6)::DOUBLE AS share FROM k ORDER BY n, label LIMIT 1")
def smallest_class(spark, sf_dir):
    found = audit.imbalance(corpus(spark, sf_dir))
    return found.select(F.col("smallest").alias("label"), F.col("least").alias("n"), F.round(F.col("smallest_share").cast("double"), 6).alias("share"))


@query("SELECT label, count(*) AS rows, round(avg(regexp_matches(text, '[À-ſ]')::INT), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id)) AS r FROM c) WHERE r <= 500 GROUP BY label")
def script_share_sample(spark, sf_dir):
    return rounded(audit.script_share(corpus(spark, sf_dir), CONFIG.script, 500, 42), "share")


@query("SELECT label, source, count(*) AS n FROM c WHERE NOT regexp_matches(text, '[À-ſ]') GROUP BY ALL")
def no_script_breakdown(spark, sf_dir):
    return audit.value_counts(corpus(spark, sf_dir).where(~X.has_script("text", CONFIG.script)), "label", "source")


SUITE = {
    "rows": "SELECT count(*) FROM c",
    "core_rows": "SELECT count(*) FROM c WHERE is_core",
    "mixed_rows": "SELECT count(*) FROM c WHERE NOT is_core",
    "long": "SELECT count(*) FROM c WHERE length(text) > 2000",
    "exact_duplicates": "SELECT sum(n) FROM (SELECT count(*) AS n FROM c GROUP BY text, label HAVING count(*) > 1)",
    "labels": "SELECT count(DISTINCT label) FROM c",
    "sources": "SELECT count(DISTINCT source) FROM c",
    "groups": "SELECT count(DISTINCT group_id) FROM c",
    "blank": "SELECT count(*) FROM c WHERE trim(text) = ''",
    "short": "SELECT count(*) FROM c WHERE length(text) < 10",
    "no_script": "SELECT count(*) FROM c WHERE NOT regexp_matches(text, '[À-ſ]')",
    "repeated_ids": "SELECT count(*) - count(DISTINCT id) FROM c",
    "contradictory": "SELECT count(*) FROM (SELECT text FROM c GROUP BY text HAVING count(DISTINCT label) > 1)",
    "leaking": "SELECT count(*) FROM (SELECT group_id FROM sx GROUP BY group_id HAVING count(DISTINCT split) > 1)",
    **{f"groups_in_{a}_{b}": f"SELECT count(*) FROM sx AS l JOIN sx AS r USING (group_id) WHERE l.split = '{a}' AND r.split = '{b}'" for a, b in (("train", "val"), ("train", "test"), ("val", "test"))},
}
SUITE_SQL = " UNION ALL ".join(f"SELECT '{k}' AS \"check\", ({v})::BIGINT AS value" for k, v in SUITE.items())
#: Rows split one by one: groups leak, so that every counter has something to find.
LEAKY_SQL = "sx AS (SELECT DISTINCT group_id, CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM c)"


def leaky_corpus(spark, sf_dir):
    split = F.element_at(F.array(*map(F.lit, SPLITS)), (F.col("id") % 3).cast("int") + 1)
    return corpus(spark, sf_dir).withColumn("split", split)


def suite(rows):
    """check, value: the counters of a corpus."""
    found = auditing.counters(auditing.summary(rows, CONFIG.script))
    return found.unpivot([], found.columns, "check", "value")


@query(f"WITH {split_sql('c')}, sx AS (SELECT DISTINCT group_id, split FROM c JOIN gs USING (group_id)) {SUITE_SQL}")
def audit_suite(spark, sf_dir):
    return suite(split_corpus(spark, sf_dir))


@query(f"WITH {LEAKY_SQL} {SUITE_SQL}")
def audit_suite_of_leaks(spark, sf_dir):
    return suite(leaky_corpus(spark, sf_dir))


def lacking(rows):
    """A corpus in which much is wrong: subcorpora, null labels and groups, repeated ids and rows, a split of its own."""
    wrong = {
        "subcorpus": F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))),
        "label": F.when(F.col("id") % 13 > 0, F.col("label")),
        "group_id": F.when(F.col("id") % 17 > 0, F.col("group_id")),
        "split": F.when(F.col("id") % 19 > 0, F.col("split")),
        "id": F.col("id") - F.col("id") % 23,
    }
    return rows.withColumns({c: wrong[c] for c in ("subcorpus", "label", "group_id", "split")}).withColumn("id", wrong["id"])


LACKING_SQL = """lk AS (SELECT id - id % 23 AS id, text, CASE WHEN id % 13 > 0 THEN label END AS label, source, CASE WHEN id % 17 > 0 THEN group_id END AS group_id, is_core,
  CASE WHEN id % 5 > 0 THEN 's' || (id % 5) END AS subcorpus, CASE WHEN id % 19 > 0 THEN CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END END AS split FROM c),
m AS (SELECT *, length(text) AS chars, """ + WORDS + """ AS words, regexp_matches(text, '[À-ſ]') AS script FROM lk),
sp AS (SELECT DISTINCT group_id, split FROM lk WHERE group_id IS NOT NULL AND split IS NOT NULL),
gz AS (SELECT group_id, count(*) AS n FROM lk WHERE group_id IS NOT NULL GROUP BY group_id)"""


def step_sql(step: int, name: str, value: str, key: str = "''", rows: str = "m", by: str = "") -> str:
    return f"SELECT {step} AS step, '{name}' AS name, {key} AS key, ({value})::DOUBLE AS value FROM {rows}" + (f" GROUP BY {by}" if by else "")


def keyed(*columns: str) -> dict[str, str]:
    return {"key": " || '|' || ".join(f"coalesce({c}, 'null')" for c in columns), "by": ", ".join(columns)}


NAMES = ("id", "text", "label", "source", "subcorpus", "group_id", "is_core", "split")
SHARE = "count(*) * 100.0 / (SELECT count(*) FROM m)"
STEPS_SQL = [
    step_sql(1, "rows", "count(*)"), step_sql(1, "columns", "max(8)"), *[step_sql(2, "nulls", f"count(*) FILTER ({c} IS NULL)", f"'{c}'") for c in NAMES], step_sql(2, "blanks", "count(*) FILTER (words = 0)", "'text'"),
    *[step_sql(k, "rows", "count(*)", **keyed(*c)) for k, c in ((3, ["label"]), (6, ["source"]), (7, ["source", "label"]), (8, ["split"]), (9, ["label", "split"]), (14, ["subcorpus"]))],
    *[step_sql(k, "share", SHARE, **keyed(c)) for k, c in ((3, "label"), (6, "source"), (8, "split"), (14, "subcorpus"))],
    step_sql(4, "core_rows", "count(*) FILTER (is_core)"), step_sql(4, "mixed_rows", "count(*) FILTER (NOT is_core)"),
    step_sql(5, "rows", "count(*)", rows="m WHERE is_core", **keyed("label")), step_sql(5, "share", "count(*) * 100.0 / (SELECT count(*) FROM m WHERE is_core)", rows="m WHERE is_core", **keyed("label")),
    step_sql(5, "imbalance", "max(n) / min(n)", rows="(SELECT count(*) AS n FROM m WHERE is_core GROUP BY label)"),
    step_sql(10, "groups", "count(*)", rows="gz"), step_sql(10, "leaking", "count(*)", rows="(SELECT group_id FROM sp GROUP BY group_id HAVING count(*) > 1)"),
    *[step_sql(10, f"groups_in_{a}_{b}", "count(*)", rows=f"sp AS l JOIN sp AS r USING (group_id) WHERE l.split = '{a}' AND r.split = '{b}'") for a, b in (("train", "val"), ("train", "test"), ("val", "test"))],
    step_sql(11, "exact_duplicates", "coalesce(sum(n), 0)", rows="(SELECT count(*) AS n FROM m GROUP BY text, label HAVING count(*) > 1)"),
    step_sql(11, "contradictory", "count(*)", rows="(SELECT text FROM m GROUP BY text HAVING count(DISTINCT label) > 1)"),
    *[step_sql(12, n, f, **keyed("label")) for n, f in (("min", "min(chars)"), ("median", "median(chars)"), ("mean", "avg(chars)"), ("max", "max(chars)"), ("std", "stddev_samp(chars)"), ("short", "count(*) FILTER (chars < 10)"), ("long", "count(*) FILTER (chars > 2000)"))],
    *[step_sql(13, n, f"{f}(words)", **keyed("label")) for n, f in (("min", "min"), ("median", "median"), ("mean", "avg"), ("max", "max"))],
    *[step_sql(15, n, f, rows="gz") for n, f in (("min", "min(n)"), ("median", "median(n)"), ("mean", "avg(n)"), ("max", "max(n)"), ("large", "count(*) FILTER (n > 100)"))],
    step_sql(16, "without_script", "count(*) FILTER (NOT script)", **keyed("label")), step_sql(16, "script_share", "100.0 - count(*) FILTER (NOT script) * 100.0 / count(*)", **keyed("label")),
    step_sql(16, "source_without_script", "count(*) FILTER (NOT script)", **keyed("source")), step_sql(17, "repeated_ids", "count(*) - count(DISTINCT id)"),
]


@query(f"WITH {LACKING_SQL} SELECT step, name, key, round(value, 6) AS value FROM ({' UNION ALL '.join(STEPS_SQL)})")
def audit_steps(spark, sf_dir):
    """All numbers of the audit of a corpus in which much is wrong."""
    return rounded(auditing.steps(auditing.summary(lacking(leaky_corpus(spark, sf_dir)), CONFIG.script)), "value")


REPORT_COUNTS = {"exact_duplicates": 11, "contradictory": 11, "repeated_ids": 17, "leaking": 10}
REPORT_SQL = ", ".join(f"(SELECT value::BIGINT FROM st WHERE name = '{n}') AS {n}" for n in REPORT_COUNTS)
SAID_SQL = " || ".join(f"CASE WHEN {c} > 0 THEN '{level}: ' || {c} || ' {what};' ELSE '' END" for c, (level, what) in auditing.ISSUES.items())
ENTRIES_SQL = "(SELECT '{{' || string_agg('\"' || coalesce({0}, 'null') || '\":' || n, ',' ORDER BY coalesce({0}, 'null')) || '}}' FROM (SELECT {0}, count(*) AS n FROM m {1} GROUP BY {0}))"


@query(f"""WITH {LACKING_SQL}, st AS ({' UNION ALL '.join(STEPS_SQL)}), r AS (SELECT {REPORT_SQL}, (SELECT count(*) FROM m) AS total_rows, (SELECT count(*) FROM m WHERE is_core) AS core_rows, (SELECT count(*) FROM m WHERE NOT is_core) AS mixed_rows,
  (SELECT count(*) FROM m WHERE NOT script) AS no_script, (SELECT count(*) FROM m WHERE chars < 10) AS short, (SELECT round(value, 2) FROM st WHERE name = 'imbalance') AS imbalance_ratio)
SELECT total_rows, core_rows, mixed_rows, {ENTRIES_SQL.format('label', 'WHERE is_core')} AS core_balance, imbalance_ratio, {ENTRIES_SQL.format('source', '')} AS sources, CASE WHEN leaking = 0 THEN 'PASS' ELSE 'FAIL' END AS leakage_check,
  exact_duplicates, contradictory AS contradictory_texts, no_script AS no_script_rows, repeated_ids AS duplicate_ids, {SAID_SQL} AS issues FROM r""")
def audit_json(spark, sf_dir):
    """The fields of the audit's JSON report."""
    found = auditing.report(auditing.summary(lacking(leaky_corpus(spark, sf_dir)), CONFIG.script))
    field = lambda c: F.get_json_object("report", f"$.{c}")
    counts = [field(c).cast("long").alias(c) for c in ("total_rows", "core_rows", "mixed_rows", "exact_duplicates", "contradictory_texts", "no_script_rows", "duplicate_ids")]
    issues = F.concat(F.array_join(F.from_json(field("issues"), F.lit("array<string>")), ";"), F.lit(";"))
    return found.select(*counts, field("core_balance").alias("core_balance"), field("imbalance_ratio").cast("double").alias("imbalance_ratio"), field("sources").alias("sources"), field("leakage_check").alias("leakage_check"), issues.alias("issues"))


@query(
    "SELECT source, count(*) FILTER (label = 'es') AS original, count(*) FILTER (label IN ('de', 'fr', 'en')) AS replaced, count(*) FILTER (regexp_matches(text, 'ß')) AS other_script FROM c GROUP BY source"
)
def benchmark_integrity(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return rows.groupBy("source").agg(
        F.count_if(F.col("label") == "es").alias("original"), F.count_if(F.col("label").isin("de", "fr", "en")).alias("replaced"), F.count_if(X.has_script("text", CONFIG.other_script)).alias("other_script")
    )


@query("SELECT label, count(*) AS n FROM c WHERE label NOT IN ('en', 'fr') GROUP BY label")
def all_labels_mapped(spark, sf_dir):
    from corpusloom.operators.labels import unmapped

    return unmapped(corpus(spark, sf_dir), "label", {"en": "eng", "fr": "fra"})


@query("SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM labels) AS b, (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS equal")
def line_count_equal(spark, sf_dir):
    a, b = (table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(n)) for t, n in (("documents", "a"), ("labels", "b")))
    return a.crossJoin(b).withColumn("equal", F.col("a") == F.col("b"))  # one row each


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS word FROM c) GROUP BY word HAVING count(*) >= 2")
def vocab_min_count(spark, sf_dir):
    return audit.vocabulary(corpus(spark, sf_dir), 2)


@query("SELECT char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM c) WHERE char <> '' GROUP BY char")
def distinct_chars(spark, sf_dir):
    return audit.characters(corpus(spark, sf_dir))


@query("SELECT label, count(DISTINCT source) AS sources, count(DISTINCT group_id) AS groups FROM c GROUP BY label")
def distinct_per_group(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("label").agg(F.count_distinct("source").alias("sources"), F.count_distinct("group_id").alias("groups"))


@query("SELECT group_id, label AS dominant FROM (SELECT group_id, label, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, label) AS r FROM c GROUP BY group_id, label) WHERE r = 1")
def dominant_label(spark, sf_dir):
    return curate.dominant(corpus(spark, sf_dir))


@query(f"SELECT conv_id, sum({WORDS})::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def token_totals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(X.word_count("text")).alias("tokens"))


@query("SELECT source, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes FROM c GROUP BY source")
def text_totals(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT label, count(*) AS n, round((SELECT count(*) FROM c) / ((SELECT count(DISTINCT label) FROM c) * count(*)), 6) AS weight FROM c GROUP BY label")
def class_weights(spark, sf_dir):
    return rounded(metrics.class_weights(corpus(spark, sf_dir)), "weight")


@query("SELECT id, CASE WHEN regexp_matches(text, '[À-ſ]') AND regexp_matches(text, '[ß]') THEN 'Mixed' WHEN regexp_matches(text, '[À-ſ]') THEN 'Sinh' WHEN regexp_matches(text, '[ß]') THEN 'Deva' ELSE 'Unknown' END AS script FROM c")
def detect_script(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", X.detect_script("text", CONFIG.script, CONFIG.other_script).alias("script"))


LETTERS = r"length(regexp_replace(text, '\P{L}', '', 'g'))"
BEYOND = r"length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))"
SCRIPT = "length(regexp_replace(text, '[^À-ſ]', '', 'g'))"


@query(rf"SELECT id, round(CASE WHEN {LETTERS} > 0 THEN length(regexp_replace(regexp_replace(text, '\P{{L}}', '', 'g'), '[^À-ſ]', '', 'g')) / {LETTERS} ELSE 0 END, 6) AS ratio FROM c")
def script_ratio_alpha(spark, sf_dir):
    return rounded(corpus(spark, sf_dir).select("id", X.script_ratio_letters("text", CONFIG.script).alias("ratio")), "ratio")


@query(f"SELECT id, round(CASE WHEN {BEYOND} > 0 THEN {SCRIPT} / {BEYOND} ELSE 0 END, 6) AS ratio FROM c")
def script_ratio_nonascii(spark, sf_dir):
    return rounded(corpus(spark, sf_dir).select("id", X.script_ratio_beyond_ascii("text", CONFIG.script).alias("ratio")), "ratio")


@query("SELECT id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(lower(text), '[^a-z]', '', 'g')) / length(text) ELSE 0 END, 6) AS ratio FROM c")
def latin_ratio(spark, sf_dir):
    return rounded(corpus(spark, sf_dir).select("id", X.latin_ratio("text").alias("ratio")), "ratio")


#: The patterns of text.SEGMENTS for the SQL (fixed values).
SEGMENT_SQL = {"sentence": r"[^.!?।\n]+(?:[.!?।\n]+|$)", "paragraph": r"(?:[^\n][\n]?)+", "auto": r"[^.!?।\n,;:()\[\]]+(?:[.!?।\n,;:()\[\]]+|$)"}


def segment_query(strategy: str, rows: str, key: str):
    sql = rf"SELECT {key}, n - 1 AS segment_index, x AS text FROM (SELECT {key}, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS n FROM (SELECT {key}, list_filter(regexp_extract_all(text, '{SEGMENT_SQL[strategy]}'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') AS s FROM {rows}))"

    @query(sql, f"segment_{strategy}")
    def segment(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.segments("text", strategy)).alias("p", "text")).select("doc_id", F.col("p").cast("long").alias("segment_index"), "text")

    return segment


segment_sentence = segment_query("sentence", "documents", "doc_id")
segment_paragraph = segment_query("paragraph", "documents", "doc_id")
segment_auto = segment_query("auto", "documents", "doc_id")


#: Matches of the pattern follow one another without a gap, after what the text begins with.
OFFSETS_SQL = rf"""SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS segment_index, x AS text, first + before AS start, first + before + length(x) AS "end" FROM (
  SELECT id, x, k, length(text) - total AS first, sum(length(x)) OVER (PARTITION BY id ORDER BY k) - length(x) AS before FROM (
    SELECT id, text, list_sum(list_transform(s, lambda y: length(y))) AS total, unnest(s) AS x, unnest(range(len(s))) AS k FROM (SELECT id, text, regexp_extract_all(text, '{SEGMENT_SQL["auto"]}') AS s FROM c)))
  WHERE trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''"""


@query(OFFSETS_SQL)
def segment_offsets(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("id", F.posexplode(X.segment_offsets("text", "auto")).alias("segment_index", "s"))
    return rows.select("id", F.col("segment_index").cast("long").alias("segment_index"), "s.text", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query(OFFSETS_SQL)
def segments_by_table_function(spark, sf_dir):
    """The same by SQL with a table function."""
    tables.register(spark)
    corpus(spark, sf_dir).createOrReplaceTempView("corpusloom_texts")
    return spark.sql("SELECT d.id, CAST(s.segment_index AS BIGINT) AS segment_index, s.text, CAST(s.start AS BIGINT) AS start, CAST(s.end AS BIGINT) AS end FROM corpusloom_texts AS d, LATERAL segments(d.text, 'auto') AS s")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS purchase FROM events")
def fill_by_table_function(spark, sf_dir):
    """Each event's last purchase by its user, by a table function over partitions in order."""
    tables.register(spark)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("purchase"))
    rows.createOrReplaceTempView("corpusloom_events")
    return spark.sql("SELECT * FROM filled(TABLE(corpusloom_events) PARTITION BY user_id ORDER BY event_id)")


@query("WITH d AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, embedding FROM embeddings) SELECT n AS number, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, len(embedding) AS size FROM d WHERE n >= 100")
def matrix_scan(spark, sf_dir):
    """Vectors written as matrix files and read back in ranges of rows."""
    path = scratch(spark, "matrix")
    matrices.register(spark)
    rows = curate.row_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "number")
    # the number goes along in the first place, which a float holds exactly up to 2**24
    weights = F.concat(F.array(F.col("number").cast("float")), F.transform("embedding", lambda x: x.cast("float")))
    rows.repartition(3).select(weights.alias("weights")).write.format("dense_matrix").option("rowsPerTask", 300).mode("append").save(path)
    found = matrices.dense_matrix(spark, path, rows_per_task=100).where("row >= 0")
    own = F.slice("weights", 2, F.size("weights") - 1)
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select(F.get("weights", F.lit(0)).cast("long").alias("number"), F.round(total, 5).alias("total"), F.size(own).cast("long").alias("size")).where("number >= 100")


@query("SELECT conv_id, turn, role, coalesce(lag(role) OVER w <> role, true) AS begins, coalesce(lead(role) OVER w <> role, true) AS ends FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def run_boundaries(spark, sf_dir):
    return curate.run_ids(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "role", "begins", "ends")


@query(
    "SELECT user_id, run, event_type, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type, true)::INT AS b FROM events)) GROUP BY user_id, run, event_type"
)
def run_lengths(spark, sf_dir):
    runs = curate.run_ids(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")
    return runs.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"SELECT id, array_to_string(list_slice(w, s, s + 4), ' ') AS words FROM (SELECT id, w, CASE WHEN len(w) >= 5 THEN 1 + ('0x' || substr(md5('42|' || id), 1, 8))::BIGINT % (len(w) - 4) ELSE 1 END AS s FROM (SELECT id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM c))"
)
def random_k_words(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", X.random_words("text", 5, 42, "id").alias("words"))


@query(r"SELECT id, array_to_string(list_slice(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), 1, 4), ' ') AS words FROM c")
def first_k_words(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", X.first_words("text", 4).alias("words"))


@query("SELECT id, n, part FROM (SELECT id, unnest(l) AS part, unnest(range(len(l))) AS n FROM (SELECT id, list_filter(list_transform(string_split_regex(text, '[.,]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM c))")
def split_terminators(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", F.posexplode(X.parts("text", "[.,]")).alias("n", "part")).withColumn("n", F.col("n").cast("long"))


WIKI_STEPS = [(r"(?s)<!--.*?-->", ""), (r"(?s)<ref\b[^>]*?(?:/>|>.*?</ref\s*>)", " "), (r"\{\{[^{}]*\}\}", " "), (r"\{\{[^{}]*\}\}", " ")]
WIKI_STEPS += [(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", r"\1"), (r"\[\[([^\[\]|]*)\]\]", r"\1"), (r"\[(?:https?:)?//[^\s\]]+[ \t]*([^\]]*)\]", "KEPT")]
WIKI_STEPS += [(r"(?m)^={1,6}[ \t]*(.*?)[ \t]*={1,6}[ \t]*$", "KEPT"), (r"[\x27]{2,5}", ""), (r"<[^>]+>", " "), (r"\s+", " ")]
#: Each document as a page of markup: literals and columns in turn.
WIKI_PARTS = ["{{box|", "source", "{{in|x}}}}\n== ", "label", " ==\n<!-- no -->[[Page|", "text", "]] '''b''' [[Page]] [https://e.org/1 ", "source", "]<ref name=a>r</ref><ref b/>\n=== End ===\n", "text"]


def wiki_sql(kept: str) -> str:
    sql = " || ".join(p if k % 2 else "'" + p.replace("'", "''") + "'" for k, p in enumerate(WIKI_PARTS))
    for pattern, new in WIKI_STEPS:
        sql = f"regexp_replace({sql}, '{pattern}', '{kept if new == 'KEPT' else new}', 'g')"
    return sql


@query(f"SELECT id, trim({wiki_sql(' ')}) AS text, trim({wiki_sql(chr(92) + '1')}) AS all_text FROM c")
def strip_wiki(spark, sf_dir):
    page = F.concat(*[F.col(p) if k % 2 else F.lit(p) for k, p in enumerate(WIKI_PARTS)])
    rows = corpus(spark, sf_dir).withColumn("page", page)
    return rows.select("id", X.strip_wiki("page").alias("text"), X.strip_wiki("page", keep=True).alias("all_text"))


@query(r"SELECT p_partkey, regexp_replace(trim(p_name), '\s+', '_', 'g') AS stub, lower(trim(p_name)) AS label, regexp_replace('__label__' || p_name, '^__label__', '') AS bare, left(p_name, 8) AS preview FROM part")
def names(spark, sf_dir):
    bare = F.regexp_replace(F.concat(F.lit("__label__"), "p_name"), "^__label__", "")
    return table(spark, sf_dir, "part").select("p_partkey", X.stub("p_name").alias("stub"), F.lower(F.trim("p_name")).alias("label"), bare.alias("bare"), F.left("p_name", F.lit(8)).alias("preview"))


@query("SELECT page_id, split_part(url, '://', 1) AS scheme, split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_replace(url, '[?#].*$', '') AS path FROM pages")
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"),
        F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"),
        F.regexp_replace("url", "[?#].*$", "").alias("path"),
    )


@query("SELECT id, name, value FROM (SELECT id, 'chars' AS name, length(text)::BIGINT AS value FROM c UNION ALL SELECT id, 'bytes', strlen(text)::BIGINT FROM c)")
def melt_features(spark, sf_dir):
    wide = corpus(spark, sf_dir).select("id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))
    return wide.unpivot("id", ["chars", "bytes"], "name", "value")


ISSUES_SQL = " UNION ALL ".join(f"SELECT '{level}: ' || n || ' {what}' AS issue FROM (SELECT ({SUITE[k]}) AS n) WHERE n > 0" for k, (level, what) in auditing.ISSUES.items())


@query(f"WITH {LEAKY_SQL} {ISSUES_SQL}")
def issue_list(spark, sf_dir):
    return auditing.issues(auditing.summary(leaky_corpus(spark, sf_dir), CONFIG.script)).select(F.explode("issues").alias("issue"))


BAD_LINES_SQL = """x AS (SELECT id AS number, CASE id % 5 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'missing keys' WHEN 2 THEN 'empty label' WHEN 3 THEN 'empty text' END AS error FROM c)"""


@query(f"WITH {BAD_LINES_SQL} SELECT number, error FROM x WHERE error IS NOT NULL")
def jsonl_validate(spark, sf_dir):
    """Lines of JSON made from the documents, four of five with an error each."""
    rows = corpus(spark, sf_dir).withColumn("k", F.col("id") % 5)
    label, text = F.when(F.col("k") == 2, " ").otherwise(F.col("label")), F.when(F.col("k") == 3, "").otherwise(F.col("text"))
    whole = F.to_json(F.struct(text.alias("text"), label.alias("label")))
    line = F.when(F.col("k") == 0, F.concat(F.lit("{"), F.left("label", F.lit(1)))).when(F.col("k") == 1, F.to_json(F.struct("text"))).otherwise(whole)
    return audit.jsonl_errors(rows.select(F.col("id").alias("number"), line.alias("value"))).select("number", "error")


def in_order(spark, sf_dir):
    """id, source, text, in files by source and id."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = corpus(spark, sf_dir).select("id", "source", "text")
    return rows.repartitionByRange(n, "source", "id").sortWithinPartitions("source", "id")


def with_marks(rows):
    """value: milestone XML, with marks of books and chapters only where they change and at a file's beginning; odd verses name them."""

    def run(batches):
        book = chapter = None
        for batch in batches:
            out = []
            for i, source, text in zip(*[batch.column(c).to_pylist() for c in ("id", "source", "text")], strict=True):
                head = ""
                if source != book:
                    book, chapter, head = source, None, f'<book id="{source}"><id>skip <h>this</h></id>'
                if i // 100 != chapter:
                    chapter = i // 100
                    head += f'<c id="{chapter}"/>'
                own = f' bcv="{source}.{chapter}.{i}"' if i % 2 else ""
                out.append(f'{head}<p>before <v id="{i}"{own}/>{escape(text)}<toc>no</toc></p><ve/>after')
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


@query(f"SELECT source AS book, (id // 100)::VARCHAR AS chapter, id::VARCHAR AS verse, {CLEAN} AS text FROM c WHERE {CLEAN} <> ''")
def usfx_scan(spark, sf_dir):
    """All documents as verses of milestone XML, written and read back."""
    path = scratch(spark, "usfx")
    with_marks(in_order(spark, sf_dir)).write.option("lineSep", "\n").text(path)
    return readers.usfx(spark, path)


@query(f"""WITH b AS (SELECT id, source || '-' || (id // 1000) AS book, {CLEAN} AS text FROM c WHERE {CLEAN} <> '')
SELECT book || '_' || lpad((row_number() OVER (PARTITION BY book ORDER BY id) - 1)::VARCHAR, 5, '0') AS id, text FROM b""")
def book_dir_scan(spark, sf_dir):
    """Directories with a book of at most a thousand documents, written and read back."""
    path = scratch(spark, "books")
    books = corpus(spark, sf_dir).select("id", F.concat_ws("-", "source", F.floor(F.col("id") / 1000)).alias("book"), F.concat("text", F.lit("<eos>")).alias("value"))
    books.repartition("book").sortWithinPartitions("book", "id").select("book", "value").write.partitionBy("book").text(path)
    return scans.book_sentences(spark, path).withColumn("id", F.regexp_replace("id", "^book=", ""))


@query(f"SELECT source || '.' || id AS id, {CLEAN} AS text FROM c WHERE {CLEAN} <> ''")
def block_scan(spark, sf_dir):
    """All documents as annotated blocks, a word a line, written and read back."""
    path = scratch(spark, "blocks")
    tokens = F.array_join(F.transform(X.words("text"), lambda w: F.concat(w, F.lit("\tX"))), "\n")
    block = F.concat(F.lit("# id = "), "source", F.lit("."), "id", F.lit("\n"), tokens, F.lit("\n"))
    in_order(spark, sf_dir).select(block.alias("value")).write.text(path)
    return readers.block_annotated(spark, path)


@query(r"""WITH t AS (SELECT id, string_split(replace(replace(text, ', ', '॥ '), chr(10), '<eos>'), '<eos>') AS p FROM c),
s AS (SELECT id, list_concat(p[:len(p) - 1], string_split(regexp_replace(p[len(p)], '([.?!।॥])\s+', '\1' || chr(1), 'g'), chr(1))) AS p FROM t)
SELECT id, n, part FROM (SELECT id, unnest(l) AS part, unnest(range(len(l))) AS n FROM (SELECT id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM s))""")
def eos_sentences(spark, sf_dir):
    """Lines as sentences; the last line is split at punctuation, dandas among it."""
    marked = F.replace(F.replace("text", F.lit(", "), F.lit("॥ ")), F.lit("\n"), F.lit("<eos>"))
    return corpus(spark, sf_dir).select("id", F.posexplode(X.split_eos(marked)).alias("n", "part")).withColumn("n", F.col("n").cast("long"))


@query("SELECT gram, count(*)::BIGINT AS tf, count(DISTINCT id)::BIGINT AS df FROM (SELECT id, substr(t, i, 2) AS gram FROM (SELECT id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM c), unnest(range(1, length(t))) AS r(i)) GROUP BY gram")
def char_ngram_tf_df(spark, sf_dir):
    from corpusloom.operators.ml import ngram_frequencies

    return ngram_frequencies(corpus(spark, sf_dir), 2, 2)


@query("WITH f AS (SELECT gram, count(*)::BIGINT AS tf, count(DISTINCT id)::BIGINT AS df FROM (SELECT id, substr(t, i, 2) AS gram FROM (SELECT id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM c), unnest(range(1, length(t))) AS r(i)) GROUP BY gram) SELECT gram, tf, df, round(ln((1.0 + (SELECT count(*) FROM c)) / (1.0 + df)) + 1, 6) AS idf FROM f ORDER BY tf DESC, gram LIMIT 100")
def char_tfidf_top(spark, sf_dir):
    from corpusloom.operators.ml import ngram_frequencies, top_features

    rows = corpus(spark, sf_dir)
    return rounded(top_features(ngram_frequencies(rows, 2, 2), rows.count(), 100), "idf")


