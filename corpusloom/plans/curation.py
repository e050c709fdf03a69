"""Queries of curation: cleaning, dedup, contradictions, balance, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import audit, curate, filters, labels
from corpusloom.plans.base import CONFIG, LABELS, corpus, query, scratch, table, written
from corpusloom.sources import waves

CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
TIDY_SQL = rf"""
t AS (SELECT id, {CLEAN} AS text, label, source, group_id FROM c WHERE length({CLEAN}) >= 10),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY id) AS r FROM t) WHERE r = 1)"""


def split_sql(rows: str) -> str:
    """SQL of grouped_split over rows with group_id and label."""
    return f"""
gc AS (SELECT group_id, label, count(*) AS n FROM {rows} GROUP BY ALL),
gd AS (SELECT group_id, label AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) AS r FROM gc) WHERE r = 1),
gr AS (SELECT *, row_number() OVER (PARTITION BY dominant ORDER BY md5('42|' || group_id)) - 1 AS before, count(*) OVER (PARTITION BY dominant) AS n FROM gd),
gv AS (SELECT *, CASE WHEN n >= 3 AND round_even(n * 0.1, 0) < 1 THEN 1 ELSE round_even(n * 0.1, 0)::INT END AS v FROM gr),
gt AS (SELECT *, CASE WHEN n >= 3 THEN least(round_even(n * 0.8, 0)::INT, n - v - 1) ELSE round_even(n * 0.8, 0)::INT END AS t FROM gv),
gs AS (SELECT group_id, dominant, CASE WHEN before < t THEN 'train' WHEN before < t + v THEN 'val' ELSE 'test' END AS split FROM gt)"""


def tidy(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("text", X.clean("text")).where(filters.long_enough())
    return curate.keep_first(rows, ["text", "label"], ["id"])


def splits(spark, sf_dir):
    return curate.grouped_split(corpus(spark, sf_dir))


@query(
    f"""WITH {TIDY_SQL}, {split_sql("d")},
j AS (SELECT d.label, gs.split FROM d JOIN gs USING (group_id)),
w AS (SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM j GROUP BY label)
SELECT * FROM w UNION ALL SELECT 'TOTAL', sum(train)::BIGINT, sum(val)::BIGINT, sum(test)::BIGINT FROM w"""
)
def curation_split_report(spark, sf_dir):
    """Clean, drop short texts, dedup, split by groups, and count rows by label and split."""
    rows = tidy(spark, sf_dir)
    return audit.crosstab(curate.with_split(rows, curate.grouped_split(rows)), "label", "split", ["train", "val", "test"])


@query(f"SELECT id, {CLEAN} AS text FROM c")
def clean_text_ws(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", X.clean("text").alias("text"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def strip_tags_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags("html").alias("text"))


@query("SELECT id, regexp_replace(replace(text, 'th', '<psiA>'), '(?i)<psi[a-z]*>', '', 'g') AS text FROM c")
def strip_join_marker(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", X.strip_join_marker(F.replace("text", F.lit("th"), F.lit("<psiA>"))).alias("text"))


@query("SELECT id, trim(translate(text, chr(10) || chr(13), '  ')) AS text FROM c")
def format_lines(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", X.one_line("text").alias("text"))


@query(
    r"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(trim(text), chr(10), ' ')), '[^\p{L}\p{N}_\s]', '', 'g'), '\d', '', 'g'), '\s+', ' ', 'g')) AS text FROM c"""
)
def normalise_words(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", X.normalise_words("text").alias("text"))


@query(f"SELECT CAST(id AS VARCHAR) AS id, {CLEAN} AS text, label, source, NULL::VARCHAR AS subcorpus, group_id, is_core, NULL::VARCHAR AS split FROM c WHERE length({CLEAN}) > 0")
def finalise_corpus(spark, sf_dir):
    return curate.finalise(corpus(spark, sf_dir), CONFIG)


@query(rf"""WITH x AS (SELECT CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN ' ' || chr(10) WHEN id % 13 = 0 THEN left(text, 4) ELSE text END AS text FROM c), y AS (SELECT text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM x)
SELECT count(*) AS rows, count(*) FILTER (t <> '') AS kept, count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (text IS NOT NULL AND t = '') AS blank_text, count(*) FILTER (t <> '' AND length(t) < 10) AS short, count(*) FILTER (t <> '') AS written FROM y""")
def finalise_report(spark, sf_dir):
    """A corpus with null, blank and short texts in its final form, written; the same job tells why rows were dropped."""
    text = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, " \n").when(F.col("id") % 13 == 0, F.left("text", F.lit(4))).otherwise(F.col("text"))
    rows, seen = curate.finalise_counted(corpus(spark, sf_dir).withColumn("text", text), CONFIG)
    done = written(rows, "finalised")
    counts = seen.get
    return done.agg(*[F.lit(counts[c]).alias(c) for c in ("rows", "kept", "null_text", "blank_text", "short")], F.count(F.lit(1)).alias("written"))


@query("SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM (SELECT left(text, 25) AS part FROM benchmark UNION ALL SELECT 'ioncl') AS b WHERE contains(c.text, b.part))")
def excluded_texts(spark, sf_dir):
    """Documents that hold none of many parts: beginnings of the benchmark's passages."""
    rules = table(spark, sf_dir, "benchmark").select(F.left("text", F.lit(25)).alias("part")).union(spark.createDataFrame([("ioncl",), ("",), (None,)], "part string"))
    return filters.excluded_names(corpus(spark, sf_dir).select("id", "text"), "text", rules).select("id")


@query("SELECT id, 'wiki_' || source || '_' || CASE WHEN length(id::VARCHAR) >= 6 THEN id::VARCHAR ELSE lpad(id::VARCHAR, 6, '0') END AS key FROM c")
def key_build(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", F.concat_ws("_", F.lit("wiki"), "source", X.padded("id", 6)).alias("key"))


@query("SELECT id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS snippet FROM c")
def snippet(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", X.snippet("text").alias("snippet"))


@query("SELECT id, coalesce(nullif(trim(CASE WHEN id % 3 = 0 THEN ' ' ELSE source END), ''), nullif(trim(label), ''), 'unknown') AS name FROM c")
def coalesce_key(spark, sf_dir):
    first = F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("source"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return corpus(spark, sf_dir).select("id", F.coalesce(blank(first), blank(F.col("label")), F.lit("unknown")).alias("name"))


@query("SELECT id, substr(text, 1, 2000) AS text FROM c")
def truncate_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", F.substring("text", 1, 2000).alias("text"))


@query("SELECT * FROM (VALUES ('en', 0), ('fr', 1), ('de', 2), ('es', 3)) AS t(label, id)")
def label_dictionary(spark, sf_dir):
    known = spark.createDataFrame([("en", 0), ("fr", 1)], "label string, id int")
    seen = corpus(spark, sf_dir).select("label").distinct().withColumn("position", F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label")))
    return curate.label_ids(known, seen)


@query("SELECT id FROM c WHERE regexp_matches(text, '[À-ſ]')")
def filter_script(spark, sf_dir):
    return corpus(spark, sf_dir).where(X.has_script("text", CONFIG.script)).select("id")


@query("SELECT id, length(text) > 2000 AS long FROM c WHERE length(text) >= 10")
def filter_short(spark, sf_dir):
    return corpus(spark, sf_dir).where(filters.long_enough()).select("id", filters.too_long().alias("long"))


#: One of these lines stands after each text: digits of three scripts, and marks that a number holds or not.
NUMBERS = ["(1, 2)", "12.3 - 4:5", "෧෨ ෩.", "१२: ३", "1,2", "7 a", "- . :"]
NUMBERS_SQL = "[" + ", ".join(f"'{x}'" for x in NUMBERS) + "]"


@query(rf"SELECT doc, line FROM (SELECT id AS doc, unnest(string_split(text || chr(10) || {NUMBERS_SQL}[id % 7 + 1], chr(10))) AS line FROM c) WHERE regexp_matches(line, '^[\p{{Nd}}\s.:-]+$')")
def filter_numeric_lines(spark, sf_dir):
    more = F.get(F.array(*map(F.lit, NUMBERS)), (F.col("id") % 7).cast("int"))
    rows = corpus(spark, sf_dir).select(F.col("id").alias("doc"), F.explode(F.split(F.concat("text", F.lit("\n"), more), "\n")).alias("line"))
    return rows.where(filters.numeric_line("line"))


@query("SELECT id FROM c WHERE length(text) >= 15 AND len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) >= 3 AND length(regexp_replace(lower(text), '[^a-z]', '', 'g')) <= 0.8 * length(text)")
def filter_latin_ratio(spark, sf_dir):
    return corpus(spark, sf_dir).where(filters.readable(latin=0.8)).select("id")


@query("SELECT min(id) AS id, text, label FROM c GROUP BY text, label")
def dedupe_text_label(spark, sf_dir):
    return curate.keep_first(corpus(spark, sf_dir), ["text", "label"], ["id"]).select("id", "text", "label")


@query("SELECT min(id) AS id, text FROM c GROUP BY text")
def dedupe_text(spark, sf_dir):
    return curate.keep_first(corpus(spark, sf_dir), ["text"], ["id"]).select("id", "text")


@query("SELECT text, array_to_string(list_sort(list_distinct(list(label2))), ',') AS labels, count(*) AS rows FROM c GROUP BY text HAVING count(DISTINCT label2) > 1")
def contradictions(spark, sf_dir):
    return curate.contradictions(corpus(spark, sf_dir), label="label2").withColumn("labels", F.array_join("labels", ","))


#: Labels by source: of L0 to L4 two are core labels, L3 is the mixed one, and two are others.
CORE5 = ["L0", "L1"]
LABEL5_SQL = """x AS (SELECT id, text, 'L' || (CAST(substr(source, 4) AS INT) % 5) AS label FROM c),
k AS (SELECT text, count(DISTINCT label) FILTER (label IN ('L0', 'L1')) AS cores, count(DISTINCT label) AS labels, count(*) FILTER (label = 'L3') AS mixed FROM x GROUP BY text),
m AS (SELECT x.*, labels > 1 AND (NOT (cores = 1 AND mixed > 0) OR label = 'L3') AS gone FROM x JOIN k USING (text))"""


def five_labels(spark, sf_dir):
    return corpus(spark, sf_dir).withColumn("label", F.concat(F.lit("L"), (F.substring("source", 4, 9).cast("int") % 5).cast("string")))


@query(f"WITH {LABEL5_SQL} SELECT id, label FROM m WHERE NOT gone")
def resolve_contradictions(spark, sf_dir):
    return curate.resolve_contradictions(five_labels(spark, sf_dir), CORE5, "L3").select("id", "label")


@query(f"""WITH {LABEL5_SQL} SELECT id, gone OR NOT regexp_matches(text, '[À-ſ]') OR length(text) < 10 AS "drop" FROM m""")
def drop_mask(spark, sf_dir):
    return curate.drop_mask(five_labels(spark, sf_dir), CORE5, "L3", CONFIG.script, 10).select("id", "drop")


@query(
    """WITH g AS (SELECT label, group_id, count(*) AS n FROM c GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY md5('42|' || group_id) ROWS UNBOUNDED PRECEDING) - n AS before FROM g)
SELECT c.id FROM c JOIN r USING (label, group_id) WHERE label NOT IN ('en', 'fr') OR before < CASE label WHEN 'en' THEN 300 ELSE 50 END"""
)
def downsample_groups(spark, sf_dir):
    return curate.downsample_groups(corpus(spark, sf_dir), {"en": 300, "fr": 50}).select("id")


@query(
    """WITH m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM c GROUP BY label)),
r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id)) - 1 AS before FROM c)
SELECT id, label FROM r, m WHERE before < least"""
)
def balance_min_class(spark, sf_dir):
    return curate.balance(corpus(spark, sf_dir), 42).select("id", "label")


@query("SELECT id FROM c ORDER BY md5('7|' || id) LIMIT 100")
def sample_n(spark, sf_dir):
    return curate.sample(corpus(spark, sf_dir), 100, 7).select("id")


@query(f"WITH {split_sql('c')} SELECT group_id, dominant, split FROM gs")
def grouped_split(spark, sf_dir):
    return splits(spark, sf_dir)


TWO_STAGE_SQL = """
tg AS (SELECT DISTINCT label, source, group_id FROM c),
tr AS (SELECT *, row_number() OVER (PARTITION BY label, source ORDER BY md5('42|' || label || '|' || source || '|' || group_id)) - 1 AS a, count(*) OVER (PARTITION BY label, source) AS n FROM tg),
tc AS (SELECT c.id, label, source, group_id, tr.a, tr.n AS groups,
       row_number() OVER (PARTITION BY label, source ORDER BY md5('42|' || c.id), c.id) - 1 AS ra, count(*) OVER (PARTITION BY label, source) AS rn FROM c JOIN tr USING (label, source, group_id)),
tn AS (SELECT id, label, CASE WHEN groups >= 3 THEN a ELSE ra END AS a, CASE WHEN groups >= 3 THEN groups ELSE rn END AS n FROM tc),
ts AS (SELECT id, label, CASE WHEN a < n * 4 // 5 THEN 'train' WHEN a < n * 4 // 5 + (n - n * 4 // 5) // 2 THEN 'val' ELSE 'test' END AS split FROM tn)"""


@query(f"WITH {TWO_STAGE_SQL} SELECT id, split FROM ts")
def two_stage_split(spark, sf_dir):
    return curate.two_stage_split(corpus(spark, sf_dir), ["label", "source"]).select("id", "split")


@query(
    """WITH r AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id)) - 1 AS a, count(*) OVER (PARTITION BY label) AS n FROM c)
SELECT id, CASE WHEN a < floor(n * 0.9) THEN 'train' ELSE 'test' END AS split FROM r"""
)
def stratified_row_split(spark, sf_dir):
    return curate.stratified_split(corpus(spark, sf_dir), 0.9, 42).select("id", "split")


def row_split(spark, sf_dir):
    return curate.stratified_split(corpus(spark, sf_dir), 0.9, 42)


ROW_SPLIT_SQL = "rs AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id)) - 1 < floor(count(*) OVER (PARTITION BY label) * 0.9) THEN 'train' ELSE 'test' END AS split FROM c)"


@query(f"WITH {ROW_SPLIT_SQL} SELECT group_id, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits FROM rs GROUP BY group_id HAVING count(DISTINCT split) > 1")
def leakage_check(spark, sf_dir):
    """A row split leaks: these groups are in both parts."""
    return audit.leakage(row_split(spark, sf_dir)).withColumn("splits", F.array_join("splits", ","))


@query(
    f"""WITH {split_sql("c")}, x AS (SELECT DISTINCT group_id, split FROM c JOIN gs USING (group_id))
SELECT a || '_' || b AS pair, (SELECT count(*) FROM x AS l JOIN x AS r USING (group_id) WHERE l.split = a AND r.split = b) AS groups
FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) AS t(a, b)"""
)
def split_intersections(spark, sf_dir):
    rows = curate.with_split(corpus(spark, sf_dir), splits(spark, sf_dir))
    return audit.split_intersections(rows, ("train", "val", "test"))


@query("SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM c) WHERE r <= 50")
def quota_per_label(spark, sf_dir):
    return curate.quota(corpus(spark, sf_dir), 50, ["id"]).select("id", "label")


@query("SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM c) WHERE r <= 20")
def streaming_quota(spark, sf_dir):
    return curate.quota(corpus(spark, sf_dir), 20, ["id"]).select("id", "label")


@query("SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM c) WHERE r <= 20")
def quota_of_files(spark, sf_dir):
    """The first rows of each label from files in the order of ids; later files are not read."""
    path = scratch(spark, "files")
    corpus(spark, sf_dir).select("id", "label", "text").repartitionByRange(32, "id").sortWithinPartitions("id").write.parquet(path)
    found, _ = waves.first_rows(spark, waves.files_below(spark, path), waves.parquet_files(spark), dict.fromkeys(LABELS, 20), "label")
    return found.select("id", "label")


@query("SELECT text, label, source FROM c WHERE NOT (label = 'es' OR source IN ('src3', 'src4')) UNION ALL SELECT text, 'bench', 'benchmark' FROM benchmark")
def rehearsal_mix(spark, sf_dir):
    """Rows of other labels and sources, with the benchmark in their place."""
    old = corpus(spark, sf_dir).select("text", "label", "source")
    new = table(spark, sf_dir, "benchmark").select("text", F.lit("bench").alias("label"), F.lit("benchmark").alias("source"))
    return curate.replace_rows(old, filters.replaced_rows("es", ["src3", "src4"]), new)


@query("SELECT id::BIGINT AS id, text, label FROM c UNION ALL SELECT item_id, text, NULL FROM benchmark")
def union_sources(spark, sf_dir):
    return curate.union_existing([corpus(spark, sf_dir).select("id", "text", "label"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")])


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_id FROM c")
def row_ids(spark, sf_dir):
    return curate.row_numbers(corpus(spark, sf_dir).select("id"), "id")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id * 1000000 + turn) - 1 AS row_id FROM conversations")
def running_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("at"))
    return curate.row_numbers(rows, "at").drop("at")


@query("SELECT page_id, regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '[.][^.]*$', '') AS parent FROM pages")
def parent_key(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(host, "[.][^.]*$", "").alias("parent"))


@query("SELECT id, 'x' AS label, 'here' AS source FROM c")
def constant_columns(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", F.lit("x").alias("label"), F.lit("here").alias("source"))


@query("SELECT id, label FROM c")
def select_present(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return rows.select([c for c in ("id", "label", "title") if c in rows.columns])


@query("SELECT c.id, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, c.label) AS label FROM c LEFT JOIN labels ON c.id = labels.doc_id")
def partial_update(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "toxic").alias("label"))
    return curate.partial_update(corpus(spark, sf_dir).select("id", "label"), new, "id", ["label"])


@query("SELECT count(*) AS n FROM c WHERE length(trim(text)) > 0")
def filter_nonempty(spark, sf_dir):
    return corpus(spark, sf_dir).where(filters.not_blank()).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, group_id FROM c WHERE text IS NOT NULL AND label IS NOT NULL AND group_id IS NOT NULL")
def dropna_subset(spark, sf_dir):
    return filters.complete(corpus(spark, sf_dir), "text", "label", "group_id").select("id", "group_id")


@query("SELECT id, label FROM c WHERE label IN ('de', 'fr', 'es')")
def label_in(spark, sf_dir):
    return corpus(spark, sf_dir).where(filters.label_in(["de", "fr"], also="es")).select("id", "label")


@query("SELECT id FROM c WHERE NOT (label = 'en' AND source NOT IN ('src1', 'src2') OR source IN ('src1', 'src2'))")
def replace_filter(spark, sf_dir):
    return corpus(spark, sf_dir).where(~filters.replaced_rows("en", ["src1", "src2"])).select("id")


@query(f"WITH {split_sql('c')} SELECT id FROM c JOIN gs USING (group_id) WHERE split = 'val'")
def split_filter(spark, sf_dir):
    return curate.with_split(corpus(spark, sf_dir), splits(spark, sf_dir)).where("split = 'val'").select("id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderkey > 10")
def owner_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_custkey = 7 AND o_orderkey > 10").select("o_orderkey")


@query("SELECT doc_id FROM labels WHERE quality BETWEEN 0 AND 1 AND toxic = 0")
def class_range(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality between 0 and 1 and toxic = 0").select("doc_id")


@query("SELECT id, line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM c) WHERE n > 3")
def skip_first_lines(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return filters.skip_lines(rows, 3, "id", "n").select("id", "line")


@query(f"WITH {split_sql('c')} SELECT id, split FROM c LEFT JOIN gs USING (group_id)")
def split_lookup_join(spark, sf_dir):
    return curate.with_split(corpus(spark, sf_dir), splits(spark, sf_dir)).select("id", "split")


@query("SELECT id FROM c WHERE group_id IN (SELECT group_id FROM c GROUP BY group_id HAVING count(*) > 5)")
def kept_groups_semi(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return rows.join(curate.group_sizes(rows, "group_id").where("n > 5"), "group_id", "left_semi").select("id")


@query("SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = c.id)")
def complement_anti(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return rows.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti").select("id")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def parent_children_sorted(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles"))


@query("SELECT DISTINCT source, label FROM c")
def distinct_on_keys(spark, sf_dir):
    return corpus(spark, sf_dir).select("source", "label").distinct()


@query("SELECT id, source FROM c")
def sort_source_id(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", "source").orderBy("source", "id")


@query("SELECT id FROM c WHERE length(text) >= 100 ORDER BY id LIMIT 35000")
def global_limit(spark, sf_dir):
    return corpus(spark, sf_dir).where(filters.long_enough(least=100)).orderBy("id").limit(35_000).select("id")


@query("SELECT p_partkey, p_name FROM part")
def order_by_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@query("SELECT item_id, b.text AS bench, d.text AS doc FROM benchmark AS b JOIN (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) AS d ON d.n = b.item_id")
def paired_lines_zip(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("bench"))
    docs = curate.row_numbers(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc")), "doc_id", "item_id").drop("doc_id")
    return bench.join(docs, "item_id")


@query("SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS first, max(CASE WHEN turn = 1 THEN text END) AS second FROM conversations GROUP BY conv_id")
def positional_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("first"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("second"))


@query("SELECT id, CASE label WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' END AS mapped FROM c")
def map_labels_strict(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", labels.mapped("label", {"en": "eng", "fr": "fra"}).alias("mapped"))


@query("SELECT id, CASE label WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' ELSE label END AS mapped FROM c")
def map_labels_passthrough(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", labels.mapped("label", {"en": "eng", "fr": "fra"}, "keep").alias("mapped"))


@query("SELECT id, CASE label WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' ELSE 'other' END AS mapped FROM c")
def map_labels_other(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", labels.mapped("label", {"en": "eng", "fr": "fra"}, "default").alias("mapped"))


RULES = [("fr", ["src1", "src2", "src3"], "fr_a", "fr_b")]


@query("SELECT id, CASE WHEN label = 'fr' AND source IN ('src1', 'src2', 'src3') THEN 'fr_a' WHEN label = 'fr' THEN 'fr_b' ELSE label END AS mapped FROM c")
def map_two_key(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", labels.by_source("label", "source", RULES).alias("mapped"))


@query("SELECT id, CASE WHEN source NOT IN ('src1', 'src2') THEN CASE label WHEN 'en' THEN 'eng' ELSE label END END AS mapped FROM c")
def map_old_languages_only(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", labels.only_old("label", {"en": "eng"}, "source", ["src1", "src2"]).alias("mapped"))


@query(
    "SELECT source, array_to_string(list_sort(list_filter(list_distinct(list(label)), lambda x: x IN ('en', 'fr'))), ', ') AS covered, array_to_string(list_sort(list_filter(list_distinct(list(label)), lambda x: x NOT IN ('en', 'fr'))), ', ') AS uncovered FROM c GROUP BY source"
)
def label_coverage_per_source(spark, sf_dir):
    return labels.coverage(corpus(spark, sf_dir), ["en", "fr"], "label", "source")


@query("SELECT label AS name, 'both' AS side FROM (SELECT DISTINCT label FROM c WHERE source = 'src1' INTERSECT SELECT DISTINCT label FROM c WHERE source = 'src2') UNION ALL SELECT label, 'first' FROM (SELECT DISTINCT label FROM c WHERE source = 'src1' EXCEPT SELECT DISTINCT label FROM c WHERE source = 'src2')")
def label_set_ops(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    a, b = (rows.where(F.col("source") == s).select(F.col("label").alias("name")) for s in ("src1", "src2"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).distinct().join(b, "name", "left_anti").withColumn("side", F.lit("first")))
