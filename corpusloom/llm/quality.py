"""Document rules and host verdicts, with DataFrame functions only (operator 5).

A document fails its rules if it has too few words or if too many of its words stand in repeated windows. By
host, failures are counted and the rate is shrunk towards that of all documents by a beta prior; a host whose shrunk
rate is too high loses all its documents. The prior is fitted to the hosts by moments: hosts weigh by their documents,
and what chance alone makes their rates differ is taken out, so it needs no bounds. If hosts differ no more than by
chance, all have the rate of all documents.

Windows of a text are compared by hashes; where two are equal, the windows themselves decide.

Defined cases: null and empty texts have no words and fail; a null host is a host of its own; repeated rows each
get a verdict; an empty table gives an empty table; further columns of the input are passed over, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_or_empty, write_table

BLANK = r"[ \t-\r]+"
#: A host goes if its shrunk failure rate is above this.
MOST_FAILING = 0.5
#: Verdicts on up to so many rejected hosts are broadcast; beyond, the join is salted.
FEW_HOSTS = 50_000
SALTS = 16


def with_words(docs: DataFrame, text: Column) -> DataFrame:
    """Adds _words (array of the words of text)."""
    return docs.withColumn("_words", F.filter(F.split(text, BLANK), lambda w: w != ""))


def with_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    whole = text_or_empty(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    found = with_words(docs, whole).withColumn("_lines", lines)
    found = found.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    found = found.withColumn("_three", F.expr("transform(slice(_hashes, 1, greatest(size(_hashes) - 2, 0)), (x, i) -> xxhash64(x, get(_hashes, i + 1), get(_hashes, i + 2)))"))
    # where hashes repeat: sorting by hash and words brings equal windows together
    window = F.expr("sort_array(transform(_three, (x, i) -> struct(x as h, concat_ws(' ', slice(_words, i + 1, 3)) as w, i as i)))")
    again = F.expr("array_sort(transform(filter(_windows, (x, i) -> (x.h <=> get(_windows, i - 1).h and x.w = get(_windows, i - 1).w) or (x.h <=> get(_windows, i + 1).h and x.w = get(_windows, i + 1).w)), x -> x.i))")
    covered = F.expr("aggregate(_again, struct(0L as n, -3 as last), (a, x) -> struct(a.n + least(3, x - a.last) as n, x as last)).n")
    repeats = F.size(F.array_distinct("_three")) < F.size("_three")
    found = found.withColumn("_windows", F.when(repeats, window)).withColumn("_again", F.when(F.col("_windows").isNotNull(), again)).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return found.withColumn("base_failed", failed).drop("_words", "_lines", "_hashes", "_three", "_windows", "_again")


def rejected_hosts(verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Hosts above the limit, from rows with a host and base_failed: _host, failing_rate."""
    hosts = verdicts.groupBy(F.coalesce(host, F.lit("")).alias("_host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    total = hosts.agg(F.sum(n).alias("docs"), F.sum(k).alias("failed"), F.sum(n * n).alias("squares"), F.sum(k * k / n).alias("spread"), F.count(F.lit(1)).alias("hosts"))
    fit = total.select((F.col("failed") / F.col("docs")).alias("m"), "docs", "squares", "spread", (F.col("hosts") - 1).cast("double").alias("free"))
    # how far hosts differ beyond chance: 0 (not at all) to 1 (each wholly passes or fails)
    by_chance = F.col("m") * (1 - F.col("m"))
    between = (F.col("spread") - F.col("docs") * F.col("m") * F.col("m")) / by_chance - F.col("free")
    room = F.col("docs") - F.col("squares") / F.col("docs") - F.col("free")
    fit = fit.select("m", F.when((by_chance > 0) & (room > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), between / room))).otherwise(F.lit(0.0)).alias("g"))  # one row
    # the beta prior has (1 - g) / g documents, m of them failing
    shrunk = (F.col("g") * k + (1 - F.col("g")) * F.col("m")) / (F.col("g") * n + 1 - F.col("g"))
    return hosts.join(F.broadcast(fit)).select("_host", shrunk.alias("failing_rate")).where(F.col("failing_rate") > MOST_FAILING)


def with_host_verdict(rows: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Adds kept: base_failed is false and the host is not among the rejected ones."""
    rejected = hosts.select("_host", F.lit(True).alias("_rejected"))
    rows = rows.withColumn("_host", F.coalesce(host, F.lit("")))
    if rejected.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS:
        joined = rows.join(F.broadcast(rejected), "_host", "left")
    else:
        salted = rejected.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, ["_host", "_salt"], "left").drop("_salt")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("_rejected").isNull()).drop("_host", "_rejected")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, source, the rules' figures, base_failed and kept for every row."""
    found = write_table(with_rules(docs.select("doc_id", "source", "text")).drop("text"), "quality")
    hosts = write_table(rejected_hosts(found), "hosts")
    return with_host_verdict(found, hosts)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with the columns of the input. The rules' figures are made once: what passes them is written."""
    own = with_rules(docs.select("doc_id", "source", "text", F.struct("*").alias("row")))
    found = write_table(own.select("doc_id", "source", "base_failed", F.when(~F.col("base_failed"), F.col("row")).alias("row")), "quality")
    hosts = write_table(rejected_hosts(found), "hosts")
    kept = with_host_verdict(found, hosts).where("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM w, unnest(range(1, len(words) - 1)) AS r(i)
), d AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g
), c AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM d, unnest([0, 1, 2]) AS u(o) WHERE n > 1 GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN l ON w.doc_id = l.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM f GROUP BY host
), a AS (
  SELECT sum(n) AS d, sum(k) / sum(n) AS m, sum(n * n) AS q, sum(k * k / n) AS s, count(*) - 1 AS o FROM h
), p AS (
  SELECT m, CASE WHEN m * (1 - m) > 0 AND d - q / d - o > 0
         THEN least(1.0, greatest(0.0, ((s - d * m * m) / (m * (1 - m)) - o) / (d - q / d - o))) ELSE 0.0 END AS g FROM a
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (g * k + (1 - g) * m) / (g * n + 1 - g) <= 0.5 AS kept
FROM f JOIN h ON f.host = h.host, p
"""
