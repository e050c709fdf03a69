"""Row predicates and their algebra."""

import unicodedata
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources.scratch import written

#: Characters of the rules of one automaton.
MOST_CHARS = 20_000_000


def not_blank(text: str = "text") -> Column:
    return F.length(X.clean(text)) > 0


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without null in the columns."""
    return df.na.drop(subset=list(columns))


def long_enough(text: str = "text", least: int = 10) -> Column:
    return F.length(text) >= least


def too_long(text: str = "text", most: int = 2000) -> Column:
    return F.length(text) > most


def numeric_line(text: str = "text", marks: str = r".:\-") -> Column:
    """Nothing but digits of any script, white space and some marks (a regular expression's class)."""
    return F.col(text).rlike(rf"(?U)^[\p{{Nd}}\s{marks}]+$")


def readable(text: str = "text", words: int = 3, chars: int = 15, latin: float = 0.1) -> Column:
    """Enough words and characters, and few Latin letters."""
    return (X.word_count(text) >= words) & (F.length(text) >= chars) & (X.latin_ratio(text) <= latin)


def label_in(labels: list[str], column: str = "label", also: str | None = None) -> Column:
    return F.col(column).isin([*labels, *([also] if also else [])])


def any_of(*masks: Column) -> Column:
    """A mask that counts null as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(m, F.lit(False)) for m in masks])


def replaced_rows(label: str, sources: list[str]) -> Column:
    """Rows that a replacement takes out: the label from other sources, or any row of the sources."""
    ours = F.col("source").isin(sources)
    return ((F.col("label") == label) & ~ours) | ours


def skip_lines(df: DataFrame, n: int, file: str, line: str) -> DataFrame:
    """Without the first n lines of each file. Only those are ranked, and a task sends no more than n lines of a file."""
    rank = F.row_number().over(Window.partitionBy("_file").orderBy("_line"))
    first = df.select(F.col(file).alias("_file"), F.col(line).alias("_line")).withColumn("_rank", rank).where(F.col("_rank") <= n)
    last = first.groupBy("_file").agg(F.max("_line").alias("_last"))
    return df.join(last, F.col(file).eqNullSafe(F.col("_file"))).where(F.col(line) > F.col("_last")).select(*df.columns)


def excluded_names(df: DataFrame, column: str, rules: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Rows whose name contains no part named by the rules (part); both sides in NFC. Null names contain nothing; null and empty parts exclude
    nothing.

    An Aho-Corasick automaton finds all parts in one pass over a name. Rules beyond so many characters are dealt out by a hash to several
    automata of about that size, which the names pass one after another.
    """
    parts = rules.select(F.col("part")).where("part != ''").distinct()
    chars = parts.agg(F.coalesce(F.sum(F.length("part")), F.lit(0)).alias("n")).first().n
    several = -(-chars // most)
    for k in range(several):
        own = parts.where(F.pmod(F.xxhash64("part"), F.lit(several)) == k)
        df = without_parts(df, column, [r.part for r in own.collect()])  # about so many characters
        if several > 1:
            df = written(df, "names")
    return df


def without_parts(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """Rows whose name contains none of some parts."""
    held = df.sparkSession.sparkContext.broadcast([unicodedata.normalize("NFC", p) for p in parts])

    @F.pandas_udf("boolean")
    def contains(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = ahocorasick.Automaton()
        for part in held.value:
            machine.add_word(part, True)
        machine.make_automaton()
        hit = lambda x: next(machine.iter(unicodedata.normalize("NFC", x)), None) is not None
        for names in batches:
            yield names.map(hit, na_action="ignore").fillna(False).astype(bool)

    return df.where(~contains(F.col(column))) if parts else df


def nfc(column: Column) -> Column:
    """Canonical composition, by an Arrow function: the engine has no expression for it."""

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return compose(column)
