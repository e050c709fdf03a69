"""Label maps: strict, passing through, or to a default; and rules by label and source."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def mapped(column: str, mapping: dict[str, str], mode: str = "strict", default: str = "other") -> Column:
    """strict: unknown labels become null; keep: they stay; default: they become the default."""
    found = F.try_element_at(lookup(mapping), F.col(column))
    return {"strict": found, "keep": F.coalesce(found, F.col(column)), "default": F.coalesce(found, F.lit(default))}[mode]


def by_source(label: str, source: str, rules: list[tuple[str, list[str], str, str]]) -> Column:
    """Rules (label, sources, label there, label elsewhere); other labels stay."""
    out = None
    for old, sources, there, elsewhere in rules:
        inside = F.col(source).isin(sources)
        for condition, new in (((F.col(label) == old) & inside, there), (F.col(label) == old, elsewhere)):
            out = F.when(condition, new) if out is None else out.when(condition, new)
    return F.col(label) if out is None else out.otherwise(F.col(label))


def only_old(column: str, mapping: dict[str, str], source: str, ours: list[str]) -> Column:
    """Labels of other projects' rows; null for ours."""
    return F.when(~F.col(source).isin(ours), F.coalesce(F.try_element_at(lookup(mapping), F.col(column)), F.col(column)))


def unmapped(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Labels without an entry, with their rows."""
    return df.where(~F.coalesce(F.col(column).isin(list(mapping)), F.lit(False))).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def bare(column: str) -> Column:
    """Without the prefix of training files, trimmed and lower."""
    return F.lower(F.trim(F.regexp_replace(F.col(column), "^__label__", "")))


def coverage(df: DataFrame, known: list[str], label: str, source: str) -> DataFrame:
    """For each source the labels that are known and those that are not."""
    labels = df.groupBy(source).agg(F.collect_set(label).alias("_labels"))
    ours = F.array(*[F.lit(x) for x in known])
    join = lambda c: F.array_join(F.array_sort(c), ", ")
    return labels.select(source, join(F.array_intersect("_labels", ours)).alias("covered"), join(F.array_except("_labels", ours)).alias("uncovered"))
