"""Text functions: columns in, columns out; all but segment_offsets inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's strings see it.
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: Segments by strategy (fixed values); any other strategy but paragraph takes the whole text.
SEGMENTS = {
    "sentence": r"[^.!?।\n]+(?:[.!?।\n]+|$)",
    "auto": r"[^.!?।\n,;:()\[\]]+(?:[.!?।\n,;:()\[\]]+|$)",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(text: Column | str) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), SPACES, " "))


def nested(text: Column | str) -> Column:
    """How deep templates stand in one another."""
    marks = F.regexp_extract_all(col(text), F.lit(r"\{\{|\}\}"), 0)

    def step(state: Column, mark: Column) -> Column:
        depth = F.when(mark == "{{", state["depth"] + 1).otherwise(F.greatest(state["depth"] - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), F.greatest(state["most"], depth).alias("most"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most")), step, lambda state: state["most"])


#: Markup that goes or gives way to its text: before and after templates, which go from the innermost one on.
WIKI_FIRST = ((r"(?s)<!--.*?-->", ""), (r"(?s)<ref\b[^>]*?(?:/>|>.*?</ref\s*>)", " "))
WIKI_TEMPLATE = r"\{\{(?:[^{}]|\{(?!\{)|\}(?!\}))*\}\}"
WIKI_PAGES = ((r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), (r"\[\[([^\[\]|]*)\]\]", "$1"))
#: Links to other sites and headings: their words are no running text, so they go unless they are asked for.
WIKI_SITES, WIKI_HEADINGS = r"\[(?:https?:)?//[^\s\]]+[ \t]*([^\]]*)\]", r"(?m)^={1,6}[ \t]*(.*?)[ \t]*={1,6}[ \t]*$"
WIKI_LAST = ((r"'{2,5}", ""), (r"<[^>]+>", " "))


def strip_wiki(text: Column | str, keep: bool = False) -> Column:
    """The running text of wiki markup: no comments, references, templates (also in one another) and tags; links to pages and
    emphasis leave their text, headings and links to other sites only with keep."""

    def replaced(out: Column, steps: tuple[tuple[str, str], ...]) -> Column:
        for pattern, new in steps:
            out = F.regexp_replace(out, pattern, new)
        return out

    def without_templates(out: Column) -> Column:
        rounds = F.filter(F.sequence(F.lit(0), nested(out)), lambda k: k > 0)
        return F.aggregate(rounds, out, lambda held, _: F.regexp_replace(held, WIKI_TEMPLATE, " "))

    words = "$1" if keep else " "
    last = (*WIKI_PAGES, (WIKI_SITES, words), (WIKI_HEADINGS, words), *WIKI_LAST)
    return clean(replaced(bound(replaced(col(text), WIKI_FIRST), without_templates), last))


def strip_join_marker(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?i)<psi[a-z]*>", "")


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"<[^>]+>", " ")


def normalise_words(text: Column | str) -> Column:
    """Lower case, on one line, without digits and marks; combining marks go as well."""
    out = F.lower(F.regexp_replace(F.trim(col(text)), "\n", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", ""), r"\d", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def one_line(text: Column | str) -> Column:
    return F.trim(F.translate(col(text), "\n\r", "  "))


def words(text: Column | str) -> Column:
    """Words between white space; none for blank texts."""
    return F.filter(F.split(clean(text), " "), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def first_words(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def parts(text: Column | str, pattern: str) -> Column:
    """Trimmed non-empty parts between matches."""
    return F.filter(F.transform(F.split(col(text), pattern), lambda x: F.trim(x)), lambda x: x != "")


def split_danda(text: Column | str) -> Column:
    return parts(text, "[।॥]")


def split_eos(text: Column | str) -> Column:
    """Parts between <eos> marks; the part after the last mark is split after punctuation and white space instead."""

    def parted(chunks: Column) -> Column:
        tail = F.split(F.element_at(chunks, -1), r"(?<=[.?!।॥])" + SPACES)
        return F.concat(F.slice(chunks, 1, F.size(chunks) - 1), tail)

    found = bound(F.split(col(text), "<eos>"), parted)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, f"^{SPACES}|{SPACES}$", "")), lambda x: x != "")


def paragraphs(text: Column | str) -> Column:
    """Runs without an empty line, each with the line end that follows it."""

    def ended(parts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.concat(F.regexp_replace(p, r"\A\n", ""), F.when(i < F.size(parts) - 1, "\n").otherwise("")))

    return bound(F.split(col(text), "\n\n+"), ended)


def segments(text: Column | str, strategy: str) -> Column:
    """Segments with a non-blank character; the whole text for other strategies, none for blank texts."""
    if strategy == "paragraph":
        found = paragraphs(text)
    else:
        found = F.regexp_extract_all(col(text), F.lit(SEGMENTS[strategy]), 0) if strategy in SEGMENTS else F.array(col(text))
    return F.filter(found, lambda x: F.length(clean(x)) > 0)


#: What SEGMENTS are to Python; paragraphs as they are found one by one.
PATTERNS = {name: re.compile(pattern) for name, pattern in SEGMENTS.items()} | {"paragraph": re.compile(r"(?:[^\n][\n]?)+")}


def spans(text: str | None, strategy: str | None) -> Iterator[tuple[str, int, int]]:
    """(segment, start, end) of a text's segments in one pass over it."""
    if not text or not text.strip():
        return
    if strategy not in PATTERNS:
        yield text, 0, len(text)
        return
    for found in PATTERNS[strategy].finditer(text):
        if found[0].strip():
            yield found[0], found.start(), found.end()


#: Texts whose segments are Python objects at once.
TEXTS = 100


def listed(values: pa.Array, strategy: str) -> pa.Array:
    """The segments of each text as a list of (text, start, end)."""
    found = [list(spans(t, strategy)) for t in values.to_pylist()]
    ends = np.cumsum([0, *map(len, found)])
    each = [s for part in found for s in part]
    columns = [pa.array([s[k] for s in each], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["text", "start", "end"]))


def segment_offsets(text: Column | str, strategy: str) -> Column:
    """Structs (text, start, end): code points, end exclusive; none for null and blank texts. An Arrow function: expressions that
    find places copy the array of segments for each of them."""

    @F.arrow_udf("array<struct<text: string, start: int, end: int>>")
    def found(values: pa.Array) -> pa.Array:
        parts = [listed(values.slice(at, TEXTS), strategy) for at in range(0, len(values), TEXTS)]
        return pa.concat_arrays(parts) if parts else listed(values, strategy)

    return found(col(text))


def only(text: Column | str, chars: str) -> Column:
    """Number of characters of a class."""
    return F.length(F.regexp_replace(col(text), f"[^{chars}]", ""))


def letters(text: Column | str) -> Column:
    return F.length(F.regexp_replace(col(text), r"\P{L}", ""))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def has_script(text: Column | str, chars: str) -> Column:
    return col(text).rlike(f"[{chars}]")


def detect_script(text: Column | str, one: str, two: str, names: tuple[str, str] = ("Sinh", "Deva")) -> Column:
    a, b = has_script(text, one), has_script(text, two)
    return F.when(a & b, "Mixed").when(a, names[0]).when(b, names[1]).otherwise("Unknown")


def script_ratio_letters(text: Column | str, chars: str) -> Column:
    """Script letters over all letters."""
    found = F.length(F.regexp_replace(F.regexp_replace(col(text), r"\P{L}", ""), f"[^{chars}]", ""))
    return ratio(found, letters(text))


def script_ratio_beyond_ascii(text: Column | str, chars: str) -> Column:
    """Script characters over all characters beyond ASCII."""
    return ratio(only(text, chars), F.length(F.regexp_replace(col(text), r"[\x00-\x7F]", "")))


def latin_ratio(text: Column | str) -> Column:
    return ratio(only(F.lower(col(text)), "a-z"), F.length(col(text)))


def snippet(text: Column | str, n: int = 40) -> Column:
    return F.when(F.length(col(text)) > n, F.concat(F.left(col(text), F.lit(n)), F.lit("..."))).otherwise(col(text))


def stub(name: Column | str) -> Column:
    return F.regexp_replace(F.trim(col(name)), r"\s+", "_")


def padded(number: Column | str, width: int) -> Column:
    """Zeros on the left; longer numbers stay whole."""
    text = col(number).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def seeded(seed: int, *keys: Column | str) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def char_ngrams(text: Column | str, low: int, high: int) -> Column:
    """All character n-grams of the lower-cased text with white space collapsed, from an array of its characters."""

    def grams(chars: Column, n: int) -> Column:
        places = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(places, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))

    plain = F.lower(F.regexp_replace(col(text), r"\s+", " "))
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    return bound(chars, lambda c: F.concat(*[grams(c, n) for n in range(low, high + 1)]))


def random_words(text: Column | str, k: int, seed: int, key: Column | str) -> Column:
    """k words in a row at a reproducible random place; short texts stay whole."""
    found = words(text)
    places = F.size(found) - k + 1
    number = F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("long")
    start = (F.pmod(number, F.greatest(places, F.lit(1))) + 1).cast("int")
    return F.array_join(F.slice(found, start, F.lit(k)), " ")


def encoded(tokens: Column | str, known: Column, most: int, unknown: int = 1) -> Column:
    """Ids of the first tokens by a map; unknown ones share an id."""
    return F.transform(F.slice(col(tokens), 1, most), lambda t: F.coalesce(F.try_element_at(known, t), F.lit(unknown)))
