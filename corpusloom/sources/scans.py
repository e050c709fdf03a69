"""Scans of text files of any size.

A file's blocks are read apart. Each gives a summary (how many marks, the last of each kind), a scan over a file's summaries tells what
stands before each block, and then blocks are finished alone: no task sees a whole file. Pieces end at a separator, and a piece that
crosses the end of a block belongs to the block that it begins in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

BLOCK = ("path", "block")


def pieces(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """path, file, block, at (rising in a block), value of the parts between separators."""
    rows = spark.read.option("lineSep", separator).option("recursiveFileLookup", True).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def carried(rows: DataFrame, sums: dict[str, Column], lasts: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and last values that are not null, over a piece and all before it in its file."""
    lasts = lasts or {}
    whole = [F.sum(c).alias(f"_{n}") for n, c in sums.items()] + [F.max_by(c, F.when(c.isNotNull(), F.col("at"))).alias(f"_{n}") for n, c in lasts.items()]
    blocks = rows.groupBy(*BLOCK).agg(*whole)
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    before = [F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums] + [F.last(f"_{n}", ignorenulls=True).over(earlier).alias(f"_{n}") for n in lasts]
    inside = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(inside) for n, c in lasts.items()})
    done = held.join(blocks.select(*BLOCK, *before), list(BLOCK))
    columns = {n: F.col(n) + F.col(f"_{n}") for n in sums} | {n: F.coalesce(n, f"_{n}") for n in lasts}
    return done.withColumns(columns).drop(*[f"_{n}" for n in columns])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1 in each file), value of every line."""
    rows = pieces(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    counts = rows.groupBy(*BLOCK).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = counts.select(*BLOCK, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return rows.join(starts, list(BLOCK)).select("file", (F.col("at") + F.col("shift")).alias("number"), "value")


def block_annotated(spark: SparkSession, path: str) -> DataFrame:
    """id, text of parts that a line "# id = ..." heads; the first tab-separated column of each line that is not blank is a word.

    Files are split at such lines, so a part is one piece and no words are shuffled; what stands before a file's first head is one piece
    too, of at most 2 GB. Only a file's first piece keeps the mark of its head.
    """
    mark = "# id ="
    rows = pieces(spark, path, "\n" + mark)
    begun = rows.where("block = 0")
    firsts = begun.groupBy("path").agg(F.min("at").alias("first"))  # a row for each file
    first, headed = F.col("at") == F.col("first"), F.col("value").startswith(mark)
    begun = begun.join(firsts, "path").where(~first | headed)  # no more than a block of a file
    begun = begun.select(F.when(first, F.substr("value", F.lit(len(mark) + 1))).otherwise(F.col("value")).alias("value"))
    rows = rows.where("block > 0").select("value").unionByName(begun).select(F.split("value", "\n").alias("l"))
    name = F.trim(F.regexp_replace(F.get("l", F.lit(0)), "\r$", ""))
    filled = F.filter(F.slice("l", F.lit(2), F.size("l")), lambda x: ~x.rlike(r"\A\s*\z"))
    found = rows.select(name.alias("id"), F.transform(filled, lambda x: F.regexp_extract(x, "^[^\t\r]*", 0)).alias("words"))
    return found.where("id != '' and size(words) > 0").select("id", F.array_join("words", " ").alias("text"))


#: A tag up to its end and the text after it; attributes may hold ">" in quotes.
TAG = r"""(?s)\A(/?)([\w:.-]+)((?:[^>"']|"[^"]*"|'[^']*')*)>(.*)\z"""
CDATA = r"(?s)\A!\[CDATA\[(.*?)\]\]>(.*)\z"
COMMENT = r"(?s)\A!--.*?-->(.*)\z"
#: Fixed names of the milestone format: what ends a verse, and headers whose text is none of it.
MILESTONES = ("book", "c", "v", "ve")
HEADERS = ("id", "h", "toc")


def unescaped(text: Column) -> Column:
    """The five named references, and numbers in the basic plane, as their characters."""
    out = text
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def attribute(rest: Column, name: str) -> Column:
    """An attribute's value, null if there is none."""
    found = F.regexp_extract(rest, rf"""(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 0)
    return F.when(found != "", unescaped(F.regexp_replace(found, r"""(?s)\A[^"']*["']|["']\z""", "")))


def usfx(spark: SparkSession, path: str) -> DataFrame:
    """book, chapter, verse, text of every verse of milestone XML: the text between its mark and the next mark.

    Tags are found by splitting at "<", so files are read in blocks. Comments must hold no "<". A verse's own bcv attribute wins over the
    last book and chapter, and holds for the verses after it.
    """
    rows = pieces(spark, path, "<")
    tagged = lambda k: F.regexp_extract("value", TAG, k)
    name, rest, closing = tagged(2), tagged(3), tagged(1) == "/"
    other = F.concat(F.regexp_extract("value", CDATA, 1), F.regexp_extract("value", CDATA, 2), F.regexp_extract("value", COMMENT, 1))
    plain = F.col("value").startswith("!")
    where = F.split(attribute(rest, "bcv"), r"\.")
    full = F.coalesce(F.size(where) == 3, F.lit(False))
    alone = rest.endswith("/")
    rows = rows.select(
        *BLOCK, "at", name.alias("name"), closing.alias("closing"), alone.alias("alone"), F.when(plain, other).otherwise(unescaped(tagged(4))).alias("text"), attribute(rest, "id").alias("id"), F.when(full, where).alias("bcv")
    )
    mark = F.col("name").isin(*MILESTONES) & ~F.col("closing")
    of = lambda n: mark & (F.col("name") == n)
    own = of("v") & F.col("bcv").isNotNull()
    header = F.col("name").isin(*HEADERS) & ~F.col("alone")
    rows = carried(
        rows,
        {"verse_number": mark.cast("int"), "inside": F.when(header & F.col("closing"), -1).when(header, 1).otherwise(0)},
        {
            "book": F.when(own, F.get("bcv", F.lit(0))).when(of("book"), F.coalesce("id", F.lit(""))),
            "chapter": F.when(own, F.get("bcv", F.lit(1))).when(of("c"), F.coalesce("id", F.lit(""))).when(of("book"), F.lit("")),
        },
    )
    # a verse's pieces are few: what stands between two marks
    parts = F.array_sort(F.collect_list(F.when(F.col("inside") <= 0, F.struct("block", "at", "text"))))
    verse = F.coalesce(F.get("bcv", F.lit(2)), F.col("id"), F.lit(""))
    found = rows.where("verse_number > 0").groupBy("path", "verse_number").agg(
        F.max(F.when(mark, F.when(F.col("name") == "v", F.struct(F.coalesce("book", F.lit("")).alias("book"), F.coalesce("chapter", F.lit("")).alias("chapter"), verse.alias("verse"))))).alias("v"), parts.alias("parts")
    )
    return found.where("v is not null").select("v.*", X.clean(F.array_join("parts.text", " ")).alias("text")).where("text != ''")


def book_sentences(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """id, text of each sentence of each book, a text file in a directory of the book's name.

    Sentences end at <eos>; what follows the last one in a file ends at punctuation instead. Ids number a book's sentences.
    """
    rows = spark.read.option("lineSep", "<eos>").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    parent = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    rows = rows.select(parent.alias("book"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    last = rows.groupBy("path").agg(F.max(F.struct("block", "at")).alias("end"))
    found = X.split_eos(X.strip_join_marker("value"))  # no mark is left: these are the tail's sentences
    ends = rows.join(last, "path").withColumn("tail", F.struct("block", "at") == F.col("end"))
    whole = F.filter(F.array(F.regexp_replace(X.strip_join_marker("value"), f"^{X.SPACES}|{X.SPACES}$", "")), lambda x: x != "")
    ends = ends.select("book", *BLOCK, "at", F.when(F.col("tail"), found).otherwise(whole).alias("found"))
    numbered = carried(ends, {"after": F.size("found").cast("long")})
    each = numbered.select("book", (F.col("after") - F.size("found")).alias("first"), F.posexplode("found").alias("n", "sentence"))
    return each.select(F.concat_ws("_", X.stub("book"), X.padded(F.col("first") + F.col("n"), 5)).alias("id"), X.clean("sentence").alias("text"))
