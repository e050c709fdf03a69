import random
from types import SimpleNamespace

import numpy as np
from corpusloom.llm import linededup
from pyspark.sql import functions as F


def made(spark, rows):
    docs = linededup.keyed(spark.createDataFrame(rows, "doc_id long, text string")).repartition(2).persist()
    known, repeated = np.full(linededup.SLOTS, 9, np.uint8), np.zeros(linededup.BITS // 8, np.uint8)
    return docs, [spark.sparkContext.broadcast(x) for x in (known, repeated)]


def test_prefix_words_are_shuffled_in_few_rows(spark):
    """Rows of the index come back from their blocks whole and in order, with the odd bits of long lines."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    rows = [(rng.choice([-1, 1]) * i, "\n".join(" ".join(rng.sample(words, rng.choice([3, 30, 80, 200, 500]))) for _ in range(8))) for i in range(60)]
    docs, filters = made(spark, rows)
    packed = linededup.emitted(docs, *filters, 4).orderBy("block")
    found = list(linededup.indexed(packed.toArrow().to_batches()))
    got = [row for part in found for row in zip(*(part[c].tolist() for c in (*linededup.NUMBERS, "wide")), strict=True)]
    local = [SimpleNamespace(value=x.value) for x in filters]
    want = []
    for columns, wide in linededup.prefix_words(docs.toArrow().to_batches(), *local, None, linededup.SPLIT):
        want += [(*row, wide.get(k)) for k, row in enumerate(columns.T.tolist())]
    assert len(want) > 3000 and packed.count() * 20 < len(want)
    assert sorted(got, key=lambda r: r[:9]) == sorted(want, key=lambda r: r[:9]) and sum(r[9] is not None for r in got) > 100
    places = [(r[0] >> linededup.RANK_BITS, r[1], r[3:6]) for r in got]
    assert len(found) > 1 or places == sorted(places)


def test_all_lines_of_open_words_are_kept(spark):
    """Later rounds need no text again: the first one leaves the rows of each word of which some line has more, all of them."""
    base = [f"b{i}" for i in range(30)]
    rows = [(k, " ".join([*base, f"own{k}"])) for k in range(6)] + [(k, " ".join(f"x{k}y{i}" for i in range(30))) for k in range(6, 10)]
    docs, filters = made(spark, rows)
    found = linededup.candidates(linededup.emitted(docs, *filters, 4), 0, 1).persist()
    assert {len(r.earlier) for r in found.where("later is not null").collect()} == {1}
    asked = {r.word for r in found.where("more").collect()}
    index = found.where("class is not null").select(F.shiftright("key", linededup.RANK_BITS).alias("word"), "class", "doc")
    kept = {}
    for r in index.collect():
        kept.setdefault(r.word, set()).add(r.doc)
    assert asked and set(kept) == asked and all(docs <= set(range(6)) and len(docs) > 2 for docs in kept.values())
