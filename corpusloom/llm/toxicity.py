"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index, whose votes weigh by distance.

Words are runs of letters in lower case. A term is a word or the beginning of words (3 to 7 letters) that examples with the label hold
far more often than others; each word counts for its strongest term, and all words without one count together for one last
term of small weight, so that a vector's direction tells how dense the terms are. Document frequencies are those of all documents.

Examples are at most EXAMPLES labelled rows (the least by a hash of doc_id), which bounds vocabulary and index; every document is
scored. Documents without words, null texts among them, count as documents without any term. Rows with a null label or a null
doc_id are no examples; several labels of one doc_id count as the highest; equal vectors are one neighbour with the share of their
labels. Rows that repeat are scored alike, and other columns are ignored. Without examples all scores are 0, without rows there are none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Labelled rows that are learnt from, and terms that they may give.
EXAMPLES = 20_000
VOCABULARY = 8192
#: Distinct vectors that vote, and entries of a block of the index.
NEIGHBOURS = 15
BLOCK = 64
#: Weight of a word without a term; distance that halves a vote; weight of the share of all labels among the votes.
REST = 0.03
NEAR = 0.05
PRIOR = 2.0
#: A term has this log-likelihood ratio at least, stands in as many examples with the label, and is so many times as frequent in them.
LEAST_RATIO, LEAST_DOCS, LEAST_TIMES = 15.0, 4, 3.0
BEGINNINGS = range(3, 8)
#: Rows of a point of the calibration at least.
LEAST_POOL = 5
WORD = re.compile(r"[^\W\d_]+")
#: Partial counts that a task keeps at once, and tasks that score the examples.
PARTS = 400_000
TASKS = 64


def candidates(word: str) -> list[str]:
    """The terms that a word may count for: its beginnings, and itself (with a mark)."""
    return [word[:n] for n in BEGINNINGS if n <= len(word)] + [f"{word}$"]


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def labelled(labels: DataFrame, key: str, label: str, usable: Column, most: int) -> DataFrame:
    """key, label: at most so many usable labelled rows, in the order of a hash."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable).groupBy(key).agg(F.max(label).cast("int").alias(label))
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def term_counts(examples: DataFrame, text: str, label: str) -> DataFrame:
    """term, pos, neg: the examples with and without the label that hold a candidate; partial counts leave a task in bounded parts."""

    def run(batches):
        held: dict[str, list[int]] = {}

        def out():
            part = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x[1] for x in held.values()], pa.int64()), pa.array([x[0] for x in held.values()], pa.int64())], names=["term", "pos", "neg"])
            held.clear()
            return part

        for batch in batches:
            for value, y in zip(batch.column(text), batch.column(label).to_pylist(), strict=True):
                for term in {t for w in words_of(value.as_py()) for t in candidates(w)}:
                    held.setdefault(term, [0, 0])[y > 0] += 1
                if len(held) > PARTS:
                    yield out()
        yield out()

    found = examples.select(text, label).mapInArrow(run, "term string, pos long, neg long")
    return found.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def strongest(counts: DataFrame, pos: int, neg: int, most: int) -> list[tuple[str, float]]:
    """(term, ratio) of the terms that tell the label best; of beginnings of equal counts the longest stands for all."""
    if not pos or not neg:
        return []
    part = lambda n, whole, rate: F.when(n > 0, n * F.log(n / (whole * rate))).otherwise(0.0)
    a, b = F.col("pos"), F.col("neg")
    rate = (a + b) / F.lit(pos + neg)
    ratio = 2 * (part(a, pos, rate) + part(b, neg, rate) + part(F.lit(pos) - a, pos, 1 - rate) + part(F.lit(neg) - b, neg, 1 - rate))
    rows = counts.where(f"pos >= {LEAST_DOCS} and pos * {neg} >= {LEAST_TIMES} * neg * {pos}").withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= LEAST_RATIO)
    found = rows.orderBy(F.desc("ratio"), F.desc(F.length("term")), "term").limit(most).collect()  # at most VOCABULARY rows
    seen, out = set(), []
    for r in found:
        if (r.term, r.pos, r.neg) not in seen:
            out.append((r.term, r.ratio))
        seen |= {(r.term[:n], r.pos, r.neg) for n in BEGINNINGS}
    return out


class Vectors:
    """Counts of terms by each word's strongest one."""

    def __init__(self, terms: list[tuple[str, float]]):
        self.strength = {t: (ratio, -k) for k, (t, ratio) in enumerate(terms)}
        self.heads = {t.rstrip("$")[: BEGINNINGS[0]] for t in self.strength}

    def term(self, word: str) -> int:
        best = max((self.strength[t] for t in candidates(word) if t in self.strength), default=None)
        return -1 if best is None else -best[1]

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """Count of each term, and of the words without one, in lowest terms."""
        words = WORD.findall(text.lower()) if text else []
        heads, first = self.heads, BEGINNINGS[0]
        held: dict[int, int] = {}
        rest = len(words)
        for word, n in Counter([w for w in words if w[:first] in heads]).items():
            at = self.term(word)
            if at >= 0:
                held[at] = held.get(at, 0) + n
                rest -= n
        if not held:
            return held, 1
        whole = math.gcd(rest, *held.values())  # equal directions are equal vectors
        return {t: n // whole for t, n in held.items()}, rest // whole


def vectors(docs: DataFrame, terms: list[tuple[str, float]], key: str, text: str) -> DataFrame:
    """The rows' columns but the text, then terms, counts (arrays, by term) and rest."""
    kept = [c for c in docs.columns if c != text]
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        made = Vectors(held.value)
        for batch in batches:
            found = [made.counts(x.as_py()) for x in batch.column(text)]
            order = [sorted(x[0]) for x in found]
            more = [pa.array(order, pa.list_(pa.int32())), pa.array([[x[0][t] for t in o] for x, o in zip(found, order, strict=True)], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *more], names=[*kept, "terms", "counts", "rest"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, text).mapInArrow(run, f"{schema}, terms array<int>, counts array<int>, rest long")


class Index:
    """Entries as unit vectors in blocks of an inverted index that knows each term's greatest weight in each block.

    Entries stand by their heaviest term and its weight, so that blocks are alike inside. A query bounds the cosines of each block.
    The blocks of the highest bounds are scored first; the k-th best cosine there rules out all blocks whose bounds do not reach it.
    """

    def __init__(self, entries: list[tuple[list[int], list[int], int]], idf: np.ndarray):
        self.idf, self.last = idf, len(idf)
        made = [self.unit(*e) for e in entries]
        heaviest = [(int(t[np.argmax(w)]), -float(w.max()), t.tolist(), w.tolist()) for t, w in made]
        self.order = sorted(range(len(made)), key=heaviest.__getitem__)
        size = [len(made[k][0]) for k in self.order]
        none = np.zeros(0)
        entry = np.repeat(np.arange(len(made)), size)
        term = np.concatenate([made[k][0] for k in self.order] or [none]).astype(np.int64)
        weight = np.concatenate([made[k][1] for k in self.order] or [none])
        by = np.argsort(term, kind="stable")
        term, self.entry, self.weight = term[by], entry[by], weight[by]
        block = self.entry // BLOCK
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.block = block[starts]
        self.most = np.maximum.reduceat(self.weight, starts) if len(starts) else none
        self.lists = np.searchsorted(term[starts], np.arange(self.last + 2)).tolist()
        self.postings = np.searchsorted(term, np.arange(self.last + 2)).tolist()
        self.blocks = -(-len(made) // BLOCK)

    def unit(self, terms: list[int], counts: list[int], rest: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights; words without a term come last."""
        t = np.r_[np.asarray(terms, np.int64), [self.last] if rest else []].astype(np.int64)
        w = np.r_[np.asarray(counts, float) * self.idf[np.asarray(terms, np.int64)], [REST * rest] if rest else []]
        return t, w / math.sqrt(float(w @ w))

    def scored(self, query: list[tuple[int, float]], several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of some blocks and their cosines."""
        place = np.full(self.blocks, -1)
        place[several] = np.arange(len(several))
        scores = np.zeros(len(several) * BLOCK)
        for t, w in query:
            entry, weight = self.entry[self.postings[t] : self.postings[t + 1]], self.weight[self.postings[t] : self.postings[t + 1]]
            at = place[entry // BLOCK]
            held = at >= 0
            scores[at[held] * BLOCK + entry[held] % BLOCK] += w * weight[held]  # an entry has a term once
        found = np.flatnonzero(scores > 0)
        return several[found // BLOCK] * BLOCK + found % BLOCK, scores[found]

    def nearest(self, terms: list[int], counts: list[int], rest: int, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines of the k nearest; ties by the order of the index."""
        query = list(zip(*[x.tolist() for x in self.unit(terms, counts, rest)], strict=True))
        bound = np.zeros(self.blocks)
        for t, w in query:
            low, high = self.lists[t], self.lists[t + 1]
            bound[self.block[low:high]] += w * self.most[low:high]
        first = np.argsort(-bound, kind="stable")[: 2 + k // BLOCK]
        entries, cosines = self.scored(query, np.sort(first))
        least = np.partition(cosines, -k)[-k] if len(cosines) >= k else 0.0
        more = bound >= least - 1e-9  # rounding apart
        more[first] = False
        more &= bound > 0
        if more.any():
            others, of = self.scored(query, np.flatnonzero(more))
            entries, cosines = np.r_[entries, others], np.r_[cosines, of]
        best = np.lexsort((entries, -cosines))[:k]
        return entries[best], np.minimum(cosines[best], 1.0)


class Voters:
    """The index with what each entry votes: its rows, those with the label, and one of its keys."""

    def __init__(self, entries: list[tuple], idf: np.ndarray):
        self.index = Index([e[:3] for e in entries], idf)
        order = self.index.order
        self.rows, self.with_label = (np.array([entries[k][i] for k in order], float) for i in (3, 4))
        self.keys = [entries[k][5] for k in order]
        self.prior = self.with_label.sum() / max(1.0, self.rows.sum())

    def share(self, terms: list[int], counts: list[int], rest: int, without: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Votes for the label, and who votes (entries, cosines). without: the label of a row of that very vector, not to be counted."""
        entries, cosines = self.index.nearest(terms, counts, rest)
        rows, told = self.rows[entries], self.with_label[entries]
        if without is not None and len(entries) and cosines[0] > 1 - 1e-12:
            rows, told = rows.copy(), told.copy()
            rows[0] -= 1
            told[0] -= without
        weight = np.where(rows > 0, NEAR / (NEAR + 1 - cosines), 0.0)
        vote = (told + self.prior) / (rows + 1)
        return float((weight @ vote + PRIOR * self.prior) / (weight.sum() + PRIOR)), entries, cosines


def rising(shares: list[float], told: list[float], rows: list[float]) -> tuple[list[float], list[float]]:
    """Points of a rising curve from shares to rates of the label: neighbours are pooled where rates fall or rows are few."""
    pools: list[list[float]] = []
    for x, y, n in sorted(zip(shares, told, rows, strict=True)):
        pools.append([x * n, y, n])
        while len(pools) > 1 and (pools[-1][1] * pools[-2][2] <= pools[-2][1] * pools[-1][2] or pools[-2][2] < LEAST_POOL):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [p[0] / p[2] for p in pools], np.maximum.accumulate([p[1] / (p[2] + 1) for p in pools]).tolist()


def scored(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """key, score, neighbours (key as text, label's share, cosine of those that voted), terms found, for each row of docs.

    usable: a condition on the labels' rows that tells which may be learnt from.
    """
    spark = docs.sparkSession
    sample = common.write_table(labelled(labels, key, label, usable, examples), "toxicity-sample")
    totals = sample.agg(F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg")).first()
    rows = docs.select(key, text)
    learnt = rows.join(F.broadcast(sample), key)  # at most EXAMPLES rows of two numbers
    terms = strongest(term_counts(learnt, text, label), totals.pos, totals.neg, VOCABULARY)
    marked = rows.join(F.broadcast(sample), key, "left")
    made = common.write_table(vectors(marked, terms, key, text), "toxicity-vectors")

    n = made.count()
    df = np.zeros(len(terms))
    for r in made.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a row a term
        df[r.t] = r["count"]
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    merged = made.where(F.col(label).isNotNull()).groupBy("terms", "counts", "rest").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col(label) > 0).cast("int")).alias("told"), F.min(key).alias("id"))
    entries = [(r.terms, r.counts, r.rest, r.rows, r.told, r.id) for r in merged.orderBy("terms", "counts", "rest").collect()]  # the examples
    voters = spark.sparkContext.broadcast(Voters(entries, idf))

    def leave_out(batches):
        """Each entry's share without one row of its own, once for rows with the label and once for those without."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for y, many in ((1, r["told"]), (0, r["rows"] - r["told"])):
                    if many:
                        out.append((voters.value.share(r["terms"], r["counts"], r["rest"], y)[0], float(many * y), float(many)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.float64()) for i in range(3)], names=["share", "told", "rows"])

    shares = merged.select("terms", "counts", "rest", "rows", "told").repartition(TASKS).mapInArrow(leave_out, "share double, told double, rows double").collect()  # twice the examples
    levels = rising([r.share for r in shares], [r.told for r in shares], [r.rows for r in shares])

    kind = made.schema[key].dataType.simpleString()
    near = pa.list_(pa.struct([("key", pa.string()), ("share", pa.float64()), ("cosine", pa.float64())]))

    def score(batches):
        names = [t for t, _ in terms]
        known: dict[tuple, tuple[float, list[dict]]] = {}
        for batch in batches:
            out = []
            for t, c, rest in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), batch.column("rest").to_pylist(), strict=True):
                at = (tuple(t), tuple(c), rest)
                if at not in known:
                    if len(known) > 10_000:
                        known.clear()
                    v = voters.value
                    share, who, cosines = v.share(t, c, rest)
                    known[at] = (float(np.interp(share, *levels)) if levels[0] else 0.0, [{"key": str(v.keys[e]), "share": v.with_label[e] / v.rows[e], "cosine": x} for e, x in zip(who.tolist(), cosines.tolist(), strict=True)])
                out.append((*known[at], [names[x] for x in t]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], near), pa.array([x[2] for x in out], pa.list_(pa.string()))], names=[key, "score", "neighbours", "terms"])

    return made.select(key, "terms", "counts", "rest").mapInArrow(score, f"`{key}` {kind}, score double, neighbours array<struct<key: string, share: double, cosine: double>>, terms array<string>")
