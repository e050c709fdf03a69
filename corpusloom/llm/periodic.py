"""Periodic runs of words: aligned blocks of a power of two words, searched across the document, seed exact runs.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of 4 q and 6 at least that no neighbouring
word extends. Its first 3 q words hold a block of B words (B the power of two with B <= q < 2 B) that begins at a multiple of B, and that
block stands again q words later. So at each scale B all aligned blocks are keys of an Aho-Corasick automaton over word numbers, its matches
that stand from B to 2 B - 1 words behind an equal block are seeds, and a seed is extended in both directions, word for word. Smaller
scales come first: a stretch of period q with a smaller one is a run that is known by then.

Blocks are only searched where a run of that scale can be: in any run, four words in a row stand again within its period, so each
run shows as a stretch of such fours. Nothing is left out by that, and texts without repetition have nothing to search.

Null and empty texts have no words and no runs. Rows that repeat are treated alike; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words in a row by which stretches are told that may hold a run.
FEW = 4
#: Words compared at once while a seed is extended; doubled each time.
STEP = 16


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def gaps(ids: np.ndarray) -> np.ndarray:
    """For each run of FEW words the distance to the one before that hashes alike; a large number where there is none."""
    n = len(ids) - FEW + 1
    named = np.zeros(n, np.uint64)
    for k in range(FEW):
        named = (named ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        named ^= named >> np.uint64(29)
    order = np.argsort(named, kind="stable")
    held = named[order]
    out = np.full(n, np.iinfo(np.int64).max)
    again = np.flatnonzero(held[1:] == held[:-1])
    out[order[again + 1]] = order[again + 1] - order[again]
    return out


def stretches(gap: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """Where runs with a period from scale to 2 scale - 1 can be: (first word, word after the last)."""
    near = np.r_[0, (gap < 2 * scale).astype(np.int8), 0]
    edges = np.flatnonzero(np.diff(near))
    first, after = edges[::2], edges[1::2]
    # of a run of 4 q words, 4 q - 3 runs of FEW begin in it, and all but the first q have one like them before
    least = max(LEAST_WORDS, LEAST_PERIODS * scale) - FEW + 1 - scale
    kept = after - first >= least
    found: list[tuple[int, int]] = []
    for low, high in zip((first[kept] - 2 * scale).tolist(), (after[kept] + FEW - 1).tolist(), strict=True):
        low = max(0, low)
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], high)
        else:
            found.append((low, high))
    return found


def seeds(ids: np.ndarray, low: int, high: int, scale: int):
    """(place, distance) of the aligned blocks between low and high that stand again scale to 2 scale - 1 words later."""
    first = -(-low // scale)
    blocks = [tuple(ids[b * scale : (b + 1) * scale].tolist()) for b in range(first, high // scale)]
    if not blocks:
        return
    keys = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for block in blocks:
        if block not in keys:
            keys[block] = len(keys)
            machine.add_word(block, keys[block])
    machine.make_automaton()
    of = [keys[block] for block in blocks]
    for last, key in machine.iter(tuple(ids[low:high].tolist())):
        at = low + last - scale + 1
        # the one aligned block that begins at such a distance before
        block = at // scale - 1
        if block >= first and block - first < len(of) and of[block - first] == key:
            yield block * scale, at - block * scale


def alike_after(ids: np.ndarray, at: int, period: int) -> int:
    """How many words from a place on equal those a period later."""
    n, done, step = len(ids) - period, at, STEP
    while done < n:
        a, b = ids[done : min(done + step, n)], ids[done + period : min(done + step, n) + period]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return done + int(differ[0]) - at
        done, step = min(done + step, n), 2 * step
    return max(0, done - at)


def alike_before(ids: np.ndarray, at: int, period: int) -> int:
    """How many words before a place equal those a period later."""
    done, step = at, STEP
    while done > 0:
        low = max(0, done - step)
        differ = np.flatnonzero(ids[low:done] != ids[low + period : done + period])
        if len(differ):
            return at - (low + int(differ[-1]) + 1)
        done, step = low, 2 * step
    return at - done


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. Word numbers below 2**31."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    gap = gaps(ids)
    found: list[tuple[int, int, int]] = []
    covered: dict[int, int] = {}  # for each distance the word up to which its stretches are known
    scale = 1
    while LEAST_PERIODS * scale <= n:
        known = Known(found)
        for low, high in stretches(gap, scale):
            for at, period in seeds(ids, low, high, scale):
                if at < covered.get(period, -1) or known.holds(at, at + period + scale, period):
                    continue
                begin = at - alike_before(ids, at, period)
                covered[period] = after = at + alike_after(ids, at, period)
                if after + period - begin >= max(LEAST_WORDS, LEAST_PERIODS * period):
                    found.append((begin, after + period - begin, period))
        scale *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


class Known:
    """Runs by their period; those of one period stand in order and never in one another."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        for start, length, period in sorted(runs):
            self.runs.setdefault(period, []).append((start, start + length))
        self.smaller: dict[int, list[int]] = {}

    def holds(self, low: int, high: int, period: int) -> bool:
        """Whether a run whose period divides this one holds the words from low to high."""
        if period not in self.smaller:
            self.smaller[period] = [p for p in self.runs if period % p == 0]
        for p in self.smaller[period]:
            k = bisect_right(self.runs[p], (low, 1 << 62)) - 1
            if k >= 0 and self.runs[p][k][1] >= high:
                return True
        return False


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay if of every run only the first period does."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_words, runs (start, length, period; by start and period), collapsed (the words outside the repetitions)."""

    def run(batches):
        for batch in batches:
            sizes, found, left = [], [], []
            for value in batch.column(text):
                words = (value.as_py() or "").encode().split()  # by ASCII white space
                runs = runs_of(numbered(words))
                sizes.append(len(words))
                found.append([{"start": a, "length": b, "period": c} for a, b, c in runs])
                kept = [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()] if runs else words
                left.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(left, pa.string())], names=[key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
