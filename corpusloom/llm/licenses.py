"""Licence scans with a generalised suffix automaton over licence words (operator 4).

The automaton holds every word run of the templates. Streaming a text through it gives matching statistics: for
each word, the longest template run that ends there, and all places of the templates where it stands. Runs that cannot be
extended and are long enough are chained into spans: the heaviest chains whose places rise in text and template alike, found with
a table of the best chain to each place of the template, so that stray runs are passed over; a span's coverage is the share of its template. The templates are short licences as a whole and the notices by which long ones are applied;
other collections can be given.

Defined cases: a null or empty text has no words, no places and score 0; repeated rows give equal results; long
texts are streamed whole; an empty table gives an empty table; only the key and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterable
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases that count wherever their words stand consecutively (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""

#: Public licence texts (without their copyright lines) and notices, under labels of this operator (fixed values).
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction""",
    "mit-notice": "This software is released under the MIT License",
    "bsd-2-text": f"{CONDITIONS} {DISCLAIMER}",
    "bsd-3-text": f"""{CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. {DISCLAIMER}""",
    "bsd-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "isc-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of
this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a
copy of the GNU General Public License along with this program.""",
    "gpl-notice": "This work is licensed under the GNU General Public License version 3",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at""",
    "apache-short": "released under the terms of the Apache License version 2.0",
    "mpl-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at""",
    "cc-by-nc-notice": "licensed under CC BY-NC 4.0",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}

#: Bytes of words as they are, A-Z in lower case, all else a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
LEAST_RUN = 3
LEAST_COVER = 0.6


class Automaton:
    """Generalised suffix automaton over word ids; for each state, all places where its runs end in each template."""

    def __init__(self, templates: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        for number, words in enumerate(templates):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, set()).add(at)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for number, at in self.ends[state].items():
                self.ends[self.link[state]].setdefault(number, set()).update(at)
        self.ends = [{number: sorted(at) for number, at in ends.items()} for ends in self.ends]

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state for exactly the run of p and word."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def statistics(self, words: list[int]) -> Iterable[tuple[int, int]]:
        """For each word the state and length of the longest run of a template that ends with it."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            else:
                state = size = 0
            yield state, size


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Scanner:
    """Phrases and templates in one automaton."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        held = [(label, words_of(text), True) for text, label in phrases.items()] + [(label, words_of(text), False) for label, text in templates.items()]
        self.vocabulary: dict[bytes, int] = {}
        for _, words, _ in held:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.labels, self.base = [x[0] for x in held], [x[2] for x in held]
        self.sizes = [len(x[1]) for x in held]
        runs = [[self.vocabulary[w] for w in x[1]] for x in held]
        self.automaton = Automaton(runs)
        n = len(self.vocabulary)
        self.pairs = np.zeros((n + 1, n + 1), bool)
        for run in runs:
            self.pairs[run[:-1], run[1:]] = True
        self.found = [self._phrases(s, runs) for s in range(len(self.automaton.link))]
        self.shorter = [self._shorter(s) for s in range(len(self.automaton.link))]

    def _phrases(self, state: int, runs: list[list[int]]) -> list[int]:
        """The phrases that end wherever this state is reached, by its chain of suffix links."""
        a, out = self.automaton, []
        while state > 0:
            for number, at in a.ends[state].items():
                if self.base[number] and self.sizes[number] - 1 in at and a.length[a.link[state]] < self.sizes[number] <= a.length[state]:
                    out.append(number)
            state = a.link[state]
        return out

    def _shorter(self, state: int) -> dict[int, tuple[int, list[int]]]:
        """Templates that only hold the end of this state's runs: the longest such run and its places."""
        a, out = self.automaton, {}
        at = a.link[state]
        while at > 0 and a.length[at] >= LEAST_RUN:
            for number, places in a.ends[at].items():
                if not self.base[number] and number not in a.ends[state]:
                    out.setdefault(number, (a.length[at], places))
            at = a.link[at]
        return out

    def _runs(self, state: int, size: int) -> dict[int, tuple[int, list[int]]]:
        """For each template the longest run that ends here, if long enough, and its places."""
        if size < LEAST_RUN:
            return {}
        own = {number: (size, at) for number, at in self.automaton.ends[state].items() if not self.base[number]}
        return own | self.shorter[state]

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Words; (label, start) of each phrase; (label, start, words, coverage) of each chained span."""
        words = words_of(text)
        n, none = len(words), len(self.vocabulary)
        if n < 2:
            return n, [], []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(none)), np.int32, n)
        joined = np.flatnonzero(self.pairs[ids[:-1], ids[1:]])
        if not len(joined):
            return n, [], []
        places, longest = [], {}
        for run in np.split(joined, np.flatnonzero(np.diff(joined) > 1) + 1):
            begin, end = int(run[0]), int(run[-1]) + 2
            seen = list(self.automaton.statistics(ids[begin:end].tolist()))
            runs = [self._runs(*x) for x in seen]
            for k, (state, size) in enumerate(seen):
                places += [(self.labels[p], begin + k + 1 - self.sizes[p]) for p in self.found[state] if self.sizes[p] <= size]
                after = runs[k + 1] if k + 1 < len(runs) else {}
                for number, (run, at) in runs[k].items():
                    if number not in after or after[number][0] <= run:
                        longest.setdefault(number, []).append((begin + k + 1 - run, run, [x + 1 - run for x in at]))
        return n, places, [x for number in sorted(longest) for x in self._chain(number, longest[number])]

    def _chain(self, number: int, matches: list[tuple[int, int, list[int]]]) -> Iterable[tuple[str, int, int, float]]:
        """Spans of the heaviest chains of a template's matches (start, words, places in the template)."""
        pairs = {(start + k, place + k) for start, size, places in matches for place in places for k in range(size)}
        for start, end, weight in spans_of(pairs, self.sizes[number]):
            yield self.labels[number], start, end + 1 - start, weight / self.sizes[number]


def spans_of(pairs: set[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """(first text word, last, words) of chains that cover enough of a template, in order and apart, as heavy together as can be.

    A chain is a sequence of pairs (place in the text, place in the template) in which both rise, and no more text than the template is long
    stands between two of them; runs that do not fit in are passed over. Of equally heavy chains to a place the one that begins last
    counts, so that texts that follow one another are not mixed.
    """
    if len({p for _, p in pairs}) < LEAST_COVER * length:
        return []
    base = 1 + max(t for t, _ in pairs)  # a chain's weight and beginning in one number
    top = np.full(length, -1, np.int64)
    held: dict[int, deque[tuple[int, int]]] = {}
    order = sorted(pairs, key=lambda x: (x[0], -x[1]))
    best: dict[int, int] = {}  # for each text word the best chain that ends with it
    gone = 0
    for t, p in order:
        while order[gone][0] < t - 1 - length:  # too far away for what comes
            old, q = order[gone]
            queue = held[q]
            if queue and queue[0][0] == old:
                queue.popleft()
                top[q] = queue[0][1] if queue else -1
            gone += 1
        before = int(top[:p].max()) if p else -1
        chain = before + base if before >= 0 else base + t
        best[t] = max(best.get(t, -1), chain)
        queue = held.setdefault(p, deque())
        while queue and queue[-1][1] <= chain:
            queue.pop()
        queue.append((t, chain))
        top[p] = queue[0][1]
    return apart([(t, c % base, c // base) for t, c in sorted(best.items()) if c // base >= LEAST_COVER * length])


def apart(chains: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of chains (end, start, weight), by their ends, those that do not overlap and weigh most together, as (start, end, weight)."""
    ends, total, taken = [c[0] for c in chains], [0], []
    for end, start, weight in chains:
        before = bisect_left(ends, start)
        taken.append(total[before] + weight > total[-1])
        total.append(max(total[-1], total[before] + weight))
    out, k = [], len(chains)
    while k:
        end, start, weight = chains[k - 1]
        if taken[k - 1]:
            out.append((start, end, weight))
            k = bisect_left(ends, start)
        else:
            k -= 1
    return out[::-1]


@cache
def scanner(templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items())) -> Scanner:
    """One scanner for each Python worker and collection of (label, text)."""
    return Scanner(PHRASES, dict(templates))


PLACE = pa.struct([("label", pa.string()), ("start", pa.int64())])
SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64())])


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """For each row: key, n_words, places (each phrase found: label, start), spans (label, start, words, coverage)."""
    collection = tuple(templates.items())

    def run(batches):
        scan = scanner(collection).scan
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                found = [scan(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key),
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([[{"label": a, "start": b} for a, b in x[1]] for x in found], pa.list_(PLACE)),
                        pa.array([[dict(zip(("label", "start", "words", "coverage"), s, strict=True)) for s in x[2]] for x in found], pa.list_(SPAN)),
                    ],
                    names=[key, "n_words", "places", "spans"],
                )

    return docs.select(key, text).mapInArrow(
        run,
        f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, places array<struct<label: string, start: long>>, "
        "spans array<struct<label: string, start: long, words: long, coverage: double>>",
    )
