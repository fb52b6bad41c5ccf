"""License scans (operator 9).

Two kinds of evidence. Base: places where a phrase's words stand consecutively.
Method: an exact set-similarity join between text blocks and license templates.
A block is any window of consecutive words, ``slack`` percent longer than the template;
a template is found in a block that holds at least ``percent`` of the
template's distinct words. Words are ordered by their frequency in the whole
corpus, rarest first, and of a block only words of some template count: no other can match. A block that meets
the threshold holds one of the template's first n - ceil(percent * n) + 1 words (prefix filter), so only
stretches around such words are looked at. A stretch must have at least ceil(percent * n) words of templates (length filter).
Then both sets are walked through in the global order: once the words in common and
the fewer of the words left in either can't reach the threshold, the pair is given up (positional filter).
What passes is verified window by window, so no block is missed, wherever it begins.

Score: the highest containment of any template found; 1 where a base
phrase stands. Labels: the base labels, and those of the templates found.

Defined results. Null and empty texts have no words and no labels (empty
strings), score 0. Repeated rows are judged one by one; other columns are not
looked at. Equally frequent words are ordered by the words themselves. Texts of any length are scanned whole.

Scale: templates are a parameter of bounded size and their frequency table has
a row per template word, so both go to the tasks. Two passes over the text, no
shuffle but for those few counts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, binaries, folded_words

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Usual notices, and texts of public licenses from the first sentence of terms on, with the method's labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
        A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
        OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
]
PERCENT, SLACK = 90, 25


def template_sets(templates) -> list[tuple[str, list[bytes], int]]:
    """Label, distinct words and number of words of each template."""
    listed = [(label, folded_words(text.encode())) for label, text in templates]
    return [(label, sorted(set(words)), len(words)) for label, words in listed]


def needed(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


def block_words(n: int, slack: int) -> int:
    """Words of a block for a template of ``n`` words."""
    return n + (slack * n + 99) // 100


class Index:
    """Templates as sets of word numbers; numbers are the global order, rarest first."""

    def __init__(self, templates, frequency: dict[bytes, int], percent: int, slack: int):
        sets = template_sets(templates)
        universe = sorted({w for _, words, _ in sets for w in words}, key=lambda w: (frequency.get(w, 0), w))
        self.number = {w: k for k, w in enumerate(universe)}
        self.label = [label for label, _, _ in sets]
        self.sets = [sorted(self.number[w] for w in words) for _, words, _ in sets]
        self.least = [needed(len(s), percent) for s in self.sets]
        self.size = [block_words(n, slack) for _, _, n in sets]
        self.prefix: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            for k in s[: len(s) - self.least[t] + 1]:
                self.prefix.setdefault(k, []).append(t)
        #: stretches that reached each step
        self.reached = {"prefix": 0, "length": 0, "positional": 0, "found": 0}

    def overlap(self, t: int, block: list[int]) -> bool:
        """Whether a block's words, in the global order, can hold enough of the template; given up as soon as positions rule it out."""
        template, least = self.sets[t], self.least[t]
        i = j = met = 0
        while met < least:
            if met + min(len(template) - i, len(block) - j) < least:
                return False
            if template[i] == block[j]:
                met, i, j = met + 1, i + 1, j + 1
            elif template[i] < block[j]:
                i += 1
            else:
                j += 1
        return True

    def best(self, t: int, hits: list[tuple[int, int]]) -> tuple[int, int]:
        """Most distinct words of the template in any of its blocks, and where the first such block's first word of the template stands."""
        held: dict[int, int] = {}
        most, at, first = 0, 0, 0
        for place, k in hits:
            held[k] = held.get(k, 0) + 1
            while hits[first][0] <= place - self.size[t]:
                out = hits[first][1]
                held[out] -= 1
                if not held[out]:
                    del held[out]
                first += 1
            if len(held) > most:
                most, at = len(held), hits[first][0]
        return most, at

    def blocks(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, first word, words in common) of the best block of every stretch that holds one."""
        number = self.number
        hits = [(i, number[w]) for i, w in enumerate(words) if w in number]
        around: dict[int, list[int]] = {}
        for i, k in hits:
            for t in self.prefix.get(k, ()):
                around.setdefault(t, []).append(i)
        if not around:
            return
        places = [i for i, _ in hits]
        for t, starts in around.items():
            reach, own = self.size[t] - 1, frozenset(self.sets[t])
            k = 0
            while k < len(starts):
                low, high = starts[k] - reach, starts[k] + reach
                while k < len(starts) and starts[k] - reach <= high:
                    high = starts[k] + reach
                    k += 1
                a, b = bisect_left(places, low), bisect_right(places, high)
                self.reached["prefix"] += 1
                if b - a < self.least[t]:
                    continue
                self.reached["length"] += 1
                if not self.overlap(t, sorted({n for _, n in hits[a:b]})):
                    continue
                self.reached["positional"] += 1
                common, at = self.best(t, [h for h in hits[a:b] if h[1] in own])
                if common >= self.least[t]:
                    self.reached["found"] += 1
                    yield t, at, common


def phrase_places(words: list[bytes], phrases: list[list[bytes]]) -> list[tuple[int, int]]:
    """(place, phrase) of every occurrence; places of phrases may coincide."""
    first: dict[bytes, list[int]] = {}
    for k, phrase in enumerate(phrases):
        first.setdefault(phrase[0], []).append(k)
    return [(i, k) for i, w in enumerate(words) if w in first for k in first[w] if words[i : i + len(phrases[k])] == phrases[k]]


def _frequencies(vocabulary: frozenset[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}
    for batch in batches:
        for text in binaries(batch, "text"):
            for w in vocabulary.intersection(folded_words(text)):
                counts[w] = counts.get(w, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def scan(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, percent: int = PERCENT, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score and the blocks found."""
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    vocabulary = frozenset(w for _, words, _ in template_sets(templates) for w in words)
    counted = arrow_map(texts.select("text"), partial(_frequencies, vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    index = Index(templates, {bytes(r[0]): r[1] for r in counted.collect()}, percent, slack)  # a row per template word at most
    listed = [folded_words(p.encode()) for p in phrases]
    names = list(phrases.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("label", pa.string()), ("from_word", pa.int64()), ("containment", pa.float64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), block]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for text in binaries(batch, "text"):
                words = folded_words(text)
                places = phrase_places(words, listed)
                base = {names[k] for _, k in places}
                blocks = [{"label": index.label[t], "from_word": at, "containment": common / len(index.sets[t])} for t, at, common in index.blocks(words)]
                at = [i for i, _ in places]
                row = (
                    len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {b["label"] for b in blocks})),
                    1.0 if base else max((b["containment"] for b in blocks), default=0.0), blocks,
                )
                for col, value in zip(out, row, strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[batch.schema.field(0).name, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(texts, run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,from_word:long,containment:double>>")
