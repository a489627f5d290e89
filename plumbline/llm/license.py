"""License scans by conditional compression.

A template may differ from the text in a share of at most EDITS of its words
(insertions, deletions and replacements; a slot such as <holder> stands for any
words). Cut into one run more than it may have edits, it must have one of its runs
word by word in the text, wherever its lines break: this loses no match. The
candidate blocks are the words about such runs, as long as the template with its
edits; for a template with a slot they reach to the ends of the run's line at least.
In a block the part that differs least is aligned with the template, then the words
on both sides of it are looked at again; a part with at most EDITS goes on. Other words
beside a wording would dilute its reduction, so a block is cut to the aligned part
before it is compressed with the template as zstandard raw dictionary. The bytes that
this saves, against compressing it alone, rank the templates (ties: the smaller share
of edits, then the first). Down the ranking, each holds its words once its exact wording
confirms it, and those that overlap it go. The wording does not confirm a part where an
overlapping one is plainly closer, with fewer edits whose words all differ in this one
too: that one holds the words instead. Sizes are some bytes off, as much as the one word
between two licenses of a family. No least reduction is asked for: what overlaps no
better one stays, however little it saves. The reduction told is the share saved.

Every word of every document is looked at. Defined results: null or empty text, no
row. A wording that occurs again in a document holds its words there too, and gives
one row, its place with the smallest share of edits (first on ties). Repeated rows
each give theirs; an empty table gives none.
"""

from __future__ import annotations

import difflib
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import bounded, column, documents

ORACLE_SQL = None
EDITS, LEVEL = 0.15, 3
SLOT = "<>"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = _BSD2 + """ 3. Neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."""

#: (license, template): public wordings, long and short.
TEMPLATES = [
    ("MIT", _MIT),
    ("BSD-2-Clause", _BSD2),
    ("BSD-3-Clause", _BSD3),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", _GPL.format("General Public License", "3")),
    ("GPL-2.0", _GPL.format("General Public License", "2")),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", "3")),
    ("AGPL-3.0", _GPL.format("Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, <> has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "Copyright (c) <> All rights reserved."),
]
_WORD = re.compile(r"<>|\w+(?:[.\-]\w+)*")
_LINE = re.compile(r"\r\n|\r|\n")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def aligned(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """(edits, start, end) of the part of block that differs least from template, the first and then the shortest."""
    n = len(block)
    row = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    index = np.arange(n + 1)
    numbers = {w: k for k, w in enumerate(dict.fromkeys(block))}
    codes = np.array([numbers[w] for w in block], np.int64)
    # (edits, start) in one number: the least edits, and of these the latest start, which is the shortest part
    key = row * (n + 1) + (n - start)
    step = n + 1
    for w in template:
        same = np.ones(n, bool) if w == SLOT else codes == numbers.get(w, -1)
        new = np.empty_like(key)
        new[0] = key[0] + (0 if w == SLOT else step)
        new[1:] = np.minimum(key[1:] + (0 if w == SLOT else step), key[:-1] + np.where(same, 0, step))
        # insertions of block words; a slot takes any number of them
        price = 0 if w == SLOT else step
        key = np.minimum.accumulate(new - index * price) + index * price
    edits = key // step
    end = int(np.argmin(edits))
    return int(edits[end]), int(n - key[end] % step), end


def differences(template: list[str], part: list[str]) -> str:
    out = []
    for what, a, b, c, d in difflib.SequenceMatcher(None, template, part, autojunk=False).get_opcodes():
        if what != "equal" and template[a:b] != [SLOT]:
            out.append({"template": " ".join(template[a:b]), "text": " ".join(part[c:d])})
    return json.dumps(out, ensure_ascii=False)


def runs_of(template: list[str], edits: int) -> list[tuple[int, list[str]]]:
    """(place, words) of runs without slots, one more than edits at least, as long as they can be."""
    cuts = [-1, *(k for k, w in enumerate(template) if w == SLOT), len(template)]
    pieces = [(a + 1, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    n = next((n for n in range(len(template), 0, -1) if sum((b - a) // n for a, b in pieces) > edits), 0)
    return [(k, template[k : k + n]) for a, b in pieces for k in range(a, b - n + 1, n)] if n else []


class Part(NamedTuple):
    """The words start to end of a text, aligned with a template."""

    template: int
    start: int
    end: int
    edits: int
    reduction: float


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.templates = []
        self.bags: list[Counter] = []
        #: by a word of the run: (run, the word's place in it, template, the run's place in that)
        self.runs: dict[str, list[tuple[list[str], int, int, int]]] = {}
        for k, (name, text) in enumerate(templates):
            t = words(text)
            data = zstandard.ZstdCompressionDict(" ".join(t).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            edits = int(EDITS * len(t) + 1e-9)
            self.bags.append(Counter(w for w in t if w != SLOT))
            self.templates.append((name, t, zstandard.ZstdCompressor(level=LEVEL, dict_data=data), edits))
            for place, run in runs_of(t, edits):
                rare = max(run, key=len)
                self.runs.setdefault(rare, []).append((run, run.index(rare), k, place))

    def hits(self, text: list[str]) -> dict[int, list[tuple[int, int]]]:
        """By template: (place in the text, place in the template) of each run."""
        out: dict[int, list[tuple[int, int]]] = {}
        for at in [k for k, w in enumerate(text) if w in self.runs]:
            for run, x, k, place in self.runs[text[at]]:
                if at >= x and text[at - x : at - x + len(run)] == run:
                    out.setdefault(k, []).append((at - x, place))
        return out

    def reduction(self, k: int, part: list[str]) -> tuple[int, float]:
        """The bytes that the template saves as a dictionary of the part, and their share of the part compressed alone."""
        data = " ".join(part).encode()
        alone, given = len(self.alone.compress(data)), len(self.templates[k][2].compress(data))
        return alone - given, 1 - given / alone

    def ranked(self, found: list[tuple[int, int, int, int]], text: list[str]) -> list[Part]:
        """The aligned parts (template, start, end, edits), those that save the most bytes first."""
        out = []
        for k, start, end, edits in found:
            saved, reduction = self.reduction(k, text[start:end])
            out.append((-saved, edits / len(self.templates[k][1]), start, Part(k, start, end, edits, reduction)))
        return [x[3] for x in sorted(out)]

    def closer(self, a: Part, b: Part, both: Counter) -> bool:
        """Whether a has fewer edits than b, all of whose words differ in b too; both: the words that they cover, counted."""
        s, t = self.bags[a.template], self.bags[b.template]
        return a.edits < b.edits and all(
            max(s[w] - both[w], 0) <= max(t[w] - both[w], 0) and max(both[w] - s[w], 0) <= max(both[w] - t[w], 0) for w in s.keys() | t.keys()
        )

    def closest(self, x: Part, rivals: list[Part], text: list[str]) -> Part | None:
        """Of rivals the one with the fewest edits that is closer than x, if any."""
        counted: dict[tuple[int, int], Counter] = {}
        for y in sorted(rivals, key=lambda y: y.edits):
            if y.edits >= x.edits:
                break
            place = min(x.start, y.start), max(x.end, y.end)
            if place not in counted:
                counted[place] = Counter(text[slice(*place)])
            if self.closer(y, x, counted[place]):
                return y
        return None

    def held(self, found: list[tuple[int, int, int, int]], text: list[str]) -> list[Part]:
        """Down the ranking, the parts that hold their words."""
        ranked = self.ranked(found, text)
        # parts of one template don't overlap: their starts and their ends are in order
        by: dict[int, list[Part]] = {}
        for x in sorted(ranked, key=lambda x: x.start):
            by.setdefault(x.template, []).append(x)
        taken, out = bytearray(len(text)), []
        free = lambda x: taken.find(1, x.start, x.end) < 0

        def rivals(x: Part) -> list[Part]:
            if not x.edits:
                return []
            spans = [parts[bisect_right(parts, x.start, key=lambda y: y.end) : bisect_left(parts, x.end, key=lambda y: y.start)] for parts in by.values()]
            return [y for parts in spans for y in parts if y is not x and free(y)]

        for x in ranked:
            if free(x):
                while y := self.closest(x, rivals(x), text):
                    x = y
                taken[x.start : x.end] = b"\1" * (x.end - x.start)
                out.append(x)
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, float, int, float, str]]:
        """(license, template, line, reduction, edits, share of edits, differences) of each confirmed wording."""
        all_ = words(text)
        if not (hits := self.hits(all_)):
            return []
        # where each line's words start, and the end
        first = [0, *accumulate(len(words(x)) for x in _LINE.split(text))]
        line = lambda at: bisect_right(first, at) - 1
        found: list[tuple] = []
        for k, places in hits.items():
            _, t, _, most = self.templates[k]
            blocks: list[list[int]] = []
            if SLOT in t:
                reach = len(t) * 5 // 4 + 8
                spans = sorted((min(first[line(at)], at - reach), max(first[line(at) + 1], at + reach)) for at, _ in places)
            else:
                spans = sorted((at - place - most, at - place + len(t) + most) for at, place in places)
            for low, high in spans:
                low, high = max(low, 0), min(high, len(all_))
                if blocks and low < blocks[-1][1]:
                    blocks[-1][1] = max(blocks[-1][1], high)
                else:
                    blocks.append([low, high])
            while blocks:
                low, high = blocks.pop()
                if high - low < sum(w != SLOT for w in t) - most:
                    continue
                edits, a, b = aligned(t, all_[low:high])
                if b > a and edits <= most:
                    found.append((k, low + a, low + b, edits))
                    blocks += [[low, low + a], [low + b, high]]
        best: dict[int, Part] = {}
        for x in self.held(found, all_):
            best[x.template] = min(best.get(x.template, x), x, key=lambda x: (x.edits, x.start))
        out = []
        for k, start, end, edits, reduction in best.values():
            name, t, _, _ = self.templates[k]
            out.append((name, k, line(start) + 1, reduction, edits, edits / len(t), differences(t, all_[start:end])))
        return sorted(out, key=lambda x: (x[2], x[1]))


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, template (its number), line, reduction, edits, share and
    differences (JSON) of each confirmed wording of each document."""
    wanted = TEMPLATES if templates is None else templates

    def scan(batches):
        scanner = Scanner(wanted)
        names = ["license", "template", "line", "reduction", "edits", "share", "differences"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.string()]
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(column(batch, "text").to_pylist()):
                for row in scanner.scan(text or ""):
                    at.append(k)
                    rows.append(row)
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(at)), *[pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("text IS NOT NULL").select("doc_id", "text")
    return bounded(rows).mapInArrow(scan, f"doc_id {kind}, license string, template int, line int, reduction double, edits int, share double, differences string")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))
