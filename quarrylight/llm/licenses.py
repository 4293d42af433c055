"""License scans by patience alignment.

Method.  A text and a license template are sequences of words (letters and digits, lower-cased).  Alignment anchors on words that
occur exactly once in both, keeps the longest increasing subsequence of them, and aligns the gaps between
anchors in the same way; a gap without such words is matched word for word from its two ends, then by its first common word.
Coverage is the share of the template's words that are aligned.  A license is reported where coverage reaches ``COVERAGE``
and, for notices shorter than ``NOTICE_WORDS``, where the words that tell it from its siblings stand in the match: its names and version
numbers all, and no restriction (NC, ND, SA, Lesser, Affero and the like) that the template lacks.

Templates are the one-line notices, headers and short texts below and the full texts in ``license_texts``.

A text may hold a license several times, and a long text holds few unique words, so alignment runs
within windows.  A window begins at a word of the template and is ``STRETCH`` times as long as the template; only windows
that hold enough different template words can reach the coverage, which bounds it from above, so no match is lost
to this filter.  Of matches that overlap, the one with more aligned words stays, then the better covered one.

Scale.  One pass over the texts, no shuffle; templates are a small fixed table.

Defined cases: null or empty texts match nothing; repeated rows are scanned each for itself; a null doc_id is kept; further columns are ignored.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import table

COVERAGE, STRETCH = 0.8, 1.5
NOTICE_WORDS = 250

# The wording of public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-line": "Use of this source code is governed by a BSD-style license.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-line": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

_GNU = 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.'
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES |= {
    "agpl-3-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3-notice": _GNU.format(name="Affero General Public License", version="3"),
    "boost-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-disclaimer": _AS_IS,
    "bsd-released-line": "Released under the BSD License.",
    "bsd-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc0-1.0-line": "Licensed under CC0 1.0.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "gpl-2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2-notice": _GNU.format(name="General Public License", version="2"),
    "isc-line": "Released under the ISC License.",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-notice": _GNU.format(name="Lesser General Public License", version="2.1"),
    "lgpl-3-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3-notice": _GNU.format(name="Lesser General Public License", version="3"),
    "mpl-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "unlicense-line": "Released under the Unlicense.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}
TEMPLATES |= {f"cc-{kind.lower()}-{v}-line": f"Licensed under CC {kind} {v}." for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "2.5", "3.0", "4.0")}
FULL_TEXTS = "apache-2.0 artistic cc0-1.0 gfdl-1.2 gfdl-1.3 gpl-1 gpl-2 gpl-3 lgpl-2 lgpl-2.1 lgpl-3 mpl-1.1 mpl-2.0".split()
TEMPLATES |= {f"{name}-text": pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in FULL_TEXTS}

#: Words that name a license, and words that set a sibling apart.
NAMES = frozenset("affero apache boost bsd cc cc0 eclipse epl gnu isc lesser library mit mozilla mpl nc nd sa unlicense zlib".split())
RESTRICTIONS = frozenset("affero lesser nc nd noncommercial noderivatives noderivs sa sharealike".split())

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence (patience sorting)."""
    tails: list[int] = []
    tops: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        back[i] = tops[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            tops.append(i)
        else:
            tails[at], tops[at] = v, i
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (in text, in template), both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if theirs[w] == 1 and ours[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        if anchors:
            anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        else:  # no unique word: the first word of the gap's template that the text has too
            anchors = next(([(text.index(w, a, b), j)] for j, w in enumerate(template[c:d], c) if ours[w]), [])
        for i, j in anchors:
            out.append((i, j))
            todo.append((a, i, c, j))
            a, c = i + 1, j + 1
        if anchors:
            todo.append((a, b, c, d))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float, stretch: float):
        self.name, self.words = name, words(text)
        self.counts = Counter(self.words)
        self.need = -(-int(coverage * 1000) * len(self.words) // 1000)
        self.span = int(stretch * len(self.words)) + 2
        own, short = set(self.words), len(self.words) < NOTICE_WORDS
        self.names = {w for w in own if w in NAMES or w.isdigit() or w == "by" and "cc" in own} if short else set()
        self.barred = RESTRICTIONS - own if short else frozenset()

    def named(self, match: list[str]) -> bool:
        """Whether the matched words tell this license from its siblings."""
        return self.names <= (found := set(match)) and not self.barred & found

    def possible(self, text: Counter[str], n_words: int) -> bool:
        """Whether the text holds enough of the template's words, each counted as often as the template has it."""
        return n_words >= self.need and sum(min(n, text[w]) for w, n in self.counts.items()) >= self.need

    def windows(self, text: list[str]) -> Iterator[tuple[int, int, int]]:
        """Maximal-count windows [a, b), with their count, in which enough of the template's words occur, each counted as often as the template has it."""
        hits = [i for i, w in enumerate(text) if w in self.counts]
        held: Counter[str] = Counter()
        useful = end = 0
        for k, a in enumerate(hits):
            while end < len(hits) and hits[end] < a + self.span:
                w = text[hits[end]]
                held[w] += 1
                useful += held[w] <= self.counts[w]
                end += 1
            if useful >= self.need:
                yield a, hits[end - 1] + 1, useful
            useful -= held[text[a]] <= self.counts[text[a]]
            held[text[a]] -= 1

    def find(self, text: list[str], fit: Callable[[list[str]], bool] | None = None) -> list[tuple[int, int, int]]:
        """Matches (aligned words, first word, end) that fit, not overlapping, the better first among overlapping windows."""
        found: list[tuple[int, int, int]] = []
        for a, b, useful in self.windows(text):
            if found and a < found[-1][2] and useful <= found[-1][0]:
                continue  # no better match begins here, and one behind the last has a window of its own
            pairs = align(text[a:b], self.words)
            if len(pairs) < self.need:
                continue
            match = (len(pairs), a + pairs[0][0], a + pairs[-1][0] + 1)
            if fit and not fit(text[match[1] : match[2]]):
                continue
            if found and match[1] < found[-1][2]:
                if match[0] > found[-1][0]:
                    found[-1] = match
            else:
                found.append(match)
        return found


def _scan(templates: dict[str, str], coverage: float, stretch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(n, t, coverage, stretch) for n, t in sorted(templates.items())]
        distinct = [(t, frozenset(t.words), t.need - len(t.words) + len(t.counts)) for t in known]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py() or "")
                own = Counter(found)
                words_of = own.keys()
                likely = [t for t, their, least in distinct if len(found) >= t.need and t.names <= words_of and len(their & words_of) >= least and t.possible(own, len(found))]
                matches = [(n, n / len(t.words), t.name, a, b) for t in likely for n, a, b in t.find(found, t.named)]
                kept: list[tuple] = []
                for m in sorted(matches, key=lambda m: (-m[0], -m[1], m[2], m[3])):
                    if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
                        kept.append(m)
                rows += [(doc, name, i, share, a, b - a) for i, (_, share, name, a, b) in enumerate(sorted(kept, key=lambda m: m[3]), 1)]
            types = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], ["doc_id", "license", "occurrence", "coverage", "first_word", "n_words"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, stretch: float = STRETCH) -> DataFrame:
    """doc_id, license, occurrence, coverage, first_word, n_words for every license notice in the documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates, coverage, stretch), "doc_id long, license string, occurrence int, coverage double, first_word long, n_words long")


def op1_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op1_patience_licenses": op1_patience_licenses}
SQL: dict[str, str] = {}
