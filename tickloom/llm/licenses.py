"""License scans by patience alignment.

A text and a license template are word sequences. Alignment anchors on the words that occur exactly once in
both, keeps the longest increasing subsequence of them, and goes on recursively in the gaps between anchors
(equal words at either end of a gap are matched first). Coverage is the share of the template's words that are
matched, density the share of matched words in the stretch of text they span.

Whole texts are scanned: adjacent word pairs of a template that stand next to each other in the text are seeds,
and seeds on one diagonal (text position minus template position, give or take what a match may insert or leave out)
mark a stretch to align. A stretch is aligned if it has as many seeds as any match with ``coverage`` and ``density``
must have, so the seeds lose nothing: of m matched words at most m / density - m gaps hold other words and at
most (1 - coverage) of the template's words are skipped, and all other neighbours are seeds. Copies that stand
close to each other have no word that is unique to their stretch, so it is also read in overlapping windows that
hold at most one whole copy; of overlapping matches the one with the highest coverage counts.

Defined cases: null, empty and wordless texts have no match; every occurrence of a template is a row; where
matches of several templates overlap, all of them are given; repeated rows are each scanned; null ids stay null;
extra columns are not looked at. Scanning is map-only; the templates are a fixed list.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, raw, slices
from .wordhash import words

# Public license notices and license texts, as their authors give them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "This project is licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
_FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def fold(text: bytes) -> bytes:
    """Same length; A-Z are lower-cased by ``words``, other ASCII but letters and digits become spaces."""
    return text.translate(_FOLD)


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by piles."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(piles[at - 1] if at else -1)
        tops[at : at + 1], piles[at : at + 1] = [v], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two sequences, in order. A stack stands for the recursion."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        once = [(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in where]
        anchors = [once[i] for i in increasing([j for _, j in once])]
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if anchors:
                todo.append((i + 1, k, j + 1, m))
        out += anchors
    return sorted(out)


class Templates:
    """Templates as word numbers, and their seeds: pairs of neighbours."""

    def __init__(self, texts: dict[str, str], coverage: float, density: float):
        self.names, self.coverage, self.density = sorted(texts), coverage, density
        folded = [words(fold(texts[n].encode()))[2] for n in self.names]
        self.vocabulary = np.unique(np.concatenate(folded))
        self.words = [np.searchsorted(self.vocabulary, h).tolist() for h in folded]
        self.size = np.array([len(w) for w in self.words])
        m = np.ceil(coverage * self.size)
        self.need = np.maximum(m - 1 - np.floor(m / density - m) - (self.size - m), 1).astype(int)
        # How far the diagonal can move within a match: words put in and words left out.
        self.slack = (np.floor(m / density - m) + self.size - m).astype(int)
        seeds = sorted((w[i] * len(self.vocabulary) + w[i + 1], t, i) for t, w in enumerate(self.words) for i in range(len(w) - 1))
        self.pair, self.of, self.at = (np.array(c) for c in zip(*seeds, strict=True))

    def stretches(self, word: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Template, first and last word to align, for word numbers (-1: in no template) of some texts."""
        near = (word[:-1] >= 0) & (word[1:] >= 0) & (owner[:-1] == owner[1:])
        place = np.flatnonzero(near)
        code = word[place] * len(self.vocabulary) + word[place + 1]
        low, high = np.searchsorted(self.pair, code), np.searchsorted(self.pair, code, side="right")
        count = high - low
        place = np.repeat(place, count)
        seed = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        template, diagonal = self.of[seed], place - self.at[seed]
        text = owner[place]
        order = np.lexsort((diagonal, template, text))
        template, diagonal, text, place, at = template[order], diagonal[order], text[order], place[order], self.at[seed][order]
        if not len(template):
            return
        new = (template[1:] != template[:-1]) | (text[1:] != text[:-1]) | (np.diff(diagonal) > self.slack[template[1:]])
        begin = np.concatenate(([0], np.flatnonzero(new) + 1))
        stop = np.append(begin[1:], len(template))
        bounds = np.searchsorted(owner, text[begin]), np.searchsorted(owner, text[begin], side="right")
        for i, j, lo, hi in zip(begin, stop, *bounds, strict=True):
            t = template[i]
            if j - i >= self.need[t]:
                # A chain of seeds longer than two templates holds several occurrences: one stretch for each.
                step = max(int(self.size[t]), 1)
                for d in range(diagonal[i], diagonal[j - 1] + 1, step):
                    last = min(d + step - 1, diagonal[j - 1])
                    yield int(t), max(int(d - self.slack[t]), int(lo)), min(int(last + self.size[t] + self.slack[t]), int(hi))
                for a, b in self.windows(t, place[i:j], at[i:j]):
                    yield int(t), max(a, int(lo)), min(b, int(hi))

    def windows(self, t: int, place: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Windows too short for two whole occurrences, one of which holds any match whole: neighbours can't hide it.

        They begin every eighth of a template, and hold as many different seeds as a match must have.
        """
        span, step = int(self.size[t] / self.density), max(int(self.size[t]) // 8, 1)
        base, blocks = int(place.min()) - span, -(-span // step) + 1
        block = (place - base) // step
        has = np.zeros((int(block.max()) + blocks, self.size[t]), dtype=bool)
        has[block, at] = True
        held = has[: len(has) - blocks + 1].copy()
        for k in range(1, blocks):
            held |= has[k : k + len(held)]
        starts = np.flatnonzero(held.sum(axis=1) >= self.need[t])
        return [(a, a + blocks * step) for a in (base + starts * step).tolist()]

    def match(self, t: int, word: list[int]) -> tuple[float, int, int] | None:
        """Coverage, first and end word of a template's best match in a stretch, if it is one."""
        pairs = patience(word, self.words[t])
        # Words far from the rest don't belong to the match: the densest run of pairs counts.
        while pairs:
            first, last = pairs[0][0], pairs[-1][0] + 1
            if len(pairs) < self.coverage * self.size[t]:
                return None
            if len(pairs) >= self.density * (last - first):
                return len(pairs) / float(self.size[t]), first, last
            pairs = pairs[1:] if len(pairs) == 1 or pairs[1][0] - pairs[0][0] >= pairs[-1][0] - pairs[-2][0] else pairs[:-1]
        return None


def find(word: np.ndarray, owner: np.ndarray, templates: Templates) -> list[tuple[int, int, float, int, int]]:
    """Text, template, coverage, first and end word of every match; of overlapping stretches the best one."""
    found = []
    for t, a, b in templates.stretches(word, owner):
        m = templates.match(t, word[a:b].tolist())
        if m:
            found.append((int(owner[a + m[1]]), t, m[0], a + m[1], a + m[2]))
    out: list[tuple[int, int, float, int, int]] = []
    kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x in sorted(set(found), key=lambda x: (x[0], x[1], -x[2], x[4] - x[3], x[3])):
        spans = kept.setdefault(x[:2], [])  # apart from each other and in order
        i = bisect_left(spans, (x[3], x[4]))
        if (i == 0 or spans[i - 1][1] <= x[3]) and (i == len(spans) or spans[i][0] >= x[4]):
            spans.insert(i, (x[3], x[4]))
            out.append(x)
    return sorted(out, key=lambda x: (x[0], x[3], x[1]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = 0.8, density: float = 0.75, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage, and the character offsets of every match."""
    templates = Templates(texts or TEMPLATES, coverage, density)
    schema = StructType().add("doc_id", docs.schema[doc_id].dataType).add("license", "string").add("coverage", "double").add("start", "integer").add("end", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, data = batch.column(0).slice(a, b - a), [x or b"" for x in raw(batch.column(1).slice(a, b - a))]
                ends = np.cumsum([len(x) + 1 for x in data])
                first, stop, hashes = words(fold(b" ".join(data)))
                owner = np.searchsorted(ends, first, side="right")
                at = np.minimum(np.searchsorted(templates.vocabulary, hashes), len(templates.vocabulary) - 1)
                word = np.where(templates.vocabulary[at] == hashes, at, -1)
                rows = find(word, owner, templates)
                begin = [int(ends[r[0]]) - len(data[r[0]]) - 1 for r in rows]
                place = lambda r, at, low: len(data[r[0]][: at - low].decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([templates.names[r[1]] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([place(r, int(first[r[3]]), x) for r, x in zip(rows, begin, strict=True)], pa.int32()),
                        pa.array([place(r, int(stop[r[4] - 1]), x) for r, x in zip(rows, begin, strict=True)], pa.int32()),
                    ],
                    names=schema.names,
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), schema)
