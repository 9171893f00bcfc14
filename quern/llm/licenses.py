"""License scans: MinHash bands over overlapping text windows, verified by shingle containment.

A template of w words is looked for in windows of w + s words, s apart, so any passage of w words
lies wholly in one window. A window that holds at least 0.8 of the template's 5-word shingles has a
Jaccard similarity with it of no less than a bound that follows from the two sizes; the number of
bands is taken so that at this bound a band collides with a probability of 0.9995 or more. Windows
with fewer shingles of templates than the smallest of their size needs are passed over, as they cannot
match. What a band retrieves is verified by counting the shingles themselves. Of matches that lie in
one of another template with more shingles only the larger is reported.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Mapping
from importlib.resources import files
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHashes, map_arrow, mix, texts
from quern.llm.decontaminate import words

SHINGLE, LEAST, ROWS, SURE = 5, 0.8, 2, 0.9995

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(license_name: str, version: str) -> str:
    """The notice that a file under a license of the GNU project has."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {license_name} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the "
        f"hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the {license_name} for more details."
    )


#: Public notices and short license texts.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_THIRD + _BSD_END,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to '
        "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE "
        "DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
        "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present "
        "and future rights to this software under copyright law."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0-header": _gnu("GNU General Public License", "2"),
    "GPL-3.0-header": _gnu("GNU General Public License", "3"),
    "LGPL-2.1-header": _gnu("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0-header": _gnu("GNU Lesser General Public License", "3"),
    "AGPL-3.0-header": _gnu("GNU Affero General Public License", "3"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def default_templates() -> dict[str, str]:
    """The notices and short licenses above, and the whole license texts of the folder ``license_texts``, by name."""
    whole = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in (files(__package__) / "license_texts").iterdir() if f.name.endswith(".txt")}
    return TEMPLATES | dict(sorted(whole.items()))


_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def window_of(n_words: int) -> tuple[int, int]:
    """Words in a window for a template of ``n_words``, and from one window to the next."""
    step = max(1, n_words // 4)
    return n_words + step, step


def bands_needed(n_words: int) -> tuple[float, int]:
    """The least Jaccard similarity of a matching window, and the bands that find it with probability SURE."""
    n = n_words - SHINGLE + 1
    held = math.ceil(LEAST * n - 1e-9)
    bound = held / (n + window_of(n_words)[0] - SHINGLE + 1 - held)
    return bound, math.ceil(math.log(1 - SURE) / math.log(1 - bound**ROWS))


def grams(ws: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(ws[i : i + SHINGLE]) for i in range(len(ws) - SHINGLE + 1)]


class Templates:
    """Templates with their bands; each has at least five words."""

    def __init__(self, named: Mapping[str, str]):
        self.hashes = WordHashes()
        split = {name: words(text.encode()) for name, text in named.items()}
        if short := [name for name, ws in split.items() if len(ws) < SHINGLE]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.sets = {name: set(grams(ws)) for name, ws in split.items()}
        self.known = np.unique(np.concatenate([self.gram_hashes(ws) for ws in split.values()]))
        self.bands = max(bands_needed(len(ws))[1] for ws in split.values())
        self.seeds = mix(np.arange(1, self.bands * ROWS + 1, dtype=np.uint64))
        self.needed: dict[tuple[int, int], int] = {}
        self.scales: dict[tuple[int, int], dict[tuple[int, int], set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, ws in split.items():
            scale = window_of(len(ws))
            for key in self.keys(self.gram_hashes(ws)):
                self.scales[scale][key].add(name)
            self.needed[scale] = min(self.needed.get(scale, 1 << 60), math.ceil(LEAST * len(self.sets[name]) - 1e-9))

    def gram_hashes(self, ws: list[bytes]) -> np.ndarray:
        h = self.hashes.of(ws)
        if len(h) < SHINGLE:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            out = mix(out) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        return mix(out)

    def keys(self, h: np.ndarray) -> list[tuple[int, int]]:
        """The band keys of a window's MinHash signature."""
        least = mix(h[None, :] ^ self.seeds[:, None]).min(axis=1).reshape(self.bands, ROWS)
        return list(enumerate((mix(least[:, 0]) ^ least[:, 1]).tolist()))

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, containment, start, end in code points) of each match; overlapping windows' matches are one."""
        ws = words(text.encode())
        h = self.gram_hashes(ws)
        if not len(h):
            return []
        near = np.searchsorted(self.known, h)
        near[near == len(self.known)] = 0
        hits = np.flatnonzero(self.known[near] == h)
        if not len(hits):
            return []
        found: dict[str, list[list]] = defaultdict(list)
        spots = [m.span() for m in _WORD.finditer(text)]
        for (width, step), index in self.scales.items():
            n = width - SHINGLE + 1
            last = max(0, -(-(len(h) - n) // step))
            starts = {k for x in hits.tolist() for k in range(max(0, -(-(x - n + 1) // step)), min(last, x // step) + 1)}
            for k in sorted(starts):
                a = k * step
                if np.searchsorted(hits, a + n) - np.searchsorted(hits, a) < self.needed[width, step]:
                    continue
                names = set().union(*(index.get(key, ()) for key in self.keys(h[a : a + n])))
                inside = grams(ws[a : a + width])
                for name in names:
                    at = [i for i, g in enumerate(inside) if g in self.sets[name]]
                    share = len({inside[i] for i in at}) / len(self.sets[name])
                    if share >= LEAST - 1e-9:
                        begin, end = spots[a + at[0]][0], spots[a + at[-1] + SHINGLE - 1][1]
                        if found[name] and begin < found[name][-1][2]:
                            old = found[name][-1]
                            old[0], old[2] = max(old[0], share), max(old[2], end)
                        else:
                            found[name].append([share, begin, end])
        return sorted(largest([(name, *x) for name, xs in found.items() for x in xs], {name: len(x) for name, x in self.sets.items()}))


def largest(matches: list[tuple[str, float, int, int]], sizes: Mapping[str, int]) -> list[tuple[str, float, int, int]]:
    """The matches that lie in no match with more shingles; those with as many are all kept."""
    by_weight: dict[int, list] = defaultdict(list)
    for m in matches:
        by_weight[round(m[1] * sizes[m[0]])].append(m)
    out, spans = [], []  # spans: of matches with more shingles, by start, with the furthest end so far
    for weight in sorted(by_weight, reverse=True):
        ends = list(accumulate((b for _, b in spans), max))
        for m in by_weight[weight]:
            k = bisect_right(spans, (m[2], math.inf))
            if not k or ends[k - 1] < m[3]:
                out.append(m)
        spans = sorted([*spans, *((m[2], m[3]) for m in by_weight[weight])])
    return out


_made: dict[int, Templates] = {}


def made_of(templates: Mapping[str, str]) -> Templates:
    """The worker's bands of the templates, made once; those of the templates asked for last are kept."""
    key = hash(tuple(sorted(templates.items())))
    if key not in _made:
        _made.clear()
        _made[key] = Templates(templates)
    return _made[key]


_MATCHES = "doc_id long, matches array<struct<template: string, containment: double, start: long, end: long, text: string>>"


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """doc_id and the license passages of every row, of :func:`default_templates` unless others are given.

    Null texts and texts of fewer than five words have none; a text of any length is scanned whole, its
    words held at once; a null doc_id stays null; repeated rows each get a row; templates that match the
    same span with as many shingles are all reported; other columns are ignored; an empty table gives no row.
    """
    templates = default_templates() if templates is None else templates
    kind = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = made_of(templates)
        for batch in batches:
            rows = [[{"template": n, "containment": c, "start": a, "end": b, "text": t[a:b]} for n, c, a, b in made.find(t)] for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, _MATCHES)
