"""License scans: anchor words of templates in an inverted index, banded alignment at every offset that can match."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import table

#: Half width of the alignment band, least share of a template's words that must match.
BAND, LEAST_COVERAGE = 8, 0.8
#: Words of little use as anchors, offsets that are counted at once.
_COMMON, _PART = frozenset("a and any are be by can distributed for form free from in into is it not of on or that the this to under use version with without work you was at do all no nor may such".split()), 50_000

#: Elements of a Creative Commons license: short and long form.
_ELEMENTS = {"NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
#: Words that make another license of one: a match may not pass over one that its template lacks.
QUALIFIERS = frozenset("nc sa nd noncommercial sharealike noderivatives noderivs lesser library affero".split())


def _creative_commons() -> list[tuple[str, str, str]]:
    """The notices of the six licenses in their versions, long and short."""
    out = []
    for version, place in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        for elements in ((), ("NC",), ("SA",), ("ND",), ("NC", "SA"), ("NC", "ND")):
            name = "-".join(("CC-BY", *elements, version))
            long = "-".join(("Attribution", *(_ELEMENTS[e] for e in elements)))
            out.append((name, f"This work is licensed under a Creative Commons {long} {version} {place} License.", f"{long} {version}"))
            out.append((name, f"Creative Commons {long} {version}", f"{long} {version}"))
            out.append((name, f"Licensed under CC {'-'.join(('BY', *elements))} {version}.", f"CC {'-'.join(('BY', *elements))} {version}"))
    return out


def _gnu() -> list[tuple[str, str, str]]:
    """The notices of the GNU licenses by version, alone or with any later one."""
    out = []
    for short, long, versions in (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",))):
        for v in versions:
            name, decide = f"{short}-{v if '.' in v else v + '.0'}", f"{long} {v}"
            out.append((name, f"This work is licensed under the GNU {long}, version {v}.", decide))
            out.append((name, f"Licensed under the {short} version {v}.", f"{short} {v}"))
            grant = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {long} as published by the Free Software Foundation, "
            out.append((name, grant + f"version {v} of the License.", decide))
            out.append((f"{name}-or-later", grant + f"either version {v} of the License, or (at your option) any later version.", f"{decide} either later"))
    return out


_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)

#: Public license texts and notices, (license, text, words that a match must hold each time the text does).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "Apache 2.0"),
    ("MIT", "Released under the MIT License.", "MIT"),
    ("MIT", "Licensed under the MIT License.", "MIT"),
    *_gnu(),
    *_creative_commons(),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived"),
    ("CC0-1.0", "Licensed under CC0 1.0.", "CC0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.", "Eclipse 2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache 2.0",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "sublicense",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "sublicense",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ""),
    ("BSD-2-Clause", _BSD + _AS_IS, ""),
    ("BSD-3-Clause", _BSD + _NAMES + _AS_IS, "neither endorse promote"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ""),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "BSD 2"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "BSD 3"),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        "",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
        "organization transmit",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
        "unencumbered",
    ),
)

_WORD = re.compile(r"[a-z0-9]+")


def _lower(text: str) -> str:
    """Lower case of A-Z alone, so that offsets stay."""
    return text.lower() if text.isascii() else text.translate(_ASCII)


_ASCII = {c: c + 32 for c in range(65, 91)}


class Index:
    """Fingerprints of the templates in an inverted index: word ids, and for each anchor word its (template, position) pairs.

    Fingerprints are of one word, since a longer one is broken by any inserted word; winnowing keeps the fewest that every
    match needs. A match misses at most len - ceil(LEAST_COVERAGE len) words of its template, so it holds one of any more positions:
    those are its anchors, the words rarest among the templates first.
    """

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _, _ in templates]
        self.words: dict[str, int] = {w: i for i, w in enumerate(sorted(QUALIFIERS), 1)}
        split = [_WORD.findall(_lower(text)) for _, text, _ in templates]
        self.ids = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in ws]) for ws in split]
        needed = [set(_WORD.findall(_lower(decide))) for _, _, decide in templates]
        self.decides = [np.array([w in d for w in ws]) for ws, d in zip(split, needed)]
        # of a qualifier that a text lacks, every occurrence in a span speaks against it
        self.against = [set(range(1, len(QUALIFIERS) + 1)) - set(ids.tolist()) for ids in self.ids]
        self.least = [next(n for n in range(len(ws) + 1) if n >= LEAST_COVERAGE * len(ws)) for ws in split]
        self.at: dict[int, list[tuple[int, int]]] = {}
        spread = Counter(w for ws in split for w in set(ws))
        for t, ws in enumerate(split):
            rare = sorted(range(len(ws)), key=lambda p: (ws[p] in _COMMON or ws[p].isdigit(), spread[ws[p]], -len(ws[p]), p))
            for p in rare[: len(ws) - self.least[t] + 1]:
                self.at.setdefault(self.words[ws[p]], []).append((t, p))
        self.anchors = np.zeros(len(self.words) + 1, bool)
        self.anchors[list(self.at)] = True

    def near(self, words: np.ndarray) -> list[int]:
        """The templates that hold some of these anchor words."""
        return sorted({t for w in words.tolist() for t, _ in self.at[w]})

    def offsets(self, t: int, diagonals: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The offsets within BAND of a diagonal at which enough template words, and all that decide, occur within the band."""
        ids = self.ids[t]
        near = np.unique(diagonals[:, None] + np.arange(-BAND, BAND + 1)[None, :])
        pad = len(ids) + 3 * BAND
        padded = np.concatenate((np.zeros(pad, np.int64), doc, np.zeros(pad, np.int64)))
        kept = []
        for part in np.split(near, range(_PART, len(near), _PART)):
            n, all_decide = np.zeros(len(part), np.int64), np.ones(len(part), bool)
            for i, w in enumerate(ids.tolist()):
                here = (padded[part[:, None] + (i + pad - BAND) + np.arange(2 * BAND + 1)[None, :]] == w).any(axis=1)
                n += here
                if self.decides[t][i]:
                    all_decide &= here
            kept.append(part[all_decide & (n >= self.least[t])])
        return np.concatenate(kept)


_NEVER = 10**6


def align(template: np.ndarray, doc: np.ndarray, offset: int, decides: np.ndarray | None = None) -> tuple[int, int, int]:
    """Best alignment within BAND of the diagonal doc = template + offset: (matched words, first, last doc word).

    A match counts 100; a word passed over on either side, a mismatch and a step off the diagonal at the start cost 1,
    so of alignments with as many matches the straightest wins. If a word that decides has no match, nothing matches.
    """
    needed = [False] * len(template) if decides is None else decides.tolist()
    width = 2 * BAND + 1
    none = (-(10**9), 0, -1, -1)
    # a cell holds (score, matched, first, last) for template words so far and column k: doc word i + offset - BAND + k
    best = [*((-abs(k - BAND), 0, -1, -1) for k in range(width)), none]
    for i, w in enumerate(template.tolist()):
        row, left, cost = [none] * (width + 1), none, _NEVER if needed[i] else 1
        for k in range(width):
            j = i + offset - BAND + k
            score, n, first, last = best[k]
            here = (score + 100, n + 1, first if n else j, j) if 0 <= j < len(doc) and doc[j] == w else (score - cost, n, first, last)
            above = best[k + 1]
            row[k] = left = max(here, (above[0] - cost, *above[1:]), (left[0] - 1, *left[1:]))
        best = row
    found = max(best)
    return found[1:] if found[0] > -_NEVER // 2 else (0, -1, -1)


def scan(text: str, index: Index) -> list[tuple]:
    """(license, template, coverage, matched, start, end) of a whole text, offsets in code points.

    Templates are rivals: of matches that overlap the one with most words counts, then the one that covers its template best,
    then the tightest. A template's deciding words must match, and no qualifier that it lacks may lie in the span.
    """
    low = _lower(text)
    get = index.words.get
    ids = np.array([get(w, 0) for w in _WORD.findall(low)], np.int64)
    hits = np.flatnonzero(index.anchors[ids])
    if not len(hits):
        return []
    present = np.zeros(len(index.words) + 1, bool)
    present[ids[ids > 0]] = True
    possible = [t for t in index.near(np.unique(ids[hits])) if present[index.ids[t]].sum() >= index.least[t] and present[index.ids[t][index.decides[t]]].all()]
    if not possible:
        return []
    by_template: dict[int, list[int]] = {t: [] for t in possible}
    for j in hits.tolist():
        for t, p in index.at[int(ids[j])]:
            if t in by_template:
                by_template[t].append(j - p)
    found = set()
    for t, diagonals in by_template.items():
        for offset in index.offsets(t, np.array(diagonals), ids).tolist():
            n, first, last = align(index.ids[t], ids, offset, index.decides[t])
            if n >= index.least[t] and not index.against[t].intersection(ids[first : last + 1].tolist()):
                found.add((n, n / len(index.ids[t]), t, first, last))
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(low)]
    kept: list[tuple] = []
    taken: list[tuple[int, int]] = []
    for n, share, t, first, last in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4] - f[3], f[3])):
        if all(last < a or b < first for a, b in taken):
            taken.append((first, last))
            kept.append((index.names[t], t, share, n, spans[first][0], spans[last][1]))
    return sorted(kept, key=lambda k: k[4])


def matches(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each match in a whole text: doc_id, license, template, coverage, matched_words, start, end (code points).

    Null and empty texts have no match. A null doc_id stays null, repeated rows repeat their matches, an empty table
    gives no rows, other columns are ignored; ties between templates go to the first listed. Texts of any length are read
    whole. The index holds the templates alone; no shuffle.
    """
    index = index or Index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1)) if t.is_valid for m in scan(t.as_py(), index)]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "template", "coverage", "matched_words", "start", "end"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, license string, template int, coverage double, matched_words long, start long, end long")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"))
