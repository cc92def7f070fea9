"""Operator 5, licence scans: normalised text compared to licence templates by the Dice coefficient over word
bigrams, with size bounds that prune candidate templates.

Words are runs of letters and digits, A-Z lower-cased; a text's bigrams are a multiset; two texts of one word have
that word. With Dice at least d, sizes a and b satisfy ``d/(2-d) <= a/b <= (2-d)/d``, so a template of b bigrams
needs a passage of at least ``b*d/(2-d)`` bigrams, of which at least ``d*(a+b)/2`` are its own. Both bounds hold for
the whole document first: a template whose bigrams the document doesn't hold in that number is left out before any
passage is looked at.

Passages are runs of words, wherever they begin and end in a line. For each template that is left, the passage of the
highest Dice coefficient is found among runs whose size lies within the bounds; the best run begins and ends with a
bigram of the template, so only those are looked at, and the lines of its first and last word are reported.
``Scanner.scan`` alone takes runs of whole lines unless told otherwise.

Templates are a parameter, of bounded size (``MAX_TEMPLATE_BYTES``), and travel with the code.

Defined results: a null or empty text, or one without words, matches nothing; ties go to the smaller template name,
then to the earlier passage, then to the shorter; repeated rows each get their row; null ids and extra columns are
kept; without templates nothing matches; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release, ship, without

MAX_TEMPLATE_BYTES = 16 << 20
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.
You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: Full texts, file notices and one-line statements of common licences.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 notice": _APACHE,
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause text": _BSD2.format(""),
    "BSD-3-Clause text": _BSD2.format(_BSD3),
    "BSD-3-Clause statement": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 statement": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0 notice": _GPL.format("General Public License", "2"),
    "GPL-3.0 notice": _GPL.format("General Public License", "3"),
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "ISC text": _ISC,
    "LGPL-3.0 notice": _GPL.format("Lesser General Public License", "3"),
    "AGPL-3.0 notice": _GPL.format("Affero General Public License", "3"),
    "MIT statement": "Released under the MIT License.",
    "MIT text": _MIT,
    "MPL-2.0 notice": _MPL,
    "Unlicense text": _UNLICENSE,
}


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def bigrams(tokens: list[bytes]) -> list[tuple[bytes, ...]]:
    return list(zip(tokens, tokens[1:], strict=False)) if len(tokens) > 1 else [tuple(tokens)] if tokens else []


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        if sum(map(len, templates.values())) > MAX_TEMPLATE_BYTES:
            raise ValueError("templates are larger than MAX_TEMPLATE_BYTES")
        self.least = least
        self.names = sorted(n for n, t in templates.items() if words(t))
        self.counts = [Counter(bigrams(words(templates[n]))) for n in self.names]
        self.sizes = np.array([c.total() for c in self.counts], dtype=np.int64)
        self.low, self.high = self.sizes * (least / (2 - least)), self.sizes * ((2 - least) / least)
        self.vocabulary = {w for c in self.counts for b in c for w in b}
        self.bigram = {b: i for i, b in enumerate(sorted({b for c in self.counts for b in c}))}
        self.matrix = np.zeros((len(self.names), len(self.bigram)), dtype=np.int64)
        for k, c in enumerate(self.counts):
            for b, n in c.items():
                self.matrix[k, self.bigram[b]] = n

    def scan(self, text: str | None, within: bool = False) -> list[dict]:
        """For each template that a passage matches: name, dice and the lines of the best passage. within: passages may
        begin and end within lines."""
        if not text or not self.names:
            return []
        tokens = words(text)
        known = [w in self.vocabulary for w in tokens]
        get = self.bigram.get
        hits = [get((tokens[i], tokens[i + 1]) if i + 1 < len(tokens) else (tokens[i],)) for i, k in enumerate(known) if k and (i + 1 == len(tokens) or known[i + 1])]
        single = [get((w,)) for w, k in zip(tokens, known, strict=True) if k] if any(s == 1 for s in self.sizes) else []
        found = np.array([h for h in [*hits, *single] if h is not None], dtype=np.int64)
        if not len(found):
            return []
        at, n = np.unique(found, return_counts=True)
        held = np.minimum(self.matrix[:, at], n).sum(axis=1)
        # a passage of a bigrams has at least least*(a+b)/2 of the template's b, and a >= low
        left = np.flatnonzero((held >= self.least * (self.low + self.sizes) / 2 - 1e-9) & (len(tokens) >= self.low))
        if not len(left):
            return []
        best, lines = self._best_within if within else self._best, text.split("\n")
        return [m for k in left if (m := best(int(k), lines))]

    def _best_within(self, k: int, lines: list[str]) -> dict | None:
        own, size, high = self.counts[k], int(self.sizes[k]), self.high[k] + 1e-9
        tokens, line_of = [], []
        for n, line in enumerate(lines):
            found = words(line)
            tokens += found
            line_of += [n] * len(found)
        single = len(next(iter(own))) == 1  # a template of one word has that word and is matched by it alone
        grams = [(w,) for w in tokens] if single else list(zip(tokens, tokens[1:], strict=False))
        high = 1 if single else high
        hits = [i for i, b in enumerate(grams) if b in own]
        best: tuple[float, int, int] | None = None
        far = 0
        for a, first in enumerate(hits):
            while far < len(hits) and hits[far] - first + 1 <= high:
                far += 1
            most = min(size, far - a)  # common bigrams of a passage from here, which has at least as many
            if 2 * most / (most + size) < self.least - 1e-12 or (best and 2 * most / (most + size) <= -best[0]):
                continue
            common, seen = 0, {}
            for end in hits[a:far]:
                b = grams[end]
                seen[b] = n = seen.get(b, 0) + 1
                common += n <= own[b]
                score = 2 * common / (end - first + 1 + size)
                if score >= self.least - 1e-12 and (best is None or (-score, first, end) < best):
                    best = (-score, first, end)
        return best and {"license": self.names[k], "dice": -best[0], "first_line": line_of[best[1]], "last_line": line_of[best[2] + (not single)]}

    def _best(self, k: int, lines: list[str]) -> dict | None:
        own, size = self.counts[k], int(self.sizes[k])
        tokens = [words(line) for line in lines]
        full = [i for i, t in enumerate(tokens) if t]
        follows = dict(zip(full, [tokens[i][0] for i in full[1:]], strict=False))
        # a passage starts where a bigram of the template does, one that goes on in the next line included
        touched = [i for i in full if any(b in own for b in bigrams(tokens[i])) or (tokens[i][-1], follows.get(i)) in own]
        best: tuple[float, int, int] | None = None
        for first in touched:
            common, seen, count, last = 0, Counter(), 0, None
            for end in range(first, len(lines)):
                t = tokens[end]
                if not t:
                    continue
                fresh = bigrams(t) if len(t) > 1 else []
                if last is not None:
                    fresh = [(last, t[0]), *fresh]
                for b in fresh:
                    count += 1
                    seen[b] += 1
                    common += seen[b] <= own.get(b, 0)
                last = t[-1]
                of = max(count, 1)
                if of > self.high[k] + 1e-9:
                    break
                score = 2 * (common or int(count == 0 and (last,) in own)) / (of + size)
                if score >= self.least - 1e-12 and (best is None or (-score, first, end) < best):
                    best = (-score, first, end)
        return best and {"license": self.names[k], "dice": -best[0], "first_line": best[1], "last_line": best[2]}


MATCHES = "array<struct<license:string,dice:double,first_line:int,last_line:int>>"
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, text_col: str = "text", matches_col: str = "__licenses") -> DataFrame:
    """docs with the matches of each text, the best first."""
    ship(docs.sparkSession)
    docs = without(docs, matches_col)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, least))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            made = [sorted(scanner.scan(t, within=True), key=lambda m: (-m["dice"], m["license"])) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, _ARROW)], names=[*batch.schema.names, matches_col])
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{matches_col}` {MATCHES}")
