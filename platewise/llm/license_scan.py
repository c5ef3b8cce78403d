"""License scans by conditional compression (operator 4).

Texts that mention licensing are searched in stretches: each reaches as many words
before and after a mention as the longest template has with its differences, across
the ends of lines, and stretches that meet are one, so that neither the length of a
line nor the wrapping of a notice matters.  Comment marks that begin a line (signs,
and the words of ``MARKS``) do not count; a match is on the line of its first word.  Every
template is compared with a stretch word by word: each place where at most
``DIFFERING`` percent of its words differ is a match; the differences are returned.
A match is compressed by zstandard alone and with the template as raw dictionary,
and templates are ranked by the bytes they save, less ``DIFFERENCE_BYTES`` for each
differing word.  A notice of
under ten words may differ in one word that neither belongs to the licence's name or
version (any word but the ``PLAIN`` ones, "license" among them) nor negates the
notice; between two words of a name only a ``PLAIN`` word may come.  Of matches that
overlap, the one that ranks first is kept, and what is left between
kept ones is searched again.  Templates are one-sentence notices, headers, whole
short licences and machine-readable tags; a whole licence saves more bytes than the
notice it begins with, and so stands for both.

Rows: very long texts are searched in whole; null texts and texts without candidates give no row; each match that
is kept gives one; ties go to the smaller share of differing words, then to the first name; repeated rows
are scanned one by one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The disclaimers that several licences end with.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_HOLDERS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Fixed wordings of public licences and notices.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-header-full": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": f"{_BSD_TERMS} {_HOLDERS}",
    "BSD-3-Clause": f"{_BSD_TERMS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_HOLDERS}",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-full": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-heading": "MIT License",
    "MIT-licensed": "is MIT licensed.",
    "MIT-full": f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
    "Proprietary-notice": "All rights reserved.",
    "Public-domain": "This work is released into the public domain.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
# Identifiers that machine-readable tags name.
SPDX = "0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
TEMPLATES |= {f"SPDX:{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}
MENTIONS = r"(?i)licen[sc]|copyright|rights\W+(?:\w+\W+)?reserved|\bcc\W+by\b|permission\W+(?:to\W+use|is\W+hereby)|redistribut|public\W+domain|spdx"
#: Comment marks of letters, at the beginning of a line.
MARKS = r"(?im)^[ \t]*(?:rem|dnl)(?=[ \t])|^c(?=[ \t])"
DIFFERING, LEVEL = 10, 3
#: Bytes that a differing word counts against what a template saves.
DIFFERENCE_BYTES = 8
#: Words of notices that name no licence, and words that turn a notice round.
PLAIN = frozenset("a an and are be been copyright distributed file in into is it licensed of or program released software terms the this to under version work".split())
NEGATIONS = frozenset("cannot except neither never no non nor not without".split())
FOUND = "doc_id long, line long, license string, saved double, n_words long, n_different long, differences string"


WORD = re.compile(r"\w+(?:[.'-]\w+)*")
MENTION = re.compile(MENTIONS, re.ASCII)  # as Spark reads it
MARK = re.compile(MARKS)
WRAP = re.compile(r"\s*\n[^\w\n(\"']*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Alignment:
    """Costs of ``template`` against the stretches of ``block`` that end at each place.

    Differences that touch ``names``, or negate a template that has some, count as more than the whole template.
    """

    def __init__(self, template: list[str], block: list[str], names: frozenset[str] = frozenset()):
        m, n, far = len(template), len(block), len(template) + 1
        self.template, self.block = template, block
        self.gone = gone = [far if w in names else 1 for w in template]
        self.added = added = [far if names and w in NEGATIONS else 1 for w in block]
        foreign = [max(c, 1 if w in PLAIN else far) for w, c in zip(block, added)]
        self.cost = cost = [[0] * (n + 1)]
        for i in range(1, m + 1):
            w, g = template[i - 1], gone[i - 1]
            plus = foreign if i < m and w in names and template[i] in names else added
            row, above = [cost[-1][0] + g], cost[-1]
            for j in range(1, n + 1):
                row.append(min(above[j - 1] + (0 if w == block[j - 1] else max(g, added[j - 1])), above[j] + g, row[j - 1] + plus[j - 1]))
            cost.append(row)

    def trace(self, j: int) -> tuple[int, list[str]]:
        """Where the best stretch that ends at ``j`` begins, and its differences."""
        template, block, cost, i, changes = self.template, self.block, self.cost, len(self.template), []
        while i:
            if j and template[i - 1] == block[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
                i, j = i - 1, j - 1
            elif j and template[i - 1] != block[j - 1] and cost[i][j] == cost[i - 1][j - 1] + max(self.gone[i - 1], self.added[j - 1]):
                changes += [f"+{block[j - 1]}", f"-{template[i - 1]}"]
                i, j = i - 1, j - 1
            elif cost[i][j] == cost[i - 1][j] + self.gone[i - 1]:
                changes.append(f"-{template[i - 1]}")
                i -= 1
            else:
                changes.append(f"+{block[j - 1]}")
                j -= 1
        return j, changes[::-1]


def wording(template: list[str], block: list[str], names: frozenset[str] = frozenset()) -> tuple[int, list[str]]:
    """Least number of differing words of ``template`` against any stretch of ``block``, and the differences.

    Differences are written ``-word`` (only in the template) and ``+word`` (only in the block).
    """
    found = Alignment(template, block, names)
    least = found.cost[-1]
    j = min(range(len(least)), key=lambda k: (least[k], k))
    return least[j], found.trace(j)[1]


def near_ends(template: list[str], block: list[str], most: int) -> list[int]:
    """Places where a stretch with at most ``most`` differing words ends (bit-parallel)."""
    present = set(block)
    if sum(w in present for w in template) < len(template) - most:
        return []
    peq: dict = defaultdict(int)
    for k, x in enumerate(template):
        peq[x] |= 1 << k
    mask, top = (1 << len(template)) - 1, 1 << (len(template) - 1)
    pv, mv, score, ends = mask, 0, len(template), []
    for j, x in enumerate(block, 1):
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
        if score <= most:
            ends.append(j)
    return ends


def apart(matches: list[tuple]) -> list[tuple]:
    """The matches ``(..., begin, end)`` that overlap none before them."""
    kept: list[tuple[int, int]] = []
    out = []
    for x in matches:
        k = bisect_right(kept, x[-2:])
        if (k == 0 or kept[k - 1][1] <= x[-2]) and (k == len(kept) or x[-1] <= kept[k][0]):
            kept.insert(k, x[-2:])
            out.append(x)
    return out


def matches_of(template: list[str], block: list[str], most: int, names: frozenset[str]) -> list[tuple[int, str, int, int]]:
    """``(differing words, differences, begin, end)`` of the matches in a block that do not overlap better ones."""
    runs: list[list[int]] = []
    for j in near_ends(template, block, most):
        if runs and j == runs[-1][-1] + 1:
            runs[-1].append(j)
        else:
            runs.append([j])
    found = []
    for run in runs:
        first = max(0, run[0] - len(template) - most)
        part = Alignment(template, block[first : run[-1]], names)
        for j in run:
            if (least := part.cost[-1][j - first]) <= most:
                begin, changes = part.trace(j - first)
                found.append((least, " ".join(changes), first + begin, j))
    return apart(sorted(found, key=lambda x: (x[0], x[3], x[2])))


def tolerance(template: list[str]) -> tuple[int, frozenset[str]]:
    """How many words of a template may differ, and the words that must not."""
    most, names = len(template) * DIFFERING // 100, frozenset(template) - PLAIN
    return (most, frozenset()) if most or not names else (1, names)


def cover(find: Callable[[int, int], list[tuple]], lo: int, hi: int) -> list[tuple]:
    """The best of the matches ``(..., begin, end)`` that ``find`` gives, and of those in the gaps they leave, in order."""
    out, pieces = [], [(lo, hi)]
    while pieces:
        lo, hi = pieces.pop()
        kept = sorted(apart(sorted(find(lo, hi))), key=lambda x: x[-2:])
        out += kept
        if kept:
            edges = [lo, *(e for x in kept for e in x[-2:]), hi]
            pieces += [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
    return sorted(out, key=lambda x: x[-2:])


class Scanner:
    """Ranks and confirms templates for the stretches of a text around mentions."""

    def __init__(self, templates: dict[str, str] | None = None, level: int = LEVEL):
        import zstandard as z

        self.templates = templates or TEMPLATES
        self.words = {k: words_of(t) for k, t in self.templates.items()}
        self.tolerance = {k: tolerance(w) for k, w in self.words.items()}
        params = z.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = z.ZstdCompressor(compression_params=params)
        self.conditional = {
            k: z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(t.encode("utf-8"), dict_type=z.DICT_TYPE_RAWCONTENT)) for k, t in self.templates.items()
        }
        self.reach = max((len(w) + self.tolerance[k][0] for k, w in self.words.items()), default=0)

    def saving(self, name: str, block: str) -> tuple[int, float]:
        """Compressed bytes that a template saves, and their share."""
        data = block.encode("utf-8")
        alone = len(self.plain.compress(data))
        saved = alone - len(self.conditional[name].compress(data))
        return saved, saved / alone

    def stretches(self, block: str, places: list[tuple[int, int]]) -> list[list[int]]:
        """Runs of words (first, last + 1) within reach of a mention."""
        starts, ends, found = [a for a, _ in places], [b for _, b in places], []
        for x in MENTION.finditer(block):
            lo, hi = max(0, bisect_right(ends, x.start()) - self.reach), min(len(places), bisect_left(starts, x.end()) + self.reach)
            if found and lo <= found[-1][1]:
                found[-1][1] = max(hi, found[-1][1])
            else:
                found.append([lo, hi])
        return found

    def scan(self, text: str) -> list[tuple[int, str, float, int, int, str]]:
        """``(line, license, saved, n_words, n_different, differences)`` of the matches, in order."""
        block = MARK.sub(lambda x: " " * len(x.group()), text)
        places = [x.span() for x in WORD.finditer(block)]
        words = [block[a:b].lower() for a, b in places]
        breaks = [x.start() for x in re.finditer("\n", block)]

        def find(lo: int, hi: int) -> list[tuple]:
            found = []
            for k, template in self.words.items():
                for least, changes, begin, end in matches_of(template, words[lo:hi], *self.tolerance[k]):
                    saved, share = self.saving(k, self.cited(block, places[lo + begin][0], places[lo + end - 1][1]))
                    found.append((DIFFERENCE_BYTES * least - saved, least / len(template), k, share, least, changes, lo + begin, lo + end))
            return found

        out = []
        for lo, hi in self.stretches(block, places):
            for _, _, k, share, least, changes, begin, _ in cover(find, lo, hi):
                out.append((bisect_left(breaks, places[begin][0]), k, round(share, 6), len(self.words[k]), least, changes))
        return out

    @staticmethod
    def cited(block: str, begin: int, end: int) -> str:
        """The words of a match with the stop after them; the end of a line, and the signs that begin the next, are one blank."""
        return WRAP.sub(" ", block[begin : end + (block[end : end + 1] in (".", ",", ";", ":"))])


def candidate_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: texts that mention licensing."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(MENTIONS))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each match that is kept."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(doc_id, *found) for found in scanner.scan(text)]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return candidate_texts(docs).mapInArrow(scan, FOUND)
