"""License scans by conditional compression.

Method: candidate blocks are compressed alone and with every license template as a raw zstandard dictionary. The
templates are ranked by how much they save; a block's winner is the one that saves most (the one whose phrase
was found, where that ties), and winners are confirmed by the exact words in which block and template differ.

A text is read as its words in lower case; line ends, comment marks and punctuation do not part them. Each
template of m words may differ in d = ``max_diff_pct`` per cent of m; it is cut into d + 1 phrases, and as a
difference spoils at most one of them, every block within the limit holds a phrase whole. One automaton finds
the phrases of all templates; from each, the template is aligned to both sides with the fewest differences, so
no block within the limit is missed. The scan reads every text once, in place; nothing is shuffled and only the
templates are broadcast.

Confirmed: the block's own template is the winner; the words of the template that the block lacks, plus words put in
between, are at most ``max_diff_pct`` per cent of the template's words; and the words that say which license it is
(``IDENTITY``, version numbers, what follows ``cc``) are the same, in the same order. Confirmed blocks go before others.
One that shares more than half its words with a better confirmed one is the same notice. Any other block counts only if
its phrase lies in no block already found; it is reported under its winner's name, unconfirmed.

Defined results: a null or empty text has no blocks; ``block`` is the number of the block's first word in the
text; ties go to fewer differences, then the template that comes first; repeated rows give repeated blocks; a
document without candidates gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqaframe.llm.common import python_ready

# Notices as their licenses word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ARR", "All rights reserved."),
    # the notices and paragraphs that stand in sources and license files
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
            "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
            "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
            "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License "
                   "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
                   "or implied. See the License for the specific language governing permissions and limitations under "
                   "the License."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                     "or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
            "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
            "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
            "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
            "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
            "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                         "the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation; either version 2 of "
                         "the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of "
                          "the GNU Lesser General Public License as published by the Free Software Foundation, either "
                          "version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of "
                          "the GNU Lesser General Public License as published by the Free Software Foundation; either "
                          "version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of "
                          "the GNU Affero General Public License as published by the Free Software Foundation, either "
                          "version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
            "License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or "
                "copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
                  "a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                        "International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                        "International License."),
)
# The Creative Commons licenses, by their short and long names.
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
       ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_OTHERS = (
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                          "GNU Lesser General Public License as published by the Free Software Foundation, either "
                          "version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the "
                          "GNU Lesser General Public License as published by the Free Software Foundation; either "
                          "version 2.1 of the License, or (at your option) any later version."),
)
TEMPLATES += _OTHERS + tuple(
    t for version, where in (("3.0", "Unported"), ("4.0", "International")) for short, long in _CC for t in (
        (f"CC-{short}-{version}", f"Licensed under CC {short} {version}."),
        (f"CC-{short}-{version}", f"This work is licensed under a Creative Commons {long} {version} {where} License."))
    if t not in TEMPLATES)
#: Words that say which license a notice names.
IDENTITY = frozenset(["mit", "apache", "gnu", "lesser", "affero", "bsd", "mozilla", "mpl", "isc", "boost", "creative", "commons", "cc",
                      "later", *(long.lower() for _, long in _CC), "sharealike", "noncommercial", "noderivatives"])
_VERSION = re.compile(r"v?\d+(?:\.\d+)*")
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
#: A line end with the marks that go on a comment in the next line.
_MARK = re.compile(r"[ \t]*\n[ \t]*(?:(?:[#*;%!>|]+|/[/*]+|--+|\.\.|(?:dnl|rem)(?=[ \t\n]))[ \t]*)?")


def identity(words: list[str]) -> list[str]:
    """The words that must be the same in a block and its template."""
    return [w for before, w in zip(["", *words], words) if w in IDENTITY or before == "cc" or _VERSION.fullmatch(w)]


def align(want: list, have: list, limit: int):
    """(differences, words of ``have`` taken) to go through all of ``want`` from the front; None beyond ``limit``."""
    n, size, far = len(want), len(have), {}
    for e in range(limit + 1):
        reach = {}
        for k in range(e, -e - 1, -2):  # k: words of have more than of want; the furthest word of want on it
            x = max(far.get(k - 1, -1), far.get(k + 1, -2) + 1) if e else 0
            if x < 0 or x > n or not 0 <= x + k <= size:
                continue
            while x < n and x + k < size and want[x] == have[x + k]:
                x += 1
            if x == n:
                return e, n + k
            reach[k] = x
        far = reach
    return None


class Scanner:
    def __init__(self, templates, max_diff_pct: int = 20, level: int = 3):
        self.templates = [(name, _WORD.findall(text.lower())) for name, text in templates]
        self.limits = [max_diff_pct * len(words) // 100 for _, words in self.templates]
        self.alone = zstandard.ZstdCompressor(level=level)
        self.given = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(
            text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, text in templates]
        places = {}
        for t, (_, words) in enumerate(self.templates):
            parts = min(self.limits[t] + 1, len(words))
            cuts = [len(words) * i // parts for i in range(parts + 1)]
            for a, z in zip(cuts, cuts[1:]):
                places.setdefault(f" {' '.join(words[a:z])} ", []).append((t, a, z))
        self.phrases = ahocorasick.Automaton()
        for phrase, found in places.items():
            self.phrases.add_word(phrase, (len(phrase), found))
        self.phrases.make_automaton()

    def blocks(self, text: str):
        """(number of the first word, block, license, size alone, size given, differing words, confirmed) in the order of the text."""
        low = _MARK.sub("\n", text.lower())
        words = _WORD.findall(low)
        plain = f" {' '.join(words)} "
        hits = [(end + 1 - size, found) for end, (size, found) in self.phrases.iter(plain)]
        if not hits:
            return []
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))  # of each word's blank in plain
        spans = [m.span() for m in _WORD.finditer(low)]
        sure, loose, place = {}, set(), {}
        for at, found in hits:
            i = bisect_right(starts, at) - 1
            for t, a, z in found:
                want, limit = self.templates[t][1], self.limits[t]
                reach = len(want) + limit
                left = align(want[:a][::-1], words[max(0, i - reach):i][::-1], limit)
                right = left and align(want[z:], words[i + z - a:i + z - a + reach], limit - left[0])
                if right:
                    key = t, i - left[1], i + z - a + right[1]
                    sure[key] = min(sure.get(key, limit), left[0] + right[0])
                else:
                    key = t, max(0, i - a), min(len(words), i - a + len(want))
                    loose.add(key)
                place.setdefault(key, (i, a, z))

        def ranked(items):
            """(size saved, differences, template, first, last, block, alone, given, winner), most saved first."""
            out, sizes = [], {}
            for t, first, last in items:
                if (first, last) not in sizes:
                    block = " ".join(low[spans[first][0]:spans[last - 1][1]].split())
                    data = block.encode()
                    sizes[first, last] = block, len(self.alone.compress(data)), [len(c.compress(data)) for c in self.given]
                block, alone, given = sizes[first, last]
                least = min(given)
                winner = t if given[t] == least else given.index(least)
                out.append((given[winner] - alone, sure.get((t, first, last), 0), t, first, last, block, alone, given[winner], winner))
            return sorted(out)

        taken, out = {}, []  # the blocks found, by each 64 words that they touch

        def take(first, last):
            for c in range(first >> 6, (last - 1 >> 6) + 1):
                taken.setdefault(c, []).append((first, last))

        def shared(first, last):
            near = (x for c in range(first >> 6, (last - 1 >> 6) + 1) for x in taken.get(c, ()))
            return max((min(last, z) - max(first, a) for a, z in near), default=0)

        lost = []
        for _, diff, t, first, last, block, alone, given, winner in ranked(sure):
            if winner != t or identity(words[first:last]) != identity(self.templates[t][1]):
                lost.append((t, first, last))
            elif 2 * shared(first, last) <= last - first:
                take(first, last)
                out.append((first, block, self.templates[t][0], alone, given, diff, True))
        free = lambda i, a, z: shared(i, i + z - a) <= 0
        for _, _, t, first, last, block, alone, given, winner in ranked(
                [k for k in (*lost, *loose) if free(*place[k])]):
            i, a, z = place[t, first, last]
            if free(i, a, z):
                take(first, last)
                want = self.templates[winner][1]
                if winner == t:
                    diff = align(want[:a][::-1], words[:i][:-len(want) - 1:-1], a)[0]
                    diff += align(want[z:], words[i + z - a:i + z - a + len(want)], len(want) - z)[0]
                else:
                    diff = align(want, words[first:last], len(want))[0]
                out.append((first, block, self.templates[winner][0], alone, given, diff, False))
        return sorted(out)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  max_diff_pct: int = 20) -> DataFrame:
    """One row per candidate block: ``id``, ``block``, ``text``, ``license``, ``size_alone``, ``size_given``, ``n_diff``, ``confirmed``."""
    python_ready(docs.sparkSession)
    base = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    names = ["id", "block", "text", "license", "size_alone", "size_given", "n_diff", "confirmed"]

    def work(batches):
        scanner = Scanner(templates, max_diff_pct)
        for b in batches:
            row, out = [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                for found in scanner.blocks(text):
                    row.append(r)
                    out.append(found)
            if out:
                kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *cols], names)

    return base.mapInArrow(work, f"id {base.schema['id'].dataType.simpleString()}, block int, text string, license string, "
                                 "size_alone int, size_given int, n_diff int, confirmed boolean")
