"""Licence scan: normalised sentences become known sentence numbers; runs of numbers are held against licence rules."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence and wording, in order of precedence. Longer wordings come before those they hold.
RULES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Licences that name themselves in a line of their own; each gives a rule after those above.
TAGGED = ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "EPL-2.0", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")
RULES += tuple((name, f"SPDX-License-Identifier: {name}") for name in TAGGED)
#: Texts and sentences without any of these are not looked at; such sentences of a rule do not count either.
ANCHORS = ("licen", "copyright", "spdx", "software", "program", "warrant", "mpl", "mozilla", "event shall", "2.0")
#: Maps over which the known sentences are dealt, as a map is searched from its start.
BUCKETS = 64

#: Abbreviations whose point ends no sentence, and what stands for the holder's name in normalised sentences.
ABBREVIATED = r"(?i)\b(corp|inc|ltd|co|llc)\."
SLOTS = (
    ("neither the names? of .{1,200}? nor the names? of", "neither the name of holder nor the names of"),
    ("is provided by .{1,200}? as is", "is provided by holder as is"),
    ("in no event shall .{1,200}? be liable", "in no event shall holder be liable"),
)

FLOW = (r"[\x20\x09-\x0D]+", " ", r"([.!?]) ", "$1\n")
LINE = (r"[\x0B-\x0D]+", "\n", r"([.!?])[\x20\x09]+", "$1\n")


def sentences(text: str) -> list[str]:
    """Normalised sentences of a rule's wording: the flow view of a document."""
    flat = re.sub(r"([.!?]) ", "\\1\n", re.sub(FLOW[0], " ", re.sub(ABBREVIATED, "\\1", text))).split("\n")
    out = [re.sub("[^A-Za-z0-9]+", " ", x).strip().lower() for x in flat]
    for pattern, name in SLOTS:
        out = [re.sub(pattern, name, x) for x in out]
    return [x for x in out if x]


class LicenceRules:
    """Sentences numbered from 1, and rules as runs of numbers written ``,1,2,3,``."""

    def __init__(self, rules: Sequence[tuple[str, str]] = RULES, anchors: Sequence[str] = ANCHORS):
        self.number: dict[str, int] = {}
        self.rules: list[tuple[int, str, str]] = []
        needed = [re.sub("[^a-z0-9]+", " ", a).strip() for a in anchors]
        for rank, (name, text) in enumerate(rules):
            found = [x for x in sentences(text) if any(a in x for a in needed)]
            if not found:
                raise ValueError(f"no anchor in: {text}")
            for x in found:
                self.number.setdefault(x, len(self.number) + 1)
            self.rules.append((rank, name, "," + ",".join(str(self.number[x]) for x in found) + ","))
        self.anchors = tuple(anchors)

    def anchor_pattern(self) -> str:
        """Any anchor, its blanks and points standing for whatever the normalisation drops."""
        return "(?i)" + "|".join("[^A-Za-z0-9]+".join(re.escape(w) for w in re.split("[^a-z0-9]+", a)) for a in self.anchors)


def normalised(sentence: Column) -> Column:
    out = F.lower(F.trim(F.regexp_replace(sentence, "[^A-Za-z0-9]+", " ")))
    for pattern, name in SLOTS:
        out = F.regexp_replace(out, pattern, name)
    return out


def scan_licences(docs: DataFrame, rules: LicenceRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that holds a known sentence: id, ``n_sentences``, ``sentence_ids`` (in order, joined by
    commas), ``licences`` (distinct, sorted, joined by commas; empty if no rule is whole) and ``rule`` (the first of the
    rules, by precedence, that are found, counted from 0; null if none).

    A text is read in two views: as lines, and as running text in which a sentence may go over lines. In each view
    sentences end at ``.``, ``!`` or ``?`` before white space, but not after some abbreviations; letters and digits are
    compared, without case, and a holder's name where a wording has one (SLOTS) may be any. A rule is found when its
    sentences stand one after another in a view, with no other sentence between them that has an anchor, so that a
    wording with a changed or added condition is not taken for the one without. A rule inside a longer found one of the
    same place is found too and gives the same or its own licence. ``sentence_ids`` are the known ones, those of the view with more
    sentences (lines if equal). Null and empty texts give no row. Every row is a document of its own, also one that repeats
    an id or has none, as nothing is grouped or shuffled; very long texts are read whole, by one task. Other columns are
    ignored. An empty table gives an empty table.
    """
    rules = rules or LicenceRules()
    pattern = rules.anchor_pattern()
    known = _lookup(rules)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(pattern))

    def view(steps: tuple[str, str, str, str]) -> Column:
        """Numbers of the sentences with an anchor, in order; 0 for those that are not known."""
        flat = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ABBREVIATED, "$1"), steps[0], steps[1]), steps[2], steps[3])
        kept = F.filter(F.split(flat, "\n"), lambda s: s.rlike(pattern))
        return F.transform(kept, lambda s: F.coalesce(known(normalised(s)), F.lit(0)))

    found = lambda c: F.filter(c, lambda n: n > 0)
    views = rows.select("id", view(LINE).alias("line"), view(FLOW).alias("flow"))
    views = views.withColumns({"lined": found("line"), "flowed": found("flow")}).filter("size(lined) + size(flowed) > 0")
    said = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    views = views.select("id", F.greatest(F.size("lined"), F.size("flowed")).cast("long").alias("n"), F.expr("size(lined) >= size(flowed)").alias("lines"), *map(said, ("line", "flow", "lined", "flowed")))
    table = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(name).alias("name"), F.lit(run).alias("run")) for k, name, run in rules.rules])
    both = F.concat(F.lit(","), "line", F.lit(",;,"), "flow", F.lit(","))  # no rule goes over the semicolon
    out = views.withColumn("hits", F.filter(table, lambda r: both.contains(r["run"])))
    first = F.array_min(F.transform("hits", lambda r: r["rank"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda r: r["name"]))), ",")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_sentences"), F.when(F.col("lines"), F.col("lined")).otherwise(F.col("flowed")).alias("sentence_ids"), names.alias("licences"), first.alias("rule"))


def _lookup(rules: LicenceRules) -> Callable[[Column], Column]:
    """The number of a normalised sentence, or null: a constant array of maps, one for each remainder of its CRC-32."""
    parts: list[list] = [[] for _ in range(BUCKETS)]
    for sentence, n in rules.number.items():
        parts[zlib.crc32(sentence.encode()) % BUCKETS] += [F.lit(sentence), F.lit(n)]
    none = F.create_map().cast("map<string,int>")
    maps = F.array(*[F.create_map(*p) if p else none for p in parts])
    return lambda s: F.try_element_at(F.get(maps, (F.crc32(s.cast("binary")) % BUCKETS).cast("int")), s)
