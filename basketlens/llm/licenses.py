"""License scans by patience alignment of texts with license templates.

Words are lower-cased runs of letters and digits.  A stretch of a text is aligned with a template as a patience
diff does it: words that occur once in both are anchors, the longest increasing subsequence of their places is kept,
equal words next to an anchor are taken along, and the gaps between anchors are aligned again in the same way, where
words that were frequent before may have become unique.  A template's coverage is the share of its words aligned.

*Texts and notices.*  Coverage c of n words needs ceil(c * n) of them, so at least one of any n - ceil(c * n) + 1 must
occur: the longest words of each template are its keys, and texts without a key are done.  Around its occurrences of the
template's words, a text is cut into stretches; a stretch longer than the template is aligned in overlapping windows of twice the
template's length, so that a repeated license is found each time.

*Names.*  A license that is only named stands in a sentence about licensing.  The sentences around the deciding word of a name are
aligned with templates that lead up to the name (``LEADS``), and count where the name is aligned as a whole, without foreign words
in it, and with it a word of the lead, unless the name itself speaks of a license.  No match goes across the end of a sentence.

Names and versions decide.  In a template each deciding word (``DECIDING`` or a number) must be among the words aligned, and no other
name or version between them unaligned: the notice of one license is not reported as that of its sibling.  Licenses without a
template are not found; a family's name alone ("GPL") stands where no template with a version does.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from basketlens.llm.shared import blocks, documents, id_and_text

LEAST_COVERAGE = 0.75
# Of the words between the first and the last aligned one, at least this share must be aligned.
LEAST_DENSITY = 0.6
LONGEST_GAP = 12
# Words of a sentence that are read to either side of a name.
SENTENCE_WORDS = 40

WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+")
# Between two words: a sentence ends, if the next one begins with a capital; a blank line ends one as well.
FULL_STOP = re.compile(rb"[.!?][\x29\x5d\"'*]*\s+\S?[\x28\x5b\"'*]*$")
BLANK_LINE = re.compile(rb"\n[ \t\r]*\n")

# How sentences lead up to a name, and words of which one must be aligned with it.
LEADS = (
    "This work is licensed under the terms of the",
    "This software is released under the",
    "The code is distributed under the terms of the",
    "is made available under the",
    "is subject to the terms of the",
    "may be used under the",
    "SPDX-License-Identifier",
    "License",
)
LICENSING = frozenset(b"licensed license licence licenses licensing released distributed available subject terms spdx identifier permission copying".split())

# Names that tell a license from another.
NAMES = frozenset(
    b"0bsd affero agpl agplv3 apache artistic attribution boost bsd cc cc0 cddl commons creativecommons eclipse epl eupl gnu gpl gplv2 gplv3 isc lesser lgpl lgplv2 lgplv3 "
    b"library mit mozilla mpl nc nd noncommercial noderivatives noderivs sa sharealike unlicense wtfpl zlib".split()
)
# The last two tell the three clauses of BSD from two.
DECIDING = NAMES | {b"endorse", b"promote"}


def _names() -> dict[str, tuple[str, ...]]:
    """The names of common licenses as they are written, with their versions and alone."""
    out: dict[str, tuple[str, ...]] = {
        "MIT": ("MIT License", "MIT licensed", "Expat License", "licensed under MIT", "license: MIT"),
        "MIT-0": ("MIT No Attribution", "MIT-0"),
        "BSD": ("BSD License", "BSD licensed", "BSD-style license"),
        "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "0BSD"),
        "ISC": ("ISC License", "ISC licensed"),
        "Zlib": ("zlib License", "zlib/libpng License"),
        "Unlicense": ("The Unlicense", "Unlicense License", "unlicense.org"),
        "BSL-1.0": ("Boost Software License", "BSL-1.0"),
        "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
        "CC0-1.0": ("CC0", "CC0 1.0", "Creative Commons Zero", "creativecommons.org/publicdomain/zero/1.0"),
        "Apache": ("Apache License", "Apache Software License", "Apache licensed"),
        "CC": ("Creative Commons License",),
    }
    for n, words in (("2", ("Simplified", "FreeBSD")), ("3", ("New", "Modified", "Revised")), ("4", ("Original",))):
        out[f"BSD-{n}-Clause"] = (f"BSD {n}-Clause", f"{n}-Clause BSD", f"BSD {n}-Clause License", f"{n}-Clause BSD License", *(f"{w} BSD License" for w in words))
    for v in ("1.0", "1.1", "2.0"):
        forms = [f"{a} {b}{v}" for a in ("Apache License", "Apache Software License") for b in ("", "Version ", "v")]
        out[f"Apache-{v}"] = (*forms, f"Apache-{v}", f"Apache {v}", f"apache.org/licenses/LICENSE-{v}")
    families = {
        "GPL": (("GNU General Public License", "GNU GPL", "GNU Public License", "GNU General Public License (GPL)"), ("1.0", "2.0", "3.0")),
        "LGPL": (("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "GNU Lesser General Public License (LGPL)"), ("2.0", "2.1", "3.0")),
        "AGPL": (("GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "GNU Affero General Public License (AGPL)"), ("1.0", "3.0")),
        "MPL": (("Mozilla Public License", "Mozilla Public License (MPL)"), ("1.0", "1.1", "2.0")),
        "EPL": (("Eclipse Public License", "Eclipse Public License (EPL)"), ("1.0", "2.0")),
        "EUPL": (("European Union Public Licence", "European Union Public License"), ("1.1", "1.2")),
        "CDDL": (("Common Development and Distribution License",), ("1.0", "1.1")),
        "Artistic": (("Artistic License",), ("1.0", "2.0")),
    }
    for family, (names, versions) in families.items():
        out[family] = (*names, f"{family} license", f"{family} licensed") if family != "Artistic" else names
        for v in versions:
            numbers = (v, v[:-2]) if v.endswith(".0") else (v,)
            forms = [f"{a} {b}{n}" for a in (*names, family) for n in numbers for b in ("", "version ", "v", "v. ")]
            out[f"{family}-{v}"] = (*forms, *(f"{family}v{n}" for n in numbers))
    elements = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        full = "-".join(elements[x] for x in kind.split("-"))
        spelled = {full, full.replace("NonCommercial", "Non-Commercial"), full.replace("ShareAlike", "Share-Alike"), full.replace("Derivatives", "Derivs")}
        spelled |= {x.replace("NoDeriv", "No-Deriv") for x in spelled}
        plain = [f"CC {kind}", *sorted(f"Creative Commons {x}" for x in spelled)]
        out[f"CC-{kind}"] = (f"CC-{kind} license", f"licensed under CC {kind}", *plain[1:])
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            forms = [f"{a} {b}{v}" for a in (*plain, *(f"{p} International" for p in plain[1:])) for b in ("", "License ")]
            forms += [f"{a} {v} {b}License" for a in plain[1:] for b in ("", "International ", "Unported ")]
            out[f"CC-{kind}-{v}"] = (*forms, f"creativecommons.org/licenses/{kind}/{v}")
    return {name: tuple(dict.fromkeys((*forms, name))) for name, forms in out.items()}


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)

_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)

# Notices and texts as published; of several forms each is a template.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0 notice": _gnu("General Public License", "2"),
    "GPL-3.0 notice": _gnu("General Public License", "3"),
    "LGPL-2.1 notice": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0 notice": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0 notice": _gnu("Affero General Public License", "3"),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause text": (_BSD, f"{_BSD} {_BSD_WARRANTY}"),
    "BSD-3-Clause text": (f"{_BSD} {_BSD_THIRD}", f"{_BSD} {_BSD_THIRD} {_BSD_WARRANTY}"),
    "Unlicense text": (
        _UNLICENSE,
        f"{_UNLICENSE} In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS,
    ),
    "ISC text": (_ISC, f"{_ISC} {_ISC_WARRANTY}"),
    "0BSD text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY
    ),
    "Zlib text": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered "
        "source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered "
        "from any source distribution."
    ),
    "BSL-1.0 text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        "license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Apache-2.0 text": (
        "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
        "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the "
        "Work and such Derivative Works in Source or Object form. 3. Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby "
        "grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, "
        "offer to sell, sell, import, and otherwise transfer the Work"
    ),
    "GPL text": (
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are "
        "designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and "
        "change all versions of a program--to make sure it remains free software for all its users.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee "
        "your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free "
        "Software Foundation's software and to any other program whose authors commit to using it.",
    ),
    "MIT text": (
        _MIT,
        f"{_MIT} {_AS_IS}",
    ),
    "MIT-0 text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. " + _AS_IS
    ),
}
FOUND = "doc_id long, license string, coverage double, n_aligned int, start_byte long, end_byte long"


NAMED = _names()


def words_of(data: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    spans = [m.span() for m in WORD.finditer(data)]
    return [data[s:e].lower() for s, e in spans], spans


def split(text: str) -> list[bytes]:
    return words_of(text.encode("utf-8"))[0]


def sentence_ends(data: bytes, spans: list[tuple[int, int]]):
    """A function that says whether a sentence ends after the i-th word."""

    def ends(i: int) -> bool:
        gap, begin = data[spans[i][1] : spans[i + 1][0]], spans[i + 1][0]
        return bool(BLANK_LINE.search(gap) or (data[begin : begin + 1].isupper() and FULL_STOP.search(gap)))

    return ends


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        before[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[at], ends[at] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both; gaps are worked off without recursion."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if there[w] == 1 and here.get(w) == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        if not anchors:
            continue
        chain = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        pairs.extend(chain)
        for (i, j), (k, m) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(pairs)


class Scanner:
    def __init__(self, templates: dict[str, str | tuple[str, ...]], coverage: float, names: dict[str, tuple[str, ...]] | None = None):
        self.coverage = coverage
        self.words = {(name, k): split(x) for name, text in templates.items() for k, x in enumerate([text] if isinstance(text, str) else text)}
        self.keys: dict[bytes, set[tuple[str, int]]] = {}
        for form, w in self.words.items():
            for key in sorted(w, key=lambda x: (-len(x), x))[: len(w) - math.ceil(coverage * len(w)) + 1]:
                self.keys.setdefault(key, set()).add(form)
        self.vocabulary = {form: set(w) for form, w in self.words.items()}
        self.deciding = {form: {x for x in w if x in DECIDING or x.isdigit()} for form, w in self.words.items()}
        # names by one of their words, a deciding one if they hold one
        self.leads = [split(x) for x in LEADS]
        self.names: dict[bytes, dict[tuple[str, tuple[bytes, ...]], None]] = {}
        for name, forms in (names or {}).items():
            for w in map(split, forms):
                key = min(sorted(w, key=lambda x: (-len(x), x)), key=lambda x: x not in NAMES)
                self.names.setdefault(key, {})[name, tuple(w)] = None
        self.any_key = self.keys.keys() | self.names.keys()

    def sentence(self, n: int, i: int, ends) -> tuple[int, int]:
        """The words of the sentence around the i-th, ``SENTENCE_WORDS`` to either side at most."""
        a, b = i, i + 1
        while a > max(0, i - SENTENCE_WORDS) and not ends(a - 1):
            a -= 1
        while b < min(n, i + SENTENCE_WORDS) and not ends(b - 1):
            b += 1
        return a, b

    def named(self, words: list[bytes], ends) -> Iterator[tuple[str, float, int, int, int]]:
        """Names that a sentence leads up to, each with its best lead."""
        for i, w in enumerate(words):
            if w not in self.names:
                continue
            a, b = self.sentence(len(words), i, ends)
            here, present = words[a:b], set(words[a:b])
            for name, form in self.names[w]:
                if present.issuperset(form):
                    found = [m for lead in self.leads if (m := self.led(here, lead, form, i - a)) is not None]
                    if found:
                        n, share, s, e = max(found, key=lambda m: (m[0], m[1]))
                        yield name, share, n, a + s, a + e

    def led(self, words: list[bytes], lead: list[bytes], name: tuple[bytes, ...], at: int) -> tuple[int, float, int, int] | None:
        """(aligned words, coverage, first, last + 1) where the sentence aligns with the lead and the name, the name as a whole around ``at``."""
        template = [*lead, *name]
        pairs = align(words, template)
        own = [i for i, j in pairs if j >= len(lead)]
        if len(own) < len(name) or own[-1] - own[0] >= len(name) or not own[0] <= at <= own[-1]:
            return None
        before = [(i, j) for i, j in pairs if j < len(lead)]
        # between the lead and a long name other words may stand, up to half as many as the name has
        near = bool(before) and own[0] - before[-1][0] <= 1 + (len(name) - 1) // 2 and any(words[i] in LICENSING for i, _ in before)
        if not near:
            if not LICENSING.intersection(name) and not {b"unlicense", b"unlicence"}.intersection(name):
                return None
            before, share = [], 1.0
        else:
            share = (len(before) + len(own)) / len(template)
        return len(before) + len(own), share, before[0][0] if before else own[0], own[-1] + 1

    def decided(self, words: list[bytes], form: tuple[str, int], pairs: list[tuple[int, int]]) -> bool:
        """Whether the deciding words are all aligned, and no others stand between them."""
        deciding = self.deciding[form]
        at = [i for i, _ in pairs if words[i] in deciding]
        if {words[i] for i in at} != deciding:
            return False
        aligned = {i for i, _ in pairs}
        for i in range(at[0], at[-1]) if at else ():
            if i not in aligned and words[i] not in deciding:
                if words[i] in NAMES or (words[i].isdigit() and words[i - 1] in (b"version", b"v")):
                    return False
        return True

    def stretches(self, words: list[bytes], name: tuple[str, int]) -> Iterator[tuple[int, int]]:
        vocabulary, n = self.vocabulary[name], len(self.words[name])
        at = [i for i, w in enumerate(words) if w in vocabulary]
        needed = math.ceil(self.coverage * n)
        begin = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] - at[k - 1] > LONGEST_GAP:
                if k - begin >= needed:
                    first, last = at[begin], at[k - 1] + 1
                    for s in range(first, max(first + 1, last - n), n):
                        yield s, min(s + 2 * n, last)
                begin = k

    def found(self, words: list[bytes], ends=lambda i: False) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, aligned words, first word, last word + 1); of overlapping ones the best."""
        matches = list(self.named(words, ends))
        forms = set().union(*(self.keys[w] for w in self.keys.keys() & set(words)))
        for form in sorted(forms):
            template = self.words[form]
            for s, e in self.stretches(words, form):
                pairs = align(words[s:e], template)
                if len(pairs) < self.coverage * len(template):
                    continue
                # ends that stand far off are accidental: drop them while what is left stays dense
                lo, hi = 0, len(pairs)
                while hi - lo >= self.coverage * len(template) and (hi - lo) < LEAST_DENSITY * (pairs[hi - 1][0] - pairs[lo][0] + 1):
                    if pairs[lo + 1][0] - pairs[lo][0] > pairs[hi - 1][0] - pairs[hi - 2][0]:
                        lo += 1
                    else:
                        hi -= 1
                if hi - lo >= self.coverage * len(template) and self.decided(words, form, [(s + i, j) for i, j in pairs[lo:hi]]):
                    matches.append((form[0], (hi - lo) / len(template), hi - lo, s + pairs[lo][0], s + pairs[hi - 1][0] + 1))
        # of overlapping matches the one with the most aligned words stays
        kept: list[tuple[str, float, int, int, int]] = []
        taken = bytearray(len(words))
        for m in sorted(matches, key=lambda m: (-m[2], -m[1], m[3], m[0])):
            if not any(taken[m[3] : m[4]]):
                taken[m[3] : m[4]] = b"\1" * (m[4] - m[3])
                kept.append(m)
        return sorted(kept, key=lambda m: m[3])


def _scan(templates: dict[str, str | tuple[str, ...]], names: dict[str, tuple[str, ...]], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, names)
        for block in blocks(batches):
            ids = block.batch.column("doc_id").to_pylist()
            rows = []
            for i in range(len(block)):
                data = block.text(i)
                if scanner.any_key.isdisjoint(WORD.findall(data.lower())):
                    continue
                words, spans = words_of(data)
                matches = scanner.found(words, sentence_ends(data, spans))
                if matches:
                    rows += [(ids[i], name, share, n, spans[s][0], spans[e - 1][1]) for name, share, n, s, e in matches]
            if rows:
                doc, name, share, n, start, end = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(np.array(n, np.int32)), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    names=["doc_id", "license", "coverage", "n_aligned", "start_byte", "end_byte"],
                )

    return run


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str | tuple[str, ...]] = TEMPLATES,
    names: dict[str, tuple[str, ...]] = NAMED,
    coverage: float = LEAST_COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per license found: doc_id, license, coverage, n_aligned, start_byte, end_byte.

    ``coverage`` is asked of ``templates``; of ``names`` the whole name and some of what leads up to it.  A document has a row for each
    place of each license, none without one; null and empty texts have none.  Where templates match the same place, the one with the
    most aligned words stands.  Texts of any length are read whole; repeated rows are scanned each; no rows give no
    rows; other columns are not read.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan(templates, names, coverage), FOUND)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(documents(spark, folder))
