"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matched.

Templates are winnowed once: of every ``window`` consecutive hashes of ``gram`` words the least (the rightmost of equals) is
kept, in an inverted index from hash to (template, place). Texts are winnowed the same way, so any run of at least
gram + window - 1 words that a text shares with a template shares a fingerprint. Hits that lie near one diagonal of a text
and a template are one candidate, which is aligned word by word within a band around its diagonals. Alignments of one template
that follow each other are one match, so that text put in between doesn't hide a license, unless it names another license. Words
of a template that decide which license it is (name, version, variant) must all match.

Names ("MIT License", "GPL v3", "2-clause BSD", identifiers) are too short to winnow: their words are the keys of a second index, of
single words. A name is read with its version and with "or later", "only" or "with ... exception" after it, and it says which
license a matched line names. Each of several names ("A or B") is a match of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import map_texts, slices

#: License texts, parts of long ones, and notices to look for. Words in braces decide which license it is. Fixed values.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the {Apache} License, Version {2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-grants": """Grant of {Copyright} License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form. 3. Grant of {Patent} License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """ + (DISCLAIMER := """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. """ + (ENDORSE := """{Neither the name} of the copyright holder nor the names of its contributors may be used to {endorse} or promote products derived from this software without specific prior written permission.""") + " " + DISCLAIMER,
    "BSD-4-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All {advertising} materials mentioning features or use of this software must display the following {acknowledgement}: This product includes software developed by the copyright holder. 4. """ + ENDORSE + " " + DISCLAIMER,
    "BSD-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause-addition": ENDORSE,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "GPL-{v}.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation, either {version V} of the License, or (at your option) any {later} version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-{v}.0-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation; either {version V} of the License, or (at your option) any {later} version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-{v}.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Affero General Public License} as published by the Free Software Foundation, either {version V} of the License, or (at your option) any {later} version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "GPL-3.0-preamble": """The {GNU General Public License} is a free, {copyleft} license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its authors. You can apply it to your programs, too.""",
    "GPL-2.0-preamble": """The licenses for most software are designed to take away your freedom to share and change it. By contrast, the {GNU General Public License} is intended to guarantee your freedom to share and change {free software}--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.) You can apply it to your programs, too.""",
    "LGPL-3.0-opening": """This version of the {GNU Lesser General Public License} incorporates the terms and conditions of {version 3} of the GNU General Public License, supplemented by the additional permissions listed below.""",
    "AGPL-3.0-preamble": """The {GNU Affero General Public License} is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of {network server} software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense-opening": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC0-1.0": "To the extent possible under law, the author has {waived} all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "{All rights reserved}. No part of this publication may be reproduced without permission.",
}
#: Names of licenses in short lines, and how lines name them. Fixed values.
NAMES = {"MIT": "{MIT} License", "BSD": "{BSD} License", "BSD-2-Clause": "{BSD 2-Clause} License", "BSD-3-Clause": "{BSD 3-Clause} License", "ISC": "{ISC} License", "Apache-2.0": "{Apache} License, Version {2.0}", "MPL-2.0": "{Mozilla} Public License, v. {2.0}", "Zlib": "{zlib} License", "Unlicense": "{Unlicense}"}
LINES = ["Released under the X.", "This project is licensed under the X.", "Licensed under the X.", "This work is licensed under the X."]
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _templates() -> dict[str, str]:
    """All templates: texts, and lines for each name and version. A name with a number in brackets is another wording."""
    found = {}
    for name, text in TEXTS.items():
        if "{v}" in name:
            for v in (1, 2, 3) if name[0] == "G" else (3,):
                found[name.replace("{v}", str(v))] = text.replace("version V", f"version {v}")
        else:
            found[name] = text
    named = dict(NAMES)
    for short, long in (("GPL", "GNU"), ("LGPL", "GNU Lesser"), ("AGPL", "GNU Affero")):
        named |= {f"{short}-{v}.0": f"{{{long} General Public License, version {v}}}" for v in (1, 2, 3) if v > 1 or short == "GPL"}
    for v in ("2.0", "2.5", "3.0", "4.0"):
        for short, long in CREATIVE.items():
            found[f"CC-{short}-{v} [1]"] = f"Licensed under {{CC {short} {v}}}."
            found[f"CC-{short}-{v} [2]"] = f"This work is licensed under a Creative Commons {{{long} {v}}} {'International' if v == '4.0' else 'Unported'} License."
    for name, wording in named.items():
        found |= {f"{name} [{k}]": line.replace("X", wording) for k, line in enumerate(LINES, 1)}
    return found


TEMPLATES = _templates()
#: Words that turn a statement about a license into its opposite, and words that name licenses and variants. Fixed values.
NEGATIONS = {"not", "never", "no", "isn", "aren", "wasn", "without", "neither", "nor", "unless", "instead"}
VARIANTS = {"nc", "nd", "sa", "lesser", "affero", "library", "noncommercial", "noderivatives", "sharealike", "except", "only"}
#: Negations that reach over a whole sentence; the others reach four words. Fixed values.
FAR_NEGATIONS = {"not", "never", "isn", "aren", "wasn", "weren", "doesn", "don", "neither", "nor"}
#: Versions of named licenses, the clauses that words before "BSD" mean, and words after which a short name is a license. Fixed values.
VERSIONS = {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("1.0", "2.0", "3.0"), "Apache": ("1.0", "1.1", "2.0"), "MPL": ("1.0", "1.1", "2.0")}
CLAUSES = {"simplified": "2", "new": "3", "modified": "3", "revised": "3", "original": "4", "2": "2", "3": "3", "4": "4", "two": "2", "three": "3", "four": "4"}
BEFORE_NAMES = {"under", "license", "licence", "licenses", "identifier"}
SHORT_NAMES = {"mit": "MIT", "isc": "ISC", "zlib": "Zlib"}
_LICENSE = {"license", "licence", "licenses"}
_GNU = re.compile(r"([al]?)gpl(?:v?(\d))?$")
_NUMBER = re.compile(r"v?(\d+)$")
_NEAR = re.compile(r"[\s,(–-]*$")
_SENTENCE = re.compile(r"[.!?](?=\s)|\n[ \t\r]*\n")
_WORD = re.compile(r"[^\W_]+")
_SHIFT = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def winnowed(words: list[str], gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen grams of a sequence of words in lower case."""
    n = len(words) - gram + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = np.array([_HASHES[w] for w in words], np.uint64)
    grams = own[:n].copy()
    for k in range(1, gram):
        grams = (grams ^ grams >> np.uint64(29)) * _SHIFT + own[k : k + n]
    grams = (grams ^ grams >> np.uint64(32)) * _SHIFT
    if n <= window:
        places = np.array([n - 1 - grams[::-1].argmin()])
    else:
        views = np.lib.stride_tricks.sliding_window_view(grams, window)
        places = np.unique(np.arange(n - window + 1) + window - 1 - views[:, ::-1].argmin(axis=1))
    return places, grams[places]


class Index:
    """The inverted index of templates: sorted hashes, and for each the templates and places that hold it. Templates of at most
    ``short`` words with decisive words have all their grams with such words in it, others the chosen grams."""

    def __init__(self, templates: dict[str, str], gram: int, window: int, short: int = 16):
        self.names, self.gram, self.window = [n.split(" [")[0] for n in templates], gram, window
        self.words, self.decisive = [], []
        for text in templates.values():
            parts = [(_WORD.findall(part.lower()), k % 2 == 1) for k, part in enumerate(re.split(r"[{}]", text))]
            self.words.append([w for words, _ in parts for w in words])
            self.decisive.append([k for k, d in enumerate(d for words, d in parts for _ in words) if d])
        by = defaultdict(list)
        for k, (words, decisive) in enumerate(zip(self.words, self.decisive)):
            every = len(words) <= short and decisive
            for place, h in zip(*winnowed(words, gram, 1 if every else window)):
                if not every or any(place <= d < place + gram for d in decisive):
                    by[int(h)].append((k, int(place)))
        self.hashes = np.array(sorted(by), np.uint64)
        self.held = [by[int(h)] for h in self.hashes]

    def candidates(self, words: list[str], band: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(template, least and greatest diagonal, first and last text place) of hits near one diagonal and near each other."""
        places, hashes = winnowed(words, self.gram, self.window)
        if not len(places) or not len(self.hashes):
            return
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hits = defaultdict(list)
        for k in np.flatnonzero(self.hashes[at] == hashes):
            for template, place in self.held[at[k]]:
                hits[template].append((int(places[k]), int(places[k]) - place))
        for template, found in hits.items():
            open_: list[list[int]] = []
            reach = len(self.words[template])
            near = min(band, reach // 2)  # so that a short line that follows itself is two candidates
            for place, diagonal in found:  # by place: candidates out of reach are done
                held = []
                for c in open_:
                    if place - c[3] > reach:
                        yield template, *c
                    else:
                        held.append(c)
                open_ = held
                for c in open_:
                    if c[0] - near <= diagonal <= c[1] + near:
                        c[0], c[1], c[3] = min(c[0], diagonal), max(c[1], diagonal), place
                        break
                else:
                    open_.append([diagonal, diagonal, place, place])
            for c in open_:
                yield template, *c


def aligned(template: list[str], words: list[str], low: int, high: int) -> tuple[list[int], int, int]:
    """Best local alignment within the diagonals low to high (place in the text less place in the template): the template places
    that matched, and the first and the end place in the text. A match scores 2, a mismatch or a gap -1."""
    width = high - low + 1
    score, best, trace = [0] * (width + 1), (0, 0, 0), []
    for i, word in enumerate(template):
        new, steps = [0] * (width + 1), bytearray(width)
        for b in range(max(0, -i - low), min(width, len(words) - i - low)):
            same = words[i + low + b] == word
            s, step = score[b] + (2 if same else -1), 1
            if score[b + 1] - 1 > s:  # a template word is left out
                s, step = score[b + 1] - 1, 2
            if b and new[b - 1] - 1 > s:  # a text word is left out
                s, step = new[b - 1] - 1, 3
            if s > 0:
                new[b], steps[b] = s, step
                if s > best[0]:
                    best = (s, i, b)
        score = new
        trace.append(steps)
    if not best[0]:
        return [], 0, 0
    _, i, b = best
    end, start, matched = i + low + b + 1, 0, []
    while i >= 0 and b < width and trace[i][b]:
        step, start = trace[i][b], i + low + b
        if step == 1:
            if words[start] == template[i]:
                matched.append(i)
            i -= 1
        elif step == 2:
            i, b = i - 1, b + 1
        else:
            b -= 1
    return matched[::-1], start, end


def _chains(found: list[tuple[list[int], int, int]], longest: int, joins: Callable[[int, int], bool] | None = None) -> Iterator[list[tuple[list[int], int, int]]]:
    """Alignments of one template that follow each other in text and template, not more than ``longest`` words apart, where
    ``joins`` allows the words from one's end to the other's start between them."""
    open_: list[list[tuple[list[int], int, int]]] = []
    for f in sorted(found, key=lambda f: (f[1], f[2])):
        held = []
        for c in open_:
            if f[1] - c[-1][2] > longest:
                yield c
            else:
                held.append(c)
        open_ = held
        for c in open_:
            if c[-1][2] <= f[1] and c[-1][0][-1] < f[0][0] and (joins is None or joins(c[-1][2], f[1])):
                c.append(f)
                break
        else:
            open_.append([f])
    yield from open_


class _Names:
    """Names of licenses in a text: list of (license, nearest, first word, end word), by place; license is "unknown" for versions
    and clauses that don't exist, and for licenses with an exception."""

    #: Words that begin names. Fixed values.
    KEYS = {"mit", "isc", "zlib", "unlicense", "bsd", "apache", "mozilla", "mpl", "gnu", "gpl", "lgpl", "agpl", "cc0", "cc"}

    def __init__(self, text: str, spans: list[tuple[int, int]], words: list[str]):
        self.text, self.spans, self.words, self.found = text, spans, words, []
        for i, w in enumerate(words):
            if (w in self.KEYS or "gpl" in w and _GNU.match(w)) and not (self.found and i < self.found[-1][3]):
                if name := self._read(i):
                    self.found.append(name)

    def _gap(self, k: int) -> str:
        """What is between word k and the next one, or the end of the text."""
        return self.text[self.spans[k][1] : self.spans[k + 1][0] if k + 1 < len(self.words) else None]

    def _next(self, end: int, wanted: set[str]) -> int:
        """``end``, or one more if the word there is among the wanted and no sentence lies between."""
        return end + 1 if end < len(self.words) and self.words[end] in wanted and _NEAR.match(self._gap(end - 1)) else end

    def _version(self, end: int) -> tuple[str | None, int]:
        """The version that follows, as major.minor, and the end of it."""
        at = self._next(end, {"version", "v", "ver", "versions"})
        if at < len(self.words) and (m := _NUMBER.match(self.words[at])) and (_NEAR.match(self._gap(at - 1)) or at > end and self.words[at - 1] != "version"):
            if at + 1 < len(self.words) and self._gap(at) == "." and self.words[at + 1].isdigit():
                return f"{int(m[1])}.{int(self.words[at + 1])}", at + 2
            return f"{int(m[1])}.0", at + 1
        return None, end

    def _read(self, i: int) -> tuple[str, str, int, int] | None:
        words, w, start = self.words, self.words[i], i
        direct = i > 0 and (words[i - 1] in BEFORE_NAMES or i > 1 and words[i - 1] == "the" and words[i - 2] in BEFORE_NAMES)
        direct = direct or bool(self.found) and self.found[-1][3] >= i - 2 and words[self.found[-1][3] : i] in (["or"], ["and"], ["or", "the"], ["and", "the"])
        if w in SHORT_NAMES:
            end = self._next(i + 1, _LICENSE)
            return (SHORT_NAMES[w], SHORT_NAMES[w], i, end) if end > i + 1 or direct else None
        if w == "unlicense":
            return ("Unlicense", "Unlicense", i, self._next(i + 1, _LICENSE)) if direct or self._next(i + 1, _LICENSE) > i + 1 else None
        if w == "cc0":
            version, end = self._version(i + 1)
            return ("CC0-1.0" if version in (None, "1.0") else "unknown", "CC0-1.0", i, end) if version or direct else None
        if w == "cc":
            end = i + 1
            while (more := self._next(end, {"by", "nc", "nd", "sa"})) > end:
                end = more
            short = "-".join(words[i + 1 : end]).upper()
            version, after = self._version(end)
            known = short in CREATIVE and version in ("1.0", "2.0", "2.5", "3.0", "4.0")
            return (f"CC-{short}-{version}" if known else "unknown", f"CC-{short}-{version if known else '4.0'}", i, after) if version and short else None
        if w == "bsd":
            clauses, end = None, i + 1
            if i > 1 and words[i - 1] in ("clause", "clauses") and _NEAR.match(self._gap(i - 1)):
                clauses, start = words[i - 2], i - 2
            elif i and words[i - 1] in CLAUSES and not words[i - 1].isdigit():
                clauses, start = words[i - 1], i - 1
            elif i + 2 < len(words) and words[i + 2] in ("clause", "clauses") and _NEAR.match(self._gap(i)):
                clauses, end = words[i + 1], i + 3
            full = self._next(end, _LICENSE)
            if clauses is None:
                return ("BSD", "BSD", i, full) if full > end or direct else None
            name = f"BSD-{CLAUSES[clauses]}-Clause" if clauses in CLAUSES else "unknown"
            return name, name if name != "unknown" else "BSD", start, full
        version, end, plain = None, i + 1, False
        if w == "gnu":
            kind = {"lesser": "LGPL", "library": "LGPL", "affero": "AGPL"}.get(words[i + 1] if i + 1 < len(words) else "")
            end = i + 2 if kind else i + 1
            if words[end : end + 2] != ["general", "public"]:
                return None
            family, end, plain = kind or "GPL", self._next(end + 2, _LICENSE), True
            end = self._next(end, {"gpl", "lgpl", "agpl"})
        elif w == "mozilla":
            if words[i + 1 : i + 2] != ["public"]:
                return None
            family, end, plain = "MPL", self._next(i + 2, _LICENSE), True
        elif w in ("apache", "mpl"):
            family, end = ("Apache" if w == "apache" else "MPL"), self._next(self._next(i + 1, {"software"}), _LICENSE)
            plain = words[end - 1] in _LICENSE
        else:
            m = _GNU.match(w)
            family, version = f"{m[1].upper()}GPL", m[2]
            if version:  # as in gplv2, lgplv2.1
                if end < len(words) and self._gap(i) == "." and words[end].isdigit():
                    version, end = f"{version}.{int(words[end])}", end + 1
                else:
                    version += ".0"
        if not version:
            version, end = self._version(self._next(end, _LICENSE))
        if not (version or plain or direct or words[end - 1] in _LICENSE):
            return None
        nearest = f"{family}-{VERSIONS[family][-1]}"
        if not version:
            return family, nearest, start, self._next(end, _LICENSE)
        name = f"{family}-{version}" if version in VERSIONS[family] else "unknown"
        if "GPL" in family:
            name, end = self._suffix(name, end)
        return name, nearest if name == "unknown" else f"{family}-{version}", start, self._next(end, _LICENSE)

    def _suffix(self, name: str, end: int) -> tuple[str, int]:
        words, after = self.words, self.words[end : end + 7]
        if after[:1] == ["with"] and "exception" in after:
            return "unknown", end + after.index("exception") + 1
        if self._gap(end - 1)[:1] == "+":
            return (f"{name}-or-later" if name != "unknown" else name), end
        if end < len(words) and re.match(r"[\s,(–-]*$", self._gap(end - 1)):
            if after[0] == "only":
                return (f"{name}-only" if name != "unknown" else name), end + 1
            if after[0] in ("or", "and"):
                for k, w in enumerate(after[1:], 1):
                    if w in ("later", "newer", "higher"):
                        return (f"{name}-or-later" if name != "unknown" else name), self._next(end + k + 1, {"version"})
                    if w not in ("any", "at", "your", "option"):
                        break
        return name, end


def _negated(text: str, spans: list[tuple[int, int]], words: list[str], places: list[int]) -> list[bool]:
    """For each word place whether its sentence has a negation before it ("not only" is none), or one stands up to four words before."""
    far = [0, *accumulate(w in FAR_NEGATIONS and words[k + 1 : k + 2] != ["only"] for k, w in enumerate(words))]
    breaks, starts = [m.end() for m in _SENTENCE.finditer(text)], [a for a, _ in spans]
    found = []
    for p in places:
        k = bisect_right(breaks, starts[p])
        first = bisect_left(starts, breaks[k - 1]) if k else 0
        close = {w for j, w in enumerate(words[max(first, p - 4) : p], max(first, p - 4)) if words[j : j + 2] != ["not", "only"]}
        found.append(far[p] > far[first] or bool(NEGATIONS & close))
    return found


def matches(text: str | None, index: Index, coverage: float, band: int, named: bool = True) -> list[tuple[str, float, int, int, int, str]]:
    """(license, coverage, matched words, start, end, nearest) in code points, end exclusive, by start.

    nearest is the template's license; license is the same, or "unknown" where a decisive word isn't matched, or a word that names
    a variant or negates stands within the matched words, a negation up to four words before them, or before a name in its sentence.
    A line says the license whose name is in it, with its version; where it holds several names each is a match instead. Names outside
    of other matches have coverage 1. Of overlapping spans a known license goes before an unknown one, then the one with most matched
    words, then of the template that they cover most, then the first; names go last.
    """
    if not text:
        return []
    low = text.lower()
    shown = low if len(low) == len(text) else text
    spans = [m.span() for m in _WORD.finditer(shown)]
    words = [low[a:b] for a, b in spans] if shown is low else _WORD.findall(low)
    if len(spans) != len(words):  # lower case made other words; places are those of the lowered text
        shown, spans = low, [m.span() for m in _WORD.finditer(low)]
    by = defaultdict(list)
    held = defaultdict(list)
    for template, least, most, _, _ in index.candidates(words, band):
        near = min(band, len(index.words[template]) // 2)
        held[template].append((least - near, most + near))
    for template, diagonals in held.items():
        own = index.words[template]
        within = set().union(*(words[max(0, low_) : high + len(own)] for low_, high in diagonals))  # all that an alignment can match
        if sum(w in within for w in own) < coverage * len(own):
            continue
        for low_, high in diagonals:
            places, a, b = aligned(own, words, low_, high)
            if places:
                by[template].append((places, a, b))
    names = _Names(shown, spans, words).found if named else []
    negated = _negated(shown, spans, words, [n[2] for n in names]) if names else []
    firsts, name_words = [n[2] for n in names], {words[n[2]] for n in names}
    found = []  # (is a name, isn't known, license, nearest, words of the template, matched words, first and end word, order)
    for template, parts in by.items():
        own = index.words[template]
        line = len(own) <= 16
        for chain in _chains(parts, len(own), None if line else lambda a, b: not (bisect_left(firsts, b) > bisect_left(firsts, a))):
            places = {p for part in chain for p in part[0]}
            if len(places) < coverage * len(own):
                continue
            a, b = chain[0][1], chain[-1][2]
            inner = {w for _, x, y in chain for w in words[x:y]} - set(own)
            known = places.issuperset(index.decisive[template]) and not inner & (NEGATIONS | VARIANTS) and not NEGATIONS & set(words[max(0, a - 4) : a])
            license_, nearest = index.names[template], index.names[template]
            if line:  # a short line's name ends where it says: no other version or variant may follow
                held = range(bisect_left(firsts, a), bisect_left(firsts, b))
                if len(held) > 1 or inner & name_words:
                    continue  # the names are matches of their own
                if held:
                    k = held[0]
                    if names[k][0] != "unknown":
                        license_ = names[k][0]
                    known, nearest, b = names[k][0] != "unknown" and not negated[k] and not inner & NEGATIONS, names[k][1], max(b, names[k][3])
                else:
                    after = words[b : b + 2]
                    known = known and not (after and (after[0] in VARIANTS or after[0].isdigit() and own[-1].isdigit()))
            found.append((False, not known, license_ if known else "unknown", nearest, len(own), len(places), a, b, template))
    found += [(True, n or name == "unknown", "unknown" if n else name, nearest, b - a, b - a, a, b, 0) for (name, nearest, a, b), n in zip(names, negated)]
    kept: list[tuple] = []
    starts: list[int] = []
    for f in sorted(found, key=lambda f: (f[0], f[1], -f[5], f[4], f[6], f[8])):
        a, b = f[6:8]
        k = bisect_right(starts, a)
        if (not k or kept[k - 1][7] <= a) and (k == len(kept) or kept[k][6] >= b):
            starts.insert(k, a)
            kept.insert(k, f)
    return [(license_, n / size, n, spans[a][0], spans[b - 1][1], nearest) for _, _, license_, nearest, size, n, a, b, _ in kept]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, gram: int = 3, window: int = 2, band: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (``id_col``, license, coverage, matched, start, end, nearest): a row for each text and template span that match.

    coverage: the share of the template's words that the alignments matched, at least the parameter. start and end: code points
    in the text, end exclusive. license is "unknown" where the words that decide are others than those of ``nearest``, or negated.
    ``templates``: texts by license, decisive words in braces, in place of the library's and of the names that it reads. Null and empty texts match nothing; ids may be null or repeated
    (each row reports its own); other columns are left out. Templates of fewer than ``gram`` words are never found.
    """
    fixed = templates if templates is not None else TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(fixed, gram, window)
        for batch in slices(batches):
            found = [(i, m) for i, t in enumerate(batch.column(1).to_pylist()) for m in matches(t, index, coverage, band, named=templates is None)]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([m[k] for _, m in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), *columns], ["id", "license", "coverage", "matched", "start", "end", "nearest"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(rows, run, f"id {kind}, license string, coverage double, matched long, start long, end long, nearest string").withColumnRenamed("id", id_col)
