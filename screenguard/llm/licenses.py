"""License scans by conditional compression.

Around each hint the words, whatever lines they stand on, are searched for runs that hold
nearly all of a template's words. Such a block is compressed twice: alone, and with the
template as a raw zstandard dictionary. Templates that don't make it smaller go; the others
are confirmed by the exact differences in wording. Of templates that fit overlapping blocks
the one that saves most bytes is taken; of equal ones the exact, then the longer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache, lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, sliced

#: Templates by SPDX-like name: notices that stand in texts (fixed values). {} is any few words.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "All-Rights-Reserved": ("All rights reserved.", "Copyright {} All rights reserved."),
}
#: Every license can also be named by its identifier.
for _name in [n for n in TEMPLATES if n not in ("All-Rights-Reserved", "BSD")]:
    TEMPLATES[_name] += (f"SPDX-License-Identifier: {_name}",)
#: Words that tell licenses apart: none of them may be missing from a block, or be added to it (fixed values).
TELLING = frozenset("2 2.0 2.1 3 3.0 4.0 affero apache attribution bsd by clause eclipse general lesser library mit mozilla nc noncommercial noderivatives nd public sa sharealike".split())
#: Words before a notice that deny it (fixed values).
DENIALS = frozenset("not never neither isn wasn aren cannot".split())
#: What a candidate block holds, in lower case (fixed values).
HINTS = ("licen", "copyright", "(c)", "©", "rights reserved", "permission", "warrant", "redistribut", "public domain", "creative commons", "spdx", "cc by", "cc-by", "cc0", "apache", "mozilla", "gnu ")
_HINT = re.compile("|".join(re.escape(h.strip()).replace(r"\ ", r"[\W_]+") for h in HINTS), re.I)
_TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*|\{\}")
#: The share of a template's words that must be equal.
EQUAL = 0.9
#: Words that {} stands for at most, so that a block has a length.
WILD = 40


@cache
def _templates() -> list[tuple[str, str, tuple[str, ...], zstandard.ZstdCompressor]]:
    out = []
    for name, texts in TEMPLATES.items():
        for t in texts:
            words = tuple(_TOKEN.findall(t.lower()))
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, t, words, zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False, write_checksum=False)))
    return out


@cache
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)


@cache
def _shapes() -> list[tuple[Counter, int, int]]:
    """Of each template: its words, how many of them a block holds at least, and how long a block is at most."""
    out = []
    for _, _, words, _ in _templates():
        fixed = Counter(w for w in words if w != "{}")
        least = next(k for k in range(fixed.total() + 1) if 1 - (fixed.total() - k) / fixed.total() >= EQUAL)
        out.append((fixed, least, len(words) + _extra(words) + WILD * words.count("{}")))
    return out


def _extra(words: tuple[str, ...]) -> int:
    """Words of others that may stand inside a template's."""
    return int(max(1, (1 - EQUAL) * len(words)))


def regions(text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    """Spans of words that a template's words around a hint may take; none overlap."""
    reach = max(length for _, _, length in _shapes())
    now = None
    for m in _HINT.finditer(text):
        a, b = max(0, bisect_left(starts, m.start()) - reach), min(len(starts), bisect_left(starts, m.end()) + reach)
        if now and a <= now[1]:
            now = (now[0], b)
        else:
            if now:
                yield now
            now = (a, b)
    if now:
        yield now


def places(words: list[str], shape: tuple[Counter, int, int]) -> Iterator[list[tuple[int, int]]]:
    """Runs of (words of the template, start) over the stretches of a block's length that hold enough of its words."""
    fixed, enough, length = shape
    left, held, run = dict(fixed), 0, []
    for end in range(len(words) + length - 1):
        if end < len(words) and (w := words[end]) in left:
            left[w] -= 1
            held += left[w] >= 0
        at = end - length + 1
        if held >= enough:
            run.append((-held, at))
        elif run:
            yield run
            run = []
        if at >= 0 and (w := words[at]) in left:
            held -= left[w] >= 0
            left[w] += 1
    if run:
        yield run


def differences(words: list[str], template: tuple[str, ...]) -> tuple[float, list[str], list[str]]:
    """(share of the template's words found in order, words missing, words between them that aren't its own)."""
    m = SequenceMatcher(None, template, words, autojunk=False)
    got = [b for b in m.get_matching_blocks() if b.size]
    if not got:
        return 0.0, list(template), []
    missing, added = [], []
    for op, i, j, a, b in m.get_opcodes():
        if op == "equal" or "{}" in template[i:j]:
            continue
        missing += template[i:j]
        if 0 < i and j < len(template):  # what stands before or after the notice isn't part of it
            added += words[a:b]
    fixed = sum(w != "{}" for w in template)
    return 1 - len(missing) / fixed, missing, added


def saved(block: str, i: int) -> tuple[int, int]:
    """(bytes by which a block gets smaller with the template ``i`` as the dictionary, its bytes alone), both compressed."""
    raw = block.encode()
    alone = len(_plain().compress(raw))
    return alone - len(_templates()[i][3].compress(raw)), alone


@lru_cache(16_384)
def judge(block: str, i: int) -> tuple[int, int, tuple, dict] | None:
    """Where the template ``i`` stands in a block of words, its rank among templates by bytes saved, and its verdict; None if it doesn't."""
    if saved(block, i)[0] <= 0:
        return None
    words = block.split()
    name, _, template, _ = _templates()[i]
    equal, missing, added = differences(words, template)
    if equal < EQUAL or len(added) > _extra(template) or not TELLING.isdisjoint((Counter(missing) - Counter(added)) | (Counter(added) - Counter(missing))):
        return None
    got = [b for b in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if b.size]
    start, end = got[0].b, got[-1].b + got[-1].size
    less, alone = saved(" ".join(words[start:end]), i)
    if less <= 0:
        return None
    return start, end, (less, not missing and not added, len(template), i), {"license": name, "reduction": round(less / alone, 6), "missing": missing, "added": added}


def scan_text(text: str) -> list[dict]:
    """License notices of a whole text: span, license, reduction and differences of each confirmed block."""
    low = text.lower()
    if not any(h.split()[0] in low for h in HINTS) or not _HINT.search(text):
        return []
    tokens = [(m.start(), m.end(), m[0].lower()) for m in _TOKEN.finditer(text)]
    starts, fits = [t[0] for t in tokens], []
    for a, b in regions(text, starts):
        words = [t[2] for t in tokens[a:b]]
        known = set(words)
        for i, shape in enumerate(_shapes()):
            if sum(w not in known for w in shape[0]) > shape[0].total() - shape[1]:
                continue
            for run in places(words, shape):
                taken: list[tuple[int, int]] = []
                for _, at in sorted(run):
                    lo, hi = max(0, at), at + shape[2]
                    # a later copy starts where the one before it ends
                    lo = max([lo, *(e for s, e in taken if s <= lo < e)])
                    hi = min([hi, *(s for s, e in taken if lo < s)])
                    if (got := judge(" ".join(words[lo:hi]), i)) and DENIALS.isdisjoint(words[max(0, lo + got[0] - 2) : lo + got[0]]) and not any(s < lo + got[1] and lo + got[0] < e for s, e in taken):
                        taken.append((lo + got[0], lo + got[1]))
                        fits.append((got[2], a + lo + got[0], a + lo + got[1], got[3]))
    # what {} stands for holds no other license's notice
    fixed = sorted((s, v["license"]) for r, s, _, v in fits if "{}" not in _templates()[r[3]][2])
    fits = [f for f in fits if "{}" not in _templates()[f[0][3]][2] or all(v == f[3]["license"] for _, v in fixed[bisect_left(fixed, (f[1],)) : bisect_left(fixed, (f[2],))])]
    found: list[tuple[int, int, dict]] = []
    for _, s, e, verdict in sorted(fits, key=lambda f: (f[0], -f[1]), reverse=True):
        at = bisect_left(found, s, key=lambda f: f[0])
        if (at == 0 or found[at - 1][1] <= s) and (at == len(found) or found[at][0] >= e):
            found.insert(at, (s, e, verdict))
    return [{"start": starts[s], "end": tokens[e - 1][1], **verdict} for s, e, verdict in found]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, notices), a row for each row of ``docs``: notices is an array of spans in code points, with license, reduction and differences.

    Null and empty texts have no notices, nor have blocks that no template compresses, or
    that differ from all templates in wording by more than a tenth or in a word that tells licenses apart, nor notices that a word
    before them denies. The opening of the BSD licenses alone is BSD. A span goes from a notice's first word to its last,
    over any number of lines. Repeated rows and null ids are kept; other columns are ignored.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    notice = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            yield pa.record_batch([b.column(0), pa.array([scan_text(t or "") for t in b.column(1).to_pylist()], notice)], ["id", "notices"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, notices array<struct<start: long, end: long, license: string, reduction: double, missing: array<string>, added: array<string>>>")
