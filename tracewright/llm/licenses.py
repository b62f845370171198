"""Licence texts in documents, by the Dice coefficient over word bigrams.

Documents and templates are normalised: lower case, words of letters and digits. With ``anywhere``, every
window of a document's words is compared, whatever its lines and sentences: a window of the best coefficient
begins and ends with a bigram of the template, so only such are looked at, and those only where enough of the
template's bigrams lie within the sizes that can reach the threshold. Without, compared are the
sentences and lines of a document (it is cut at line breaks and after a full stop that white space
follows) and runs of them, as long as the largest template allows. Each is a bag of word bigrams;
its Dice coefficient with a template is twice the number of shared bigrams by the sum of both sizes. At
a threshold t, sizes x and y can reach it only if x >= y * t / (2 - t) and the reverse; so templates are
kept by size, and a run looks at those within the bounds alone. A bigram index leaves out runs without
any bigram of a template: their coefficient is 0.

The result is every template found in a document, with the best coefficient and the first run that has
it. Of runs that overlap, each template counts by itself.

``start`` and ``end`` are those of the best window; of equal ones, the first that begins, then the first that ends.

Defined cases: a null id, a null, empty or blank text has no licence; texts of one word have no bigrams
and none either; equal templates are reported by the first name; rows that share an id are scanned each
and the best is reported. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, number
from .kernels import NOT_ALNUM, U, batch_blocks, byte_prefix, hash_spans, mix, spans

THRESHOLD = 0.8
#: Short notices by SPDX name. Further templates are a parameter.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole licence texts, which only windows of words can hold.
FULL_TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.

""" + _BSD_END),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)


def words_of(text: str) -> list[str]:
    """Words as the kernels take them: runs of ASCII letters, digits and bytes beyond ASCII."""
    raw = text.lower().encode()
    return "".join(" " if b < 128 and NOT_ALNUM[b] else chr(b) for b in raw).split()


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Templates:
    """Bags of bigram hashes, sorted by size, and which bigrams any of them has."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        seen: dict[tuple, tuple[str, Counter]] = {}
        for name, text in templates:
            data = np.frombuffer(text.lower().encode(), np.uint8)
            h = bigrams(data, np.array([0, len(data)]))[0]
            if len(h):
                bag = Counter(h.tolist())
                key = tuple(sorted(bag.items()))
                if key not in seen or name < seen[key][0]:
                    seen[key] = (name, bag)
        self.all = sorted(seen.values(), key=lambda t: (t[1].total(), t[0]))
        self.sizes = [bag.total() for _, bag in self.all]
        self.known = np.array(sorted({h for _, bag in self.all for h in bag}), U)
        self.own = [(np.searchsorted(self.known, np.array(sorted(bag), U)), np.array([bag[h] for h in sorted(bag)])) for _, bag in self.all]
        self.threshold = threshold
        self.bound = threshold / (2 - threshold)

    def best(self, bag: Counter, size: int) -> list[tuple[str, float]]:
        """(name, coefficient) of the templates that reach the threshold."""
        lo, hi = bisect_left(self.sizes, size * self.bound - 1e-9), bisect_right(self.sizes, size / self.bound + 1e-9)
        found = ((name, dice(bag, t)) for name, t in self.all[lo:hi])
        return [(name, d) for name, d in found if d >= self.threshold]


def bigrams(data: np.ndarray, offsets: np.ndarray):
    """Hash and first word of each bigram, words' starts and ends, and each document's first word."""
    starts, ends, first = spans(data, offsets, NOT_ALNUM)
    h = hash_spans(byte_prefix(data), starts, ends)
    pair = mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else np.zeros(0, U)
    ok = np.ones(len(pair), bool)
    inner = first[1:-1]
    inner = inner[(inner > 0) & (inner < len(h))]
    ok[inner - 1] = False
    at = np.flatnonzero(ok)
    return pair[at], at, starts, ends, first


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a line or sentence begins, the documents' ends included."""
    after = np.zeros(len(data) + 1, bool)
    after[offsets] = True
    if len(data):
        after[1:] |= data == 10
        stop = (data[:-1] == 46) & ((data[1:] == 32) | (data[1:] == 10))
        after[1:-1] |= stop
    return np.flatnonzero(after)


def _scan(known: Templates, data: np.ndarray, offsets: np.ndarray):
    """(document, name, coefficient, start byte, end byte) of each template that a run reaches."""
    h, at, starts, ends, first = bigrams(data, offsets)
    if not len(h) or not len(known.known):
        return
    place = np.minimum(np.searchsorted(known.known, h), len(known.known) - 1)
    hit = at[known.known[place] == h]
    if not len(hit):
        return
    edge = cuts(data, offsets)
    part_first = np.searchsorted(starts, edge)  # first word of each part
    doc_of = np.searchsorted(offsets, edge[:-1], side="right") - 1
    largest = known.sizes[-1] / known.bound
    # the parts from which a run may reach a known bigram
    near = np.zeros(len(part_first) + 1, np.int64)
    np.add.at(near, np.searchsorted(part_first, hit - int(largest)), 1)
    np.add.at(near, np.searchsorted(part_first, hit + 1, side="right"), -1)
    begins = np.flatnonzero(np.cumsum(near) > 0)
    for p in begins[begins < len(doc_of)].tolist():
        for q in range(p + 1, len(doc_of) + 1):
            if doc_of[q - 1] != doc_of[p]:
                break
            a, b = int(part_first[p]), int(part_first[q])
            if q > p + 1 and (part_first[q] == part_first[q - 1] or part_first[p + 1] == a):
                continue  # a part without words adds nothing
            if b - a - 1 > largest:
                break
            if b - a < 2:
                continue
            lo = int(np.searchsorted(at, a))
            own = h[lo : lo + b - a - 1]
            for name, d in known.best(Counter(own.tolist()), len(own)):
                yield int(doc_of[p]), name, d, int(starts[a]), int(ends[b - 1])


def _scan_words(known: Templates, data: np.ndarray, offsets: np.ndarray):
    """(document, name, coefficient, start byte, end byte) of the best window of words for each template."""
    h, at, starts, ends, first = bigrams(data, offsets)
    if not len(h) or not len(known.known):
        return
    place = np.minimum(np.searchsorted(known.known, h), len(known.known) - 1)
    hit = known.known[place] == h
    at, place = at[hit], place[hit]
    doc = np.searchsorted(first, at, side="right") - 1
    copies = np.zeros(len(known.known), np.int64)
    for (name, _), size, (own, counts) in zip(known.all, known.sizes, known.own, strict=True):
        copies[own] = counts
        n = copies[place]
        copies[own] = 0
        mine = np.flatnonzero(n)
        need = max(1, math.ceil(size * known.bound - 1e-9))
        if len(mine) < need:
            continue
        a, d, n = at[mine], doc[mine], n[mine]
        largest = int(size / known.bound + 1e-9)
        begins = np.flatnonzero((a[need - 1 :] - a[: len(a) - need + 1] < largest) & (d[need - 1 :] == d[: len(d) - need + 1]))
        if not len(begins):
            continue
        stop = np.minimum(np.searchsorted(a, a[begins] + largest), np.searchsorted(d, d[begins], side="right"))
        # a bigram counts in a window from i on if the one as many copies before it as the template has lies before i
        order = np.argsort(place[mine], kind="stable")
        nth, same = np.arange(len(order)) - n[order], place[mine][order]
        earlier = np.full(len(order), -1)
        has = nth >= 0
        has[has] = same[nth[has]] == same[has]
        earlier[order[has]] = order[nth[has]]
        best: dict[int, tuple[float, int, int]] = {}
        for i, j in zip(begins.tolist(), stop.tolist(), strict=True):
            shared = np.cumsum(earlier[i:j] < i)
            if shared[-1] < need:
                continue
            score = 2 * shared / (a[i:j] - a[i] + 1 + size)
            k = int(score.argmax())
            if score[k] >= known.threshold and ((old := best.get(int(d[i]))) is None or score[k] > old[0]):
                best[int(d[i])] = (float(score[k]), i, i + k)
        for where, (score, i, k) in best.items():
            yield where, name, score, int(starts[a[i]]), int(ends[a[k] + 1])


def _scanned(templates, threshold: float, anywhere: bool):
    def run(batches):
        known = Templates(templates, threshold)
        for batch, i, j, low, offsets in batch_blocks(batches, "text", lower=True):
            best: dict[tuple[int, str], tuple[float, int, int]] = {}
            for doc, name, d, a, b in (_scan_words if anywhere else _scan)(known, low, offsets):
                old = best.get((doc, name))
                if old is None or (-d, a, b) < (-old[0], old[1], old[2]):
                    best[doc, name] = (d, a, b)
            lead = np.append(0, np.cumsum((low & 0xC0) != 0x80))
            rows = [(i + doc, name, d, int(lead[a] - lead[offsets[doc]]), int(lead[b] - lead[offsets[doc]])) for (doc, name), (d, a, b) in best.items()]
            at, *cols = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "license", "dice", "start", "end"])

    return run


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, anywhere: bool = False) -> DataFrame:
    """(doc_id, license, dice, start, end): each licence of a document, and the characters of its best run, or
    with ``anywhere`` of its best window of words."""
    src = docs.select(number(docs, id_col).alias("id"), column(docs, text_col).alias("text")).where("id is not null and text is not null")
    each = src.mapInArrow(_scanned(tuple(templates), threshold, anywhere), "doc_id long, license string, dice double, start long, end long")
    first = F.min(F.struct((-F.col("dice")).alias("d"), "start", "end")).alias("m")
    return each.groupBy("doc_id", "license").agg(first).select("doc_id", "license", (-F.col("m.d")).alias("dice"), "m.start", "m.end")
