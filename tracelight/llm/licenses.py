"""License scans: passages against licence templates by the Dice coefficient over word bigrams.

A passage is any run of a document's words. The Dice coefficient of a passage
with a template is twice the number of bigrams they share (as multisets) over
the number of bigrams of both. It can reach a threshold t only if the passage
has between t / (2 - t) and (2 - t) / t times the template's bigrams and shares
at least t / (2 - t) of them: templates that a document has too few bigrams
for, by size or by shared bigrams, are passed over, and passages of other sizes
are never compared.

The best passage begins and ends with a shared bigram, so only those are tried.
Of matches that overlap, the one that shares most stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelight.llm.common import slices, table, with_ids

#: Name and text of each template: short notices, header notices and whole short licences.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
BSD_2 = NOTICES[7][1].split("Neither the name")[0]
GNU = (
    ("GPL-1.0", "General", "1"), ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.0", "Library General", "2"),
    ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"),
)
CC = ("Attribution", "BY"), ("ShareAlike", "SA"), ("NonCommercial", "NC"), ("NoDerivatives", "ND")
CC_PARTS = (0,), (0, 1), (0, 2), (0, 3), (0, 2, 1), (0, 2, 3)
CC_VERSIONS = ("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")


def siblings() -> list[tuple[str, str]]:
    """Templates of the other common licences and versions, so that a notice isn't named after its sibling."""
    out = []
    for name, kind, version in GNU:
        out += [
            (name, f"This work is licensed under the GNU {kind} Public License, version {version}."),
            (name, NOTICES[6][1].replace("GNU General", f"GNU {kind}").replace("version 3 of", f"version {version} of")),
        ]
        if kind.startswith(("Lesser", "Library")):
            out[-1] = (name, out[-1][1].replace("This program", "This library"))
    for parts in CC_PARTS:
        short, long = ("-".join(CC[i][k] for i in parts) for k in (1, 0))
        for version, kind in CC_VERSIONS:
            out += [
                (f"CC-{short}-{version}", f"Licensed under CC {short} {version}."),
                (f"CC-{short}-{version}", f"This work is licensed under a Creative Commons {long} {version} {kind} License."),
            ]
    for version in ("1.0", "1.1", "2.0"):
        out.append((f"Apache-{version}", f"Licensed under the Apache License, Version {version}."))
        out.append((f"MPL-{version}", f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {version}."))
        out.append((f"MPL-{version}", f"Licensed under the Mozilla Public License, Version {version}."))
    for version in ("1.0", "2.0"):
        out.append((f"EPL-{version}", f"Licensed under the Eclipse Public License, Version {version}."))
    for name, called in (
        ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("Unlicense", "Unlicense"),
        ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("0BSD", "BSD Zero Clause License"),
    ):
        out.append((name, f"Released under the {called}."))
    out += [
        ("CC0-1.0", "Licensed under CC0 1.0."),
        ("BSD-2-Clause", BSD_2),
        ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
        (
            "Unlicense",
            """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
            sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
            non-commercial, and by any means.""",
        ),
        (
            "BSL-1.0",
            "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        ),
    ]
    return out


TEMPLATES: tuple[tuple[str, str], ...] = (*NOTICES, *(x for x in siblings() if x not in NOTICES))
#: Least Dice coefficient of a match.
THRESHOLD = 0.8

WORD = re.compile(r"\w+(?:[.]\w+)*")


def words(text: str) -> list[str]:
    """The normalised words: lower case, without punctuation but for points inside (version numbers)."""
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    name: str
    number: int
    #: how often it has each bigram, by the bigram's number
    grams: dict[int, int]
    size: int
    #: bounds on the number of a passage's bigrams; the lower one holds for shared bigrams, too
    least: float
    most: float


class Scanner:
    """Templates compiled for scanning. Those of fewer than two words have no bigram and are left out."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold is above 0 and at most 1")
        self.threshold = threshold
        self.vocabulary: dict[str, int] = {}
        numbers: dict[tuple[int, int], int] = {}
        self.templates: list[Template] = []
        for i, (name, text) in enumerate(templates):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            grams = Counter(numbers.setdefault(g, len(numbers)) for g in zip(ids, ids[1:]))
            n = grams.total()
            if n:
                self.templates.append(Template(name, i, dict(grams), n, n * threshold / (2 - threshold), n * (2 - threshold) / threshold))
        #: bigrams in order of their code, and the number of each
        codes = np.array([a * len(self.vocabulary) + b for a, b in numbers], np.int64)
        order = np.argsort(codes)
        self.codes, self.numbers = codes[order], order.astype(np.int64)
        self.least = np.array([t.least for t in self.templates])
        self.member = np.zeros((len(self.templates), len(numbers)), bool)
        for k, t in enumerate(self.templates):
            self.member[k, list(t.grams)] = True

    def matches(self, text: str | None) -> list[tuple[int, int, float, Template]]:
        """First word, number of words, Dice coefficient and template of each match, in the text's order."""
        found = words(text or "")
        if len(found) < 2 or not self.templates:
            return []
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, count=len(found))
        known = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if not len(known):
            return []
        code = ids[known] * len(self.vocabulary) + ids[known + 1]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        places, grams = known[hit], self.numbers[at[hit]]
        out: list[tuple[int, int, float, Template]] = []
        counts = self.member[:, grams].sum(axis=1)
        for k in np.flatnonzero((counts >= self.least) & (len(found) - 1 >= self.least)).tolist():
            own = self.member[k, grams]
            out += self.passages(places[own], grams[own], self.templates[k])
        # the most shared bigrams, and of as many the closer template
        out.sort(key=lambda m: (-round(m[2] * (m[1] - 1 + m[3].size) / 2), -m[2], m[0], m[3].number))
        taken, kept = np.zeros(len(found), bool), []
        for m in out:
            if not taken[m[0] : m[0] + m[1]].any():
                taken[m[0] : m[0] + m[1]] = True
                kept.append(m)
        return sorted(kept, key=lambda m: m[0])

    def passages(self, places: np.ndarray, grams: np.ndarray, t: Template) -> list[tuple[int, int, float, Template]]:
        """From left to right, the best passage from each place that can begin one, none overlapping the one before."""
        ends = np.searchsorted(places, places + int(t.most), side="left")
        starts = np.flatnonzero(ends - np.arange(len(places)) >= t.least)
        place, gram = places.tolist(), grams.tolist()
        out, free = [], 0
        for i in starts.tolist():
            if place[i] < free:
                continue
            best = self.best_from(place, gram, i, int(ends[i]), t)
            if not best:
                continue
            # a later beginning inside this passage may be better
            for j in range(i + 1, int(ends[i])):
                if place[j] + t.least > best[0] + best[1]:
                    break
                other = self.best_from(place, gram, j, int(ends[j]), t)
                if other and other[2] > best[2]:
                    best = other
            out.append(best)
            free = best[0] + best[1]
        return out

    def best_from(self, place: list[int], gram: list[int], i: int, end: int, t: Template) -> tuple[int, int, float, Template] | None:
        left, shared, best = dict(t.grams), 0, None
        for j in range(i, end):
            if left[gram[j]]:
                left[gram[j]] -= 1
                shared += 1
                size = place[j] - place[i] + 1
                value = 2 * shared / (size + t.size)
                if value >= self.threshold and (best is None or value > best[2]):
                    best = (place[i], size + 1, value, t)
        return best


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row per match: ``doc_id``, ``license``, ``template`` (its number), ``dice``, ``first_word``, ``n_words``, ``passage`` (normalised).

    Whole texts are read once and never shuffled. Null and empty texts, and
    texts without a match, give no row; rows that repeat give theirs again; no
    rows give no rows; extra columns are ignored. The templates are a parameter of the operator,
    not a table, and go along with the tasks.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())

    def batches(it):
        for batch in slices(it):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i, text in zip(ids, texts):
                if found := shipped.value.matches(text):
                    own = words(text)
                    rows += [(i, t.name, t.number, d, a, n, " ".join(own[a : a + n])) for a, n, d, t in found]
            columns = zip(*rows) if rows else [[]] * len(SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    kinds = "doc_id long, license string, template int, dice double, first_word long, n_words long, passage string"
    return with_ids(docs, "doc_id", "text").mapInArrow(batches, kinds)


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("dice", pa.float64()),
        ("first_word", pa.int64()), ("n_words", pa.int64()), ("passage", pa.string()),
    ]
)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
