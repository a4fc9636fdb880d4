"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are runs of letters and digits, lower-cased; a shingle is ``SHINGLE`` consecutive words.  A template of L shingles belongs to the
smallest scale s >= L (4, 8, 16, ... shingles).  At each scale in use a document is cut into windows of 2 s shingles, s apart,
so every run of up to s + 1 shingles lies whole in some window.  Windows and templates have ``BANDS`` MinHash values, each a
band of its own: a window that holds a template whole has similarity L / 2 s to it, at least 1/8 for the shortest (one shingle) and above
1/4 from four shingles on, and shares a band with probability 1 - (1 - 1/8)^64 > 0.9998 (> 0.99999998 from four on).
Minima of blocks of s shingles serve all windows: a window is two blocks, a block of the next scale is two of this one.

A retrieved (window, template) pair is verified exactly: the share of the template's distinct shingles that the window holds must reach
``CONTAINMENT``.  Of matches of one family (``family_of``) that overlap in a document the one with the largest share stays (ties: the longer
template, then the first name), so the header of one license is not reported as that of its near relative too.  The templates (bounded: a parameter) go to the tasks; nothing is shuffled.  Very long documents are
cut into windows like any other.

Null and empty texts, and texts shorter than a shingle, match nothing.  A null id stays null.  Rows that repeat are reported each.  No
table rows or no template: no result row.  Columns other than id and text are not read.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import WordHashes, mix, small_batches, window_hashes

SHINGLE, BANDS, CONTAINMENT, SMALLEST = 3, 64, 0.8, 4
#: Shingles handled at once.
PART = 1 << 16

#: Notices and opening paragraphs of public licenses, word for word.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-notice": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "isc-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "lgpl-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "bsd-3-clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "zlib-notice": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
        "it and redistribute it freely, subject to the following restrictions:"
    ),
    "bsl-1.0-notice": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"
    ),
    "cc-by-nd-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def family_of(license_id: str) -> str:
    """Licenses whose notices differ in a few words: of one passage only the best match of a family counts."""
    return "gpl" if "gpl-" in license_id else license_id.split("-")[0]

_WORD = re.compile(rb"(?:[a-z0-9]|[\xc3-\xf4][\x80-\xbf]+)+")
_rng = np.random.default_rng(20240301)
_MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))
    return mix(window_hashes(hashes.of(words), SHINGLE)) if len(words) >= SHINGLE else np.empty(0, np.uint64)


def _permuted(values: np.ndarray, band: int) -> np.ndarray:
    v = values * _MULTIPLIERS[band]
    return v ^ (v >> np.uint64(31))


class Templates:
    """Templates by scale: shingle sets and, per band, the minimum of each."""

    def __init__(self, texts: dict[str, str]):
        hashes = WordHashes()
        self.sets = {name: np.unique(shingles(text, hashes)) for name, text in texts.items()}
        self.sets = {name: s for name, s in self.sets.items() if len(s)}
        self.scales: dict[int, list[str]] = {}
        for name, s in self.sets.items():
            length, scale = len(shingles(texts[name], hashes)), SMALLEST
            while scale < length:
                scale *= 2
            self.scales.setdefault(scale, []).append(name)
        self.top = max(self.scales, default=0)
        self.values, self.filters = {}, {}
        for scale, names in self.scales.items():
            for band in range(BANDS):
                low = np.array([_permuted(self.sets[n], band).min() for n in names], np.uint64)
                self.values[scale, band] = low
                bits = np.zeros(1 << 16, bool)  # of the upper 16 bits: most windows stop here
                bits[(low >> np.uint64(48)).astype(int)] = True
                self.filters[scale, band] = bits


def retrieve(values: np.ndarray, sizes: np.ndarray, templates: Templates) -> set[tuple[int, int, int, str]]:
    """(document, scale, window, template) that share a band; ``values`` are the shingles of all documents in a row."""
    found: set[tuple[int, int, int, str]] = set()
    # blocks of the smallest scale, none across a document's end
    number = -(-sizes // SMALLEST)
    begin = np.cumsum(sizes) - sizes
    doc0 = np.repeat(np.arange(len(sizes)), number)
    index0 = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    starts = begin[doc0] + index0 * SMALLEST
    for band in range(BANDS):
        low, doc, index, scale = np.minimum.reduceat(_permuted(values, band), starts), doc0, index0, SMALLEST
        while True:
            if scale in templates.scales:
                window = low.copy()
                same = doc[1:] == doc[:-1]
                window[:-1] = np.where(same, np.minimum(low[:-1], low[1:]), low[:-1])
                for j in np.flatnonzero(templates.filters[scale, band][(window >> np.uint64(48)).astype(np.int64)]):
                    for name, value in zip(templates.scales[scale], templates.values[scale, band], strict=True):
                        if value == window[j]:
                            found.add((int(doc[j]), scale, int(index[j]), name))
            if scale >= templates.top:
                break
            pair = np.flatnonzero(index % 2 == 0)
            low = np.minimum.reduceat(low, pair)
            doc, index, scale = doc[pair], index[pair] // 2, scale * 2
    return found


def _verify(found, values: np.ndarray, sizes: np.ndarray, templates: Templates) -> dict[tuple[int, str], tuple[float, int]]:
    """Best containment and the first word of the best window, by (document, template)."""
    begin = np.cumsum(sizes) - sizes
    best: dict[tuple[int, str], tuple[float, int]] = {}
    matches: dict[tuple[int, str], list[tuple]] = {}
    for doc, scale, window, name in sorted(found):
        at = window * scale
        part = values[begin[doc] + at : begin[doc] + min(at + 2 * scale, sizes[doc])]
        want = templates.sets[name]
        share = float(np.isin(want, part).sum()) / len(want)
        if share >= CONTAINMENT:
            matches.setdefault((doc, family_of(name)), []).append((-share, -len(want), name, at, at + 2 * scale))
    for (doc, _), some in matches.items():
        taken: list[tuple[int, int]] = []
        for share, _, name, a, b in sorted(some):
            if not any(a < d and c < b for c, d in taken):
                taken.append((a, b))
                if -share > best.get((doc, name), (0.0, 0))[0]:
                    best[doc, name] = (-share, a)
    return best


def _scan(batches, texts: dict[str, str]):
    templates, hashes = Templates(texts), WordHashes()
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "license_id": [], "containment": [], "start_word": []}
        ids, group, size = batch.column(0).to_pylist(), [], 0

        def scan(group):
            values, sizes = np.concatenate([s for _, s in group]), np.array([len(s) for _, s in group], np.int64)
            best = _verify(retrieve(values, sizes, templates), values, sizes, templates)
            for (doc, name), (share, at) in sorted(best.items()):
                for column, value in zip(out.values(), (ids[group[doc][0]], name, share, at), strict=True):
                    column.append(value)

        for i, text in enumerate(batch.column(1).to_pylist() if templates.sets else []):
            s = shingles(text, hashes)
            if len(s):
                group.append((i, s))
                size += len(s)
            if size >= PART:
                scan(group)
                group, size = [], 0
        if group:
            scan(group)
        types = (pa.int64(), pa.string(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def template_table(table: DataFrame, id_col: str = "license_id", text_col: str = "text", limit: int = 10_000) -> dict[str, str]:
    """Templates from a table of full texts or headers; it goes to every task, so it may have ``limit`` rows at most."""
    rows = table.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} templates")
    return dict(sorted((r["i"], r["t"]) for r in rows))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, license_id, containment, start_word`` of every license that a document holds."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run = partial(_scan, texts=TEMPLATES if templates is None else templates)
    return rows.mapInArrow(run, "doc_id long, license_id string, containment double, start_word long")
