"""Licence scan by conditional compression.

Lines that speak of a licence, with as many words around them as the longest template
has, are compressed alone and, for each licence template of which a part stands there
unchanged, with the template as a zstandard raw dictionary. The templates are ranked by
how much smaller the block becomes with them and confirmed, in that order, by the exact
differences in wording between template and block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bound_batches
from .textbytes import runs

#: Texts: fixed wordings of public licences, or of the notices that they ask for.
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
}
#: Names of public licences: fixed values.
NAMES = {
    "0BSD": ("Zero-Clause BSD License",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3.0"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3.0"),
    "MIT": ("MIT License", "MIT Licence", "Expat License"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL",),
    "Zlib": ("zlib License",),
}
#: What a Creative Commons licence may ask for, its name in full, and the versions: fixed values.
CC_TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
#: How notices name a licence: fixed values.
FRAMES = ("under {}", "under the {}", "under a {}", "under the terms of the {}", "subject to the terms of the {}", "available under the {}", "licence is the {}")


def notices() -> dict[str, str]:
    """A template for each frame, name and version."""
    named = {k: list(v) for k, v in NAMES.items()}
    for term, full in CC_TERMS.items():
        for version in CC_VERSIONS:
            kind = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            named[f"CC-{term}-{version}"] = [f"CC {term} {version}", f"Creative Commons {full} {version} {kind} License", f"Creative Commons {full} {version}"]
    return {f"{licence}-notice/{i}.{j}": frame.format(name) for licence, names in named.items() for i, name in enumerate(names) for j, frame in enumerate(FRAMES)}


#: Texts and notices by name; what follows a slash tells forms of one notice apart.
TEMPLATES = TEXTS | notices()
#: Lines with one of these words, and the words around them that one template may take up, are scanned.
TRIGGER = re.compile(r"licen[cs]e|\bcc[ -]?(?:by|0)\b|\b(?:[al]?gpl|mpl|wtfpl|eupl)\b|copyright|permission|warrant|redistribut|public domain|creative commons|as is\b|gnu general", re.I | re.A)
#: Lines without such a word that may lie inside a block that is counted.
GAP_LINES = 2
#: Share of a template's words that may be missing or added.
TOLERANCE = 0.1
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
LEVEL = 3


@dataclass
class Template:
    name: str
    words: list[str]
    compressor: object
    own: int
    #: Words that may be missing or added: none of a notice, where one word tells licences apart.
    most: int


@lru_cache(maxsize=1)
def _compressors(items: tuple[tuple[str, str], ...]) -> tuple[list[Template], object]:
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    alone = zstandard.ZstdCompressor(compression_params=params)
    out = []
    for name, text in items:
        raw = zstandard.ZstdCompressionDict(normal(text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(Template(name, words_of(text), zstandard.ZstdCompressor(compression_params=params, dict_data=raw), len(alone.compress(normal(text).encode())), 0 if "/" in name else int(TOLERANCE * len(words_of(text)))))
    return out, alone


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def normal(text: str) -> str:
    return " ".join(words_of(text))


def n_blocks(text: str) -> int:
    """Candidate blocks: runs of trigger lines with at most ``GAP_LINES`` others between."""
    hits = [i for i, line in enumerate(text.split("\n")) if TRIGGER.search(line)]
    return sum(b - a > GAP_LINES + 1 for a, b in zip(hits, hits[1:], strict=False)) + bool(hits)


def blocks(text: str, context: int) -> Iterator[list[tuple[int, str]]]:
    """What is scanned: each word with its line, of trigger lines and ``context`` words on both sides, as far as these meet."""
    placed: list[tuple[int, str]] = []
    spans: list[list[int]] = []
    for i, line in enumerate(text.split("\n")):
        begin = len(placed)
        placed += [(i, w) for w in words_of(line)]
        if TRIGGER.search(line):
            low, high = max(begin - context, 0), len(placed) + context
            if spans and low <= spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
    yield from (placed[a:b] for a, b in spans if placed[a:b])


def rank(words: list[str], templates: list[Template], alone: object) -> list[tuple[float, Template]]:
    """Templates by bytes of the block's size that they save, the most first, with the share of their own size; ties by share and name.

    None is left out: in a long block a short notice may save next to nothing.
    """
    raw = " ".join(words).encode()
    base = len(alone.compress(raw))
    saved = [(base - len(t.compressor.compress(raw)), t) for t in templates]
    ranked = sorted((-n, -n / t.own, t.name, t) for n, t in saved)
    return [(-share, t) for _, share, _, t in ranked]


def pieces(template: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """Places and words of as many parts as a copy may have differences, and one: a copy has one of them unchanged."""
    n = most + 1
    bounds = [len(template) * i // n for i in range(n + 1)]
    yield from ((a, template[a:b]) for a, b in zip(bounds, bounds[1:], strict=False) if a < b)


def seeds(template: list[str], most: int, words: list[str], places: dict[str, list[int]]) -> list[tuple[int, int, int]]:
    """Where parts of the template stand unchanged: place and end of the part, and where the template would begin."""
    return sorted((at, at + len(part), at - off) for off, part in pieces(template, most) for at in places.get(part[0], ()) if words[at : at + len(part)] == part)


def differences(template: list[str], words: list[str | None]) -> tuple[int, int, int, int]:
    """Of the alignment with the fewest: template words that are missing, words added between, and the first and last aligned word."""
    # Best of each end: missing + added, missing, first and last aligned word (-1: none yet).
    row = [(0, 0, -1, -1)] * (len(words) + 1)
    for i, t in enumerate(template, 1):
        new = [(i, i, -1, -1)]
        for j, w in enumerate(words, 1):
            up, left, over = row[j], new[-1], row[j - 1]
            best = (up[0] + 1, up[1] + 1, up[2], up[3])
            if left[2] >= 0 and left[0] + 1 < best[0]:
                best = (left[0] + 1, *left[1:])
            if t == w and over[0] <= best[0]:
                best = (over[0], over[1], j - 1 if over[2] < 0 else over[2], j - 1)
            new.append(best)
        row = new
    total, missing, first, last = min(row, key=lambda x: x[0])
    return missing, total - missing, first, last


def wording(template: list[str], words: list[str]) -> str:
    """The exact differences: words of the template that are missing (-) and others (+), in order, of the shortest such list."""
    # Least differences of each pair of ends.
    cost = [[i + j if not i or not j else 0 for j in range(len(words) + 1)] for i in range(len(template) + 1)]
    for i, t in enumerate(template, 1):
        for j, w in enumerate(words, 1):
            cost[i][j] = cost[i - 1][j - 1] if t == w else 1 + min(cost[i - 1][j], cost[i][j - 1])
    out, i, j = [], len(template), len(words)
    while i or j:
        if i and j and template[i - 1] == words[j - 1]:
            i, j = i - 1, j - 1
        elif i and (not j or cost[i - 1][j] <= cost[i][j - 1]):
            i -= 1
            out.append("-" + template[i])
        else:
            j -= 1
            out.append("+" + words[j])
    return " ".join(reversed(out))


def scan_text(text: str, templates: list[Template], alone: object) -> list[tuple[str, int, int, float, int, int, str]]:
    """Confirmed licences: name, first and last line, reduction, missing and extra words, the differences in wording; in order of place."""
    found = []
    longest = max((len(t.words) for t in templates), default=0)
    for placed in blocks(text, longest + int(TOLERANCE * longest)):
        words = [w for _, w in placed]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        at_parts = {t.name: found_at for t in templates if (found_at := seeds(t.words, t.most, words, places))}
        free: list[str | None] = list(words)
        for reduction, t in rank(words, [t for t in templates if t.name in at_parts], alone) if at_parts else ():
            most = t.most
            for at, end, begin in at_parts[t.name]:
                # A copy around this part lies within the template's length and tolerance.
                while all(free[at:end]):
                    low = max(begin - most, 0)
                    missing, extra, first, last = differences(t.words, free[low : begin + len(t.words) + most])
                    if missing + extra > most or not all(free[low + first : low + last + 1]):
                        break
                    a, b = low + first, low + last
                    free[a : b + 1] = [None] * (b - a + 1)
                    found.append((t.name.split("/")[0], placed[a][0], placed[b][0], reduction, missing, extra, wording(t.words, words[a : b + 1])))
    return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Licences of each whole text.

    One row per row of ``docs``: doc_id, n_blocks (candidates), n_licences, licences (names in
    order of place, comma-joined), spans (name:first line:last line:missing:extra, joined
    likewise), differences (the wording: -word is missing, +word stands instead or besides;
    of licences with any), reduction (the largest, null without any). A null or empty text has none.
    Null or repeated ids stay. Only doc_id and text are read.
    """
    bound_batches(docs.sparkSession)
    items = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, alone = _compressors(items)
        for batch in batches:
            for run in runs(batch.column(1)):
                part = batch.slice(run.first, run.last - run.first)
                out = []
                for text in part.column(1).to_pylist():
                    has = bool(text) and TRIGGER.search(text) is not None
                    found = scan_text(text, known, alone) if has else []
                    out.append((n_blocks(text) if has else 0, len(found), ",".join(f[0] for f in found), ",".join(":".join(map(str, (*f[:3], *f[4:6]))) for f in found), "; ".join(f"{f[0]}: {f[6]}" for f in found if f[6]), max((f[3] for f in found), default=None)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_blocks", "n_licences", "licences", "spans", "differences", "reduction"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n_blocks long, n_licences long, licences string, spans string, differences string, reduction double")
