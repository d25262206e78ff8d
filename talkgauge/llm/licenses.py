"""License notices in texts, by how much each template helps to compress the blocks where it may stand.

A template may stand where at least ``MATCH`` of its words stand in order, with at most ``EXTRA`` as many words
between them.  Such a place cannot miss all of any n - MATCH n + 1 of the template's words, so these, the rarest of
them, are the words it is looked for by.  Around each of them blocks are cut from the text's words, over any line
breaks and comment signs: twice as long as templates of this size reach, one every such reach, so that each place
lies whole in a block.  Every block is compressed with zstandard alone and with every template of its size as raw
dictionary.  The bytes saved rank block and template, and in this order templates are confirmed and get their
places, with the exact differences of wording; on equal bytes the greater share of words goes first, then the
earlier place, then the first name.  Spans of notices do not overlap.

Templates of one size are those whose numbers of words have equally many binary digits.

Defined results: null and empty texts have no notices; a null key stays null; repeated rows are answered one by one;
other columns take no part, whatever they are called, and a key named as a result column gets "_" appended; an empty table gives an empty one; a template that saves nothing
is confirmed last, not left out; a template without words raises an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from talkgauge.llm.frames import fresh
from talkgauge.llm.text import batches

#: Beginnings of words that are rare outside notices; they are looked for before other long words.
RARE = re.compile(r"(sub)?licen[sc]|copyright|reserved|warrant|redistribut|permission|merchantab|affero|mozilla|apache|eclipse|unencumbered|gnu")
MATCH, EXTRA = 0.85, 0.25
_BATCH = 4 << 20

#: The wording of notices, by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-2-Clause-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "BSD-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work "
        "worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "MIT-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "reserved": "All rights reserved.",
}

_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
def word_spans(text: str) -> np.ndarray:
    """Start and end of each word, a row each."""
    return np.fromiter((x for m in _WORD.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)


class Template:
    """A wording, what it is looked for by and its dictionary."""

    def __init__(self, name: str, wording: str):
        self.name, self.words = name, _words(wording)
        n = len(self.words)
        if not n:
            raise ValueError(f"template {name} has no words")
        self.need, self.most = math.ceil(MATCH * n), int(EXTRA * n)
        self.size = n.bit_length()
        kinds = sorted(set(self.words), key=lambda w: (RARE.match(w) is None, -len(w), w))
        covered = np.cumsum([self.words.count(w) for w in kinds])
        #: Words of which every place holds one: n - need + 1 or more stand in the template.
        self.cues = kinds[: int(np.searchsorted(covered, n - self.need + 1)) + 1]
        raw = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=raw)


class Scanner:
    """Templates prepared for many texts."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.plain = zstandard.ZstdCompressor(level=9)
        self.templates = [Template(name, wording) for name, wording in sorted(templates.items())]
        self.sizes: dict[int, list[Template]] = {}
        self.cued: dict[str, list[Template]] = {}
        for t in self.templates:
            self.sizes.setdefault(t.size, []).append(t)
            for word in t.cues:
                self.cued.setdefault(word, []).append(t)
        #: Words that a place of templates of one size covers at most.
        self.reach = {size: max(len(t.words) + t.most for t in group) for size, group in self.sizes.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in self.cued:
            self.automaton.add_word(word)
        if self.cued:
            self.automaton.make_automaton()

    def reductions(self, block: str, templates: list[Template]) -> dict[str, tuple[int, float]]:
        """Bytes that each template saves of the compressed block, and their share of it."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        saved = {t.name: alone - len(t.compressor.compress(data)) for t in templates}
        return {name: (n, n / alone) for name, n in saved.items()}

    def ranked(self, text: str) -> list[tuple[int, str]]:
        """All templates by the bytes they save of a text."""
        saved = self.reductions(" ".join(_words(text)), self.templates)
        return sorted(((n, name) for name, (n, _) in saved.items()), key=lambda r: (-r[0], r[1]))

    def scan(self, text: str) -> list[dict]:
        """Confirmed notices: span, template, share saved, share of its words found and the differing words."""
        if not self.cued or next(self.automaton.iter(text.lower()), None) is None:
            return []
        spans = word_spans(text)
        words = [text[a:b].lower() for a, b in spans.tolist()]
        cues: dict[str, list[int]] = {}
        for p, word in enumerate(words):
            for t in self.cued.get(word, ()):
                cues.setdefault(t.name, []).append(p)
        saved: dict[tuple[int, int], dict[str, tuple[int, float]]] = {}
        open_places: dict[str, list[tuple[int, int, int]]] = {}
        for t in self.templates:
            at, step = cues.get(t.name, []), self.reach[t.size]
            for number in sorted({k for p in at for k in (max(0, p - step + 1) // step, p // step)}):
                if (t.size, number) not in saved:
                    block = " ".join(words[number * step : (number + 2) * step])
                    saved[t.size, number] = self.reductions(block, self.sizes[t.size])
            open_places[t.name] = [(low + a, low + b, n) for low, high in _around(at, len(t.words) + t.most, len(words)) for a, b, n in _places(t.words, words[low:high])]
            open_places[t.name].sort(key=lambda p: (-p[2], p[1] - p[0], p[0]))
        found: list[dict] = []
        taken = bytearray(len(words))
        while True:
            hits = []
            for t in self.templates:
                step = self.reach[t.size]
                for begin, end, count in _apart(open_places[t.name], taken):
                    number = begin // step
                    block = max(saved[t.size, k][t.name] for k in (number, number - 1) if (t.size, k) in saved and end <= (k + 2) * step)
                    hits.append((begin, end, count, t, block))
            if not hits:
                break
            for rivals in _meeting(sorted(hits, key=lambda h: h[:2])):
                ranked = []
                for begin, end, count, t, (bytes_saved, share) in rivals:
                    own = self.reductions(" ".join(words[begin:end]), [t])[t.name][0] if len(rivals) > 1 else bytes_saved
                    ranked.append((-own, -count / len(t.words), -bytes_saved, begin, t.name, end, share, t))
                for _, matched, _, begin, name, end, share, t in sorted(ranked, key=lambda r: r[:5]):
                    if taken.find(1, begin, end) < 0:
                        taken[begin:end] = bytes([1]) * (end - begin)
                        missing, added = _difference(t.words, words[begin:end])
                        found.append({"start": int(spans[begin, 0]), "end": int(spans[end - 1, 1]), "template": name, "gain": share, "matched": -matched, "missing": missing, "added": added})
            # a template whose place went to another one may still fit beside it
            open_places = {name: [p for p in places if taken.find(1, p[0], p[1]) < 0] for name, places in open_places.items()}
        return sorted(found, key=lambda f: (f["start"], f["template"]))


def _around(at: list[int], reach: int, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of words within reach of positions in order, joined where they overlap."""
    low = high = -1
    for p in at:
        a, b = max(0, p - reach + 1), min(n, p + reach)
        if high < 0:
            low = a
        elif a >= high:
            yield low, high
            low = a
        high = b
    if high >= 0:
        yield low, high


def _apart(places: list[tuple[int, int, int]], taken: bytearray) -> Iterator[tuple[int, int, int]]:
    """Of places, best first, those that overlap neither a better one nor what is taken."""
    used = bytearray(taken) if places else taken
    for begin, end, count in places:
        if used.find(1, begin, end) < 0:
            used[begin:end] = bytes([1]) * (end - begin)
            yield begin, end, count


def _meeting(hits: list[tuple]) -> Iterator[list[tuple]]:
    """Groups of hits, sorted by begin, that overlap one another."""
    group, reach = [hits[0]], hits[0][1]
    for hit in hits[1:]:
        if hit[0] >= reach:
            yield group
            group = []
        group.append(hit)
        reach = max(reach, hit[1])
    yield group


def _words(text: str) -> list[str]:
    return [m.group().lower() for m in _WORD.finditer(text)]


def _places(wording: list[str], words: list[str]) -> list[tuple[int, int, int]]:
    """Every range of words in which enough of a template's stand in order, few others between: begin, end, how many; best first.

    Longest common subsequences from each begin on; the clear bits of ``row`` are their length (Hyyrö 2004).
    """
    n = len(wording)
    need, most = math.ceil(MATCH * n), int(EXTRA * n)
    bits = dict.fromkeys(wording, 0)
    for k, word in enumerate(wording):
        bits[word] |= 1 << k
    own = [bits.get(w, 0) for w in words]
    held = np.concatenate(([0], np.cumsum(np.array([x > 0 for x in own], dtype=np.int64))))
    begins = np.flatnonzero(np.diff(held))
    begins = begins[held[np.minimum(begins + n + most, len(words))] - held[begins] >= need]
    out, full = [], (1 << n) - 1
    for begin in begins.tolist():
        row, best = full, need - 1
        for end in range(begin + 1, min(len(words), begin + n + most) + 1):
            both = row & own[end - 1]
            row = (row + both | row - both) & full
            count = n - row.bit_count()
            if end - begin - count > most:  # it never falls again
                break
            if count > best:
                best = count
                out.append((begin, end, count))
    return sorted(out, key=lambda p: (-p[2], p[1] - p[0], p[0]))


def _difference(wording: list[str], words: list[str]) -> tuple[list[str], list[str]]:
    """Words of a template that are missing, and words added, beside the longest common subsequence."""
    bits: dict[str, int] = {}
    for k, word in enumerate(wording):
        bits[word] = bits.get(word, 0) | 1 << k
    rows = [(1 << len(wording)) - 1]
    for word in words:
        both = rows[-1] & bits.get(word, 0)
        rows.append((rows[-1] + both | rows[-1] - both) & rows[0])
    i, j, missing, added = len(words), len(wording), [], []

    def common(i: int, j: int) -> int:
        return j - (rows[i] & (1 << j) - 1).bit_count()

    while i or j:
        if j and common(i, j) == common(i, j - 1):
            j -= 1
            missing.append(wording[j])
        elif i and common(i, j) == common(i - 1, j):
            i -= 1
            added.append(words[i])
        else:
            i, j = i - 1, j - 1
    return missing[::-1], added[::-1]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per confirmed notice: the key, start and end in characters, template, gain, matched, missing and added words."""
    named = {"start": T.LongType(), "end": T.LongType(), "template": T.StringType(), "gain": T.DoubleType(), "matched": T.DoubleType(), "missing": T.ArrayType(T.StringType()), "added": T.ArrayType(T.StringType())}
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(name, kind) for name, kind in named.items()]])
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")

    def run(arrivals):
        scanner = Scanner(templates)
        for part in batches(arrivals, "text", _BATCH):
            hits = [scanner.scan(t) for t in part["text"].to_pylist()]
            at = [i for i, h in enumerate(hits) for _ in h]
            flat = [f for h in hits for f in h]
            columns = {"key": part["key"].combine_chunks().take(pa.array(at, pa.int64()))}
            for name, kind in named.items():
                columns[name] = pa.array([f[name] for f in flat], to_arrow_type(kind))
            yield from pa.table(columns).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema).withColumnRenamed("key", *fresh(list(named), key))
