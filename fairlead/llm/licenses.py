"""License scan: candidate blocks, compression against templates, exact wording differences."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import written

# Usual names and notices of public licenses, whole texts of the short ones. The words named first tell
# the license from its kin: those that a wording has may not be missing where it holds.
TEMPLATES = {
    "Apache-2.0": ("apache 2.0", (
        "Apache License, Version 2.0", "Apache-2.0", "Apache License 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")),
    "MIT": ("mit", ("MIT License", "MIT licensed", "the MIT license terms")),
    "MIT-text": ("permission granted free charge merge sublicense", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE")),
    "BSD-2-Clause": ("bsd 2", ("BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License (2 clause)")),
    "BSD-3-Clause": ("bsd 3", ("BSD 3-Clause License", "BSD-3-Clause", "New BSD License (3 clause)")),
    "BSD-text": ("redistribution source binary forms permitted", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",)),
    "GPL-2.0": ("gnu general public 2", (
        "GNU General Public License, version 2", "GPL-2.0", "GPL version 2",
        "GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version")),
    "GPL-3.0": ("gnu general public 3", (
        "GNU General Public License, version 3", "GPL-3.0", "GPL version 3",
        "GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version")),
    "LGPL-2.1": ("gnu lesser general public 2.1", (
        "GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPL version 2.1")),
    "LGPL-3.0": ("gnu lesser general public 3", (
        "GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPL version 3")),
    "AGPL-3.0": ("gnu affero general public 3", (
        "GNU Affero General Public License, version 3", "AGPL-3.0", "AGPL version 3")),
    "MPL-2.0": ("mozilla 2.0", (
        "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0")),
    "ISC": ("isc", ("ISC License",)),
    "ISC-text": ("permission distribute fee granted notice", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",)),
    "Unlicense": ("unencumbered public domain", (
        "This is free and unencumbered software released into the public domain",)),
    "CC-BY-4.0": ("by 4.0", (
        "CC BY 4.0", "Creative Commons Attribution (BY) 4.0 International License", "Creative Commons Attribution 4.0 International")),
    "CC-BY-SA-4.0": ("by sa sharealike 4.0", (
        "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike (BY-SA) 4.0 International License",
        "Creative Commons Attribution-ShareAlike 4.0 International")),
    "CC-BY-NC-4.0": ("by nc noncommercial 4.0", (
        "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial (BY-NC) 4.0 International License",
        "Creative Commons Attribution-NonCommercial 4.0 International")),
    "CC-BY-NC-SA-4.0": ("by nc sa 4.0", ("CC BY-NC-SA 4.0",)),
    "CC-BY-ND-4.0": ("by nd 4.0", ("CC BY-ND 4.0",)),
    "CC0-1.0": ("cc0 1.0", ("CC0 1.0 Universal", "CC0-1.0")),
}
CUES = (r"licen[cs]|copyright|spdx|creative commons|\bcc0\b|\bcc[ -]by\b|public domain|hereby granted|without warranty|redistribution and use"
        r"|apache-2|\bbsd-[23]|\b[al]?gpl|\bmpl-2")
AROUND, GAP, COVER = 600, 200, 0.8
# A wording of up to this many words holds word for word only.
SHORT = 4
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
VERSION = re.compile(r"([a-z]*?)v?([0-9]+(?:\.[0-9]+)*)")
IDENTIFIER = re.compile(r"spdx-license-identifier:([^\n]*)", re.IGNORECASE)
# Words that make another license of the same name.
KIN = {"lesser", "affero", "sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives"}
_cue = re.compile(CUES, re.IGNORECASE)
_edge = re.compile(r"\n|(?<!\bv)[.!?](?=\s)")


def blocks(text: str) -> list[tuple[int, int]]:
    """(from, to) of stretches around license cues: whole sentences or lines, joined where they are close."""
    out: list[tuple[int, int]] = []
    for cue in _cue.finditer(text):
        a, b = max(0, cue.start() - AROUND), min(len(text), cue.end() + AROUND)
        if out and cue.end() <= out[-1][1]:
            continue
        for edge in _edge.finditer(text, a, cue.start()):
            a = edge.end()
        after = _edge.search(text, cue.end(), b)
        b = after.end() if after else b
        if out and a - out[-1][1] <= GAP:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def words(text: str) -> list[str]:
    """Lower-case words; versions are numbers of their own without a trailing .0 (GPLv3, v3.0 and 3 end alike)."""
    out = []
    for word in WORD.findall(text.lower()):
        found = VERSION.fullmatch(word)
        if not found or found[1] == "cc":  # CC0 is a name
            out.append(word)
            continue
        if found[1]:
            out.append(found[1])
        number = found[2]
        while number.endswith(".0"):
            number = number[:-2]
        out.append(number)
    return out


_templates: list[tuple] = []


def _compiled() -> list[tuple]:
    """(name, [(wording, telling words)] longest first, compressor) of every template."""
    if not _templates:
        for name, (must, wordings) in TEMPLATES.items():
            content = zstandard.ZstdCompressionDict(
                "\n".join(wordings).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            listed = sorted(map(words, wordings), key=len, reverse=True)
            _templates.append((name, [(w, set(words(must)) & set(w)) for w in listed],
                               zstandard.ZstdCompressor(level=6, dict_data=content)))
    return _templates


def common_places(wording: list[str], stretch: list[str | None]) -> list[tuple[int, int]]:
    """(place in wording, place in stretch) of a longest common subsequence."""
    n, m = len(wording), len(stretch)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        word, row, below = wording[i], best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if stretch[j] == word else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if wording[i] == stretch[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _held(wording: list[str], must: set[str], have: list[str | None]) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """(from, to, missing, added) of the places where a wording holds; words that are None belong to other wordings.

    A place lies around an occurrence of the wording's rarest telling word: the whole wording fits
    before and after it with a quarter more words. Places do not overlap.
    """
    met = Counter(have)
    if not must <= met.keys():
        return
    n, free, need = len(wording), 0, Counter(wording)
    anchor = min(sorted(must), key=lambda w: met[w])
    before, after = n - 1 - wording[::-1].index(anchor), n - wording.index(anchor)
    for at in [i for i, w in enumerate(have) if w == anchor]:
        if at < free:
            continue
        if n <= SHORT:
            a = next((a for a in (at - i for i, w in enumerate(wording) if w == anchor)
                      if a >= free and have[a:a + n] == wording), None)
            if a is not None:
                free = a + n
                yield a, a + n, [], []
            continue
        a, b = max(free, at - before - before // 4 - SHORT), at + after + after // 4 + SHORT
        stretch = have[a:b]
        if sum((Counter(stretch) & need).values()) < COVER * n:
            continue
        same = common_places(wording, stretch)
        if len(same) < COVER * n:
            continue
        first, last = same[0][1], same[-1][1]
        places, kept = {j for _, j in same}, {i for i, _ in same}
        inside = [w for j, w in enumerate(stretch[first:last + 1], first) if j not in places]
        missing = [w for i, w in enumerate(wording) if i not in kept]
        if must - {wording[i] for i in kept} or None in inside or (KIN - set(wording)) & set(inside):
            continue
        free = a + last + 1
        yield a + first, free, missing, inside


def classify(block: str) -> list[dict]:
    """All licenses of a block, one per place where a wording holds, in the order of the text.

    Templates are ranked by how much smaller they make the block as a dictionary; a place belongs to the
    first in rank whose wording holds there. A wording holds where nearly all its words stand in order,
    none of its telling words is missing and no word of a kindred license stands among them; short ones
    hold word for word. Identifiers after ``SPDX-License-Identifier`` that name a template hold too. Gives the words missing and
    added at the place. A block in which nothing holds gives one entry without a license.
    """
    raw, have = block.lower().encode(), words(block)
    plain = len(zstandard.ZstdCompressor(level=6).compress(raw))
    ranked = sorted(((plain - len(c.compress(raw)), name, wordings) for name, wordings, c in _compiled()),
                    key=lambda r: (-r[0], r[1]))
    out, saving = [], {name: saved for saved, name, _ in ranked}

    def found(place, name, missing, added):
        out.append({"license": name.removesuffix("-text"), "place": place, "reduction": saving[name],
                    "share": saving[name] / plain, "missing": missing, "added": added})

    for line in IDENTIFIER.finditer(block):
        before = len(words(block[:line.start(1)]))
        size = len(words(line[1]))
        names = {name.lower(): name for name in TEMPLATES if not name.endswith("-text")}
        for part in re.finditer(r"[A-Za-z0-9.+-]+", line[1]):
            name = names.get(re.sub(r"(\+|-only|-or-later)$", "", part[0].lower()))
            if name:
                found(before + len(words(line[1][:part.start()])), name, [], [])
        have[before:before + size] = [None] * size
    for _, name, wordings in ranked:
        for wording, must in wordings:
            for a, b, missing, added in _held(wording, must, list(have)):
                found(a, name, missing, added)
                have[a:b] = [None] * (b - a)
    if not out:
        out.append({"license": None, "place": None, "reduction": ranked[0][0], "share": ranked[0][0] / plain,
                    "missing": None, "added": None})
    return sorted(out, key=lambda r: r["place"] or 0)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per license of a candidate block: doc_id, block (number in its text), start, length (characters), text,
    license, place (words of the block before it), reduction (bytes its template saves), share, missing, added (words
    against the wording).

    A license that stands at several places of a block has a row for each. A block in which no template's
    wording holds has one row, whose ``license`` and ``place`` are null; texts without a cue give no row. Whole texts
    are read. Equal blocks are compared once, however many documents hold them. Null and empty texts
    and an empty table give no row; null ids and repeated rows keep their rows; other columns are left out.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for n, (a, b) in enumerate(blocks(text)):
                    part = text[a:b].strip()
                    key = hashlib.md5(part.encode(), usedforsecurity=False).digest()
                    for column, value in zip(rows, (doc, n, a, b - a, part, key)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)],
                                             names=["doc_id", "block", "start", "length", "text", "key"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, f) for key, text in zip(batch.column(0).to_pylist(), batch.column(1)) for f in classify(text.as_py())]
            kinds = {"license": pa.string(), "place": pa.int32(), "reduction": pa.int32(), "share": pa.float64(),
                     "missing": pa.list_(pa.string()), "added": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays(
                [pa.array([key for key, _ in found], pa.binary()), *(pa.array([f[k] for _, f in found], t) for k, t in kinds.items())],
                names=["key", *kinds])

    cued = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(f"(?i){CUES}"))
    rows = written(cued.mapInArrow(
        cut, "doc_id long, block int, start long, length long, text string, key binary"), "blocks")
    known = rows.groupBy("key").agg(F.min("text").alias("text")).mapInArrow(
        judge, "key binary, license string, place int, reduction int, share double, missing array<string>, added array<string>")
    return rows.join(known, "key").select(*rows.columns[:-1], "license", "place", "reduction", "share", "missing", "added")
