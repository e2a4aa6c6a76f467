"""License scans by conditional compression.

Lines with a word that licenses use, those between trigger lines close to each other, and as many words on both sides as
the longest template has are a candidate block; blocks longer than a window are cut into windows that overlap by more
than the longest template, so that each notice stands whole in one of them. A window is compressed alone and with each
template as a zstandard raw dictionary; the templates are ranked by the bytes that they save.

Every template that saves any is held against the exact wording: all of its words are aligned with a stretch of the
window, and the differences are the words inserted and deleted. Too many differences, a distinctive word that is
missing, or a difference in a word that tells variants apart ("lesser", "nc", a version number) refuse it. The
confirmed template that explains most words wins, ties by rank; its words are taken out, the rest is compressed again,
and so on until nothing is confirmed. So notices that stand together are each found by their own words.

Defined cases: a null or empty text has no blocks; repeated rows get a row each; a very long text is scanned whole;
templates that explain equally many words go by saved bytes, then by their place in the list; a license found in two
windows is reported once, with its fewest differences; an empty table gives an empty result; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, read_table

#: Beginnings of words that stand in license notices.
TRIGGERS = (b"licen", b"copyright", b"warrant", b"permission", b"redistribut", b"cc by", b"cc-by", b"cc0", b"spdx", b"creative commons", b"public domain")
GAP = 3
#: The share of a template's words that must stand in order, and insertions at most as a share of its words.
LEAST_WORDING = 0.9
MOST_INSERTED = 0.25


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    distinctive: tuple[str, ...]


#: Public license notices, by SPDX identifier, with the words that tell them apart.
NOTICES = (
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("MIT", "This project is licensed under the MIT License, see the LICENSE file for details.", ("mit",)),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("sublicense", "merge"),
    ),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2", "0")),
    Template(
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("apache", "2", "0"),
    ),
    Template(
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("general", "public", "3", "later"),
    ),
    Template(
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ("general", "public", "2", "later"),
    ),
    Template(
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("affero", "3", "later"),
    ),
    Template(
        "LGPL-3.0-or-later",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("lesser", "3", "later"),
    ),
    Template("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.", ("lesser", "3")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2")),
    Template(
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistribution", "retain", "reproduce"),
    ),
    Template(
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("redistribution", "retain", "reproduce", "neither", "endorse"),
    ),
    Template(
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("redistribution", "neither", "endorse"),
    ),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("fee", "appear")),
    Template("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ("fee",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "nc", "4")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "sa", "4")),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("attribution", "4", "international")),
    Template("CC0-1.0", "This work is released under CC0 1.0 Universal, dedicated to the public domain.", ("cc0",)),
)

#: Names of licenses, in notices that say no more than "licensed under the ..." or give the identifier.
NAMES = {
    "MIT": "MIT License",
    "Apache-2.0": "Apache License 2.0",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-2.0-or-later": "GNU General Public License, version 2 or later",
    "GPL-3.0": "GNU General Public License, version 3",
    "GPL-3.0-or-later": "GNU General Public License, version 3 or later",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License 1.0",
}
#: Words whose insertion or deletion makes another license of a notice.
VARIANTS = frozenset("affero lesser nc nd sa noncommercial noderivatives sharealike later only not 0 1 2 3 4 5".split())

_WORD = re.compile(r"[0-9a-z]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _named(license: str, name: str) -> Iterator[Template]:
    own = tuple(w for w in words_of(name) if w not in ("gnu", "license", "version", "or", "public", "general"))
    for text in (f"This work is licensed under the {name}.", f"Licensed under the {name}.", f"Released under the {name}."):
        yield Template(license, text, own)
    yield Template(license, f"SPDX-License-Identifier: {license}", ("spdx", *words_of(license)))


TEMPLATES = NOTICES + tuple(t for license, name in NAMES.items() for t in _named(license, name))

#: Words of the longest template, and of a window: a notice that is not cut by one stands whole in the next.
LONGEST = max(len(words_of(t.text)) for t in TEMPLATES)
WINDOW = 3 * LONGEST
STEP = WINDOW - int(LONGEST * (1 + MOST_INSERTED)) - 1


def blocks_of(text: str) -> list[list[str]]:
    """The words of each candidate block: trigger lines and what is between or around them."""
    lines = text.lower().split("\n")
    at = [i for i, line in enumerate(lines) if any(t in line.encode() for t in TRIGGERS)]
    groups: list[list[int]] = []
    for i in at:
        if groups and i - groups[-1][1] <= GAP:
            groups[-1][1] = i
        else:
            groups.append([i, i])
    out = []
    for first, last in groups:
        before: list[str] = []
        for k in range(first - 1, -1, -1):
            if len(before) >= LONGEST:
                break
            before = words_of(lines[k]) + before
        after: list[str] = []
        for k in range(last + 1, len(lines)):
            if len(after) >= LONGEST:
                break
            after += words_of(lines[k])
        own = [w for line in lines[first : last + 1] for w in words_of(line)]
        out.append(before[max(0, len(before) - LONGEST) :] + own + after[:LONGEST])
    return out


def windows_of(block: list[str]) -> list[list[str]]:
    return [block[a : a + WINDOW] for a in range(0, max(1, len(block) - (WINDOW - STEP)), STEP)]


def aligned(template: np.ndarray, window: np.ndarray) -> list[tuple[int, int]] | None:
    """Pairs (place in the template, place in the window) of the best alignment of the whole template.

    A matched word counts 1, a deleted or inserted one -1; words of number -1 in the window are taken and can't be
    crossed. None if nothing matches.
    """
    m, n = len(template), len(window)
    cost = np.concatenate([[0], np.cumsum(np.where(window < 0, 4 * m, 1))])
    best = np.zeros((m + 1, n + 1), dtype=np.int64)
    for i in range(1, m + 1):
        row = best[i - 1] - 1
        row[1:] = np.maximum(row[1:], np.where(window == template[i - 1], best[i - 1, :-1] + 1, row[1:]))
        best[i] = np.maximum.accumulate(row + cost) - cost if i < m else row
    j = int(np.argmax(best[m]))
    out, i = [], m
    while i > 0:
        if j > 0 and window[j - 1] == template[i - 1] and best[i, j] == best[i - 1, j - 1] + 1:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return out[::-1] or None


@dataclass(frozen=True)
class Found:
    license: str
    saved: float  # the bytes saved, as a share of the template's own
    wording: float  # the share of the template's words that stand in order
    inserted: tuple[str, ...]
    deleted: tuple[str, ...]


class Scanner:
    def __init__(self, templates: tuple[Template, ...] = TEMPLATES) -> None:
        import zstandard

        self.templates = templates
        self.alone = zstandard.ZstdCompressor(level=9)
        self.words = [words_of(t.text) for t in templates]
        self.given, self.sizes = [], []
        for words in self.words:
            text = " ".join(words).encode()
            raw = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(level=9, dict_data=raw))
            self.sizes.append(len(self.alone.compress(text)))
        self.needs = [frozenset(t.distinctive) for t in templates]
        self.numbers: dict[str, int] = {}
        self.coded = [np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words]) for words in self.words]

    def ranked(self, words: list[str]) -> list[tuple[int, int]]:
        """(saved bytes, template) of the templates that save any of the words' compressed bytes, most first."""
        raw = " ".join(words).encode()
        size = len(self.alone.compress(raw))
        saved = [(size - len(c.compress(raw)), k) for k, c in enumerate(self.given)]
        return sorted(((s, k) for s, k in saved if s > 0), key=lambda x: (-x[0], x[1]))

    def confirmed(self, words: list[str | None], k: int, saved: int) -> tuple[int, list[int], Found] | None:
        """Words explained less differences, the places taken, and the differences; None if the wording is another."""
        mine = self.words[k]
        there = set(words)
        if not self.needs[k] <= there or sum(w in there for w in mine) < LEAST_WORDING * len(mine):
            return None
        taken = len(self.numbers)  # any other word
        pairs = aligned(self.coded[k], np.array([-1 if w is None else self.numbers.get(w, taken) for w in words]))
        if pairs is None or len(pairs) < LEAST_WORDING * len(mine):
            return None
        kept, spots = {i for i, _ in pairs}, [j for _, j in pairs]
        deleted = [w for i, w in enumerate(mine) if i not in kept]
        chosen = set(spots)
        inserted = [words[j] for j in range(spots[0], spots[-1]) if j not in chosen]
        if None in inserted or len(inserted) > max(1, MOST_INSERTED * len(mine)) or not VARIANTS.isdisjoint(deleted + inserted) or not self.needs[k] <= {mine[i] for i in kept}:
            return None
        found = Found(self.templates[k].license, saved / self.sizes[k], len(pairs) / len(mine), tuple(inserted), tuple(deleted))
        return len(pairs) - len(inserted) - len(deleted), spots, found

    def licenses(self, window: list[str]) -> list[Found]:
        """The confirmed licenses of a window, those that explain most words first."""
        words: list[str | None] = [*window]
        out = []
        while ranks := self.ranked([w for w in words if w is not None]):
            best = None
            for saved, k in ranks:
                if (now := self.confirmed(words, k, saved)) and (best is None or now[0] > best[0]):
                    best = now
            if best is None:
                break
            for j in best[1]:
                words[j] = None
            out.append(best[2])
        return out

    def scan(self, text: str) -> tuple[int, list[Found]]:
        """The number of candidate blocks, and each license once, by identifier."""
        blocks = blocks_of(text)
        found: dict[str, Found] = {}
        for one in (f for b in blocks for w in windows_of(b) for f in self.licenses(w)):
            old = found.get(one.license)
            if old is None or (len(one.inserted) + len(one.deleted), -one.saved) < (len(old.inserted) + len(old.deleted), -old.saved):
                found[one.license] = one
        return len(blocks), [found[k] for k in sorted(found)]


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("saved", pa.float64()), ("wording", pa.float64()), ("inserted", pa.list_(pa.string())), ("deleted", pa.list_(pa.string()))]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks (candidate blocks) and found of each row: an array of license (SPDX identifier), saved (share of
    the template's bytes), wording (share of its words), inserted and deleted (words), rising by license."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_worker("licenses", "", Scanner)
        for batch in batches:
            blocks, found = [], []
            for text in batch.column(1):
                raw = text.as_buffer()
                low = bytes(raw).lower() if raw is not None else b""
                n, mine = scanner.scan(low.decode()) if any(t in low for t in TRIGGERS) else (0, [])
                blocks.append(n)
                found.append([{"license": f.license, "saved": f.saved, "wording": f.wording, "inserted": list(f.inserted), "deleted": list(f.deleted)} for f in mine])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.int64()), pa.array(found, _FOUND)], ["doc_id", "n_blocks", "found"])

    kinds = "array<struct<license:string,saved:double,wording:double,inserted:array<string>,deleted:array<string>>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_blocks long, found {kinds}")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_blocks, n_licenses, licenses (comma-joined), the largest saving, and how many words of the
    confirmed notices are inserted and deleted."""
    found = scan(read_table(spark, sf_dir, "documents"))
    total = lambda part: F.aggregate("found", F.lit(0), lambda n, f: n + F.size(f[part])).cast("long")
    saved = F.round(F.coalesce(F.array_max(F.transform("found", lambda f: f["saved"])), F.lit(0.0)), 4)
    return found.select(
        "doc_id",
        "n_blocks",
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.transform("found", lambda f: f["license"]), ",").alias("licenses"),
        saved.alias("saved"),
        total("inserted").alias("n_inserted"),
        total("deleted").alias("n_deleted"),
    )
